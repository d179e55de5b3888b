"""Small hand-written graphs with known results."""

from __future__ import annotations

import numpy as np

from factweave.schemas import NODE

FIELDS = [f.name for f in NODE.fields]


def node_frame(spark, rows):
    """Rows are dicts; ``input_pos`` defaults to the position in the list."""
    data = [tuple({"input_pos": i, **r}.get(f) for f in FIELDS) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, NODE)


def vector_frame(spark, vectors: dict):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "id string, vec array<float>")


def edge_set(df, *columns, digits=3):
    out = set()
    for r in df.select(*columns).collect():
        out.add(tuple(round(v, digits) if isinstance(v, float) else v for v in r))
    return out


def unit(values):
    v = np.asarray(values, dtype=float)
    return v / np.linalg.norm(v)


def random_vectors(ids, dim=768, seed=7):
    rng = np.random.default_rng(seed)
    return {i: unit(rng.standard_normal(dim)) for i in ids}
