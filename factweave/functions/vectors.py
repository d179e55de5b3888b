"""Vector math on ARRAY columns, evaluated in the JVM."""

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has zero length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def hashed_text_vector(text: Column, dim: int = 64) -> Column:
    """Deterministic offline embedding: unit-length hashed term counts, in Arrow batches.

    Stands in for a neural model; ``embed_with`` plugs one in.
    """

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for word in re.findall(r"\w+", t.lower()):
                out[i, zlib.crc32(word.encode()) % dim] += 1.0
        return out

    return embed_with(encode)(text)


def embed_with(encode: Callable[[list[str]], np.ndarray], batch: int = 32):
    """A vectorised UDF that embeds text with any batch encoder and scales to unit length."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        rows = []
        values = texts.fillna("").tolist()
        for i in range(0, len(values), batch):
            m = np.asarray(encode(values[i : i + batch]), dtype=np.float64)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            rows.extend((m / np.where(n == 0, 1.0, n)).astype(np.float32))
        return pd.Series(rows)

    return embed
