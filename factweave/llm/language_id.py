"""Language identification in two steps: family first, then a linear SVM for each pair of languages within it.

A text becomes hashed counts of its lower-case byte bigrams and trigrams, square-rooted and scaled to length
one; whole texts are read. The models are fitted on the driver on at most ``SAMPLE`` labelled documents of each
language (those with the smallest hash), and go to the tasks as a small weight matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.shared import stored

SAMPLE = 400
#: Labels that are learned: the most frequent ones. 64 of them are at most 400 MB of vectors in the driver.
LANGUAGES = 64
SPARE = 4
DIMENSIONS = 4096
UNKNOWN = "und"
#: A document is rejected by the filter below this score.
MIN_SCORE = 0.3
FOLDS, HELD_OUT = 5, 0

# Families of closely related languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "da", "sv", "nb", "nn", "no", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "indic": ("hi", "mr", "ne", "bn", "as", "gu", "pa", "or", "ur"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tk", "tt"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt", "am"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"={lang}")


def features(text: str) -> np.ndarray:
    raw = np.frombuffer(f"  {text.lower()}  ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    two = raw[:-1] | raw[1:] << np.uint32(8)
    three = two[:-1] | raw[2:] << np.uint32(16)
    half = DIMENSIONS // 2
    shift = np.uint32(32 - half.bit_length() + 1)
    counts = np.concatenate([np.bincount((x * np.uint32(m)) >> shift, minlength=half) for x, m in ((two, 0x9E3779B1), (three, 0x85EBCA77))])
    vector = np.sqrt(counts.astype(np.float32))
    return vector / np.linalg.norm(vector)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 30, seed: int = 9) -> np.ndarray:
    """Weights of a linear SVM (squared hinge loss), by dual coordinate descent; ``y`` is 1 or -1.

    Both classes weigh the same, however many rows they have.
    """
    rng = np.random.default_rng(seed)
    share = {s: len(y) / (2 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    ridge = np.array([1 / (2 * cost * share[int(s)]) for s in y])
    norms = (x * x).sum(axis=1) + ridge
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1], np.float64)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w @ x[i]) - 1 + ridge[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / norms[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Model:
    """One weight vector per family against the rest, and one per pair of languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        labels = np.array(langs)
        self.langs = sorted(set(langs))
        self.families = sorted({family(v) for v in self.langs})
        self.members = {f: [v for v in self.langs if family(v) == f] for f in self.families}
        own = np.array([family(v) for v in langs])
        weights, self.pairs = [], []
        if len(self.families) > 1:
            weights += [fit_svm(x, np.where(own == f, 1, -1)) for f in self.families]
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                rows = (labels == a) | (labels == b)
                weights.append(fit_svm(x[rows], np.where(labels[rows] == a, 1, -1)))
                self.pairs.append((a, b))
        self.weights = np.array(weights, np.float32).reshape(-1, x.shape[1])

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score: how sure the family is, times how sure the closest contest within it is."""
        margins = x @ self.weights.T
        n = len(self.families) if len(self.families) > 1 else 0
        chosen = margins[:, :n].argmax(axis=1) if n else np.zeros(len(x), int)
        sure = _sure(margins[np.arange(len(x)), chosen]) if n else np.ones(len(x))
        names = np.empty(len(x), object)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            langs = self.members[name]
            votes, least = np.zeros((len(rows), len(langs))), np.full((len(rows), len(langs)), np.inf)
            for k, (a, b) in enumerate(self.pairs):
                if a in langs:
                    m = margins[rows, n + k].astype(np.float64)
                    for lang, signed in ((a, m), (b, -m)):
                        i = langs.index(lang)
                        votes[:, i] += signed > 0
                        least[:, i] = np.minimum(least[:, i], signed)
            best = (votes + 1e-3 * np.tanh(np.where(np.isinf(least), 0, least))).argmax(axis=1)
            names[rows] = np.array(langs, object)[best]
            if len(langs) > 1:
                sure[rows] *= _sure(least[np.arange(len(rows)), best])
        return names.tolist(), sure


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * margin.astype(np.float64)))


def fold(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, key: str = "doc_id", per_language: int = SAMPLE) -> Model | None:
    """Learns from the text and the label of documents outside the held-out fold; None where there are none.

    A null key is in no fold and not learned from; of rows that repeat a key and a label, one is. The ``LANGUAGES`` most frequent
    labels are learned (ties: the first by name), so that what reaches the driver is bounded however many odd labels there are.
    """
    usable = docs.filter((fold(key) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # The rows with the smallest hashes of each language. Only a share that surely holds them is ranked, a few
    # times as many as are wanted, however many documents the language has.
    place = F.shiftrightunsigned(F.xxhash64(F.lit(17), key), 11) / F.lit(2.0**53)
    counts = stored(docs.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES), "language-counts")
    early = usable.select(key, "lang", place.alias("place")).join(counts, "lang").filter(F.col("place") * F.col("n") <= SPARE * per_language).drop("n").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", key))
    ranked = early.withColumn("rank", rank).filter(F.col("rank") <= per_language)
    # Written, so that Spark knows how small it is and needn't shuffle the texts.
    drawn = stored(ranked.select(key, F.col("lang").alias("__lang")), "language-sample")
    texts = docs.select(key, "text").join(drawn, key).filter("text is not null").dropDuplicates([key, "__lang"]).select("__lang", "text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column("__lang"), pa.array([features(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())], names=["lang", "vector"])

    # At most ``per_language`` rows a language, of a fixed size.
    rows = texts.mapInArrow(run, "lang string, vector binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["vector"])))
    return Model(np.array([np.frombuffer(r["vector"], np.float32) for r in rows]), [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the text alone.

    A text that is null or has no letter, and any text without a model, is ``und`` with score 0. Columns of these
    names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                rows = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if rows:
                    found, sure = model.predict(np.array([features(texts[i]) for i in rows]))
                    for i, name in zip(rows, found):
                        names[i] = name
                    scores[rows] = sure
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores)], names=[*kept, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), "lang_pred string, score double"])
    return docs.select(kept).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; a null id is not held out."""
    held_out = F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held_out, "text"), fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def language_filter(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is told with at least ``min_score``; their columns stay as they are."""
    scored = predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), fit(docs))
    return scored.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
