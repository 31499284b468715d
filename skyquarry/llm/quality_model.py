"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a sparse vector of hashed words and word shapes, each weighed by log(1 + count) and the vector scaled to length
1. One weight vector is shared by all grades; ordered thresholds t_0 < t_1 < ... give P(grade > k) = sigmoid(w x - t_k).
The sums of these are the expected grade; P(grade >= TAIL) decides which documents are kept. The rating of a labelled
document is 0 for low quality, 1 for good but toxic, 2 for good and not toxic. Fitted by AdaGrad to FIT rows at most,
those with the smallest hashes.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, limited_batches, ship, table, words_of, written

ship(__name__)

HELD, HELD_IS = 5, 0
GRADES, TAIL, KEEP = 3, 1, 0.5
BITS, FIT, EPOCHS, BATCH, STEP, RIDGE = 15, 8000, 6, 32, 0.3, 1e-5
_SHAPES = ((re.compile(r"[a-zà-öø-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "0"))


class Hashes(dict):
    """word -> places of the word and of its shape."""

    def __missing__(self, word: str):
        if len(self) > 200_000:
            self.clear()
        shape = word
        for pattern, to in _SHAPES:
            shape = pattern.sub(to, shape)
        mask = (1 << BITS) - 1
        got = self[word] = (zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) & mask, zlib.crc32(b"shape " + shape[:12].encode("utf-8", "surrogatepass")) & mask)
        return got


def vector(text: str | None, seen: Hashes) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(text or "")
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at, n = np.unique(np.array(list(map(seen.__getitem__, words)), np.int32).ravel(), return_counts=True)
    x = np.log1p(n)
    return at, (x / np.sqrt((x * x).sum())).astype(np.float32)


class Ordinal:
    def __init__(self, grades: int = GRADES):
        self.w, self.cuts = np.zeros(1 << BITS), np.linspace(-1, 1, grades - 1)

    def tails(self, at, x) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ...: falling, as the cuts rise."""
        return 1 / (1 + np.exp(-np.clip(self.w[at] @ x - self.cuts, -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 3) -> Ordinal:
        r, gw, gc = np.random.default_rng(seed), np.full(1 << BITS, 1e-6), np.full(len(self.cuts), 1e-6)
        edges = np.arange(len(self.cuts))
        for _ in range(EPOCHS):
            order = r.permutation(len(rows))
            for i in range(0, len(rows), BATCH):
                dc, parts = np.zeros(len(self.cuts)), []
                for j in order[i : i + BATCH]:
                    at, x = rows[j]
                    e = self._slope(self.w[at] @ x, int(y[j]), edges)
                    parts.append((at, x * e.sum()))
                    dc -= e
                at = np.concatenate([p[0] for p in parts])
                places, inverse = np.unique(at, return_inverse=True)
                g = np.bincount(inverse, np.concatenate([p[1] for p in parts])) / BATCH + RIDGE * self.w[places]
                gw[places] += g * g
                self.w[places] -= STEP * g / np.sqrt(gw[places])
                dc /= BATCH
                gc += dc * dc
                self.cuts = np.sort(self.cuts - STEP * dc / np.sqrt(gc))
        return self

    def _slope(self, s: float, y: int, edges: np.ndarray) -> np.ndarray:
        """Of -log P(grade = y) with regard to s - cut, for each cut."""
        p = np.concatenate([[1.0], 1 / (1 + np.exp(-np.clip(s - self.cuts, -30, 30))), [0.0]])
        own = max(p[y] - p[y + 1], 1e-9)
        slope = p[1:-1] * (1 - p[1:-1])
        return (np.where(edges == y, slope, 0) - np.where(edges == y - 1, slope, 0)) / own


def graded(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, kept: one row for each row of docs.

    Texts without words have expected grade 0 and are not kept. Without labels the model knows nothing: P = 1/2. Several
    labels of an id count with their lowest quality and highest toxicity; rows with a null label not at all. Rows with equal
    ids are learned from in the order of their texts. Each row is graded by itself and whole.
    """
    spark = docs.sparkSession
    given = labels.filter("quality is not null and toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    given = given.filter(crc_mod(F.col("doc_id"), HELD) != HELD_IS).select("doc_id", F.when(F.col("q") <= 0, 0).when(F.col("t") > 0, 1).otherwise(2).alias("y"))
    given = written(given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT), "grades-fit")
    rows = limited_batches(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))

    def vectors(text):
        seen = Hashes()
        both = [vector(t, seen) for t in text]
        return pd.DataFrame({"at": [b[0] for b in both], "x": [b[1] for b in both]})

    kind = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))])
    fit = rows.join(F.broadcast(given), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "text").limit(FIT)
    fit = fit.select("y", F.pandas_udf(_typed(vectors), kind)("text").alias("v")).collect()
    known = [(np.array(r["v"]["at"], np.int32), np.array(r["v"]["x"], np.float32)) for r in fit]
    model = Ordinal()
    if fit:
        model.fit(known, np.array([r["y"] for r in fit]))
    sent = spark.sparkContext.broadcast(model)

    def tails(text):
        seen, out = Hashes(), []
        for t in text:
            at, x = vector(t, seen)
            out.append(sent.value.tails(at, x).tolist() if len(at) else [0.0] * (GRADES - 1))
        return pd.Series(out, index=text.index, dtype=object)

    held = F.coalesce(crc_mod(F.col("doc_id"), HELD) == HELD_IS, F.lit(False))
    out = rows.select("doc_id", held.alias("held_out"), F.pandas_udf(_typed(tails), T.ArrayType(T.DoubleType()))("text").alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    tail = F.round(F.element_at("p", TAIL), 9)
    return out.select("doc_id", "held_out", F.round(total, 9).alias("expected_grade"), tail.alias("tail_probability"), (tail >= KEEP).alias("kept"))


def _typed(f):
    """Annotations as types, which pandas_udf reads."""
    f.__annotations__ = {"text": pd.Series, "return": pd.DataFrame if f.__name__ == "vectors" else pd.Series}
    return f


def op5_quality_model(spark, sf_dir):
    return graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
