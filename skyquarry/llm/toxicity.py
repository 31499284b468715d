"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words (A-Z and a-z lower-cased, marks around them dropped) that stand in far more toxic than other
training texts, LEXICON at most. Features of a text are densities of lexicon words (all, strong ones, in a row, near a
second-person word), capitals, punctuation and obfuscation. Trees are fitted to FIT labelled rows at most, those with the
smallest hashes, however few there are. A quarter of these is kept from the trees and calibrates their scores by isotonic regression.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, limited_batches, lower_ascii, lower_az, ship, table, with_uid, words_col, words_of, written

ship(__name__)

HELD, HELD_IS = 3, 1
PREDICT = 0.7
FIT, LEXICON, LEAST_DOCS = 20_000, 200, 8
#: Least log odds ratio of a lexicon word, and of a strong one. A word must be in LEAST_DOCS documents, or 2 and a quarter of
#: the toxic ones where these are few; a leaf has LEAF rows, or a tenth of all.
ODDS, STRONG = 1.5, 2.5
TREES, DEPTH, RATE, BINS, LEAF = 80, 3, 0.15, 64, 12
#: Second-person words.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te ti tú usted ustedes vosotros vous toi votre vos ton ta tes".split())
#: Characters that stand for letters in obfuscated words.
LEET = str.maketrans("013457@$!", "oieastasi")
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~«»„“”…"
_INNER = re.compile(r"[A-Za-z]+[0-9@$!*]+[A-Za-z]+")
FEATURES = 16


def bare(word: str) -> str:
    """The word without marks around it, A-Z lower-cased; other capitals stay, as in bare_col."""
    return lower_ascii(word.strip(_EDGE))


def bare_col(word):
    return F.btrim(lower_az(word), F.lit(_EDGE))


class Seen(dict):
    """word as written -> (lexicon weight, second person?, obfuscated lexicon word?, all capitals?, marks)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) > 200_000:
            self.clear()
        low = bare(word)
        weight = self.lexicon.get(low, 0.0)
        hidden = 0.0
        if not weight and _INNER.search(word):
            hidden = self.lexicon.get(bare(word.translate(LEET)), 0.0) or self.lexicon.get(re.sub(r"[^a-z]", "", low), 0.0)
        got = self[word] = (weight, low in YOU, hidden, len(word) > 2 and word.isupper(), sum(not c.isalnum() for c in word), bool(_INNER.search(word)))
        return got


def features(text: str | None, seen: Seen) -> list[float]:
    """FEATURES numbers; zeros but for the length for an empty text."""
    words = words_of(text or "")
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    c = np.array(list(map(seen.__getitem__, words)), dtype=np.float64)
    lex, you, hidden = c[:, 0], c[:, 1] > 0, c[:, 2]
    hit = np.flatnonzero((lex > 0) | (hidden > 0))
    near = 0
    if len(hit) and you.any():
        at = np.flatnonzero(you)
        i = np.searchsorted(at, hit)
        gap = np.minimum(np.abs(at[np.minimum(i, len(at) - 1)] - hit), np.abs(at[np.maximum(i - 1, 0)] - hit))
        near = int((gap <= 3).sum())
    k = 1000 / n
    chars = len(text)
    return [
        len(hit) * k, len(hit), float((lex >= STRONG).sum()), float((lex >= STRONG).sum()) * k, float(lex.sum() + hidden.sum()), float((lex.sum() + hidden.sum()) * k),
        float(len(set(words[i] for i in hit))), near * 1.0, near * k, float(you.mean()), float(c[:, 3].mean()), float(c[:, 4].sum() / chars), text.count("!") / chars, float(c[:, 5].mean()), float((hidden > 0).sum()), math.log1p(n),
    ]


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """train: text, y -> weights of the LEXICON words with the largest smoothed log odds ratio. Counted by Spark."""
    n = train.agg(F.sum("y").alias("y"), F.count("*").alias("n")).first()
    yes, no = int(n["y"] or 0), int(n["n"] - (n["y"] or 0))
    if not yes or not no:
        return {}
    least = min(LEAST_DOCS, 2 + yes // 4)
    words = train.select("y", F.explode(F.array_distinct(F.transform(words_col(F.col("text")), bare_col))).alias("w")).filter("w <> ''")
    by = words.groupBy("w").agg(F.sum("y").alias("a"), F.count("*").alias("n")).filter(F.col("n") >= least)
    odds = F.log((F.col("a") + 0.5) / (yes - F.col("a") + 0.5)) - F.log((F.col("n") - F.col("a") + 0.5) / (no - F.col("n") + F.col("a") + 0.5))
    rows = by.withColumn("odds", F.round(odds, 9)).filter(F.col("odds") >= ODDS).orderBy(F.desc("odds"), "w").limit(LEXICON).collect()
    return {r["w"]: r["odds"] for r in rows}


class Trees:
    """Boosted regression trees on the logistic loss; features are cut into BINS quantile bins."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self._bins(x)
        self.leaf = min(LEAF, 1 + len(y) // 10)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = math.log(share / (1 - share))
        f, self.trees = np.full(len(y), self.start), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._tree(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self._leaves(tree, b)
        return self

    def _bins(self, x):
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def _tree(self, b, g, h):
        """Nodes in heap order: (feature, bin) or a value; rows of a bin above go right."""
        nodes, rows = {}, {1: np.arange(len(g))}
        for node in range(1, 2 ** (DEPTH + 1)):
            r = rows.pop(node, None)
            if r is None:
                continue
            best, total_g, total_h = (1e-6, None), g[r].sum(), h[r].sum()
            if node < 2**DEPTH and len(r) >= 2 * self.leaf:
                for j in range(b.shape[1]):
                    bg, bh, bn = (np.bincount(b[r, j], w, BINS + 1).cumsum()[:-1] for w in (g[r], h[r], None))
                    gain = bg**2 / (bh + 1) + (total_g - bg) ** 2 / (total_h - bh + 1) - total_g**2 / (total_h + 1)
                    gain[(bn < self.leaf) | (len(r) - bn < self.leaf)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0] + 1e-9:
                        best = (gain[k], (j, k))
            if best[1] is None:
                nodes[node] = RATE * total_g / (total_h + 1)
            else:
                j, k = nodes[node] = best[1]
                right = b[r, j] > k
                rows[2 * node], rows[2 * node + 1] = r[~right], r[right]
        return nodes

    @staticmethod
    def _leaves(nodes, b):
        at, out = np.ones(len(b), np.int64), np.zeros(len(b))
        for node in sorted(nodes):
            here = np.flatnonzero(at == node)
            if isinstance(nodes[node], tuple):
                j, k = nodes[node]
                at[here] = 2 * node + (b[here, j] > k)
            else:
                out[here] = nodes[node]
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        return self.start + sum(self._leaves(t, b) for t in self.trees)


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores and rising shares between which others are interpolated."""
    order = np.argsort(s, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for a, b in zip(s[order].tolist(), y[order].tolist()):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks])


class Model:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.trees, self.curve, self.share = lexicon, None, None, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        self.share = float(y.mean()) if len(y) else 0.0
        held = np.zeros(len(y), bool)
        for kind in (0, 1):  # the last of every four of each kind; rows come in the order of their hashes
            held[np.flatnonzero(y == kind)[3::4]] = True
        if not 0 < y[held].sum() < held.sum():  # under four rows of a kind none can be spared
            held[:] = False
        if 0 < y.sum() < len(y):
            self.trees = Trees().fit(x[~held], y[~held])
            of = held if held.any() else ~held
            self.curve = isotonic(self.trees.raw(x[of]), y[of])
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        return np.clip(np.interp(self.trees.raw(x), *self.curve), 0, 1)


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs.

    Labels join on the id; several labels of an id count as their mean, halves as toxic; null labels not at all. Trees are
    fitted from one row of each kind on; without labels of both kinds every score is the share of toxic ones (0 without
    labels). Each row is scored by itself, so repeated rows have equal scores; texts are read whole, however long. A null id is neither held out nor
    labelled. Null texts count as empty ones. Only the columns named are read, so others may have any names; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    given = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    given = given.filter(crc_mod(F.col("doc_id"), HELD) != HELD_IS)
    given = written(given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT), "toxic-fit")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    lexicon = spark.sparkContext.broadcast(learn_lexicon(rows.join(F.broadcast(given), "doc_id")))

    def dense(text: pd.Series) -> pd.Series:
        seen = Seen(lexicon.value)
        return pd.Series([features(t, seen) for t in text], index=text.index, dtype=object)

    x = limited_batches(with_uid(rows)).select("uid", "doc_id", F.pandas_udf(dense, T.ArrayType(T.DoubleType()))("text").alias("x"))
    x = written(x, "toxic-features")
    fit = x.join(F.broadcast(given), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("x"), "uid").limit(FIT).select("x", "y").toPandas()
    model = Model(lexicon.value).fit(np.stack(fit["x"]) if len(fit) else np.zeros((0, FEATURES)), fit["y"].to_numpy(float))
    known = spark.sparkContext.broadcast(model)

    def score(x: pd.Series) -> pd.Series:
        return pd.Series(known.value.score(np.stack(x)), index=x.index) if len(x) else pd.Series([], dtype=float)

    held = F.coalesce(crc_mod(F.col("doc_id"), HELD) == HELD_IS, F.lit(False))
    out = x.select("doc_id", held.alias("held_out"), F.round(F.pandas_udf(score, T.DoubleType())("x"), 9).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT).cast("int"))


def op4_toxicity(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
