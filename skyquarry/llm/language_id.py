"""Language identification by rank-order profiles.

A text's letters, lower-cased and with one mark between words, give n-grams of 1 to 3 characters inside words (marks at
both ends included). The TOP most frequent, ties by code point, are the text's profile. Its distance to a language is the
sum over its n-grams of how far each is out of place in the language's profile, TOP if it isn't there; the nearest
language wins. Language profiles come from about FIT documents a language, chosen by a hash of id and
text.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, join_small, limited_batches, ship, table

ship(__name__)

HELD, HELD_IS = 4, 2
TOP, FIT = 300, 2000
UNKNOWN = "und"
EDGE = 1


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def letter_codes(text: str | None) -> np.ndarray:
    """Code points of lower-case letters, EDGE where others stand, one at each end; empty if there is no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF).tolist():
        letter[i] = chr(codes[i]).isalpha()
    if not letter.any():
        return codes[:0]
    codes = np.concatenate([[EDGE], np.where(letter, codes, EDGE), [EDGE]])
    return codes[np.r_[True, (codes[1:] != EDGE) | (codes[:-1] != EDGE)]]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams as numbers (21 bits a character), rising, and their counts."""
    c = letter_codes(text)
    if not len(c):
        return c, c
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != EDGE]
    every = np.concatenate([c[c != EDGE], two, three])
    every.sort()
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    return every[first], np.diff(np.r_[first, len(every)])


def profile(text: str | None) -> np.ndarray:
    """The TOP most frequent n-grams, the most frequent first."""
    grams, n = ngrams(text)
    if len(n) > 4 * TOP:  # only those that can be among the first
        least = np.partition(n, len(n) - TOP)[len(n) - TOP]
        grams, n = grams[n >= least], n[n >= least]
    return grams[np.argsort(-n, kind="stable")[:TOP]]


class Profiles:
    def __init__(self, ranked: dict[str, list[int]]):
        self.langs = sorted(ranked)
        self.sorted = []
        for lang in self.langs:
            grams = np.array(ranked[lang], np.int64)
            order = np.argsort(grams)
            self.sorted.append((grams[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(text)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        place, d = np.arange(len(own)), []
        for grams, rank in self.sorted:
            i = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            d.append(np.where(grams[i] == own, np.abs(rank[i] - place), TOP).sum() / (TOP * len(own)))
        order = np.argsort(d, kind="stable")
        best = d[order[0]]
        # how much nearer than the second; alone, how near at all
        return self.langs[order[0]], float(1 - best / d[order[1]] if len(d) > 1 and d[order[1]] else 1 - best)


def _counted(batches):
    for df in batches:
        by = {}
        for lang, text in zip(df["lang"], df["text"]):
            by.setdefault(lang, []).append(ngrams(text))
        for lang, of in by.items():
            grams = np.concatenate([g for g, _ in of])
            kinds, at = np.unique(grams, return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in of]), len(kinds)).astype(np.int64) if len(kinds) else kinds
            yield pd.DataFrame({"lang": lang, "gram": kinds, "n": n})


def learn(docs: DataFrame) -> Profiles:
    """docs: doc_id, text, lang of the documents to learn from. Collects TOP n-grams for each language."""
    sizes = docs.groupBy("lang").agg(F.count("*").alias("size_"))
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.lit(1_000_000.0 * FIT) / F.col("size_")
    rows = join_small(docs, sizes, "lang", "inner", spread="text").filter(chance).select("lang", "text")
    grams = limited_batches(rows).mapInPandas(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = {}
    for r in sorted(grams.withColumn("rank", rank).filter(F.col("rank") <= TOP).collect(), key=lambda r: (r["lang"], r["rank"])):
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked)


def identified(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs.

    Null texts and texts without a letter are UNKNOWN with score 0, as are all if nothing can be learned. Of languages at
    the same distance the first by code point wins. Null ids are not held out, and learned from.
    Repeated rows count again and get equal predictions; texts are read whole. Only the columns named are read, so others may have
    any names; an empty table gives an empty result. Profiles of all languages are in each task: a column of languages
    should have hundreds of values, not one for each row.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    held = F.coalesce(crc_mod(F.col("doc_id"), HELD) == HELD_IS, F.lit(False))
    known = docs.sparkSession.sparkContext.broadcast(learn(rows.filter(~held & F.col("lang").isNotNull())))

    def predict(text):
        return pd.DataFrame([known.value.predict(t) for t in text], columns=["lang_pred", "score"])

    predict.__annotations__ = {"text": pd.Series, "return": pd.DataFrame}
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = limited_batches(rows).select("doc_id", held.alias("held_out"), F.pandas_udf(predict, kind)("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", F.round("p.score", 9).alias("score"))


def op8_language_id(spark, sf_dir):
    return identified(table(spark, sf_dir, "documents"))
