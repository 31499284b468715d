"""Repeated passages: bytes that lie in a string of LEAST bytes which begins elsewhere too, by suffix arrays of shards.

A shard must hold all strings that could be equal. Each string of LEAST bytes has a mark, the least hash of its substrings
of GRAMS[0] bytes, which is the same wherever the string stands; a run of strings with one mark is a segment of the text, of
a few hundred bytes. A mark that occurs once can't be of a repeated string. Segments of all others are written; equal ones
are one row with a count; and segments of a mark go to one shard, whose suffix array (suffixes.py) finds the strings that
begin twice among them. A mark with more than GROUP different segments is divided by marks of longer substrings, the last
of which are the strings themselves, so that no group is larger. Nothing is compared with all, and no text passes through one task for
another's sake: where a passage is in a third of all documents, its inner segments are one row.

Texts are known by 128 bits of their SHA-256. A task looks at the first of equal texts among its own; texts that occur twice are
repeated as a whole.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, carried, has_bits, join_small, limited_batches, places_of_bits, rehash, ship, table, written
from .suffixes import repeated_places

ship(__name__)
ship("skyquarry.llm.suffixes")

LEAST = 400
#: Lengths of the substrings whose hashes mark a string of LEAST bytes, as parts of LEAST; the last is all of it.
GRAMS = (0.5, 0.75, 0.875, 0.94, 0.97, 0.985, 0.9925, 1.0)
#: Segments that share a mark in a shard; bytes of a shard; bytes that a task looks at at once.
GROUP, SHARD, SLICE = 2_000, 2 << 20, 1 << 20
#: Bits of the filter of marks: 16 for each, at least and at most 2 to these powers. A fuller one passes more, and loses none.
FILTER_BITS = (20, 30)

_BASE = 0x9E3779B97F4A7C15
#: A number for each byte.
_BYTES = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None


def gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes in a row: differences of running sums of bytes times powers, modulo 2**64."""
    global _UP, _DOWN
    n = len(a)
    if _UP is None or len(_UP) <= n:
        size = max(n + 1, SLICE + 4096)
        _UP, _DOWN = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[a] * _DOWN[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _UP[: n - k + 1]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def least_of(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w in a row, by running minima of blocks from both sides."""
    n = len(h) - w + 1
    blocks = np.concatenate([h, np.full(-len(h) % w, ~np.uint64(0))]).reshape(-1, w)
    forward, back = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forward[w - 1 : w - 1 + n])


def slices(texts: list[bytes], least: int):
    """Texts in pieces of about SLICE bytes: lists of (number, place, bytes). Pieces of a text overlap by least - 1 bytes."""
    out, size = [], 0
    for i, x in enumerate(texts):
        for at in range(0, len(x) - least + 1, SLICE):
            out.append((i, at, x[at : at + SLICE + least - 1]))
            size += len(out[-1][2])
            if size >= SLICE:
                yield out
                out, size = [], 0
    if out:
        yield out


def segments(texts: list[bytes], k: int, least: int = LEAST):
    """For each slice: (piece, begin in the slice's bytes, strings, mark, own) of its segments, the slice, its bytes and the pieces' begins.

    own: a string of the segment may begin twice in it, as its marking substring comes twice.
    """
    for pieces in slices(texts, least):
        joined = b"".join(x for _, _, x in pieces)
        a = np.frombuffer(joined, np.uint8)
        h = gram_hashes(a, k)
        mark = least_of(h, least - k + 1)
        begins = np.cumsum([0, *(len(x) for _, _, x in pieces)])
        whole = np.ones(len(mark), bool)  # strings inside one piece
        for e in begins[1:-1].tolist():
            whole[max(0, e - least + 1) : e] = False
        at = np.flatnonzero(whole)
        new = np.flatnonzero(np.r_[True, (mark[at[1:]] != mark[at[:-1]]) | (np.diff(at) != 1)])
        # a string that begins with its mark, and the next one has the same: there it is again
        twice = mark[at] == h[at]
        twice[:-1] &= (mark[at[1:]] == mark[at[:-1]]) & (np.diff(at) == 1)
        twice[-1] = False
        begin, count = at[new], np.diff(new, append=len(at))
        own = np.logical_or.reduceat(twice, new)
        yield np.searchsorted(begins, begin, "right") - 1, begin, count, mark[begin], own, pieces, joined, begins


def _fresh(batch: pa.RecordBatch, seen: set[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Digests and texts that this task has not met."""
    ids, texts = [], []
    for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if d not in seen:
            seen.add(d)
            ids.append(d)
            texts.append(x)
    return ids, texts


def marks(rows: DataFrame, k: int, least: int) -> DataFrame:
    """(digest, data) -> (m, n): how many segments have a mark, at least where it is one."""

    def each(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for _, _, _, mark, own, *_ in segments(_fresh(batch, seen)[1], k, least):
                value, at = np.unique(mark, return_inverse=True)
                yield pa.RecordBatch.from_pydict({"m": pa.array(value.view(np.int64)), "n": pa.array(np.bincount(at, 1 + own).astype(np.int64))})

    return limited_batches(rows).mapInArrow(each, "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))


OCCURRENCES = "m long, s binary, digest binary, at long, own boolean, data binary"


def occurrences(rows: DataFrame, k: int, least: int, passes=None) -> DataFrame:
    """(digest, data) -> segments: mark, digest of the bytes, text and place, own, bytes.

    passes: a _filter() of marks; others are left out.
    """

    def each(batches):
        seen: set[bytes] = set()
        for batch in batches:
            ids, texts = _fresh(batch, seen)
            for piece, begin, count, mark, own, pieces, joined, begins in segments(texts, k, least):
                good = np.ones(len(mark), bool) if passes is None else _inside(passes, mark)
                piece, begin, count, mark, own = (x[good] for x in (piece, begin, count, mark, own))
                data = [joined[b : b + c + least - 1] for b, c in zip(begin.tolist(), count.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "m": pa.array(mark.view(np.int64)), "s": pa.array([blake2b(x, digest_size=16).digest() for x in data], pa.binary()), "digest": pa.array([ids[pieces[p][0]] for p in piece.tolist()], pa.binary()),
                    "at": pa.array(begin - begins[piece] + np.array([at for _, at, _ in pieces], np.int64)[piece], pa.int64()), "own": pa.array(own), "data": pa.array(data, pa.binary()),
                })

    return limited_batches(rows).mapInArrow(each, OCCURRENCES)


def _shards(least: int):
    """Segments sorted by mark -> (s, lo, hi): strings from lo to before hi begin elsewhere too, in whole marks of SHARD bytes or more."""

    def found(held):
        s, lo, hi = [], [], []
        for (name, _), places in zip(held, repeated_places([x for _, x in held], least)):
            if len(places):
                cut = np.flatnonzero(np.diff(places) != 1)
                lo += places[np.r_[0, cut + 1]].tolist()
                hi += (places[np.r_[cut, len(places) - 1]] + 1).tolist()
                s += [name] * (len(cut) + 1)
        return pa.RecordBatch.from_pydict({"s": pa.array(s, pa.binary()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})

    def each(batches):
        held, size = [], 0
        same, own, before = [], False, None  # segments of one mark: alone, and without itself in it, there is nothing to find

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)))
            yield None, None, False, b""

        for m, s, o, x in rows():
            if m != before:
                if len(same) > 1 or own:
                    held += same
                    size += sum(len(y) for _, y in same)
                if held and (size >= SHARD or m is None):
                    yield found(held)
                    held, size = [], 0
                same, own, before = [], False, m
            same.append((s, x))
            own |= o

    return each


def repeated(found: DataFrame, least: int, group: int = GROUP, level: int = 0) -> DataFrame:
    """Segments (written) -> (digest, lo, hi): the strings of a text from place lo to before hi that begin elsewhere too."""
    segs = found.groupBy("m", "s").agg(F.count("*").alias("n"), F.max("own").alias("own"), F.first("data").alias("data"))
    segs = written(segs, "repeats-segments", "zstd")
    # as often as its text, without an array; it still is in one if others might share a part of it
    whole = segs.filter("n > 1").select("s", F.lit(0).cast("long").alias("lo"), (F.length("data") - least + 1).cast("long").alias("hi"))
    cold, deep = segs.select("m", "s", "own", "data"), level + 1 < len(GRAMS)
    size = segs.agg(F.sum(F.length("data")).alias("b")).first()["b"] or 0
    if deep:
        hot = written(segs.groupBy("m").agg(F.count("*").alias("k")).filter(F.col("k") > group).select("m", F.lit(True).alias("hot_")), "repeats-hot")
        both = join_small(cold, hot, "m", "left", spread="s")  # one mark in `group` segments is hot at most
        cold, warm = both.filter("hot_ is null").drop("hot_"), both.filter("hot_").select(F.col("s").alias("digest"), "data")
        deep = not hot.isEmpty()
    cold = cold.repartition(size // SHARD + 1, "m").sortWithinPartitions("m")
    parts = whole.unionByName(limited_batches(cold).mapInArrow(_shards(least), "s binary, lo long, hi long"))
    if deep:
        inner = written(occurrences(warm, max(1, round(GRAMS[level + 1] * least)), least), "repeats-found", "zstd")
        parts = parts.unionByName(repeated(inner, least, group, level + 1).withColumnRenamed("digest", "s"))
    parts = parts.groupBy("s").agg(F.collect_set(F.struct("lo", "hi")).alias("parts"))
    # a passage of many texts is one row of parts and many places: Spark splits such a key of the join
    places = found.select("s", "digest", "at").distinct()
    out = places.join(parts.hint("merge"), "s").select("digest", "at", F.explode("parts").alias("x"))
    return out.select("digest", (F.col("at") + F.col("x.lo")).alias("lo"), (F.col("at") + F.col("x.hi")).alias("hi"))


def _digest(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, 16)


def _merged(least: int):
    @F.pandas_udf("array<struct<start: long, end: long>>")
    def merged(lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(lo, hi):
            a, b = np.asarray(a, np.int64), np.asarray(b, np.int64) + least - 1
            by = np.argsort(a)
            a, reach = a[by], np.maximum.accumulate(b[by])
            new = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
            out.append([{"start": s, "end": e} for s, e in zip(a[new].tolist(), reach[np.r_[new[1:] - 1, len(a) - 1]].tolist())])
        return pd.Series(out, index=lo.index)

    return merged


def repeats(docs: DataFrame, text: str = "text", least: int = LEAST, group: int = GROUP) -> DataFrame:
    """docs with `spans`: start and end (exclusive), in bytes of UTF-8, of all maximal runs of bytes that are covered by a
    string of `least` bytes which begins at another place of this text or of another row's.

    Strings never cross texts. Null and empty texts, and those shorter than `least`, have no spans. Rows with equal texts
    repeat one another, whatever their ids. Texts count whole, a slice at a time. An empty table gives an empty result.
    A column of docs that is named spans is replaced.
    """
    spark = docs.sparkSession
    rows = carried(docs, data=text).withColumn("data", F.coalesce(F.col("data"), F.lit("")).cast("binary")).withColumn("digest", _digest(F.col("data")))
    long = rows.filter(F.length("data") >= least).select("digest", "data")
    k = max(1, round(GRAMS[0] * least))
    known = written(marks(long, k, least).filter("n > 1").select("m"), "repeats-known")
    found = written(occurrences(long, k, least, _filter(known.select(F.col("m").alias("h")))), "repeats-found", "zstd")
    copies = long.groupBy("digest").agg(F.count("*").alias("n"), F.first(F.length("data")).alias("size")).filter("n > 1")
    copies = copies.select("digest", F.lit(0).cast("long").alias("lo"), (F.col("size") - least + 1).cast("long").alias("hi"))
    spans = repeated(found, least, group).unionByName(copies).groupBy("digest").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    spans = written(limited_batches(spans).select("digest", _merged(least)("lo", "hi").alias("spans")), "repeats-spans")
    # only texts that may have spans are sent to meet them
    rows = rows.drop("data").withColumn("may_", _passes(_filter(spans.select(F.xxhash64("digest").alias("h"))))(F.xxhash64("digest")))
    out = rows.filter("may_").join(spans.hint("merge"), "digest", "left")
    out = out.unionByName(rows.filter(~F.col("may_")).withColumn("spans", F.lit(None).cast(out.schema["spans"].dataType)))
    kept = [F.col("doc_")[c].alias(c) for c in docs.columns if c.lower() != "spans"]
    return out.select(*kept, F.coalesce("spans", F.array().cast(out.schema["spans"].dataType)).alias("spans"))


def _filter(hashes: DataFrame):
    """(h), different longs -> a broadcast (bits of two places each, logarithm of their number)."""
    bits = min(max(FILTER_BITS[0], (16 * hashes.count()).bit_length()), FILTER_BITS[1])
    again = limited_batches(hashes).mapInArrow(_both, "h long")
    return hashes.sparkSession.sparkContext.broadcast((bitmap(again.select(F.shiftrightunsigned("h", 64 - bits).alias("b")), bits), bits))


def _inside(sent, h: np.ndarray) -> np.ndarray:
    filter_, bits = sent.value
    return has_bits(filter_, places_of_bits(h, bits)) & has_bits(filter_, places_of_bits(rehash(h), bits))


def _passes(sent):
    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        return pd.Series(_inside(sent, h.to_numpy().view(np.uint64)), index=h.index)

    return passes


def _both(batches):
    for batch in batches:
        h = batch.column(0).to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate([h, rehash(h)]).view(np.int64))})


@F.pandas_udf(T.BinaryType())
def without(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The bytes of texts outside their spans."""
    out = []
    for x, cut in zip(text, spans):
        data, at, parts = (x or "").encode("utf-8", "surrogatepass"), 0, []
        for span in cut:
            parts.append(data[at : span["start"]])
            at = span["end"]
        out.append(b"".join(parts) + data[at:])
    return pd.Series(out, index=text.index)


def op11_repeated_passages(spark, sf_dir):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of all documents."""
    docs = limited_batches(repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    kept = F.sha2(without("text", "spans"), 256)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.select("doc_id", n_bytes.alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), kept.alias("kept_sha256"))
