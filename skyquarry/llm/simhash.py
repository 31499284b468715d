"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at RADIUS or fewer differing bits.

Equal fingerprints are first folded into one row, so exact copies cost nothing later. Two fingerprints within RADIUS bits
agree on at least BLOCKS - RADIUS of BLOCKS blocks of bits; each choice of so many blocks is a table, and fingerprints
meet only where such a table gives them the same key. Inside a bucket they are compared exactly: sorted by population
count, in tiles, with numpy's exclusive-or and bit counts; pairs of tiles whose population counts differ beyond the radius
are skipped. A bucket above TILE_ROWS is dealt out to pairs of its parts, so no task holds more than two parts. A bucket
reports a spanning forest of its links, never all pairs.

near_duplicates() is the digest by 4-word shingles and RADIUS bits. deduplicated() finds near copies: texts that share
SIMILARITY of their different COPY_SHINGLE-word shingles. All whose fingerprints are linked as above meet in a bucket, so no
pair within RADIUS bits is missed. Fingerprints of many such texts differ in more bits than pigeonhole blocks can bound, so
bands of minima of the shingles give further buckets; inside all of them fingerprints are compared in the same tiles, within
COPY_RADIUS bits, and pairs so linked are compared exactly by their shingles.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, join_hot, join_small, limited_batches, ship, table, with_uid, word_bytes, written
from .components import components

ship(__name__)

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 1024
#: Rows of a bucket, or of a part of one.
TILE_ROWS = 16_384
#: Buckets of so many rows or fewer are compared many at a time.
SMALL = 64
#: Blocks of bits by the number of different fingerprints. More blocks mean more tables (5, 15, 35, 70), whose longer keys
#: (12, 21, 27, 32 bits) keep buckets small. A row in a table costs about as much as 1,000 comparisons, so a plan is left
#: when its buckets pass 2,000 rows.
PLANS = ((8_000_000, 5), (4_000_000_000, 6), (270_000_000_000, 7), (1 << 62, 8))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = word_bytes(text or "")
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        grams = [joined]
    else:
        ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist() + [len(joined)]
        begins = [0, *(e + 1 for e in ends[: len(words) - shingle])]
        grams = [joined[b:e] for b, e in zip(begins, ends[shingle - 1 :])]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams)))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):  # a long text's bits are never all unpacked at once
        bits = np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(T.LongType())
def fingerprint_col(text: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((_signed(fingerprint(t)) for t in text), np.int64, len(text)), index=text.index)


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return int(x)


def tiles(values: np.ndarray, radius: int):
    """values by rising population count -> pairs of places (a < b) within the radius, tile by tile."""
    counts = np.bitwise_count(values).astype(np.int64)
    for i in range(0, len(values), TILE):
        x = values[i : i + TILE]
        for j in range(i, len(values), TILE):
            if counts[j] - counts[min(i + TILE, len(values)) - 1] > radius:
                break  # later tiles have larger counts still
            a, b = np.nonzero(np.bitwise_count(x[:, None] ^ values[None, j : j + TILE]) <= radius)
            a, b = a + i, b + j
            yield a[a < b], b[a < b]


def band(values: np.ndarray, bucket: np.ndarray, radius: int):
    """The same for many buckets of SMALL values or fewer that lie one after another: tiles of one row each, all at once."""
    counts = np.bitwise_count(values).astype(np.int16)
    for d in range(1, SMALL):
        same = bucket[:-d] == bucket[d:]
        if not same.any():
            break
        same &= np.abs(counts[:-d] - counts[d:]) <= radius
        i = np.flatnonzero(same)
        i = i[np.bitwise_count(values[i] ^ values[i + d]) <= radius]
        yield i, i + d


def spanning(values: np.ndarray, part: np.ndarray, both: bool, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest among values within the radius, compared tile by tile.

    both: only pairs of different parts are looked for, as others are compared elsewhere.
    """
    order = np.argsort(np.bitwise_count(values), kind="stable")
    values, part = values[order], part[order]
    parent, out = np.arange(len(values)), []
    for a, b in tiles(values, radius):
        if both:
            a, b = a[part[a] != part[b]], b[part[a] != part[b]]
        for m, n in zip(a.tolist(), b.tolist()):
            if (r := _find(parent, m)) != (s := _find(parent, n)):
                parent[s] = r
                out.append((int(values[m]), int(values[n])))
    return out


def _small(values: np.ndarray, bucket: np.ndarray, part: np.ndarray, cross: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of many small buckets."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    out = []
    for i, j in band(values, bucket, RADIUS):
        good = ~cross[i] | (part[i] != part[j])
        for m, n in zip(i[good].tolist(), j[good].tolist()):
            if (r := root(m)) != (q := root(n)):
                parent[q] = r
                out.append((int(values[m]), int(values[n])))
    return out


def whole_buckets(batches, keys: list[str]):
    """Rows sorted by keys -> frames of whole buckets, with the numbers of their rows' buckets. One may span batches."""
    rest = None
    for df in batches:
        if not len(df):
            continue
        df = pd.concat([rest, df], ignore_index=True) if rest is not None else df
        of = df[keys].to_numpy()
        new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]).any(axis=1)])
        if new[-1]:
            yield df.iloc[: new[-1]], new
        rest = df.iloc[new[-1] :]
    if rest is not None:
        yield rest, np.array([0, len(rest)])


def _bucket_links(batches):
    """Rows sorted by bucket -> links of a spanning forest of each."""
    for df, new in whole_buckets(batches, ["t", "k", "p", "q"]):
        sizes = np.diff(new)
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        values, part, cross = df["fp"].to_numpy().view(np.uint64), df["part"].to_numpy(), (df["p"] != df["q"]).to_numpy()
        few = np.repeat(sizes <= SMALL, sizes)
        out = _small(values[few], bucket[few], part[few], cross[few]) if few.any() else []
        for i, n in zip(new[:-1][sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            out += spanning(values[i : i + n], part[i : i + n], bool(cross[i]))
        yield pd.DataFrame([(_signed(a), _signed(b)) for a, b in out], columns=["a", "b"]).astype("int64")


def _masks(blocks: int, radius: int = RADIUS) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(each, blocks - radius)]


def dealt(rows: DataFrame, by: str, most: int) -> DataFrame:
    """Rows of buckets of n rows -> rows of pairs (p, q) of the buckets' parts of about `most` rows."""
    parts = F.ceil(F.col("n") / most).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(by), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other")).drop("other", "parts")


def links(fingerprints: DataFrame) -> DataFrame:
    """(fp): different signed 64-bit fingerprints -> (a, b): links that connect all within RADIUS bits of one another."""
    n = fingerprints.count()
    masks = _masks(next(b for most, b in PLANS if n <= most))
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks))))
    rows = fingerprints.select("fp", keys.alias("key")).select("fp", "key.t", "key.k")
    rows = written(rows, "simhash-keys")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    rows = dealt(rows.join(sizes, ["t", "k"]), "fp", TILE_ROWS).select("fp", "part", "t", "k", "p", "q")
    rows = rows.repartition("t", "k", "p", "q").sortWithinPartitions("t", "k", "p", "q", F.bit_count("fp"), "fp")
    return rows.mapInPandas(_bucket_links, "a long, b long").distinct()


def fingerprinted(rows: DataFrame) -> DataFrame:
    """rows with doc_id and text -> a written table with uid_ and fp_ instead of text, one row for each row."""
    return written(limited_batches(with_uid(rows, "uid_")).withColumn("fp_", fingerprint_col(F.col("text"))).drop("text"), "simhash")


def classes(prints: DataFrame) -> DataFrame:
    """(fp_, first): for each fingerprint the smallest doc_id of its component (null only if all its ids are null)."""
    one = written(prints.groupBy("fp_").agg(F.min("doc_id").alias("first")), "simhash-fps")
    linked = members(components(links(one.select(F.col("fp_").alias("fp")))))
    linked = written(linked.join(one.withColumnRenamed("fp_", "node"), "node"), "simhash-linked")
    least = written(linked.groupBy("root").agg(F.min("first").alias("least")), "simhash-least")
    known = join_hot(linked.drop("first"), least, "root", "inner").select(F.col("node").alias("fp_"), "least")
    return written(one.join(known, "fp_", "left").select("fp_", F.coalesce("least", "first").alias("first")), "simhash-classes")


def members(roots: DataFrame) -> DataFrame:
    """components() -> the same with the roots themselves."""
    return written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "cc-members")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with equal ids are rows of their own.
    component_id is null only where all ids of a component are null. An empty table gives an empty result.
    """
    prints = fingerprinted(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    out = join_hot(prints, classes(prints), "fp_", "inner")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp_"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


# near copies by Jaccard similarity, for the pipeline

#: Two texts are near copies where this share of all their different COPY_SHINGLE-word shingles is in both.
COPY_SHINGLE, SIMILARITY = 5, 0.8
#: Texts meet where their fingerprints are linked, and where all ROWS minima of one of BANDS bands agree: at a similarity of
#: 0.8 all but 0.04 % of pairs do.
BANDS, ROWS = 20, 5
#: Bits in which fingerprints of near copies may differ. At a similarity of 0.8 they differ in 9.7 of 64 bits, with a
#: deviation of 2.9: one pair in 8,000 is beyond.
COPY_RADIUS = 20
#: Texts of a large bucket, or of a part of one, that a task holds with their shingles.
COPY_ROWS = 2048
_MIX = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32) | np.uint32(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the different shingles; a text of COPY_SHINGLE words or fewer is one shingle.

    A shingle's hash is made of those of its words, so each word is hashed once.
    """
    words = word_bytes(text or "")
    of = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(COPY_SHINGLE, len(words))
    out = np.full(max(1, len(words) - size + 1), size, np.uint64)
    for i in range(size):
        out = (out ^ of[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def bands(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band: the mixed minima of its ROWS permutations of 32 bits of the hashes."""
    of = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, ~np.uint32(0))
    for i in range(0, len(of), 1024):
        least = np.minimum(least, ((of[i : i + 1024, None] ^ _MIX[0]) * _MIX[1]).min(axis=0))
    least, out = least.astype(np.uint64).reshape(BANDS, ROWS), np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        out = (out ^ least[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


_BANDED = T.StructType([T.StructField("code", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


@F.pandas_udf(_BANDED)
def _banded(text: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in text]
    codes = [_signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets]
    return pd.DataFrame({"code": codes, "fp": [_signed(majority(s)) for s in sets], "bands": [bands(s).view(np.int64) for s in sets]}, index=text.index)


@F.pandas_udf(T.BinaryType())
def _shingles(text: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).tobytes() for t in text], index=text.index, dtype=object)


def similar(x: bytes, y: bytes) -> bool:
    """Do two sets of shingles share SIMILARITY of both?"""
    m, n = len(x) // 8, len(y) // 8
    if min(m, n) < SIMILARITY * max(m, n):
        return False
    both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
    return both >= SIMILARITY * (m + n - both)


def _near_pairs(batches):
    """Rows of small buckets (t, k, code_, fp), sorted -> pairs of codes within COPY_RADIUS bits."""
    for df, new in whole_buckets(batches, ["t", "k"]):
        values, codes = df["fp"].to_numpy().view(np.uint64), df["code_"].to_numpy()
        for i, j in band(values, np.repeat(np.arange(len(new) - 1), np.diff(new)), COPY_RADIUS):
            yield pd.DataFrame({"a": np.minimum(codes[i], codes[j]), "b": np.maximum(codes[i], codes[j])})


def _similar_links(batches):
    """Parts of large buckets (t, k, p, q, part, root, code_, fp, s), sorted -> links between different groups.

    Pairs within COPY_RADIUS bits, of texts that are not linked yet, are compared exactly by their shingles.
    """
    for df, new in whole_buckets(batches, ["t", "k", "p", "q"]):
        out = []
        for i, n in zip(new[:-1].tolist(), np.diff(new).tolist()):
            of = df.iloc[i : i + n]
            values = of["fp"].to_numpy().view(np.uint64)
            order = np.argsort(np.bitwise_count(values), kind="stable")
            values, cross = values[order], of["p"].iloc[0] != of["q"].iloc[0]
            codes, part, sets = of["code_"].to_numpy()[order], of["part"].to_numpy()[order], of["s"].to_numpy()[order]
            first, parent = np.unique(of["root"].to_numpy()[order], return_index=True, return_inverse=True)[1:]
            parent = first[parent]  # groups that are known already
            for a, b in tiles(values, COPY_RADIUS):
                if cross:
                    a, b = a[part[a] != part[b]], b[part[a] != part[b]]
                apart = parent[a] != parent[b]
                for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                    if (r := _find(parent, x)) != (q := _find(parent, y)) and similar(sets[x], sets[y]):
                        parent[q] = r
                        out.append((codes[x], codes[y]))
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _by_code(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) -> those whose sets are similar."""
    both = pairs.join(sets.select(F.col("code_").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("code_").alias("b"), F.col("s").alias("y")), "b")

    def good(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(p, q) for p, q in zip(x, y)], index=x.index, dtype=bool)

    good.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return limited_batches(both).filter(F.pandas_udf(good, T.BooleanType())("x", "y")).select("a", "b")


def copy_groups(one: DataFrame, texts: DataFrame) -> DataFrame:
    """(code_, fp, bands_, uid_), codes different, and (uid_, text), written -> (node, root), written: the groups of near
    copies, as components() gives them.

    A text is in a bucket for the component of its fingerprint under links(), and in one for each band. Buckets of SMALL
    texts or fewer report all pairs within COPY_RADIUS bits, which are compared exactly. In a larger one each text is first
    compared with a drawn one, another in each band, so that a group of copies is linked by as many links as it has texts.
    Only buckets whose texts are then still in different groups are compared in full, in tiles, parts of COPY_ROWS texts
    against one another: no pair that meets is left out.
    """
    linked = members(components(links(one.select("fp").distinct()))).withColumnRenamed("node", "fp")
    linked = join_hot(one.select("code_", "fp"), linked, "fp").select("code_", "fp", F.lit(BANDS).alias("t"), F.coalesce("root", "fp").alias("k"))
    keys = written(one.select("code_", "fp", F.posexplode("bands_").alias("t", "k")).unionByName(linked), "copies-keys")
    drawn = F.min(F.struct(F.xxhash64("code_", "t").alias("h"), "code_"))["code_"].alias("drawn")
    sizes = keys.groupBy("t", "k").agg(F.count("*").alias("n"), drawn).filter("n > 1")
    met = written(keys.join(sizes, ["t", "k"]), "copies-met")
    few = met.filter(F.col("n") <= SMALL).repartition("t", "k").sortWithinPartitions("t", "k", F.bit_count("fp"), "code_")
    pairs = few.select("t", "k", "code_", "fp").mapInPandas(_near_pairs, "a long, b long")
    many = met.filter((F.col("n") > SMALL) & (F.col("code_") != F.col("drawn"))).select(F.least("code_", "drawn").alias("a"), F.greatest("code_", "drawn").alias("b"))
    pairs = written(pairs.unionByName(many).distinct(), "copies-pairs")
    asked = pairs.select(F.col("a").alias("code_")).unionByName(pairs.select(F.col("b").alias("code_"))).distinct()
    asked = written(one.join(asked, "code_", "left_semi").select("code_", "uid_"), "copies-asked")
    sets = limited_batches(join_small(texts, asked, "uid_", "inner")).select("code_", _shingles("text").alias("s"))
    sets = written(sets, "copies-sets")
    found = written(_by_code(pairs, sets), "copies-links")
    large = met.filter(F.col("n") > SMALL).select("t", "k", "n", "code_", "fp")
    roots = written(components(found), "copies-roots")
    large = large.join(members(roots).withColumnRenamed("node", "code_"), "code_", "left").withColumn("root", F.coalesce("root", "code_"))
    large = written(large, "copies-large")
    apart = large.groupBy("t", "k").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("t", "k")
    apart = written(apart, "copies-apart")
    if apart.isEmpty():
        return roots
    rows = dealt(large.join(apart, ["t", "k"], "left_semi"), "code_", COPY_ROWS).join(sets, "code_")
    rows = rows.repartition("t", "k", "p", "q").sortWithinPartitions("t", "k", "p", "q")
    more = limited_batches(rows).select("t", "k", "p", "q", "part", "root", "code_", "fp", "s").mapInPandas(_similar_links, "a long, b long")
    more = written(more, "copies-more")
    # links between groups join the groups' own stars
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return written(components(stars.unionByName(more)), "copies-roots") if not more.isEmpty() else roots


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without all but one row of each group of near copies: the one with the smallest id, and of several the first read.

    Groups are components of the pairs that share SIMILARITY of their shingles. Null and empty texts are equal ones. A null
    id is larger than any. Texts are compared whole, however long.
    """
    rows = limited_batches(with_uid(carried(docs, doc_id=key, text=text), "uid_")).withColumn("b_", _banded("text"))
    rows = written(rows.select("doc_", "doc_id", "uid_", "b_.code", "b_.fp", "b_.bands"), "copies")
    keep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid_")).alias("s")
    first = rows.groupBy(F.col("code").alias("code_")).agg(F.first("fp").alias("fp"), F.first("bands").alias("bands_"), keep, F.min("uid_").alias("uid_"))
    first = written(first, "copies-first")
    roots = copy_groups(first, rows.select("uid_", F.col("doc_")[text].alias("text")))
    known = first.join(roots.withColumnRenamed("node", "code_"), "code_", "left").withColumn("root", F.coalesce("root", "code_"))
    stay = known.groupBy("root").agg(F.min("s").alias("s")).select(F.col("s.uid_").alias("uid_"))
    gone = rows.select("uid_").join(stay, "uid_", "left_anti")
    return join_small(rows, written(gone, "copies-gone"), "uid_", "left_anti").select("doc_.*")


def op6_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
