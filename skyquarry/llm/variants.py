"""Spelling variants: words within one edit of one another, found by Aho-Corasick automata of their halves.

If two words differ by one edit, one half of either stands unchanged at its end of the other. So each word gives two
segments, its first and its second half; automata hold the segments, words are scanned by them, and an occurrence counts if
it lies at the segment's end of the scanned word and the lengths differ by one at most. What is left is verified exactly.

Automata are dealt out by a hash of the segment (and of the length of its word), about SHARD segments each, and a word only
goes to the automata that can hold a half of its own kind: six at most, so the work grows with the number of words, not with
its square. A segment of more than GROUP words is made longer, by one half of what remains of each word; again one of the two
is unchanged. That goes on until no group is larger or one code point remains, so a group is bounded by GROUP or the alphabet.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, limited_batches, lower_az, ship, table, written

ship(__name__)

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: One run of a document in so many loses a code point.
LOSES = 199
#: A form occurs so many times as often as the word.
TIMES = 5
#: Words that share a segment, before it is made longer; segments of an automaton.
GROUP, SHARD = 64, 10_000


def words(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, `length` code points or more, that occur `count` times or more.

    A run whose crc32 with the document's id is divisible by LOSES loses the code point at crc32 % length first. A null id
    is read as an empty one. Null and empty texts have no words. Counts are added up in each task before the shuffle.
    """
    # shorter runs can't give a word
    runs = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([A-Za-zÀ-ÿ]{{{length},}})"), F.lit(1)))
    df = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id_"), runs.alias("run_")).withColumn("run_", lower_az(F.col("run_")))
    h, n = F.crc32(F.concat(F.col("id_"), F.lit(":"), F.col("run_")).cast("binary")), F.length("run_")
    at = (h % n).cast("int")
    less = F.concat(F.substring("run_", F.lit(1), at), F.substring("run_", at + 2, n))
    df = df.select(F.when(h % LOSES == 0, less).otherwise(F.col("run_")).alias("word")).filter(F.length("word") >= length)
    return df.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def _key(p: Column, q: Column) -> Column:
    """A hash of what a word must have unchanged: p code points at its beginning and q at its end, for words of length la.

    It only says where rows meet; two that share one by chance cost a comparison.
    """
    return F.xxhash64("la", F.substring("word", F.lit(1), p), F.substring("word", F.length("word") - q + 1, q))


def _longer(df: DataFrame, rest: list[str]) -> DataFrame:
    """Each row as two, with a longer beginning and with a longer end: half of what p and q leave of a word of length la."""
    half = F.floor((F.col("la") - F.col("p") - F.col("q")) / 2).cast("int")
    both = F.array(F.struct((F.col("p") + half).alias("p"), F.col("q").alias("q")), F.struct(F.col("p").alias("p"), (F.col("la") - F.col("p") - half).alias("q")))
    df = df.select(*rest, "la", F.explode(both).alias("cut_"))
    return df.select(*rest, "la", "cut_.p", "cut_.q").withColumn("key", _key(F.col("p"), F.col("q")))


def segments(known: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(word, n) -> segments (word, n, la, p, q, key), and the words to scan for them (word, key)."""
    whole = known.select("word", "n", F.length("word").alias("la"), F.lit(0).alias("p"), F.lit(0).alias("q"))
    lengths = F.explode(F.array(F.length("word") - 1, F.length("word"), F.length("word") + 1)).alias("la")
    seen = known.select("word", lengths, F.lit(0).alias("p"), F.lit(0).alias("q"))
    held, scanned = [], []
    while True:
        whole, seen = _longer(whole, ["word", "n"]), _longer(seen, ["word"])
        sizes = whole.groupBy("key").agg(F.count("*").alias("size_"), F.first(F.col("la") - F.col("p") - F.col("q")).alias("left_"))
        # at most one key in `group` words is hot: the table is small beside the words, and most rows meet no other table
        hot = written(sizes.filter((F.col("size_") > group) & (F.col("left_") > 1)).select("key", F.lit(True).alias("hot_")), "variant-hot")
        whole, seen = join_small(whole, hot, "key", "left", spread="word"), join_small(seen, hot, "key", "left", spread="word")
        held.append(whole.filter("hot_ is null").drop("hot_"))
        scanned.append(seen.filter("hot_ is null").select("word", "key"))
        if hot.isEmpty():
            break
        whole, seen = written(whole.filter("hot_"), "variant-held"), written(seen.filter("hot_"), "variant-seen")
    for more in held[1:]:
        held[0] = held[0].unionByName(more)
    for more in scanned[1:]:
        scanned[0] = scanned[0].unionByName(more)
    return held[0], scanned[0]


def one_edit(a: str, b: str, p: int = 0) -> bool:
    """One code point inserted, deleted or replaced; the first p are known to be equal."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    while p < n and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] and p < n if n == len(b) else a[p:] == b[p + 1 :]


class Automaton:
    """Segments of words: those at the beginning and those at the end, and what else of the word must be unchanged."""

    def __init__(self, rows):
        """rows: (word, n, p, q)"""
        first: dict[str, dict] = {}
        last: dict[str, dict] = {}
        for word, n, p, q in rows:
            begin, end = word[:p], word[len(word) - q :]
            by, segment, other = (first, begin, end) if p >= q else (last, end, begin)
            by.setdefault(segment, {}).setdefault((len(word), other), []).append((word, n))
        self.trie = ahocorasick.Automaton()
        for segment in first.keys() | last.keys():
            self.trie.add_word(segment, (len(segment), first.get(segment, {}), last.get(segment, {})))
        if self.trie:
            self.trie.make_automaton()

    def near(self, word: str):
        """(other word, its n) for all held words one edit away; one may come twice."""
        if not self.trie:
            return
        m = len(word)
        for at, (size, first, last) in self.trie.iter(word):
            if at + 1 == size:
                for (n, other), found in first.items():
                    if abs(n - m) <= 1 and word.endswith(other):
                        yield from (x for x in found if x[0] != word and one_edit(x[0], word, min(size, m)))
            if at + 1 == m:
                for (n, other), found in last.items():
                    if abs(n - m) <= 1 and word.startswith(other):
                        yield from (x for x in found if x[0] != word and one_edit(x[0], word, len(other)))


def _scan(batches):
    """Rows by shard, segments before words -> (word, near, near_n)."""
    shard, held, automaton, before = None, [], None, None
    for df in batches:
        out = []
        for s, word, n, p, q in zip(df["shard"], df["word"], df["n"], df["p"], df["q"]):
            if s != shard:
                shard, held, automaton, before = s, [], None, None
            if n > 0:
                held.append((word, n, p, q))
            elif word != before:
                if automaton is None:
                    automaton = Automaton(held)
                before = word
                out += [(word, *x) for x in set(automaton.near(word))]
        yield pd.DataFrame(out, columns=["word", "near", "near_n"])


def near_words(known: DataFrame, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """(word, n), each word once -> (word, near, near_n): every pair of words one edit apart, both ways, each once."""
    held, scanned = segments(known, group)
    shards = held.count() // shard + 1
    rows = held.select("key", "word", "n", "p", "q").unionByName(scanned.select("key", "word", F.lit(0).cast("long").alias("n"), F.lit(0).alias("p"), F.lit(0).alias("q")))
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "word", "n", "p", "q")
    # texts of words are sorted too, so that one that comes to a shard by several keys is scanned once
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", F.col("n") == 0, "word")
    found = limited_batches(rows).mapInPandas(_scan, "word string, near string, near_n long")
    return found.groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) with form never null -> (word, root): forms followed to the last, by doubling.

    Counts rise by TIMES at each step, so chains are short and have no rings.
    """
    far = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        step = join_small(far.withColumnRenamed("word", "word_").withColumnRenamed("root", "word"), far, "word", "left", spread="word_")
        step = step.select(F.col("word_").alias("word"), F.coalesce("root", "word").alias("root"), F.col("root").isNotNull().alias("on_"))
        step = written(step, "variant-roots")
        far = step.drop("on_")
        if step.filter("on_").isEmpty():
            return far


def variants(known: DataFrame, times: int = TIMES, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """(word, n), each word once -> word, n, n_near, form, form_n, root.

    form: the near word of largest n, the smallest in code-point order among equals, if its n is at least `times` the
    word's, else null, as is form_n. root: where forms lead, the word itself if it has none. An empty table gives an empty one.
    """
    known = written(known.select("word", "n"), "variant-words")
    best = F.min(F.struct((-F.col("near_n")).alias("n_"), F.col("near").alias("near")))
    best = near_words(known, group, shard).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best_"))
    out = known.join(best.hint("merge"), "word", "left")
    good = -F.col("best_.n_") >= times * F.col("n")
    out = written(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best_.near")).alias("form"), F.when(good, -F.col("best_.n_")).cast("long").alias("form_n")), "variant-forms")
    root = roots(out.filter("form is not null").select("word", "form"))
    return out.join(root.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark, sf_dir):
    """word, form, root, n, n_near, form_n for the words of all documents.

    Null and empty texts have no words, rows repeated count again, a null id is read as an empty one; of near words with equal counts the
    smallest is the form. An empty table gives an empty result. Only doc_id and text are read, so other columns may have any names.
    """
    return variants(words(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


#: Near words meet by what is left when one code point of either or of both is left out. crc32 byte by byte, by its polynomial.
OP13_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT] || [0::UBIGINT FOR z IN range(8)],
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS c FROM range(256) r(i))),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS h FROM r GROUP BY id, run),
b AS (SELECT id, run, n, list_transform(range(1, length(h), 2), lambda i: ((instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1)::UBIGINT) AS bytes FROM g),
c AS (SELECT run, n, xor(list_reduce([4294967295::UBIGINT] || bytes, lambda a, x: xor(a >> 8, t[((xor(a, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS crc FROM b, tab),
d AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, n FROM c),
w AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
l AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM l a JOIN l b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM l JOIN w ON l.less = w.word UNION SELECT w.word, l.word, l.n FROM l JOIN w ON l.less = w.word),
o AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS nth FROM p),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN o ON o.word = w.word AND nth = 1),
s AS (SELECT word, coalesce(form, word) AS at FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.at WHERE f.form IS NOT NULL AND s.at <> s.word),
z AS (SELECT s.word, s.at AS root FROM s JOIN f ON f.word = s.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word
"""
