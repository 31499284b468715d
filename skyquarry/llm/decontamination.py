"""Benchmark decontamination by template canonicalisation.

Words lose marks around them and case; numbers, units after a number, and names (capitalised words inside a sentence)
become the placeholders <num>, <unit> and <name>. A capitalised word that begins a sentence may be a name or not, and is
read both ways. WINDOW such words in a row are a template window. Windows of benchmark items are hash-joined with windows
of documents, which finds items whose values were changed; the matched windows are then compared word by word: each value
of an item must stand for one value of the document throughout (2 apples ... 2 pears may become 7 apples ... 7 pears, not
7 ... 9). Where windows contradict each other, wherever in the document they lie, the most of them that agree count.

The benchmark's windows are a table, joined in Spark whatever its size. What executors get of it is a filter of at most
FILTER_BITS bits, so that nearly all windows of documents end where they are made. Documents are known by a digest of
their text: copies of one text are judged once.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, carried, has_bits, join_small, limited_batches, places_of_bits, rehash, ship, table, with_uid, written

ship(__name__)

WINDOW = 8
#: Words of a window that are no placeholder, for its template to be evidence.
LITERAL = 2
#: An item of fewer words is no evidence inside a text: it is found where it is the whole text, word by word.
LEAST_WORDS = 4
#: An item is found where this share of its windows is, or this many words in a row.
SHARE, RUN = 0.5, 13
#: Bits of the filter: 16 for each window, and at least and at most 2 to these powers. A fuller filter only passes more.
FILTER_BITS = (20, 30)
#: Words that a task looks at together, and windows whose readings it holds at once; they change no result.
TOGETHER, READ = 1 << 18, 1 << 16
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Units of measure, currency and time, in lower case.
UNITS = frozenset("km m cm mm mi ft in yd kg g mg lb lbs oz t l ml gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years % percent usd eur gbp dollars dollar euros euro cents cent mph kph km/h m/s hz khz mhz ghz w kw mw v kv a kb mb gb tb °c °f".split())
_EDGE = re.compile(r"^[^\w<>%$€£°]+|[^\w<>%$€£°]+$")
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d,.:/]*(?:st|nd|rd|th)?%?")
_ENDS = re.compile(r"[.!?:][\"')\]]*$")


def _code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 3


#: A number, a unit, a word after which a sentence begins, marks alone.
IS_NUMBER, IS_UNIT, ENDS, NOTHING = 1, 2, 4, 8
#: Words remembered between batches; one batch may have more.
REMEMBER = 400_000


class Words(dict):
    """word in UTF-8 -> place in arrays: codes of it, of its template as the first word of a sentence and inside one, FLAGS."""

    def __init__(self):
        self.names = ("low", "outer", "inner", "flags")
        for name in self.names:
            setattr(self, name, np.zeros(1 << 14, np.uint8 if name == "flags" else np.uint64))

    def __missing__(self, raw: bytes) -> int:
        n = len(self)
        if n == len(self.flags):
            for name in self.names:
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        word = raw.decode("utf-8", "surrogatepass")
        plain = word.rstrip(".,;:!?")
        if plain.isalpha():  # most words need no pattern
            number, ends = False, word[-1] in ".!?:"
        else:
            plain = _EDGE.sub("", word)
            number, ends = bool(_NUMBER.fullmatch(plain)), bool(_ENDS.search(word))
        low = plain.lower()
        self.low[n] = code = _code(low)
        self.outer[n] = self.inner[n] = _NUM_CODE if number else code
        if plain[:1].isupper() and not number:
            self.inner[n] = _NAME_CODE
        self.flags[n] = IS_NUMBER * number | IS_UNIT * (low in UNITS) | ENDS * ends | NOTHING * (not low)
        self[raw] = n
        return n


_NUM_CODE, _NAME_CODE, _UNIT_CODE = _code(NUM), _code(NAME), _code(UNIT)
_WORDS: Words | None = None


def places_of(words: list[bytes], more: bool = False) -> np.ndarray:
    """Where words stand in the arrays of Words; more: beside those that were asked for before, whose places stay."""
    global _WORDS
    if _WORDS is None or not more and len(_WORDS) > REMEMBER:
        _WORDS = Words()
    return np.fromiter(map(_WORDS.__getitem__, words), np.int32, len(words))


class Template:
    """The canonical words of some texts (their places_of()), one text after another; marks alone are left out.

    codes: of the templates; low: of the words themselves; either: a capital begins a sentence, so it may be a name; text:
    which text a word is of.
    """

    def __init__(self, at: np.ndarray, sizes: list[int]):
        flags, text = _WORDS.flags[at], np.repeat(np.arange(len(sizes)), sizes)
        first = np.ones(len(at), bool)
        first[1:] = text[1:] != text[:-1]
        before = np.zeros(len(at), np.uint8)
        before[1:] = flags[:-1]
        before[first] = 0
        inside = ~first & (before & ENDS == 0)
        codes = np.where(inside, _WORDS.inner[at], _WORDS.outer[at])
        unit = (flags & IS_UNIT > 0) & (before & IS_NUMBER > 0)
        codes[unit] = _UNIT_CODE
        either = ~inside & ~unit & (_WORDS.inner[at] != _WORDS.outer[at])
        keep = flags & NOTHING == 0
        self.codes, self.low, self.either, self.text = codes[keep], _WORDS.low[at][keep], either[keep], text[keep]

    def windows(self, size: int, known: np.ndarray | None = None):
        """(hashes, places) of windows inside one text, READ windows at a time, in all readings.

        known: which words the other side has. A window with another word matches nothing, unless it may be a name; then it
        is only read as one.
        """
        n = len(self.codes) - size + 1
        if n <= 0:
            return
        usable = self.text[:n] == self.text[size - 1 :]
        if known is not None:
            bad = np.r_[0, np.cumsum(~(known | self.either))]
            usable &= bad[size:] == bad[:-size]
        every, literal = np.flatnonzero(usable), np.r_[0, np.cumsum(_literal(self.codes))]
        for begin in range(0, len(every), READ):
            at = every[begin : begin + READ]
            here = at[:, None] + np.arange(size)
            codes, either = self.codes[here], self.either[here]
            words = literal[at + size] - literal[at]
            if not either.any():
                yield hashed(_evidence(codes, words, self.low, at)), at
                continue
            name = np.uint64(_NAME_CODE)
            if known is not None:
                named = either & ~known[here]
                words = words - named.sum(axis=1)
                codes, either = np.where(named, name, codes), either & known[here]
            nth, count = np.cumsum(either, axis=1) - 1, either.sum(axis=1)
            for mask in range(1 << int(count.max())):
                rows = 1 << count > mask
                read = np.where(either[rows] & (mask >> nth[rows].clip(0) & 1 > 0), name, codes[rows])
                yield hashed(_evidence(read, words[rows] - mask.bit_count(), self.low, at[rows])), at[rows]

    def plain(self, at: np.ndarray, size: int) -> list[bytes]:
        """The words themselves of windows, as codes."""
        return [w.tobytes() for w in self.low[at[:, None] + np.arange(size)]] if len(at) else []


def _literal(codes: np.ndarray) -> np.ndarray:
    return (codes != np.uint64(_NUM_CODE)) & (codes != np.uint64(_NAME_CODE)) & (codes != np.uint64(_UNIT_CODE))


def _evidence(codes: np.ndarray, literal: np.ndarray, low: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Windows of templates (at: their first words' places in low), of which those with fewer than LITERAL words that are no
    placeholder stand as they are written: a row of numbers or names alone is like any other, so only the same ones are evidence.

    literal: how many such words each has.
    """
    few = np.flatnonzero(literal < min(LITERAL, codes.shape[1]))
    if len(few):
        codes = codes.copy()
        codes[few] = low[at[few][:, None] + np.arange(codes.shape[1])]
    return codes


def hashed(codes: np.ndarray) -> np.ndarray:
    """A hash of each row of codes and of their number (modulo 2**64)."""
    out = np.full(len(codes), codes.shape[1], np.uint64)
    for x in codes.T:
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _items(batches):
    """A row for each window of an item in each reading. Items of fewer than LEAST_WORDS words have one, of size -words."""
    for df in batches:
        out = []
        for k, item, raw in zip(df["k"], df["item_id"], df["text"]):
            words = raw.split() if raw else []
            t = Template(places_of(words), [len(words)])
            size = min(WINDOW, len(t.codes))
            if not size:
                continue
            if size < LEAST_WORDS:
                read = [(hashed(t.low[None]), np.zeros(1, np.int64))]
            else:
                read = list(t.windows(size))
            h, at = (np.concatenate(x) for x in zip(*read))
            kind = size if size >= LEAST_WORDS else -size
            out.append(pd.DataFrame({"k": k, "item_id": item, "size": kind, "n": len(t.codes) - size + 1, "i": at, "h": h.view(np.int64), "again": rehash(h).view(np.int64), "own": t.plain(at, size)}))
        if out:
            yield pd.concat(out)


def _item_words(batches):
    for df in batches:
        for raw in df["text"]:
            words = raw.split() if raw else []
            t = Template(places_of(words), [len(words)])
            yield pd.DataFrame({"b": np.unique(np.r_[t.codes, [_NAME_CODE] * bool(t.either.any())].astype(np.uint64)).astype(np.int64)})


#: Bits of a word's code that the table of known words looks at, of 61.
KNOWN_BITS = 22


def _hits(sent):
    """Documents (digest, text) -> the windows that pass the filter: digest, h, j (place), own (words as codes)."""

    def together(rows, words, lengths):
        known, filter_, bits, sizes = sent.value
        t, out = Template(np.concatenate(words), lengths), []
        is_known = has_bits(known, (t.codes >> np.uint64(61 - KNOWN_BITS)).astype(np.int64))
        starts = np.searchsorted(t.text, np.arange(len(rows)))

        def add(h, at, size):
            good = has_bits(filter_, places_of_bits(h, bits))
            h, at = h[good], at[good]
            good = has_bits(filter_, places_of_bits(rehash(h), bits))
            h, at = h[good], at[good]
            if len(at):
                of = t.text[at]
                out.append(pd.DataFrame({"digest": [rows[i] for i in of.tolist()], "h": h.view(np.int64), "j": at - starts[of], "own": t.plain(at, size)}))

        for size in sizes:
            if size > 0:
                for h, at in t.windows(size, is_known):
                    add(h, at, size)
            else:  # texts that are as short as such an item
                short = np.flatnonzero(np.bincount(t.text, minlength=len(rows)) == -size)
                if len(short):
                    at = starts[short]
                    add(hashed(t.low[at[:, None] + np.arange(-size)]), at, -size)
        return pd.concat(out) if out else None

    def part(batches):
        rows, words, lengths, n = [], [], [], 0  # of words only the places are kept
        for df in batches:
            for digest, raw in zip(df["digest"], df["text"]):
                if not raw:
                    continue
                own = places_of(raw.split(), more=bool(rows))
                rows.append(digest)
                words.append(own)
                lengths.append(len(own))
                n += len(own)
                if n >= TOGETHER:
                    if (got := together(rows, words, lengths)) is not None:
                        yield got
                    rows, words, lengths, n = [], [], [], 0
        if rows and (got := together(rows, words, lengths)) is not None:
            yield got

    return part


def judge(alignments: list[list[tuple[int, bytes, bytes]]], n: int, size: int) -> tuple[int, bool] | None:
    """(windows that agree, was a value changed?) of an item of n windows in a text; None if it is not found.

    alignments: for each shift between item and text its matched windows (place in the item, the text's words, the item's).
    Sets of windows that agree grow from the verbatim ones, and for each alignment from those whose values stand for what
    they most often stand for, and from the longest run without a contradiction; to each, windows of all alignments that
    agree with it are added. The largest counts. The item is found if any set has SHARE of its windows or RUN words in a row.
    """
    hits = []
    for matched in alignments:
        rows = [(i, list(zip(np.frombuffer(own, np.uint64).tolist(), np.frombuffer(text, np.uint64).tolist()))) for i, text, own in sorted(matched)]
        rows = [(i, pairs) for i, pairs in rows if len(set(pairs)) == len({a for a, _ in pairs})]  # agrees with itself
        if rows:
            hits.append(rows)
    hits.sort(key=lambda rows: (-len(rows), rows))
    if not hits:
        return None
    most = len({i for rows in hits for i, _ in rows})
    # of each window, what it would stand for in the text, and in which alignments
    windows: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
    for of, rows in enumerate(hits):
        for i, pairs in rows:
            windows[i][tuple(pairs)].append(of)
    best, found, seen = (0, 0, False), False, set()
    for seed in _seeds(hits):
        to: dict[int, int] = {}
        kept: dict[int, set] = defaultdict(set)

        def add(rows):
            for of, i, pairs in rows:
                if i not in kept[of] and all(to.get(a, b) == b for a, b in pairs):  # noqa: B023
                    to.update(pairs)  # noqa: B023
                    kept[of].add(i)  # noqa: B023

        add((of, i, pairs) for of, rows in seed for i, pairs in rows)
        known = frozenset(to.items())
        if known in seen:  # it would grow to the same set
            continue
        seen.add(known)
        rest = []
        for i, stands in windows.items():
            slots = [a for a, _ in next(iter(stands))]
            if all(a in to for a in slots):  # then it is looked up
                for of in stands.get(tuple((a, to[a]) for a in slots), ()):
                    kept[of].add(i)
            else:
                rest += [(of, i, pairs) for pairs, ofs in stands.items() for of in ofs]
        add(sorted(rest))
        count = len(set().union(*kept.values()))
        run = max(map(longest, kept.values())) + size - 1
        found |= count >= SHARE * n or run >= RUN
        if (count, run) > best[:2]:
            best = count, run, any(a != b for a, b in to.items())
        if best[0] == most and found:
            break
    return (best[0], best[2]) if found else None


def _seeds(hits):
    """Sets to begin with: lists of (number of the alignment, windows)."""
    verbatim = [(of, [(i, pairs) for i, pairs in rows if all(a == b for a, b in pairs)]) for of, rows in enumerate(hits)]
    if any(rows for _, rows in verbatim):
        yield verbatim
    for of, rows in enumerate(hits):
        often = defaultdict(Counter)
        for pair in {(i + x, pair) for i, pairs in rows for x, pair in enumerate(pairs)}:
            often[pair[1][0]][pair[1][1]] += 1
        to = {a: max(bs, key=lambda b: (bs[b], b == a, b)) for a, bs in often.items()}
        mostly = [(i, pairs) for i, pairs in rows if all(to[a] == b for a, b in pairs)]
        yield [(of, mostly)]
        if len(mostly) < len(rows):
            yield [(of, agreeing_run(rows))]


def agreeing_run(rows: list) -> list:
    """The longest run of windows, each one word after the last, without a contradiction; of several the first."""
    best, run = [], []
    last: dict[int, dict[int, int]] = {}  # value -> {what it stands for: its last place}
    for i, pairs in rows:
        if run and run[-1][0] != i - 1:
            run, last = [], {}
        begin = i
        for x, (a, b) in enumerate(pairs):
            last.setdefault(a, {})[b] = i + x
        run.append((i, pairs))
        # the run begins after the last word that contradicts a later one
        begin = max((sorted(bs.values())[-2] + 1 for bs in last.values() if len(bs) > 1), default=0)
        run = [r for r in run if r[0] >= begin]
        if len(run) > len(best):
            best = list(run)
    return best


def longest(places: set[int]) -> int:
    """Places in a row."""
    best = run = 0
    for p in sorted(places):
        run = run + 1 if p - 1 in places else 1
        best = max(best, run)
    return best


VERDICT = T.StructType([T.StructField("windows", T.LongType()), T.StructField("changed", T.BooleanType())])


@F.pandas_udf(VERDICT)
def _judged(alignments: pd.Series, n: pd.Series, size: pd.Series) -> pd.DataFrame:
    out = []
    for of, most, wide in zip(alignments, n, size):
        if wide < 0:  # a short item that is the whole text
            out.append((1, False))
        else:
            out.append(judge([[(h["i"], h["text"], h["own"]) for h in a["a"]] for a in of], most, wide) or (None, None))
    return pd.DataFrame(out, columns=["windows", "changed"]).astype({"windows": "Int64", "changed": "boolean"})


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(digest, item_id, windows, changed): the items that each different text of docs holds, written; digest is digest_of(text).

    An item is a row of the benchmark, whatever its id: ids may be null, repeated and of any type. Null and empty texts
    hold nothing, and null and empty items are in no text.
    """
    spark = docs.sparkSession
    bench = limited_batches(with_uid(benchmark.select(F.col(item).alias("item_id"), F.col(item_text).cast("binary").alias("text")), "k"))
    id_type = benchmark.schema[item].dataType
    kinds = {"k": T.LongType(), "item_id": id_type, "size": T.IntegerType(), "n": T.LongType(), "i": T.LongType(), "h": T.LongType(), "again": T.LongType(), "own": T.BinaryType()}
    index = written(bench.mapInPandas(_items, T.StructType([T.StructField(k, t) for k, t in kinds.items()])), "bench-windows")
    windows = index.count()
    bits = min(max(FILTER_BITS[0], (16 * windows).bit_length()), FILTER_BITS[1])
    sizes = [r["size"] for r in index.select("size").distinct().collect()]
    filter_ = bitmap(index.select(F.explode(F.array("h", "again")).alias("h")).select(F.shiftrightunsigned("h", 64 - bits).alias("b")), bits)
    known = bitmap(bench.select("text").mapInPandas(_item_words, "b long").select(F.shiftrightunsigned("b", 61 - KNOWN_BITS).alias("b")), KNOWN_BITS)
    sent = spark.sparkContext.broadcast((known, filter_, bits, sorted(sizes)))
    hits = limited_batches(docs.select(digest_of(F.col(text)).alias("digest"), F.col(text).cast("binary").alias("text")))
    hits = hits.mapInPandas(_hits(sent), "digest string, h long, j long, own binary").dropDuplicates(["digest", "h", "j"])
    hits = written(hits.withColumnRenamed("own", "text"), "bench-hits")
    met = join_small(hits, index.drop("again"), "h", "inner", spread="digest")
    by_shift = met.groupBy("digest", "k", (F.col("j") - F.col("i")).alias("shift")).agg(F.sort_array(F.collect_set(F.struct("i", "text", "own"))).alias("a"), *(F.first(c).alias(c) for c in ("item_id", "n", "size")))
    # the same words at many shifts are one alignment
    by_item = by_shift.groupBy("digest", "k").agg(F.collect_set(F.struct("a")).alias("a"), *(F.first(c).alias(c) for c in ("item_id", "n", "size")))
    judged = limited_batches(by_item).select("digest", "item_id", _judged("a", "n", "size").alias("v")).filter("v.windows is not null")
    return written(judged.select("digest", "item_id", "v.windows", "v.changed"), "bench-found")


def digest_of(text):
    return F.md5(text.cast("binary"))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, item_id, windows, changed: a row for each item found in a row of docs.

    Repeated documents and repeated items give repeated rows; ids may be null and of any type; ties don't matter, as every
    item found is reported. Texts are compared whole, however long. Only the columns named are read, so others may have any
    names; without documents or without items the result is empty.
    """
    found = matches(docs, benchmark, text)
    rows = docs.select(F.col(key).alias("doc_id"), digest_of(F.col(text)).alias("digest"))
    return join_small(rows, found, "digest", "inner", spread="doc_id").select("doc_id", "item_id", "windows", "changed")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; null texts stay.

    Equal rows go or stay together; columns keep their names, whatever these are; an empty table stays empty.
    """
    found = matches(docs, benchmark, text).select(F.col("digest").alias("digest_")).distinct()
    rows = carried(docs, text=text).select("doc_", digest_of(F.col("text")).alias("digest_"), F.xxhash64("doc_").alias("spread_"))
    return join_small(rows, found, "digest_", "left_anti", spread="spread_").select("doc_.*")


def op9_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
