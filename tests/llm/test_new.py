"""Repeated passages, whitening and spelling variants against brute force; odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyquarry.llm import repeats, suffixes, variants, whitening
from skyquarry.llm.common import table
from skyquarry.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string"


# suffix arrays


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=50), st.sampled_from([0, 40, 10**9]))
def test_suffix_array(letters, dense):
    """Against sorted suffixes, in waves and one by one; permuted prefixes against plain comparison."""
    before, suffixes.DENSE = suffixes.DENSE, dense
    try:
        x = [*letters, 0]
        want = sorted(range(len(x)), key=lambda i: x[i:])
        assert suffixes.suffix_array(np.array(x), 4).tolist() == want
    finally:
        suffixes.DENSE = before
    phi, shared = suffixes.common_prefixes(np.array(x), np.array(want))
    assert phi[want[0]] == -1 and shared[want[0]] == 0
    for a, b in zip(want, want[1:]):
        n = next(i for i in range(len(x)) if x[a + i] != x[b + i])
        assert phi[b] == a and shared[b] == n


def brute_spans(texts, least):
    """Maximal runs of bytes in strings of `least` bytes that begin twice in all of texts."""
    seen = Counter(x[i : i + least] for x in texts for i in range(len(x) - least + 1))
    out = []
    for x in texts:
        hit = np.zeros(len(x) + 1, np.int8)
        for i in range(len(x) - least + 1):
            if seen[x[i : i + least]] > 1:
                hit[i : i + least] = 1
        edges = np.flatnonzero(np.diff(np.r_[0, hit, 0]))
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist())))
    return out


def test_repeated_places():
    r = random.Random(5)
    texts = [bytes(r.choices(b"ab", k=r.randint(0, 40))) for _ in range(30)] + [b"a" * 30, b"ab" * 12, b""]
    want = brute_spans(texts, 6)
    for x, places, spans in zip(texts, suffixes.repeated_places(texts, 6), want):
        covered = np.zeros(len(x) + 1, np.int8)
        for i in places.tolist():
            covered[i : i + 6] = 1
        edges = np.flatnonzero(np.diff(np.r_[0, covered, 0]))
        assert list(zip(edges[::2].tolist(), edges[1::2].tolist())) == spans


def passages(n, words, length, seed=3):
    """Texts of random words that share passages at random places, with copies, periodic texts and characters of several bytes."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé日", k=r.randint(1, 6))) for _ in range(words)]
    text = lambda k: " ".join(r.choices(vocabulary, k=k))
    shared = [text(length) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [text(r.randint(0, 2 * length))]
        for _ in range(r.randint(0, 3)):
            x = r.choice(shared)
            a = r.randint(0, len(x) // 2)
            parts += [x[a : a + r.randint(1, len(x))], text(r.randint(0, length))]
        rows.append((i, " ".join(parts)))
    rows += [(n, rows[0][1]), (n, rows[0][1]), (n + 1, "ab" * 400), (n + 2, "a" * 700), (n + 3, rows[1][1] + " " + rows[1][1]), (n + 4, None), (n + 5, ""), (None, rows[2][1]), (n + 6, "\x00" * 90)]
    return rows


@pytest.mark.parametrize("least, group", [(40, 2000), (40, 2), (17, 3)])
def test_repeats(spark, least, group, monkeypatch):
    """Against brute force; with group, marks are divided down to single strings; texts are read in small slices."""
    monkeypatch.setattr(repeats, "SLICE", 300)
    monkeypatch.setattr(repeats, "SHARD", 2000)
    rows = passages(60, 50, 25)
    docs = spark.createDataFrame([(*x, "mine", "mine") for x in rows], DOCS + ", data string, digest string").repartition(3)
    out = repeats.repeats(docs, least=least, group=group)
    assert out.columns == ["doc_id", "text", "data", "digest", "spans"]
    got = Counter((r["doc_id"], r["text"], tuple((x["start"], x["end"]) for x in r["spans"])) for r in out.collect())
    want = brute_spans([(t or "").encode() for _, t in rows], least)
    assert got == Counter((i, t, tuple(s)) for (i, t), s in zip(rows, want))
    assert sum(bool(s) for s in want) > 20


def test_long_text(spark):
    """A text of over a megabyte that is cut into slices, holding a passage of another."""
    r = random.Random(8)
    long = "".join(r.choices("abcdefghij ", k=1_500_000))
    at = (1 << 20) - 200
    rows = [(1, long), (2, "x" + long[at : at + 500] + "y"), (3, long[:399])]
    out = {x["doc_id"]: [tuple(s) for s in x["spans"]] for x in repeats.repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {1: [(at, at + 500)], 2: [(1, 501)], 3: []}


def test_op11_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = []
    for (i, t), spans in zip(docs, brute_spans([(t or "").encode() for _, t in docs], 400)):
        data, at, kept = (t or "").encode(), 0, b""
        for s, e in spans:
            kept, at = kept + data[at:s], e
        kept += data[at:]
        want.append((i, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    out = QUERIES["op11_repeated_passages"](spark, SF)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(want) and sum(x[3] for x in want)


def test_repeats_of_nothing(spark):
    assert repeats.repeats(spark.createDataFrame([], DOCS)).collect() == []
    assert [r["spans"] for r in repeats.repeats(spark.createDataFrame([(1, None), (2, "")], DOCS)).collect()] == [[], []]


# whitening


def plain_whitening(vectors, k=4):
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, right = np.linalg.eigh(centred.T @ centred / n)
    values, right = values[::-1][:k], right[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ right / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("fanin", [16, 2])
def test_whitening(spark, fanin, monkeypatch):
    """Against the eigenvectors of the covariance, which the operator does not form; merged in a flat and a deep tree."""
    monkeypatch.setattr(whitening.r_factor, "__defaults__", (fanin,))
    rows = table(spark, SF, "embeddings")
    odd = spark.createDataFrame([(-1, None, 0), (-2, [], 0), (-3, [1.0, None], 0), (-4, [float("nan")] * 64, 0), (-5, [float("inf")] * 64, 0), (-6, [1.0, 2.0], 0)], rows.schema)
    df = rows.unionByName(odd).unionByName(rows.limit(9)).repartition(7).withColumn("x", F.lit("mine")).withColumn("n", F.lit("mine"))
    got = whitening.whiten(df).collect()
    source = [(r["vec_id"], r["embedding"]) for r in rows.collect()]
    n, deviation, white, share = plain_whitening([v for _, v in source])
    place = {v: i for i, (v, _) in enumerate(source)}
    assert len(got) == 4 * (len(source) + 9) and all(r["n"] == n and r["identity_error"] < 1e-9 for r in got)
    sign = np.sign([sum(r["whitened"] * white[place[r["vec_id"]], k] for r in got if r["component"] == k + 1) for k in range(4)])
    for r in got:
        i, k = place[r["vec_id"]], r["component"] - 1
        assert r["deviation"] == deviation[i] and abs(r["explained"] / share[k] - 1) < 1e-9 and abs(r["whitened"] - sign[k] * white[i, k]) < 1e-7


def test_whitening_of_little(spark):
    """No rows, one vector, a direction without variance, fewer directions than components, numbers near the end of longs."""
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(frame([])).collect() == [] and whitening.whiten(frame([(1, None)])).collect() == []
    one = whitening.whiten(frame([(1, [0.5, 2.0]), (None, [0.5, 2.0])])).collect()
    assert len(one) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None) for r in one)
    flat = whitening.whiten(frame([(1, [0.0, 3.0]), (2, [1.0, 3.0])])).collect()
    assert {(r["vec_id"], r["component"]): r["whitened"] and abs(r["whitened"]) for r in flat} == {(1, 1): 1.0, (2, 1): 1.0, (1, 2): None, (2, 2): None}
    big = whitening.whiten(frame([(1, [float(2**22)]), (2, [-float(2**22)])])).collect()
    assert [r["deviation"] for r in big] == [2**62, 2**62]
    with pytest.raises(Exception, match="beyond a long"):
        whitening.whiten(frame([(1, [float(2**24)]), (2, [-float(2**24)])])).collect()


def test_exact_sums(spark):
    """Sums beyond 64 bits are exact."""
    x = 2**62
    fit = spark.createDataFrame([([x, 1],), ([x, 2],), ([x, -3],)], "x array<long>").coalesce(1)
    assert whitening.sums(fit, 2) == (3, [3 * x, 0])


# spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, times=5):
    """By comparing all with all, for words that share what is left without one code point."""
    left = defaultdict(set)
    for w in counts:
        left[w].add(w)
        for i in range(len(w)):
            left[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for ws in left.values():
        for a in ws:
            near[a] |= {b for b in ws if one_edit(a, b)}
    best = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: b if b and counts[b] >= times * n else None for (w, n), b in zip(counts.items(), best.values())}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def words_of_rows(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


@given(st.text("ab", max_size=7), st.text("ab", max_size=7))
def test_one_edit(a, b):
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert (variants.one_edit(a, b) and a != b) == one_edit(a, b) == (a != b and variants.one_edit(a, b, same))


@pytest.mark.parametrize("group, shard", [(64, 50_000), (2, 300), (1, 20)])
def test_variants(spark, group, shard):
    """Words of few letters, so that many are near; small groups make segments longer, level by level."""
    r = random.Random(group)
    counts = {"".join(r.choices("abÀ", k=r.randint(6, 9))): 5 ** r.randint(1, 6) for _ in range(900)} | {"x" * n: 5**n for n in range(6, 14)}
    out = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), group=group, shard=shard)
    got = [tuple(x) for x in out.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(counts) and set(got) == plain_variants(counts)


def test_words_of_documents(spark):
    r = random.Random(9)
    vocabulary = ["kitten", "Kittens", "façade", "CAFÉTERIA", "abcde", "straße", "mitten", "ÀÉÎõü÷", "Ärger"]
    rows = [(i, " ".join(r.choices(vocabulary, k=400)) + "-kittenx1") for i in range(30)] + [(None, "kitten " * 9), (1, None), (2, ""), (3, "abcdef" * 4000), (3, "abcdef" * 4000)]
    docs = spark.createDataFrame([(*x, "mine") for x in rows], DOCS + ", word string")
    want = words_of_rows(rows)
    assert {x["word"]: x["n"] for x in variants.words(docs).collect()} == want and len(want) > 8
    assert variants.variants(variants.words(docs.limit(0))).collect() == []


def test_op13_query(spark, duck):
    out = QUERIES["op13_spelling_variants"](spark, SF)
    same_rows(out, duck, ORACLE_SQL["op13_spelling_variants"])
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert {tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain_variants(words_of_rows(rows))
