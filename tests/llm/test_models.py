"""Operators that learn: held-out accuracy on the given tables, their parts against brute force, and odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from skyquarry.llm import gru_lm, language_id, quality_model, toxicity
from skyquarry.llm.common import table, word_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF01 = "/root/testdata/sf0.01"


def odd(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "a", 0), (3, " \t\n", "de", "a", 3), (4, "1234 ... !!", "de", "b", 1), (5, "word " * 40_000, "en", "b", 1), (5, "word " * 40_000, "en", "b", 1), (None, "a null id", "en", "c", 1), (6, "\U00010400\U00010428 Ωmega", None, None, 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("uid", F.lit("mine")).withColumn("score", F.lit("mine")).withColumn("p", F.lit(1))




# toxicity


def test_toxicity_held_out(spark):
    out = toxicity.op4_toxicity(spark, SF01)
    rows = out.join(table(spark, SF01, "labels").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert out.count() == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    good = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    assert good > 0.93
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out.collect())


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        out = toxicity.scored(odd(spark), given).collect()
        assert len(out) == 8 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.scored(odd(spark).limit(0), labels).collect() == []


def _marked(n, r):
    """Texts of which every third is toxic, by words and capitals."""
    words = [f"word{i}" for i in range(200)]
    out = []
    for i in range(n):
        w = [r.choice(words) for _ in range(40)]
        if i % 3 == 0:
            w[5:8] = ["you", "Nasty", "FOOL!!!"]
        out.append((i, " ".join(w), int(i % 3 == 0)))
    return out


@pytest.mark.parametrize("n", [12, 99, 100, 300])
def test_toxicity_of_few_labels(spark, n):
    """Trees are fitted from whatever labels there are: no number of rows from which things change."""
    rows = _marked(2 * n, random.Random(n))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = df.filter(F.col("doc_id") < n).select("doc_id", F.col("y").alias("toxic"))
    out = toxicity.scored(df.select("doc_id", "text"), labels).collect()
    assert len({r["score"] for r in out}) > 1
    toxic, clean = ([r["score"] for r in out if (r["doc_id"] % 3 == 0) == k] for k in (True, False))
    assert np.mean(toxic) > np.mean(clean) + (0.2 if n < 50 else 0.7)


def test_lexicon_words_are_found_as_counted():
    """Capitals beyond A-Z count as they are, where words are learned and where they are looked up."""
    lexicon = {"\u00c9t\u00c9x": 2.0, "\u00e9t\u00e9": 2.0}
    hits = lambda t: toxicity.features(t, toxicity.Seen(lexicon))[1]
    assert hits("\u00c9T\u00c9X!") == 1 and hits("\u00e9T\u00e9.") == 1 and hits("\u00c9t\u00e9") == 0


def test_toxicity_against_a_plain_version(spark):
    """The query's scores are those of the model, fitted by hand to the same rows in the same order."""
    rows = _marked(240, random.Random(1))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in toxicity.scored(df.select("doc_id", "text"), df.select("doc_id", F.col("y").alias("toxic"))).collect()}
    train = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    yes = sum(y for *_, y in train)
    a, n = Counter(), Counter()
    for _, t, y in train:
        for w in {toxicity.bare(w) for w in t.split()} - {""}:
            n[w] += 1
            a[w] += y
    odds = {w: math.log((a[w] + 0.5) / (yes - a[w] + 0.5)) - math.log((n[w] - a[w] + 0.5) / (len(train) - yes - n[w] + a[w] + 0.5)) for w in n if n[w] >= min(8, 2 + yes // 4)}
    best = sorted(((round(o, 9), w) for w, o in odds.items() if o >= 1.5), key=lambda x: (-x[0], x[1]))[:200]
    seen = toxicity.Seen({w: o for o, w in best})
    x = {i: np.array(toxicity.features(t, seen)) for i, t, _ in rows}
    order = [r["doc_id"] for r in df.orderBy(F.xxhash64("doc_id")).select("doc_id").collect()]
    y = {i: y for i, _, y in train}
    model = toxicity.Model({}).fit(np.stack([x[i] for i in order if i in y]), np.array([float(y[i]) for i in order if i in y]))
    for i, t, _ in rows:
        s = round(float(model.score(x[i][None])[0]), 9)
        assert got[i] == (zlib.crc32(str(i).encode()) % 3 == 1, pytest.approx(s, abs=2e-9), int(got[i][1] >= 0.7))


def test_toxic_features():
    seen = toxicity.Seen({"idiot": 3.0, "fool": 1.6})
    f = toxicity.features("You IDIOT, fool! 1d1ot and id10t words here", seen)
    assert f[1] >= 3 and f[7] >= 1 and f[10] > 0 and f[14] >= 1
    assert toxicity.features(None, seen) == [0.0] * toxicity.FEATURES


def test_isotonic():
    r = np.random.default_rng(0)
    s, y = r.random(300), (r.random(300) < 0.5).astype(float)
    x, p = toxicity.isotonic(s, y)
    assert (np.diff(p) >= 0).all() and (np.diff(x) > 0).all()
    assert abs(np.interp(s, x, p).mean() - y.mean()) < 0.05


def test_trees_learn():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = toxicity.Trees().fit(x[:1000], y[:1000])
    assert ((t.raw(x[1000:]) > 0) == (y[1000:] > 0)).mean() > 0.95


# quality


def test_quality_held_out(spark):
    out = quality_model.op5_quality_model(spark, SF01)
    rows = out.join(table(spark, SF01, "labels"), "doc_id").filter("held_out").collect()
    assert out.count() == 1000
    clean = [r for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.97 * len(clean)
    assert np.mean([r["expected_grade"] for r in clean]) > np.mean([r["expected_grade"] for r in bad]) + 0.3


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        out = quality_model.graded(odd(spark), given).collect()
        assert len(out) == 8 and not any(r["kept"] for r in out if r["doc_id"] in (1, 2, 3))
    assert quality_model.graded(odd(spark).limit(0), labels).collect() == []


def test_ordinal_orders_grades():
    r = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(1500):
        g = int(r.integers(3))
        rows.append((np.array([g, 10 + int(r.integers(50))]), np.array([0.8, 0.6], np.float32)))
        y.append(g)
    m = quality_model.Ordinal().fit(rows, np.array(y))
    assert (np.diff(m.cuts) >= 0).all()
    grade = [m.tails(np.array([g]), np.array([0.8])) for g in range(3)]
    assert all((np.diff(t) <= 1e-12).all() for t in grade)
    assert grade[0].sum() < 0.5 < 0.7 < grade[1].sum() < 1.3 < 1.5 < grade[2].sum()


def test_ordinal_gradient():
    m = quality_model.Ordinal()
    for y in range(3):
        def loss(s):
            p = np.concatenate([[1.0], 1 / (1 + np.exp(-(s - m.cuts))), [0.0]])
            return -math.log(p[y] - p[y + 1])

        want = (loss(0.3 + 1e-5) - loss(0.3 - 1e-5)) / 2e-5
        assert abs(m._slope(0.3, y, np.arange(2)).sum() - want) < 1e-6


# languages


def brute_profile(text):
    words, n = [], Counter()
    low = (text or "").lower()
    for w in "".join(c if c.isalpha() else " " for c in low).split(" "):
        if w:
            words.append(w)
    for w in words:
        n.update(w)
    joined = "\x01" + "\x01".join(words) + "\x01"
    for i in range(len(joined) - 1):
        n[joined[i : i + 2]] += 1
    for i in range(len(joined) - 2):
        if joined[i + 1] != "\x01":
            n[joined[i : i + 3]] += 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [code(g) for g in sorted(n, key=lambda g: (-n[g], code(g)))[: language_id.TOP]] if words else []


@pytest.mark.parametrize("text", ["", "...", "Abc abc-ab", "Ωmega straße \U00010400x", "the cat and the dog " * 50, "zażółć gęślą jaźń\n" * 3])
def test_profile(text):
    assert language_id.profile(text).tolist() == brute_profile(text)


def test_distance_is_out_of_place():
    p = language_id.Profiles({"a": [1, 2, 3], "b": [3, 9]})
    own = np.array([3, 1])
    want = {"a": (2 + 1) / (300 * 2), "b": (0 + 300) / (300 * 2)}
    for lang, (grams, rank) in zip(p.langs, p.sorted):
        i = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        assert np.where(grams[i] == own, np.abs(rank[i] - np.arange(2)), 300).sum() / 600 == want[lang]


def test_null_ids_do_not_crowd_the_profiles(spark, monkeypatch):
    """Documents without an id, a third of all here, are drawn by their texts like others."""
    monkeypatch.setattr(language_id, "FIT", 30)
    df = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    drawn = []
    monkeypatch.setattr(language_id, "limited_batches", lambda rows: drawn.append(rows.count()) or rows)
    language_id.learn(df)
    assert 10 <= drawn[0] <= 60


def test_language_held_out(spark):
    out = language_id.op8_language_id(spark, SF01)
    rows = out.join(table(spark, SF01, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert out.count() == 1000 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark):
    out = language_id.identified(odd(spark)).collect()
    assert len(out) == 8
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] in (1, 2, 3, 4))
    assert language_id.identified(odd(spark).limit(0)).collect() == []
    assert {r["lang_pred"] for r in language_id.identified(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# language model


def _corpus():
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    return [(i, " ".join(r.choice(vocab[: 5 + i % 55]) for _ in range(r.randint(0, 80))), None, None, 0) for i in range(150)]


def test_counts_and_base_score(spark, monkeypatch):
    """Counts, known tokens and base scores are those of a plain loop, with all words in the table or none."""
    rows = _corpus() + [(None, "W1 w2", None, None, 0), (200, None, None, None, 0), (201, "", None, None, 0), (202, "neverseen W1", None, None, 0), (202, "neverseen W1", None, None, 0), (203, "w3 " * 30_000, None, None, 0)]
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*word_bytes(t or ""), b""]
    c = Counter()
    for i, t, *_ in rows:
        if not is_held(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, is_held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 3)) for i, t, *_ in rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("uid", F.lit("mine")).withColumn("word", F.lit(1))
    for known, own in ((500_000, 4000), (40, 8)):
        monkeypatch.setattr(gru_lm, "KNOWN", known)
        monkeypatch.setattr(gru_lm, "VOCABULARY", own)
        out = gru_lm.scored(df).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in out) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert gru_lm.scored(df.limit(0)).collect() == []


def test_probabilities_sum_to_one():
    counts = np.array([50, 30, 20, 10, 5, 4, 3, 2, 1] + [7] * gru_lm.OTHERS)
    net = gru_lm.Gru(counts)
    h = np.random.default_rng(0).normal(size=(1, gru_lm.STATE)).astype(np.float32)
    p = np.exp(net.output(np.repeat(h, len(counts), 0), np.arange(len(counts))))
    assert abs(p.sum() - 1) < 1e-4


def test_lm_scores_batches_together(monkeypatch):
    """Long documents of several batches run beside each other; no batch is lost, and their order stays."""
    monkeypatch.setattr(gru_lm, "SCORE_TOKENS", 10)
    batch = lambda *sizes: pa.RecordBatch.from_pydict({"ids": pa.array([bytes(4 * n) for n in sizes], pa.binary())})
    batches = [batch(4), batch(3, 2), batch(), batch(1), batch(25), batch(2)]
    got = list(gru_lm.pooled(iter(batches)))
    assert [len(x) for x in got] == [4, 1, 1]
    assert [b for x in got for b in x] == batches
    assert list(gru_lm.pooled(iter([]))) == []


def test_batches_change_nothing():
    """A document's score is the same alone, among others, and whatever the windows: the state is carried."""
    r = np.random.default_rng(3)
    net = gru_lm.Gru(np.array([9, 8, 7, 6, 5, 4, 3, 2] + [1] * gru_lm.OTHERS))
    docs = [r.integers(0, 8 + gru_lm.OTHERS, n) for n in (1, 5, 300, 64, 129, 2, 700)]
    together = net.score(docs)
    for d, s in zip(docs, together):
        h, total = np.zeros((1, gru_lm.STATE), np.float32), 0.0
        for x in d:
            total += float(net.output(h, np.array([x]))[0])
            h = net.step(np.array([x]), h)
        assert abs(total - s) < 1e-2 * max(1, abs(total)) * 0.1
    assert abs(net.score(docs[2:3])[0] - together[2]) < 1e-2
    assert len(net.score([])) == 0


def test_backpropagation():
    """Gradients of a window against finite differences."""
    net = gru_lm.Gru(np.array([9, 8, 7, 6, 5, 4] + [1] * gru_lm.OTHERS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(1)
    ids, new = r.integers(0, 6 + gru_lm.OTHERS, (5, 3)), np.zeros((5, 3), bool)
    new[0] = True
    new[2, 1] = True
    h0 = np.zeros((3, gru_lm.STATE))

    def loss():
        h, total = h0, 0.0
        for x, b in zip(ids, new):
            h = np.where(b[:, None], 0.0, h)
            total -= net.output(h, x).sum()
            h = net.step(x, h)
        return total

    grads = {k: np.zeros_like(v) for k, v in net.p.items()}
    net._window(ids, new, h0, grads)
    for k, g in grads.items():
        if k in ("w", "wb") and not np.abs(g).any():
            continue
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.p[k][i] += 1e-5
        up = loss()
        net.p[k][i] -= 2e-5
        down = loss()
        net.p[k][i] += 1e-5
        assert abs((up - down) / 2e-5 - g[i]) < 1e-3 * max(1, abs(g[i])), k


def test_model_beats_counts(spark):
    out = gru_lm.op3_lm_score(spark, SF).filter("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert out["s"] > out["b"]


def test_every_token_is_learned_from(monkeypatch):
    """Streams of unequal length, a document longer than a stream's share, an empty one: all tokens are in a window, once."""
    net = gru_lm.Gru(np.array([9, 8, 7, 6, 5, 4] + [1] * gru_lm.OTHERS))
    r, seen = np.random.default_rng(2), Counter()
    docs = [r.integers(0, 6, n) for n in (1, 1, 700, 3, 40, 0, 5)]
    plain = net._window

    def window(ids, new, h, grads, here):
        seen.update(ids[here].tolist())
        return plain(ids, new, h, grads, here)

    monkeypatch.setattr(net, "_window", window)
    net.train(docs, epochs=1, most=4)
    assert seen == Counter(np.concatenate(docs).tolist())


def test_partitions_without_words(spark, monkeypatch):
    """Partitions without rows, and those whose last words have just been passed on, are counted like any other."""
    rows = [(i, f"some words w{i}", None, None, 0) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7, "doc_id").filter("doc_id < 5").withColumn("held", F.lit(False))
    assert {r["word"]: r["c"] for r in gru_lm.word_counts(df.select("text", "held")).collect()} == {"": 5, "some": 5, "words": 5} | {f"w{i}": 1 for i in range(5)}
    import pandas as pd

    monkeypatch.setattr(gru_lm, "FLUSH", 1)
    out = list(gru_lm._count(iter([pd.DataFrame({"text": [b"a b"], "held": [False]})] * 2)))
    assert len(out) == 2 and all(len(x) == 3 for x in out)


def test_all_tokens_train_the_model(spark, monkeypatch):
    """By the module's own numbers every token of every training row is in a group, those of repeated rows as often."""
    monkeypatch.setattr(gru_lm, "TRAIN_TOKENS", 400)
    monkeypatch.setattr(gru_lm, "GROUP_TOKENS", 300)
    rows = [(i, " ".join(f"w{(i + j) % 40}" for j in range(30)), None, None, 0) for i in range(100)] + [(5, "the same text", None, None, 0)] * 40 + [(None, None, None, None, 0)]
    got = []
    plain = gru_lm.written

    def written(df, name):
        out = plain(df, name)
        if name == "lm-train":
            got.append((out.select(F.sum(F.length("ids") / 4)).first()[0], out.groupBy("g").agg(F.sum(F.length("ids") / 4).alias("n")).agg(F.max("n")).first()[0]))
        return out

    monkeypatch.setattr(gru_lm, "written", written)
    n = gru_lm.scored(spark.createDataFrame(rows, SCHEMA)).first()["train_tokens"]
    assert n > 2000 and got[0][0] == n and got[0][1] < n / 2


def test_networks_are_averaged():
    nets = [gru_lm.Gru(np.array([9, 8, 7] + [1] * gru_lm.OTHERS), seed) for seed in (1, 2, 3)]
    n = [10.0, 30.0, 60.0]
    rows = [{"piece": i, "n": m, "v": (x * m).tobytes()} for net, m in zip(nets, n) for i, x in enumerate(net.pieces())]
    import pandas as pd

    halves = [pd.DataFrame(rows[: len(rows) // 2]), pd.DataFrame(rows[len(rows) // 2 :])]
    (summed,) = gru_lm._summed(iter(halves))
    out = gru_lm.Gru(np.array([9, 8, 7] + [1] * gru_lm.OTHERS), 4)
    out.set_pieces(summed.to_dict("records"))
    for k in out.p:
        assert np.allclose(out.p[k], sum(net.p[k] * m for net, m in zip(nets, n)) / 100, atol=1e-6)


def test_training_grows_with_the_corpus(spark, monkeypatch):
    """The share of the tokens that is trained on, in groups, with null ids and repeated rows; scores stay finite."""
    for name, value in (("TRAIN_TOKENS", 400), ("GROUP_TOKENS", 300), ("TRAIN_SHARE", 2)):
        monkeypatch.setattr(gru_lm, name, value)
    r = random.Random(2)
    rows = [(None if i % 3 == 0 else i, " ".join(r.choice(["a", "b", "c", f"w{i % 40}"]) for _ in range(30)), None, None, 0) for i in range(300)] + [(5, "the same text", None, None, 0)] * 40
    df = spark.createDataFrame(rows, SCHEMA)
    trained = []
    plain = gru_lm.written

    def written(df, name):
        out = plain(df, name)
        if name == "lm-train":
            trained.append((out.count(), out.select(F.sum(F.length("ids") / 4)).first()[0], out.select("g").distinct().count()))
        return out

    monkeypatch.setattr(gru_lm, "written", written)
    out = gru_lm.scored(df).collect()
    assert len(out) == 340 and all(math.isfinite(r["score"]) for r in out)
    n = out[0]["train_tokens"]
    wanted = 400 + (n - 400) / 2
    assert 0.6 * wanted <= trained[0][1] <= 1.3 * wanted and trained[0][2] >= wanted / 300 / 2


def test_texts_are_cut_once_for_training_and_scores(spark, monkeypatch):
    """One written table has the tokens of every row, held out or not; training and scores start from it."""
    rows = _corpus() + [(None, None, None, None, 0), (300, "", None, None, 0), (301, " A\tb ", None, None, 0), (301, " A\tb ", None, None, 0)]
    df, got, plain = spark.createDataFrame(rows, SCHEMA), [], gru_lm.written

    def written(df, name):
        got.append((name, plain(df, name)))
        return got[-1][1]

    monkeypatch.setattr(gru_lm, "written", written)
    out = gru_lm.scored(df).collect()
    train = next(x for name, x in got if name == "lm-train").collect()
    assert len(train) == len(rows) and all((r["ids"] is None) != (r["rest"] is None) and (r["g"] is None) == (r["ids"] is None) for r in train)
    assert Counter((r["doc_id"], len(r["ids"] or r["rest"]) // 4, r["ids"] is None) for r in train) == Counter((r["doc_id"], r["n_tokens"], r["held_out"]) for r in out)


def test_words_by_columns():
    """Words as bytes.split() has them, whatever the spaces, and an end for each text."""
    import pyarrow as pa

    r = random.Random(4)
    parts = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", " ", "A", "b", "É", "İ", "\x00", "Zß"]
    texts = [None, "", " ", "\t \n", " a", "a ", *("".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(3000))]
    texts = [t if t is None else t.encode() for t in texts]
    got = gru_lm.split(pa.array(texts, pa.binary())).cast(pa.list_(pa.binary())).to_pylist()
    assert got == [[*(t or b"").lower().split(), b""] for t in texts]


def test_adam(monkeypatch):
    """Steps in blocks are those of Adam written out."""
    monkeypatch.setattr(gru_lm, "BLOCK", 100)
    r = np.random.default_rng(5)
    docs = [r.integers(0, 6 + gru_lm.OTHERS, n) for n in (900, 300, 1333, 1)]
    nets = [gru_lm.Gru(np.array([9, 8, 7, 6, 5, 4] + [1] * gru_lm.OTHERS)) for _ in range(2)]
    calls, plain = [], nets[0]._window

    def window(ids, new, h, grads, here):
        calls.append((ids, new, h.copy(), here))
        return plain(ids, new, h, grads, here)

    monkeypatch.setattr(nets[0], "_window", window)
    nets[0].train(docs, epochs=2, most=4, step=0.01)
    p, steps = nets[1].p, len(calls)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for t, (ids, new, h, here) in enumerate(calls, 1):
        g = {k: np.zeros_like(x) for k, x in p.items()}
        nets[1]._window(ids, new, h, g, here)
        for k in p:
            d = g[k] / here.sum()
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
            p[k] -= 0.01 * (1 - 0.9 * (t - 1) / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
    assert steps > 20
    for k in p:
        assert np.abs(p[k] - nets[0].p[k]).max() < 2e-3, k


def test_adam_of_tokens_that_are_rare(monkeypatch):
    """Tokens are moved when they are read again, by all that the steps between would have moved them, whenever sums are decayed."""
    r, n = np.random.default_rng(6), 40 + gru_lm.OTHERS
    counts = np.arange(n, 0, -1)
    docs = [np.minimum(r.geometric(0.15, size), n) - 1 for size in (1800, 2100, 1999)]
    docs[0][[700, 1500]] = n - 1  # in two windows of over 60; others in none
    assert len(np.unique(np.concatenate(docs))) < n
    got = []
    for decay in (1, 7, 10_000):  # with 1, all tokens are moved in every step, as Adam is written
        monkeypatch.setattr(gru_lm, "DECAY", decay)
        net = gru_lm.Gru(counts)
        net.train(docs, epochs=1, most=3, step=0.01)
        got.append(net.p)
    unseen = np.setdiff1d(np.arange(n), np.concatenate(docs))
    start = gru_lm.Gru(counts).p["x"]
    for p in got:
        assert (p["x"][unseen] == start[unseen]).all() and np.abs(p["x"][n - 1] - start[n - 1]).max() > 1e-3
        # all alike, but for numbers whose gradients are about as small as Adam's least root
        assert all(np.abs(p[k] - got[0][k]).mean() < 1e-5 and np.abs(p[k] - got[0][k]).max() < 5e-3 for k in p)


def test_adam_reads_few_tokens(monkeypatch):
    """A step's work on tokens follows those of its window, not the vocabulary: op3_lm_score's budget of CPU seconds."""
    n = 3000 + gru_lm.OTHERS
    net, sizes, plain = gru_lm.Gru(np.arange(n, 0, -1)), [], np.sqrt

    def root(x, *args, **more):
        sizes.append(np.size(x))
        return plain(x, *args, **more)

    monkeypatch.setattr(gru_lm.np, "sqrt", root)
    net.train([np.arange(5).repeat(400)], epochs=1, most=2, step=0.01)
    steps, others = 1000 // gru_lm.WINDOW + 1, sum(x.size for k, x in net.p.items() if k != "x")
    assert sum(sizes) < steps * (others + 5 * 3 * gru_lm.STATE) + 2 * net.p["x"].size


def test_sums_of_runs():
    """Runs of rows, the longest first; more long runs than are summed one by one, and fewer."""
    r = np.random.default_rng(7)
    for tokens in (3, 200):
        ids = np.sort(np.minimum(r.geometric(0.02, 5000), tokens))
        order, rows = r.permutation(5000), r.normal(size=(5000, 4))
        begin, sizes = gru_lm.runs_of(ids)
        by = np.argsort(-sizes, kind="stable")
        got = gru_lm.summed(rows, order, begin[by], sizes[by])
        assert np.allclose(got, np.add.reduceat(rows[order], begin)[by])


def test_groups_across_batches():
    import pandas as pd

    rows = [(0, [1]), (0, [2, 2]), (3, []), (3, [4]), (3, [5]), (7, [6])]
    frame = lambda part: pd.DataFrame({"g": [g for g, _ in part], "ids": [np.array(x, np.int32).tobytes() for _, x in part]})
    for n in (1, 2, 4, 6):
        got = list(gru_lm.grouped(frame(rows[i : i + n]) for i in range(0, len(rows), n)))
        assert [[d.tolist() for d in docs] for docs in got] == [[[1], [2, 2]], [[], [4], [5]], [[6]]]
    assert list(gru_lm.grouped(iter([]))) == []
