"""Cases of a review, each of which failed before its change."""

import random

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_exact import found_in

from skyquarry.llm import decontamination as D
from skyquarry.llm import common, simhash
from skyquarry.llm.common import table, word_bytes, written


def brute_copies(rows):
    """Smallest ids of the components of all pairs with a 5-word Jaccard similarity of 0.8."""
    sets = []
    for _, t in rows:
        w = word_bytes(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted(least.values())


@pytest.mark.parametrize("small, part", [(64, 2048), (2, 2048), (2, 16)])
def test_edited_copies_go(spark, monkeypatch, small, part):
    """Copies with some words changed go as by brute force, in buckets of all sizes; a doubled empty text stays once.

    With small and part, nearly all buckets are large ones, of one and of several parts.
    """
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "COPY_ROWS", part)
    r = random.Random(4)
    rows = [(x["doc_id"], x["text"]) for x in table(spark, SF, "documents").select("doc_id", "text").collect()]
    n = max(i for i, _ in rows) + 1
    base = " ".join(f"w{i}" for i in range(120)).split()  # a group of copies that are also far from one another
    for t in [t for _, t in rows[:60]] + [" ".join(base)] * 60:
        w = t.split(" ")
        for _ in range(r.randint(0, 1 + len(w) // 40)):
            w[r.randrange(len(w))] = "changed"
        rows.append((n := n + 1, " ".join(w)))
    rows += [(n + 1, ""), (n + 2, None), (n + 3, "one two"), (n + 4, "one  two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid_", F.lit("mine")).withColumn("code", F.lit("mine"))
    want = brute_copies(rows)
    assert len(want) < len(rows) - 20
    got = simhash.deduplicated(df)
    assert got.columns == df.columns and sorted(x["doc_id"] for x in got.collect()) == want
    assert simhash.deduplicated(df.limit(0)).collect() == []


def test_contradictions_split(spark):
    """A passage stays found where one of two equal values was altered; windows that share no agreement are not."""
    item = "take 3 cups and add 4 spoons then stir 3 times and wait 4 minutes for all of it to set"
    n = len(item.split()) - 7
    altered = item.replace("3", "7", 1)  # the first two windows hold the altered word
    texts = [altered, item.replace("3", "7").replace("4", "9"), "so then " + altered + " and so on", "add 3 and 4 and 5 and 6"]
    want = [(0, 1, n - 2, False), (1, 1, n, True), (2, 1, n - 2, False)]
    assert sorted(found_in(spark, [(1, item), (2, "add 3 and 3 and 3 and 3")], texts)) == want


def test_contradictions_split_in_tables(spark):
    item = "take 3 cups and add 4 spoons then stir 3 times and wait 4 minutes for all of it to set"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("3", "7", 1)), (2, "no such thing")], "doc_id long, text string")
    assert [r["doc_id"] for r in D.contaminated(docs, bench).collect()] == [1] and [r["doc_id"] for r in D.clean(docs, bench).collect()] == [2]


def test_names_begin_sentences(spark):
    """Names that begin sentences may be changed like others; other words there match with and without a capital."""
    item = "Tom has 3 apples. Tom buys 4 more apples. How many apples does Tom have now?"
    texts = [
        item.replace("Tom", "Ana").replace("3", "7").replace("4", "9"), "so tom has 3 apples and no more", "Here we ask: " + item.replace("Tom", "Ana"),
        "Once Ana has 3 apples. Ana buys 4 more apples. How many apples does Ana have now?", "Ana likes 3 pears. Bob sells 4 old pears. How many pears does Eve see now?",
    ]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["changed"]) for r in D.contaminated(docs, bench).collect()) == [(0, True), (2, True), (3, True)]
    assert sorted(r["doc_id"] for r in D.clean(docs, bench).collect()) == [1, 4]


def test_linked_fingerprints_meet(spark):
    """Copies whose fingerprints differ by a few bits meet though no band agrees; texts that only share a fingerprint stay."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "changed"]), " ".join(["changed", *words[1:]]), " ".join(f"v{i}" for i in range(400))]
    sets = [simhash.shingle_set(t) for t in texts]
    fps = [simhash.majority(s) for s in sets]
    assert len(set(fps[:3])) > 1 and all((a ^ fps[0]).bit_count() <= simhash.RADIUS for a in fps[:3])
    fps[3] = fps[0]
    rows = [(i, simhash._signed(fps[i]), [100 * i + j for j in range(simhash.BANDS)], i, t) for i, t in enumerate(texts)]
    one = written(spark.createDataFrame(rows, "code_ long, fp long, bands_ array<long>, uid_ long, text string"), "test-one")
    got = simhash.copy_groups(one.drop("text"), one.select("uid_", "text")).collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 0)]


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    """Sides beyond BROADCAST_ROWS, of which Spark takes the files' size or leaves out the salts, are joined by shuffles."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    big, small = written(spark.range(100).withColumn("t", F.col("id").cast("string")), "test-big"), written(spark.range(0, 100, 3), "test-small")
    for df, n in ((common.join_small(big, small, "id", "left_anti", spread="t"), 66), (common.join_small(big, small, "id", "inner"), 34), (common.join_hot(big, small, "id", "inner"), 34)):
        assert df.count() == n and "SortMergeJoin" in (plan := df._jdf.queryExecution().toString())
        assert "BroadcastHashJoin" not in plan or "hot-keys" in plan


# Windows of placeholders, and tables of other queries


def rows_of_numbers(n, seed=1):
    r = random.Random(seed)
    return " ".join(str(r.randint(1, 10**6)) for _ in range(n))


def test_numbers_are_no_evidence(spark):
    """An item that is a row of numbers isn't found in other numbers, but in the same ones; templates with words are found with other numbers."""
    item = "Continue the sequence: " + " ".join(str(2**i) for i in range(1, 17))
    puzzle = "If a train leaves the station at 5 and travels 30 miles every hour how far has it come by 9"
    bench = spark.createDataFrame([(1, item), (2, " ".join(str(2**i) for i in range(1, 17))), (3, puzzle)], "item_id long, text string")
    texts = [(1, "Monthly rainfall by station: " + rows_of_numbers(40)), (2, "Here: " + " ".join(str(2**i) for i in range(1, 17)) + " and so on"), (3, "Text. " + puzzle.replace("30", "45").replace(" 5 ", " 7 ") + " then?"), (4, rows_of_numbers(3000))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = D.contaminated(docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == {(2, 1), (2, 2), (3, 3)}
    assert sorted(r["doc_id"] for r in D.clean(docs, bench).collect()) == [1, 4]


@pytest.mark.parametrize("n, most", [(800, 2.0), (10_000, 20.0)])
def test_long_tables_take_little_time(spark, n, most):
    """Numbers of period nine against n random ones: seconds as n, not as its square."""
    import time

    bench = spark.createDataFrame([(1, " ".join(str(100 + i % 9) for i in range(27)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, rows_of_numbers(n)), (2, " ".join(str(100 + i % 9) for i in range(n)))], "doc_id long, text string")
    D.contaminated(docs.limit(0), bench).collect()
    began = time.time()
    assert {r["doc_id"] for r in D.contaminated(docs, bench).collect()} == {2}
    took = time.time() - began
    began = time.time()
    D.contaminated(docs.limit(1), bench).collect()
    assert took - (time.time() - began) < most


def test_judge_of_many_alignments():
    """The windows of one template at 800 places, each with other numbers, are judged in about a second."""
    import time

    r = random.Random(3)
    word = lambda x: int(x).to_bytes(8, "little")
    own = [[1, 100 + i % 9, 2, 101 + i % 9, 3, 102 + i % 9, 4, 103 + i % 9] for i in range(20)]
    alignments = []
    for _ in range(800):
        to = {100 + k: r.randint(10**4, 10**6) for k in range(12)}
        alignments.append([(i, b"".join(word(to.get(a, a)) for a in w), b"".join(map(word, w))) for i, w in enumerate(own) if r.random() < 0.5])
    began = time.time()
    verdict = D.judge(alignments, 20, 8)
    assert verdict and verdict[1] and time.time() - began < 3


def test_other_queries_tables_stay(spark):
    """op3 deletes what its own training has written, not what another query of the driver writes meanwhile."""
    import threading

    before = common.n_written()
    theirs = []

    def other():
        theirs.append(written(spark.range(3), "others"))

    with common.own_tables() as own:
        mine = written(spark.range(2), "mine")
        t = threading.Thread(target=other)
        t.start()
        t.join()
    assert len(own) == 1 and common.drop_tables(spark, own) == 1 and common.n_written() == before + 1
    assert theirs[0].count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        mine.count()
    with common.own_tables() as outer:
        with common.own_tables() as inner:
            written(spark.range(1), "inner")
        written(spark.range(1), "outer")
    assert len(inner) == 1 and len(outer) == 2
