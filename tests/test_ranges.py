"""Ranges of steps, samples, sketches, offloaded payloads, depths, joins by slices, pages by files: against plain versions."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from skyquarry.operators import control as C
from skyquarry.operators import entities as E
from skyquarry.operators import logs as L
from skyquarry.operators import offload as O
from skyquarry.operators import ranges as R
from skyquarry.operators import samples as S
from skyquarry.operators import sketches
from skyquarry.operators import traces as T
from skyquarry.operators import work


def plain_windows(points, start, end, step, window):
    """rate and mean of each series by looking at every window's points."""
    out = {}
    for s in {x for x, _, _ in points}:
        for at in range(start, end + 1, step):
            best = {}
            for x, t, v in points:
                if x == s and at - window < t <= at and v is not None:
                    best[t] = max(v, best.get(t, -math.inf))
            ts = sorted(best)
            if not ts:
                continue
            vs = [best[t] for t in ts]
            grown = sum(b if b < a else b - a for a, b in zip(vs, vs[1:]))
            rate = None
            if len(ts) > 1:
                sampled, mean = ts[-1] - ts[0], (ts[-1] - ts[0]) / (len(ts) - 1)
                lo, hi = ts[0] - (at - window), at - ts[-1]
                lo = mean / 2 if lo >= mean * 1.1 else lo
                hi = mean / 2 if hi >= mean * 1.1 else hi
                if grown > 0 and vs[0] >= 0:
                    lo = min(lo, sampled * vs[0] / grown)
                rate = grown * (sampled + lo + hi) / sampled / window
            out[s, at] = (len(ts), sum(vs) / len(vs), rate)
    return out


@pytest.mark.parametrize("step, window", [(60, 300), (50, 75), (100, 30)])
def test_windows(spark, step, window):
    """Windows that overlap, that don't divide by the step, and that leave gaps; restarts, nulls, two points at a time."""
    r = random.Random(step)
    points = [(f"s{r.randint(0, 3)}", r.randint(0, 1500), r.choice([None, *[float(r.randint(0, 40))] * 6])) for _ in range(300)] + [("lone", 500, 3.0)]
    states = R.windows(spark.createDataFrame(points, "series string, t long, v double"), ["series"], "t", "v", 100, 1400, step, window)
    want = plain_windows(points, 100, 1400, step, window)
    means = {(x["series"], x["stamp"]): x["v"] for x in R.avg_over_time(states).collect()}
    assert means.keys() == want.keys() and all(abs(v - want[k][1]) < 1e-9 for k, v in means.items())
    rates = {(x["series"], x["stamp"]): x["v"] for x in R.rate(states, window).collect()}
    assert rates.keys() == {k for k, v in want.items() if v[2] is not None} and all(abs(v - want[k][2]) < 1e-9 for k, v in rates.items())


def test_points_are_added_up_once(spark):
    """Window functions and states of a series need one shuffle beside the one that folds points of one time."""
    df = spark.range(100).select((F.col("id") % 3).alias("s"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    plan = R.windows(df, ["s"], "t", "v", 0, 99, 5, 50)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan


def test_quantile_of_buckets(spark):
    rows = [("a", 1, le, v) for le, v in (("1", 1.0), ("5", 4.0), ("10", 4.0), ("+Inf", 8.0))] + [("b", 1, "1", 5.0), ("c", 1, "-1", 5.0), ("c", 1, "+Inf", 5.0), ("d", 1, "1", 4.0), ("d", 1, "2", 3.0), ("d", 1, "+Inf", 6.0), ("e", 1, "1", 0.0), ("e", 1, "+Inf", 0.0)]
    out = lambda q: {r["k"]: r["v"] for r in R.quantile(spark.createDataFrame(rows, "k string, stamp long, le string, v double"), q, "le", ["k"]).collect()}
    assert out(0.25) == {"a": 1 + 4 * (2 - 1) / 3, "b": None, "c": -1.0, "d": 0.375, "e": None}
    assert out(0.9)["a"] == 10.0 and abs(out(0.6)["d"] - 0.9) < 1e-9


def test_top(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (1, "c", 3.0), (2, "a", 1.0)], "stamp long, k string, v double")
    assert [(r["stamp"], r["k"]) for r in R.top(df, 2, ["k"]).orderBy("stamp", "rank").collect()] == [(1, "b"), (1, "c"), (2, "a")]
    assert [r["k"] for r in R.top(df, 1, ["k"], largest=False).filter("stamp = 1").collect()] == ["a"]


def test_merged_sketches(spark):
    """Merged over steps and series they are as one pass, near the exact values."""
    r = random.Random(4)
    rows = [(f"s{i % 5}", i, r.randint(0, 3000), r.gauss(100, 20)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "series string, t long, id long, v double").repartition(6)
    rolled = sketches.rollup(df, ["series"], "t", 500, "id", "v")
    got = sketches.merge(sketches.merge(rolled, ["series"], 5000), []).select("n", sketches.distinct_count().alias("d"), sketches.quantile(0.9).alias("q")).first()
    exact, values = len({x for _, _, x, _ in rows}), sorted(v for *_, v in rows)
    assert got["n"] == 20_000 and abs(got["d"] - exact) < 0.05 * exact
    assert abs(sum(v <= got["q"] for v in values) / len(values) - 0.9) < 0.03
    one = sketches.merge(sketches.rollup(df, [], "t", 10**6, "id"), []).select(sketches.distinct_count().alias("d")).first()["d"]
    assert one == got["d"]


def test_samples_of_labels(spark):
    rows = spark.createDataFrame([({"a.b": "r", "9x": "1"}, {"a_b": "p", "le": "mine"}, 1_500_000, "h.m", 3, 2.5, [1, 2], [0.5])], "resource map<string,string>, attributes map<string,string>, time_ns long, metric string, count long, sum double, counts array<long>, bounds array<double>")
    out = sorted(((r["name"], dict(r["labels"]), r["t"], r["value"]) for r in S.samples({"histogram": rows}).collect()), key=lambda x: (x[0], x[3] != 3.0))
    base = {"_9x": "1", "a_b": "p"}
    assert out == [("h_m_bucket", base | {"le": "+Inf"}, 1, 3.0), ("h_m_bucket", base | {"le": "0.5"}, 1, 1.0), ("h_m_count", base | {"le": "mine"}, 1, 3.0), ("h_m_sum", base | {"le": "mine"}, 1, 2.5)]


def test_offload(spark):
    rows = [(1, {"prompt": "é" * 30, "pw": "xyz", "list": '[{"a": 1}, "b", 3]', "small": "s", "otel.payload.x.bytes": "9"}), (2, {"prompt": "é" * 30, "big": "y" * 70, "list": "[1, null]", "pw": ""}), (3, None), (4, {"prompt": ""})]
    df = spark.createDataFrame(rows, "row long, attributes map<string,string>")
    policy = O.Policy(keys=["prompt", "list"], redact=["pw"], split=["list"], threshold=60, most=41)
    out, payloads = O.offload(df, policy, F.lit("t"), F.lit(1), "secret", "row")
    got = {r["row"]: r for r in out.collect()}
    a, held = got[1]["attributes"], {r["ref"]: (r["content"], r["first_row"]) for r in payloads.collect()}
    assert a["otel.payload.prompt.bytes"] == "40" and a["otel.payload.list.bytes"] == "18"
    assert a["otel.payload.prompt.truncated_from"] == "60" and a["pw"] == "" and a["otel.payload.pw.redacted_from"] == "3" and a["otel.payload.list.elements"] == "3" and a["small"] == "s" and "otel.payload.x.bytes" not in a
    refs = [x.removeprefix("h:") for x in json.loads(a["list"])]
    assert [held[x][0] for x in refs] == ['{"a":1}', "b", "3"] and held[json.loads(a["prompt"])[0][2:]] == ("é" * 20, 1)
    assert sorted(got[1]["payload_refs"]) == sorted([json.loads(a["prompt"])[0][2:], *refs])
    b = got[2]["attributes"]
    assert held[json.loads(b["list"])[0][2:]] == ("[1, null]", 2) and b["otel.payload.big.truncated_from"] == "70" and "otel.payload.pw.redacted_from" not in b
    assert dict(got[3]["attributes"]) == {} and got[4]["attributes"] == {"prompt": ""} and len(held) == 6


def test_depths(spark):
    """A chain of 10,000, a ring with a tail, a lost parent, ids that repeat."""
    chain = [("c", f"{i}", f"{i - 1}" if i else "") for i in range(10_000)]
    ring = [("r", "a", "c"), ("r", "b", "a"), ("r", "c", "b"), ("r", "tail", "a"), ("r", "root", ""), ("r", "x", "root"), ("r", "x", "root")]
    lost = [("l", "a", "gone"), ("l", "b", "a"), ("l", "self", "self")]
    out = T.depths(spark.createDataFrame(chain + ring + lost, "trace_id string, span_id string, parent_id string"))
    got = [(r["trace_id"], r["span_id"], r["depth"]) for r in out.collect()]
    assert sorted(g for g in got if g[0] == "c") == sorted(("c", f"{i}", i) for i in range(10_000))
    assert sorted(map(str, (g for g in got if g[0] != "c"))) == sorted(map(str, [("r", k, None) for k in ("a", "b", "c", "tail")] + [("r", "root", 0), ("r", "x", 1), ("r", "x", 1)] + [("l", k, None) for k in ("a", "b", "self")]))
    assert T.depths(spark.createDataFrame([], "trace_id string, span_id string, parent_id string")).collect() == []


def test_slices_meet_once(spark):
    """An interval and a point in it share one block, whatever the width of slices."""
    r = random.Random(2)
    ivs = [(i, a, a + r.randint(0, 60)) for i, a in enumerate(r.randint(-20, 220) for _ in range(60))] + [(99, 50, None)]
    pts = [(i, r.randint(0, 200)) for i in range(80)]
    iv, pt = spark.createDataFrame(ivs, "i long, a long, b long"), spark.createDataFrame(pts, "p long, t long")
    for slices in (1, 4, 16, 4096):
        s = work.Slices.of(pt, "t", slices)
        met = s.points(pt, F.col("t")).join(s.intervals(iv, F.col("a"), F.col("b")), work.ON).filter("t >= a and (b is null or t <= b)")
        assert sorted((x["p"], x["i"]) for x in met.collect()) == sorted((p, i) for p, t in pts for i, a, b in ivs if a <= t and (b is None or t <= b))


def test_many_gaps_of_one_cluster(spark):
    """20,000 versions and 20,000 gaps of one cluster; the join is by cluster and block."""
    n = 20_000
    versions = spark.range(n).select(F.lit("c").alias("k"), F.col("id").alias("version"), (F.col("id") * 10).alias("valid_from"), (F.col("id") * 10 + 10).alias("closed_at"))
    gaps = spark.range(n).select(F.lit("c").alias("k"), (F.col("id") * 10 + 3).alias("lo"), (F.col("id") * 10 + 3 + F.when(F.col("id") % 100 == 0, 8).otherwise(2)).alias("hi"))
    out = E.in_gaps(versions, gaps, "k")
    assert out.filter("uncertain").count() == 2 * n // 100  # the end of one and the beginning of the next
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "level_" in plan and "block_" in plan


def test_residual_attributes(spark):
    facts = spark.createDataFrame([(1, "e1", {"k": "x"}), (2, "e1", {}), (3, "e2", None), (4, "e9", {"k": ""}), (5, "e2", {"k": "y"})], "i long, e string, res map<string,string>")
    kv = spark.createDataFrame([("k", "x", "e2"), ("k", "y", "e1")], "key string, value string, e string")
    ask = lambda op, vs, **m: sorted(r["i"] for r in E.attribute_filter(facts, kv, "e", "k", op, vs, residual="res", **m).collect())
    assert ask("=", ["x"]) == [1, 3] and ask("!=", ["x"]) == [2, 4, 5] and ask("=", [""]) == [4] and ask("like", ["%"]) == [1, 2, 3, 4, 5]
    assert ask("=", ["x"], covered=["other"]) == [1] and ask("!=", ["x"], covered=["other"]) == [2, 3, 4, 5] and ask("=", ["x"], covered=["k"]) == [1, 3]


def test_scoped_watermark(spark):
    rows = [(None, None, 100), (None, "logs", 120), ("a", None, 150), ("a", "logs", 180), ("a", "", 160), ("b", None, 90)]
    p = spark.createDataFrame(rows, "cluster string, signal string, value long")
    at = lambda *a, **k: {r["cluster"]: r["complete_through"] for r in C.scoped_watermark(p, *a, **k).collect()}
    assert at(["a", "b", "c"], None, 130) == {"a": 150, "b": 100, "c": 130}
    assert at(["a"], ["logs"]) == {"a": 180} and at(["a"], ["logs", "spans"]) == {"a": 160} and at(["b"], ["logs"]) == {"b": 100}
    assert at() == {None: 100} and at(None, ["logs"]) == {None: 120}


def test_newest_rows_by_files(spark, tmp_path):
    r = random.Random(7)
    paths = []
    for i in range(20):
        rows = [(i * 100 + j, i * 50 + r.randint(0, 60)) for j in range(40)]
        paths.append((str(tmp_path / f"f{i}"), max(t for _, t in rows) if i != 3 else None))
        spark.createDataFrame(rows, "id long, s long").coalesce(1).write.parquet(paths[-1][0])
    files = spark.createDataFrame(paths, "path string, max_time long")
    read = lambda ps: spark.read.schema("id long, s long").parquet(*ps)
    every = read([p for p, _ in paths])
    for n in (1, 30, 90, 5000):
        page, done = L.newest_by_files(files, n, "s", ["id"], read, first=2)
        assert [tuple(x) for x in page.collect()] == [tuple(x) for x in L.newest(every, n, "s", "id").collect()]
        assert done == 20 if n == 5000 else done < 20


def test_file_skew(spark, tmp_path):
    spark.createDataFrame([("p", 1000), ("p", 2000)], "producer string, received long").coalesce(1).write.parquet(str(tmp_path / "f"))
    r = C.file_skew(spark.read.parquet(str(tmp_path / "f")), "received", ["producer"]).first()
    assert r["least"] == r["most"] == r["median"] > 1_000_000_000


def test_running_counts(spark):
    """Counts go on from slice to slice, also over slices without rows; rows of one time by their order."""
    r = random.Random(7)
    rows = [(f"k{r.randint(0, 2)}", r.choice([r.randint(0, 400), r.randint(-50, 4000)]), i, r.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v double").repartition(5)
    got = {x["i"]: (x["n"], x["low"]) for x in R.running(df, ["k"], "t", ["i"], {"n": F.lit(True), "low": F.col("v") <= 0.3}, 60).collect()}
    want, seen = {}, {}
    for k, _, i, v in sorted(rows, key=lambda x: (x[1], x[2])):
        n, low = seen.get(k, (0, 0))
        want[i] = seen[k] = (n + 1, low + (v <= 0.3))
    assert got == want


def test_no_window_over_a_whole_series_of_points(spark):
    """Points are sorted within parts and slices of time; whole series only where their parts are added up."""
    from conftest import SF

    from skyquarry.plans import more

    for query in (more.range_histogram_quantile, more.range_rate):
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.splitlines() if "Window [" in x and ("event_id" in x or "t_#" in x)]
        assert windows and all("slice_#" in x or "part_#" in x for x in windows)
