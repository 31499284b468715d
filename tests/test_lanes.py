"""Lanes of entities as claims, index shards, plans that are made again, watermark history, payload references."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from skyquarry.operators import control as C
from skyquarry.operators import entities as E
from skyquarry.operators import index as I
from skyquarry.operators import metrics as M
from skyquarry.operators import traces as T

RECORD = "lane string, n long, o long, kind string, entity string, version string, t long, until long"


def brute_claims(records):
    """One record after another, with what is alive kept by hand."""
    out = []
    for lane in sorted({r[0] for r in records}):
        mine = sorted((r for r in records if r[0] == lane), key=lambda r: (r[1], r[2]))
        log, alive, waiting = [], {}, []  # log: (entity, version or None, t) in order
        for n in sorted({r[1] for r in mine}):
            objects = [r for r in mine if r[1] == n]
            syncs = [r for r in objects if r[3] == "sync"]
            if syncs:
                t = max(r[6] for r in syncs)
                for i in waiting:
                    out[i][6] = t
                waiting = []
                there = {r[4] for r in objects if r[3] in ("sync", "delta") and r[4] is not None}
                for e in sorted(k for k, v in alive.items() if v and k not in there):
                    out.append([lane, e, "retract", n << 24, None, t, None])
                    log.append((e, None, t))
                    alive[e] = False
            for _, _, o, kind, e, v, t, until in objects:
                if kind in ("delta", "sync") and e is not None:
                    out.append([lane, e, "retract" if v is None else "assert", (n << 24) + o + 1, v, t, None])
                    log.append((e, v, t))
                    alive[e] = v is not None
                elif kind in ("gap", "restart"):
                    if kind == "gap" and until is not None and until <= t:
                        continue
                    at = {}
                    for x, w, when in log:
                        if when <= t:
                            at[x] = w
                    for x in sorted(k for k, w in at.items() if w is not None):
                        out.append([lane, x, "unknown", (n << 24) + o + 1, None, t, until if kind == "gap" else None])
                        if kind == "restart":
                            waiting.append(len(out) - 1)
    return out


def got_claims(spark, records):
    df = E.claims_from_lanes(spark.createDataFrame(records, RECORD))
    assert {r["source"] for r in df.collect()} <= {"controller"}
    return sorted([list(r) for r in df.select("lane", "entity", "kind", "seq", "version", "valid_from", "valid_to").collect()], key=str)


def test_lanes_as_claims(spark):
    """Random lanes: deltas, closes, syncs (empty ones too), gaps and restarts, several records an object."""
    r = random.Random(12)
    for _ in range(6):
        records = []
        for lane in "ab":
            t = 0
            for n in range(12):
                t += 100
                kind, o = r.choice(["delta", "delta", "sync"]), 0
                if kind == "sync":
                    records.append((lane, n, 0, "sync", None, None, t, None))
                for e in r.sample("pqrs", r.randint(0, 3)):
                    o += 1
                    gone = kind == "delta" and r.random() < 0.3
                    records.append((lane, n, o, kind, e, None if gone else f"v{r.randint(0, 9)}", t if kind == "sync" else t + o, None))
                if r.random() < 0.3:
                    records.append((lane, n, o + 1, r.choice(["gap", "restart"]), None, None, t - 50, t + r.choice([-60, 40])))
        assert got_claims(spark, records) == sorted(brute_claims(records), key=str)


def test_claims_of_gaps_leave_their_join_as_they_are(spark):
    """They can be gaps times entities, so no task may hold them to make them different; a gap told twice still counts once."""
    records = [("a", n, o, "delta", e, "v1", 100 * n, None) for n in (1, 2) for o, e in enumerate("pqr")]
    records += [("a", 3, 0, "gap", None, None, 300, 350), ("a", 3, 0, "gap", None, None, 300, 350), ("a", 4, 0, "gap", None, None, 150, 350)]
    df = E.claims_from_lanes(spark.createDataFrame(records, RECORD))
    unknown = sorted((r["entity"], r["seq"] >> 24) for r in df.filter("kind = 'unknown'").collect())
    assert unknown == [(e, n) for e in "pqr" for n in (3, 4)]
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    outermost = min((len(x) - len(x.lstrip(" :+-")) for x in plan if "Join" in x and "block_" in x))
    above = [x for x in plan[1:] if len(x) - len(x.lstrip(" :+-")) < outermost]
    assert not [x for x in above if "Aggregate" in x or "Distinct" in x]


def resolved(spark, records, entity, vt):
    claims = E.claims_from_lanes(spark.createDataFrame(records, RECORD))
    rows = [r for r in E.point(claims, vt, 1 << 40, 1200).collect() if r["entity"] == entity]
    return (rows[0]["status"], rows[0]["version"]) if rows else ("absent", None)


def test_lane_histories(spark):
    delta = lambda n, o, e, v, t: ("l", n, o, "delta", e, v, t, None)
    relabelled = [delta(1, 1, "a", "11", 5), delta(2, 1, "a", None, 100), delta(2, 2, "a", "12", 100), delta(3, 1, "a", None, 200)]
    assert [resolved(spark, relabelled, "a", t) for t in (4, 5, 99, 100, 199, 200)] == [("absent", None), ("asserted", "11"), ("asserted", "11"), ("asserted", "12"), ("asserted", "12"), ("retracted", None)]
    within = [delta(1, 1, "a", "11", 100), delta(1, 2, "a", None, 300)]
    assert [resolved(spark, within, "a", t) for t in (99, 100, 299, 300)] == [("absent", None), ("asserted", "11"), ("asserted", "11"), ("retracted", None)]
    synced = [delta(1, 1, "a", "11", 5), delta(1, 2, "b", "21", 5), ("l", 2, 0, "sync", None, None, 300, None), ("l", 2, 1, "sync", "b", "21", 300, None), delta(3, 1, "c", "31", 350)]
    assert [resolved(spark, synced, "a", t) for t in (299, 300)] == [("asserted", "11"), ("retracted", None)]
    assert resolved(spark, synced, "b", 400) == ("asserted", "21") and resolved(spark, synced, "c", 350) == ("asserted", "31")
    gap = [delta(1, 1, "a", "11", 5), delta(1, 2, "b", "21", 5), delta(2, 1, "b", None, 50), delta(3, 1, "a", None, 121), ("l", 3, 2, "gap", None, None, 100, 121)]
    assert [resolved(spark, gap, "a", t)[0] for t in (99, 100, 120, 121)] == ["asserted", "unknown", "unknown", "retracted"]
    assert resolved(spark, gap, "b", 110)[0] == "retracted"  # gone before the gap began


def test_index_of_hours_and_days(spark, tmp_path):
    """Whatever is merged, a look-up finds the files of the hours asked for and no shard is read for other keys."""
    r = random.Random(5)
    rows = [(f"k{r.randint(0, 30)}", f"f{i % 17}", 3600 * r.randint(0, 71)) for i in range(400)]
    path = str(tmp_path / "index")
    I.write_hours(spark.createDataFrame(rows, "key string, file string, hour long"), path)
    keys = ["k1", "k2", "k30", "none"]
    want = lambda lo, hi: {(k, f) for k, f, h in rows if k in keys and lo <= h < hi}
    look = lambda lo, hi, merged: {tuple(x) for x in I.look_up(spark, path, keys, lo, hi, merged).collect()}
    assert look(0, 3 * I.DAY, set()) == want(0, 3 * I.DAY) and look(3600 * 5, 3600 * 30, set()) == want(3600 * 5, 3600 * 30)
    for day in (0, I.DAY):
        I.merge_day(spark, path, day)
        I.merge_day(spark, path, day)
    assert look(0, 3 * I.DAY, {0, I.DAY}) == want(0, 3 * I.DAY)
    # of merged days a superset: all files of the day
    assert want(3600 * 5, 3600 * 30) <= look(3600 * 5, 3600 * 30, {0, I.DAY}) <= want(0, 2 * I.DAY)
    plan = I.look_up(spark, path, ["k1"], 0, I.DAY, {0})._jdf.queryExecution().executedPlan().toString()
    assert "shard" in plan.split("PartitionFilters:")[1].splitlines()[0]


def test_plans_are_made_again(spark, tmp_path):
    """A file that goes between plan and read: planned again; if that never helps, no answer at all."""
    old, new = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(5).coalesce(1).write.parquet(old)
    spark.range(5).coalesce(1).write.parquet(new)
    plans = []

    def plan(paths):
        def make():
            plans.append(paths[min(len(plans), len(paths) - 1)])
            df = spark.read.schema("id long").parquet(plans[-1])
            if plans[-1] == old:
                for f in (tmp_path / "a").glob("*.parquet"):
                    f.unlink()
            return df

        return make

    assert C.answered(plan([old, new]), lambda df: len(df.collect())) == 5 and plans == [old, new]
    with pytest.raises(ZeroDivisionError):
        C.answered(lambda: 1, lambda _: 1 / 0)

    def gone():
        p = tmp_path / f"g{len(plans)}"
        plans.append(p)
        spark.range(2).coalesce(1).write.parquet(str(p))
        df = spark.read.schema("id long").parquet(str(p))
        for f in p.glob("*.parquet"):
            f.unlink()
        return df

    with pytest.raises(C.Failed):
        C.answered(gone, lambda df: df.collect())


def test_hourly_history(spark):
    steps = spark.createDataFrame([("a", 100, 1), ("a", 3700, 2), ("a", 3900, 3), ("a", 11_000, 4), ("b", 7300, 9)], "k string, at long, c long")
    got = {(r["k"], r["hour"]): (r["c"], r["at"], r["final"]) for r in C.hourly_history(steps, ["k"], 3600, 14_400, 10_800).collect()}
    assert got == {("a", 3600): (3, 3900, True), ("a", 7200): (3, 3900, True), ("a", 10_800): (4, 11_000, False), ("b", 7200): (9, 7300, True), ("b", 10_800): (9, 7300, False)}
    early = C.hourly_history(steps, ["k"], 7200, 10_800, 0).filter("k = 'a'").collect()
    assert [(r["hour"], r["c"]) for r in early] == [(7200, 3)]


def test_keyed_references(spark):
    """Equal contents of a tenant and day share a reference; another tenant, day or key has another."""
    df = spark.createDataFrame([("x", "a", 1), ("x", "a", 1), ("x", "b", 1), ("x", "a", 2), ("y", "a", 1), ("", "a", 1)], "c string, t string, d long")
    ref = lambda secret: [r[0] for r in df.select(T.keyed_ref(F.col("c"), F.col("t"), F.col("d"), secret)).collect()]
    one = ref("s")
    assert one[0] == one[1] and len(set(one)) == 5 and not set(one) & set(ref("other"))
    h = lambda *parts: hashlib.sha256(b"".join(parts)).digest()
    key = h(b"s", h(b"s", b"a\x1f1"))
    assert one[0] == h(key, h(key, b"x")).hex()


def test_histogram_rollups_merge(spark):
    """Roll-ups of parts, merged, are the roll-up of the whole; resets count as a new beginning."""
    rows = [("a", t, [t // 3 % 7, t]) for t in range(0, 60, 3)] + [("b", t, [5, 60 - t]) for t in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "k string, t long, counts array<long>")
    whole = {r["bucket"]: (r["n"], r["counts"]) for r in M.merge_histograms(M.histogram_rollup(df, ["k"], 10, 2), [], 30, 2).collect()}
    want = {}
    for k in "ab":
        mine = [r for r in rows if r[0] == k]
        for old, (_, t, c) in zip([None, *mine], mine):
            d = [0, 0] if old is None else c if any(x < y for x, y in zip(c, old[2])) else [x - y for x, y in zip(c, old[2])]
            n, s = want.get(t - t % 30, (0, [0, 0]))
            want[t - t % 30] = (n + 1, [x + y for x, y in zip(s, d)])
    assert whole == want
