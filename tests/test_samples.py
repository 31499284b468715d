"""Samples: labels with odd names, and what a query over all kinds reads; depths of spans."""

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from skyquarry.operators.samples import labels_of, samples
from skyquarry.plans import more

_M = "map<string,string>"


def plain_labels(resource, attributes):
    named = [(re.sub("[^a-zA-Z0-9_:]", "_", k), v) for k, v in [*resource, *attributes]]
    return dict(sorted({("_" + k if k[:1].isdigit() else k): v for k, v in named}.items()))


@pytest.mark.parametrize(
    "resource, attributes",
    [([], []), ([("", "e")], []), ([("a.b", "1"), ("a_b", "2")], [("a-b", "3"), ("c", None)]), ([("user", "r")], [("user", "a")]), ([("9x", "1"), ("\n", "2"), ("b\n7", "3")], [("_9x", "4")]), ([("z\n", "1")], [("é1", "2"), ("1", "3"), ("a", "")]), ([("b", "1")], [("a", "2"), ("$1", "3")])],
)
def test_labels(spark, resource, attributes):
    df = spark.createDataFrame([(dict(resource), dict(attributes))], f"r {_M}, a {_M}")
    got = df.select(labels_of(F.col("r"), F.col("a")).alias("l"), F.map_keys(labels_of(F.col("r"), F.col("a"))).alias("k")).first()
    want = plain_labels(resource, attributes)
    assert got["l"] == want and got["k"] == list(want)


def test_own_label_replaces(spark):
    df = spark.createDataFrame([({"le": "r", "x": "1"}, {}, 1_000_000, "m", 2, 3.0, [1, 1], [0.5])], f"resource {_M}, attributes {_M}, time_ns long, metric string, count long, sum double, counts array<long>, bounds array<double>")
    rows = {(r["name"], r["labels"]["le"], r["value"]) for r in samples({"histogram": df}).collect()}
    assert rows == {("m_bucket", "0.5", 1.0), ("m_bucket", "+Inf", 2.0), ("m_sum", "r", 3.0), ("m_count", "r", 2.0)}


def test_all_kinds_read_events_once(spark):
    """Points are made once for the five kinds, not by a scan and a shuffle of the events for each."""
    plan = more.prometheus_all_kinds(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_depths_write_a_root_once(spark, monkeypatch):
    """Spans that have their depth are not written again, and traces are only counted if one round is not enough."""
    from skyquarry.operators import traces as T

    wrote = []
    real = T.written
    monkeypatch.setattr(T, "written", lambda df, name: wrote.append(real(df, name)) or wrote[-1])
    rows = [("t", f"{i}", "" if i == 0 else f"{i - 1}") for i in range(9)] + [("u", "0", ""), ("u", "1", "0"), ("r", "a", "b"), ("r", "b", "a"), ("r", "c", "b"), ("l", "x", "lost"), ("u", "1", "2")]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string")
    got = {(r["trace_id"], r["span_id"], r["parent_id"]): r["depth"] for r in T.depths(df).collect()}
    assert got == {(t, s, p): int(s) if t in "tu" else None for t, s, p in rows}
    sizes = [x.count() for x in wrote]
    assert sizes[0] == 15 and sum(x.filter("up is null").count() for x in wrote) == 11 and sizes == sorted(sizes, reverse=True)
