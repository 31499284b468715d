"""Small operators that no registered query goes through."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skyquarry.functions import columns as X
from skyquarry.operators import alerts, control, lanes, logs, metrics, traces
from skyquarry.plans import service
from skyquarry.sources import feeds
from skyquarry.streaming import ingest


def test_bucket_index(spark):
    df = spark.createDataFrame([(t,) for t in (-1, 0, 4, 5, 11, 12)], "t long")
    assert [r[0] for r in df.select(X.bucket_index(F.col("t"), 0, 12, 5)).collect()] == [-1, 0, 0, 1, 2, -1]
    assert [r[0] for r in df.select(X.bucket(F.col("t"), 5, 2)).collect()] == [-3, -3, 2, 2, 7, 12]


def test_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": ""},), ({"b": "", "a": "1"},), ({},)], "m map<string,string>")
    assert [r[0] for r in df.select(X.map_get("m", "zz")).collect()] == ["", "", ""]
    ids = [r[0] for r in df.select(X.content_id("m")).collect()]
    assert ids[0] == ids[1] != ids[2]
    assert df.select(X.items("m")).first()[0] == ["a=1", "b="]
    over = F.create_map(F.lit("a"), F.lit("2"), F.lit("c"), F.lit("3"))
    assert df.select(X.overlay(F.col("m"), over)).first()[0] == {"b": "", "a": "2", "c": "3"}


@pytest.mark.parametrize("op,values,want", [("=", ["a"], "a"), ("!=", ["a"], "b"), ("in", ["a", "b"], "ab"), ("not in", ["a"], "b"), ("like", ["a%"], "a"), ("not like", ["a%"], "b"), ("ilike", ["A%"], "a"), ("not ilike", ["A%"], "b")])
def test_matches(spark, op, values, want):
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    assert "".join(r[0] for r in df.filter(X.matches(F.col("v"), op, values)).collect()) == want


def test_rules_from_json():
    r = alerts.rules_from_json('[{"name": "x", "window": 60, "every": 60, "op": ">", "threshold": 3}]')[0]
    assert r == alerts.Rule("x", 60, 60, ">", 3)
    with pytest.raises(ValueError):
        alerts.rules_from_json('[{"name": "x", "window": 60, "every": 60, "op": "~", "threshold": 3}]')


def test_plan_hash_ignores_order():
    assert control.plan_hash(["b", "a"]) == control.plan_hash(["a", "b"]) != control.plan_hash(["a"])


def test_attach_and_truncated(spark):
    rows = spark.createDataFrame([("f1", 1), ("f2", 2), ("f9", 3)], "file string, v long")
    m = spark.createDataFrame([("f1", "k1"), ("f2", "k2")], "file string, content_key string")
    assert {r["v"]: r["content_key"] for r in lanes.attach(rows, m, "file", ["content_key"]).collect()} == {1: "k1", 2: "k2"}
    slots = spark.createDataFrame([("a", 0, 5), ("a", 1, 9), ("b", 3, 50), ("c", 2, 1)], "lane string, seq long, min_time long")
    assert [r["lane"] for r in lanes.truncated(slots, ["lane"], 10).collect()] == ["b"]


def test_union_matching(spark):
    spark.range(2).withColumn("a", F.lit(1)).createOrReplaceTempView("logs_one")
    spark.range(3).withColumn("b", F.lit(2)).createOrReplaceTempView("logs_two")
    out = logs.union_matching(spark, "logs_.*")
    assert out.count() == 5 and set(out.columns) == {"id", "a", "b"}
    t = service.system_tables(spark, {"logs_one": ["id"]}).collect()
    assert [(r["name"], r["column"]) for r in t] == [("logs_one", "id")]
    with pytest.raises(ValueError):
        logs.union_matching(spark, "none_.*")
    for n in ("logs_one", "logs_two"):
        spark.catalog.dropTempView(n)


def test_waterfall(spark):
    s = spark.createDataFrame([("t", 1, "s1", "n", "svc"), ("u", 2, "s2", "n", "svc")], "trace_id string, start long, span_id string, name string, service string")
    g = spark.createDataFrame([("t", 3, "s1", "hello", "svc")], "trace_id string, start long, span_id string, body string, service string")
    assert sorted(r["kind"] for r in traces.waterfall(s, g, "t").collect()) == ["log", "span"]


def test_nanoseconds(spark, tmp_path):
    p = str(tmp_path / "n.parquet")
    pq.write_table(pa.table({"t": pa.array([1_700_000_000_123_456_789], pa.timestamp("ns"))}), p)
    df = feeds.nanosecond_parquet(spark, p)
    assert df.first()["t"] == 1_700_000_000_123_456_789
    assert df.select(F.unix_micros(feeds.micros_of(F.col("t")))).first()[0] == 1_700_000_000_123_456
    assert datetime.datetime.fromtimestamp(1_700_000_000, datetime.UTC).year == 2023


def test_write_sorted(spark, tmp_path):
    p = str(tmp_path / "w")
    ingest.write_sorted(spark.range(100).withColumn("k", F.md5(F.col("id").cast("string"))).repartition(2), p, ["id"], bloom=["k"])
    df = spark.read.parquet(p)
    assert df.count() == 100 and df.filter(F.col("k") == F.md5(F.lit("7"))).first()["id"] == 7
    assert feeds.expired(df.withColumn("day", F.col("id") % 4), "day", 2, 4).count() == 2


def test_samples(spark):
    df = feeds.generated(spark, 1000)
    a = service.sampled(df, "id", 10)
    assert a.collect() == service.sampled(df, "id", 10).collect() and 40 < a.count() < 200


def test_exponential_and_summary_metrics(spark):
    line = '{"resourceMetrics":[{"resource":{},"scopeMetrics":[{"metrics":[{"name":"e","exponentialHistogram":{"aggregationTemporality":1,"dataPoints":[{"timeUnixNano":"5","count":"3","sum":1.5,"scale":2,"zeroCount":"1","positive":{"offset":1,"bucketCounts":["1","1"]}}]}},{"name":"s","summary":{"dataPoints":[{"timeUnixNano":"6","count":"2","sum":2.0,"quantileValues":[{"quantile":0.5,"value":1.0}]}]}},{"name":"h","histogram":{"aggregationTemporality":2,"dataPoints":[{"timeUnixNano":"7","count":"2","sum":2.0,"bucketCounts":["1","1"],"explicitBounds":[1.0]}]}}]}]}]}'
    kinds = feeds.otlp_metrics(spark.createDataFrame([(line,)], "value string"))
    e, s, h = (kinds[k].first() for k in ("exponentialHistogram", "summary", "histogram"))
    assert (e["scale"], e["zero"], e["counts"], e["temporality"]) == (2, 1, [1, 1], 1)
    assert (s["count"], s["quantiles"][0]["value"]) == (2, 1.0)
    assert (h["counts"], h["bounds"], h["time_ns"]) == ([1, 1], [1.0], 7)
    assert kinds["gauge"].count() == 0


@pytest.mark.parametrize("counts,want", [([0, 10, 0], 1.5), ([0, 0, 4], 2.0), ([4, 0, 0], 0.5), ([0, 0, 0], None), ([1, 1, 2], 2.0)])
def test_interpolated(spark, counts, want):
    got = spark.createDataFrame([(counts,)], "c array<long>").select(metrics.interpolated(F.col("c"), [1.0, 2.0], 0.5)).first()[0]
    assert got == want


@pytest.mark.parametrize("values,want", [([0.7, 0.1, 0.775, 1.0] * 7 + [0.75, 0.75, 0.75, 3.175], 0.732813), ([0.0, 2.0], 1.0), ([None, None], None), ([None, 0.5], 0.5), ([1e300, 1.0], 5e299), ([float("inf"), 1.0], float("inf"))])
def test_score_means_at_a_rounding(spark, values, want):
    """Sums of tenths and fortieths over 32 that lie just between two roundings, in any order; nulls; more than decimals hold."""
    spans = spark.createDataFrame([("t", "m"), ("t", "m")], "trace_id string, model string")
    for order in (values, values[::-1], sorted(values, key=repr)):
        rows = spark.createDataFrame([("t", "n", v) for v in order], "trace_id string, name string, value double").coalesce(1)
        assert [tuple(r) for r in traces.score_means(rows, spans).collect()] == [("m", "n", len(values), want)]
