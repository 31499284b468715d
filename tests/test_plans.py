"""Physical plans are the ones that are wanted: filters at the scan, few columns, no join by nested loops, no Python."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from skyquarry.operators import entities as E
from skyquarry.operators.control import Basis
from skyquarry.operators.scope import scoped_sql
from skyquarry.plans import feeds, follow, keep, observe, rest


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scope_and_basis_reach_the_scan(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.createDataFrame([("a", "x", 1, 5, "wide"), ("b", "y", 2, 6, "wide")], "cluster string, namespace string, s long, received long, body string").write.parquet(p)
    df = spark.read.parquet(p).filter(Basis({"a": 10}).predicate("received", "cluster"))
    text = plan(scoped_sql(spark, "SELECT s, count(*) AS n FROM logs WHERE s > 0 GROUP BY s", {"logs": df}, [("a", "*")]))
    pushed = text.split("PushedFilters:")[1].splitlines()[0]
    assert "EqualTo(cluster,a)" in pushed and "LessThan(received,10)" in pushed and "GreaterThan(s,0)" in pushed
    assert "body" not in text.split("ReadSchema:")[1].splitlines()[0]


ALL = {n: f for m in (observe, follow, keep, feeds, rest) for n, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", ALL)
def test_no_python_and_no_products(spark, name):
    text = plan(ALL[name](spark, SF))
    assert not any(x in text for x in ("Python", "Pandas", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_top_n_is_not_a_sort(spark):
    assert "TakeOrderedAndProject" in plan(observe.log_newest_n(spark, SF))


def test_series_are_combined_before_the_shuffle(spark):
    text = plan(observe.kv_rollup_15m(spark, SF))
    assert text.index("HashAggregate") < text.index("Exchange") < text.rindex("partial_count")


def test_as_of_joins_meet_a_slice(spark):
    """Joined on the key and the slice of time; what a fact is compared with is a small part of its key's versions."""
    for df in (follow.cost_asof_price(spark, SF), follow.catalog_join_asof(spark, SF)):
        joins = [x for x in plan(df).splitlines() if "Join" in x]
        assert any("slice_" in x for x in joins), joins
    dim = spark.range(1000).select(F.lit("hot").alias("k"), (F.col("id") * 10).alias("valid_from"), (F.col("id") * 10 + 10).alias("valid_to"), "id")
    facts = spark.range(0, 10_050, 7).select(F.lit("hot").alias("k"), (F.col("id") - 20).alias("t"))
    plain = E.join_as_of(facts, dim, ["k"], "t").collect()
    assert sorted(plain) == sorted(E.join_as_of(facts, dim, ["k"], "t", span=(0, 9_000)).collect()) and sum(r["id"] is None for r in plain) > 2


@pytest.mark.parametrize("name", ["log_search_hist", "log_newest_n"])
def test_times_reach_the_scan(spark, name):
    pushed = plan(ALL[name](spark, SF)).split("PushedFilters:")[1].splitlines()[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "event_type" in pushed, pushed


def test_metrics_reach_the_scan(spark):
    assert "EqualTo(event_type,view)" in plan(observe.topk_gauge(spark, SF)).split("PushedFilters:")[1].splitlines()[0]


def test_severities_by_type(spark):
    from skyquarry.sources.tables import logs

    every = logs(spark, SF)
    for wanted in (["info"], ["ERROR"], ["INFO", "warn"], ["INFO", "WARN", "ERROR"]):
        assert logs(spark, SF, severities=wanted).count() == every.filter(F.col("severity").isin([w.upper() for w in wanted])).count()


def test_children_only_meet_possible_parents(spark):
    """lineitem is read once, for the children."""
    assert plan(follow.span_parent_child(spark, SF)).count("lineitem.parquet") <= 1


def test_text_is_read_for_few_columns(spark):
    text = plan(observe.topk_gauge(spark, SF).filter(F.lit(True)))
    schema = text.split("ReadSchema:")[1].splitlines()[0]
    assert "props" not in schema and "ts" not in schema.replace("struct", "")
