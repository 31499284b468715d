"""Every query with SQL gives the rows that DuckDB gives."""

import pytest
from conftest import SF, same_rows

from skyquarry.plans import feeds, follow, keep, more, observe, rest

ALL = {n: (f, m.SQL[n]) for m in (observe, follow, keep, feeds, rest, more) for n, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", ALL)
def test_query(spark, duck, name):
    f, sql = ALL[name]
    same_rows(f(spark, SF), duck, sql)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["bucket", "severity", "n"]


def test_filters_reach_the_scan(spark):
    """Columns are pruned, and the filter is among those that the scan gets."""
    plan = observe.topk_gauge(spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema, pushed = (plan.split(x)[1].splitlines()[0] for x in ("ReadSchema: ", "PushedFilters: "))
    assert "user_id" in schema and "value" in schema and "props" not in schema and "event_id" not in schema
    assert "EqualTo(event_type,view)" in pushed
