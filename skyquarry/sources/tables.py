"""Readers, and the telemetry views that stand on the given tables.

Each view has the same columns in Spark (a function) and in DuckDB (a text of common table expressions), so that a query
and the SQL it is compared with begin from equal rows.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01, the first day of events, in seconds; a day and an hour.
T0, DAY, HOUR = 1_704_067_200, 86_400, 3_600


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(name)


#: Severities by event type; all other types are INFO.
SEVERITY = {"error": "ERROR", "purchase": "WARN"}


def second(df: DataFrame, name: str, s: int) -> Column:
    """A literal of the column's own type, so that a comparison with it reaches the files' statistics."""
    text = datetime.fromtimestamp(s, UTC).strftime("%Y-%m-%d %H:%M:%S")
    return F.expr(f"timestamp_ntz'{text}'" if dict(df.dtypes)[name] == "timestamp_ntz" else f"timestamp'{text}Z'")


def logs(spark: SparkSession, sf_dir: str, lo: int | None = None, hi: int | None = None, severities: list[str] | None = None, metric: str | None = None) -> DataFrame:
    """events as log rows and metric points, with the envelope of the batch that brought each.

    lo, hi (seconds, half open), severities and metric choose rows by the columns that the files hold, not by those that are
    computed here, so that they are pushed down to the scan and skip row groups.
    """
    e = read(spark, sf_dir, "events")
    if lo is not None:
        e = e.filter(F.col("ts") >= second(e, "ts", lo))
    if hi is not None:
        e = e.filter(F.col("ts") < second(e, "ts", hi))
    if severities:
        wanted = {x.upper() for x in severities}
        if "INFO" in wanted:
            e = e.filter(~F.col("event_type").isin([k for k, v in SEVERITY.items() if v not in wanted])) if set(SEVERITY.values()) - wanted else e
        else:
            e = e.filter(F.col("event_type").isin([k for k, v in SEVERITY.items() if v in wanted]))
    if metric is not None:
        e = e.filter(F.col("event_type") == metric.removeprefix("events."))
    us, u = micros(e, "ts"), F.col("user_id")
    kind = F.col("event_type")
    return e.select(
        "event_id", "user_id", "event_type", "value", us.alias("us"), F.floor(us / 1_000_000).cast("long").alias("s"),
        F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").otherwise("INFO").alias("severity"),
        F.concat(F.lit("events."), kind).alias("metric"), F.regexp_extract("props", r'"k": *([0-9]+)', 1).alias("k"),
        F.concat(F.lit("c"), u % 3).alias("cluster"), F.concat(F.lit("ns"), u % 5).alias("namespace"),
        (F.floor(us / 1_000_000) + (F.col("event_id") * 7919) % 600 + F.when(F.col("event_id") % 50 == 0, 7200).otherwise(0)).cast("long").alias("received"),
        F.floor(F.col("event_id") / 100).cast("long").alias("batch_id"), (F.col("event_id") % 100).alias("row_ordinal"), F.concat(F.lit("p"), F.col("event_id") % 4).alias("producer"),
    )


LOGS = """ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS severity,
  'events.' || event_type AS metric, regexp_extract(props, '"k": *([0-9]+)', 1) AS k,
  'c' || (user_id % 3) AS cluster, 'ns' || (user_id % 5) AS namespace,
  epoch_us(ts) // 1000000 + (event_id * 7919) % 600 + CASE WHEN event_id % 50 = 0 THEN 7200 ELSE 0 END AS received,
  event_id // 100 AS batch_id, event_id % 100 AS row_ordinal, 'p' || (event_id % 4) AS producer FROM events)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as root spans and lineitem as their children."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    key = lambda c: F.md5(F.col(c).cast("string"))
    root = o.select(
        key("o_orderkey").alias("trace_id"), F.concat(F.lit("o"), "o_orderkey").alias("span_id"), F.lit("").alias("parent_id"), F.lit("order").alias("name"), F.col("o_orderpriority").alias("service"),
        F.floor(micros(o, "o_orderdate") / 1_000_000).cast("long").alias("start"), F.floor("o_totalprice").cast("long").alias("duration"), F.when(F.col("o_orderstatus") == "F", "Error").otherwise("Ok").alias("status"),
    )
    child = li.select(
        key("l_orderkey").alias("trace_id"), F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("span_id"), F.concat(F.lit("o"), "l_orderkey").alias("parent_id"), F.lit("line").alias("name"), F.concat(F.lit("supplier "), F.col("l_suppkey") % 10).alias("service"),
        F.floor(micros(li, "l_shipdate") / 1_000_000).cast("long").alias("start"), F.floor(F.col("l_quantity") * 100).cast("long").alias("duration"), F.when(F.col("l_returnflag") == "R", "Error").otherwise("Ok").alias("status"),
    )
    return root.unionByName(child)


SPANS = """sp AS (SELECT md5(o_orderkey::VARCHAR) AS trace_id, 'o' || o_orderkey AS span_id, '' AS parent_id, 'order' AS name, o_orderpriority AS service,
  epoch_us(o_orderdate) // 1000000 AS start, floor(o_totalprice)::BIGINT AS duration, CASE WHEN o_orderstatus = 'F' THEN 'Error' ELSE 'Ok' END AS status FROM orders
  UNION ALL SELECT md5(l_orderkey::VARCHAR), l_orderkey || '-' || l_linenumber, 'o' || l_orderkey, 'line', 'supplier ' || (l_suppkey % 10),
  epoch_us(l_shipdate) // 1000000, floor(l_quantity * 100)::BIGINT, CASE WHEN l_returnflag = 'R' THEN 'Error' ELSE 'Ok' END FROM lineitem)"""


def llm_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as model calls: a turn is a span, a conversation a session, its text a payload."""
    c = read(spark, sf_dir, "conversations")
    n = F.length(F.coalesce("text", F.lit("")))
    return c.select(
        F.concat(F.lit("s"), "conv_id").alias("session_id"), F.concat_ws("-", F.lit("t"), F.col("conv_id"), F.floor(F.col("turn") / 2)).alias("trace_id"), F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("span_id"), "role",
        F.concat(F.lit("m"), F.col("conv_id") % 4).alias("model"), (F.lit(T0) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("start"), (n * 3).cast("long").alias("duration"),
        F.floor(n / 4).cast("long").alias("tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("ref"), F.coalesce("text", F.lit("")).alias("content"), F.concat(F.lit("ns"), F.col("conv_id") % 5).alias("namespace"),
    )


LLM = f"""ls AS (SELECT 's' || conv_id AS session_id, 't-' || conv_id || '-' || (turn // 2) AS trace_id, conv_id || '-' || turn AS span_id, role,
  'm' || (conv_id % 4) AS model, {T0} + conv_id * 3600 + turn * 60 AS start, (length(coalesce(text, '')) * 3)::BIGINT AS duration,
  (length(coalesce(text, '')) // 4)::BIGINT AS tokens, md5(coalesce(text, '')) AS ref, coalesce(text, '') AS content, 'ns' || (conv_id % 5) AS namespace FROM conversations)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as model prices: each is valid from a day, and was recorded six hours before or after."""
    p = read(spark, sf_dir, "part")
    valid = F.lit(T0) + F.col("p_size") * 10_800
    return p.select(F.concat(F.lit("m"), F.col("p_partkey") % 4).alias("model"), F.col("p_partkey").alias("price_id"), valid.cast("long").alias("valid_from"), (valid + F.when(F.col("p_partkey") % 2 == 0, 21_600).otherwise(-21_600)).cast("long").alias("system_from"), (F.col("p_retailprice") / 1_000_000).alias("price"))


PRICES = f"""pr AS (SELECT 'm' || (p_partkey % 4) AS model, p_partkey AS price_id, ({T0} + p_size * 10800)::BIGINT AS valid_from,
  ({T0} + p_size * 10800 + CASE WHEN p_partkey % 2 = 0 THEN 21600 ELSE -21600 END)::BIGINT AS system_from, p_retailprice / 1000000 AS price FROM part)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as score facts: every fourth score is corrected later, every seventh retracted."""
    x = read(spark, sf_dir, "labels")
    d = F.col("doc_id")
    fact = lambda n, value, kind: x.select(
        F.concat(F.lit("q"), d).alias("score_id"), F.concat_ws("-", F.lit("t"), F.floor(d / 10), d % 3).alias("trace_id"), F.when(d % 2 == 0, "helpfulness").otherwise("safety").alias("name"),
        value.cast("double").alias("value"), F.lit(kind).alias("kind"), (F.lit(T0 + n * DAY) + d * 60).cast("long").alias("received"), F.lit(n).cast("long").alias("ordinal"), d.alias("doc_id"))
    first = fact(0, F.col("quality") * 0.75 + (d % 10) / 40, "assert")
    return first.unionByName(fact(1, (d % 10) / 10, "assert").filter(d % 4 == 0)).unionByName(fact(2, F.lit(0.0), "retract").filter(d % 7 == 0))


SCORES = f"""sc AS (SELECT 'q' || doc_id AS score_id, 't-' || (doc_id // 10) || '-' || (doc_id % 3) AS trace_id,
    CASE WHEN doc_id % 2 = 0 THEN 'helpfulness' ELSE 'safety' END AS name, value, kind, ({T0} + n * {DAY} + doc_id * 60)::BIGINT AS received, n::BIGINT AS ordinal, doc_id
  FROM (SELECT doc_id, 0 AS n, quality * 0.75::DOUBLE + (doc_id % 10) / 40.0::DOUBLE AS value, 'assert' AS kind FROM labels
    UNION ALL SELECT doc_id, 1, (doc_id % 10) / 10.0::DOUBLE, 'assert' FROM labels WHERE doc_id % 4 = 0
    UNION ALL SELECT doc_id, 2, 0.0::DOUBLE, 'retract' FROM labels WHERE doc_id % 7 = 0))"""


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
