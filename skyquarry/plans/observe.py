"""Queries over logs and metrics, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import bucket, has_tokens
from ..operators import logs as L
from ..operators import metrics as M
from ..sources.tables import DAY, HOUR, LOGS, T0, logs, read, with_

LO, HI = T0 + 5 * DAY, T0 + 12 * DAY
BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
QUERIES, SQL = {}, {}
EV = with_(LOGS)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f
    return add


@query(EV + f"SELECT s - s % 21600 AS bucket, severity, count(*) AS n FROM ev WHERE s >= {LO} AND s < {HI} AND severity IN ('ERROR', 'WARN') GROUP BY ALL")
def log_search_hist(spark, d):
    rows = logs(spark, d, LO, HI, ["error", "warn"])
    return L.histogram(rows, "severity", "s", 21_600)


@query(EV + f"SELECT event_id, s, severity, value FROM ev WHERE s >= {LO} AND s < {HI} AND severity = 'ERROR' ORDER BY us DESC, event_id LIMIT 50")
def log_newest_n(spark, d):
    rows = logs(spark, d, LO, HI, ["ERROR"])
    return L.newest(rows, 50, "us", "event_id").select("event_id", "s", "severity", "value")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'license') ")
def log_text_contains(spark, d):
    return L.containing(read(spark, d, "documents"), "text", "LICENSE").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])apache([^a-z0-9_]|$)') AND regexp_matches(lower(text), '(^|[^a-z0-9_])license([^a-z0-9_]|$)') AND lower(text) LIKE '%apache license%'")
def log_token_search(spark, d):
    t = F.col("text")
    rows = read(spark, d, "documents").filter(F.lower(t).contains("apache license"))  # the cheap test first
    return rows.filter(has_tokens(t, ["apache", "license"])).select("doc_id", "source")


@query("SELECT doc_id, n_chars, md5(text) AS body FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def log_details_late(spark, d):
    return L.newest_then_details(read(spark, d, "documents"), 20, "n_chars", "doc_id").select("doc_id", "n_chars", F.md5("text").alias("body"))


@query(EV + "SELECT metric, cluster, s - s % 3600 AS bucket, count(value) AS n, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM ev GROUP BY metric, cluster, bucket")
def metric_chart(spark, d):
    return M.chart(logs(spark, d), ["metric", "cluster"], "s", "value", HOUR).withColumn("sum", F.round("sum", 4))


def _counter(spark, d, reset=None):
    return M.cumulative_counter(logs(spark, d), ["user_id", "metric"], ["us", "event_id"], reset=reset)


_CT = EV + ", ct AS (SELECT *, sum(value) OVER (PARTITION BY user_id, metric ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS total FROM ev)\n"


@query(_CT + f""", r AS (SELECT user_id, metric, cluster, s - s % {DAY} AS bucket,
  (arg_max(total, (s, event_id)) - arg_min(total, (s, event_id))) / greatest(max(s) - min(s), 1) AS r FROM ct GROUP BY ALL)
SELECT cluster, metric, bucket, round(sum(r), 6) AS rate FROM r GROUP BY ALL""")
def counter_rate(spark, d):
    out = M.counter_rate(_counter(spark, d), ["user_id", "metric"], ["cluster", "metric"], "s", "total", DAY, "event_id")
    return out.withColumn("rate", F.round("rate", 6))


@query(_CT + f""", r AS (SELECT user_id, s - s % {DAY} AS bucket, cluster, metric, (arg_max(total, (s, event_id)) - arg_min(total, (s, event_id))) / greatest(max(s) - min(s), 1) AS r
  FROM ct WHERE namespace = 'ns2' GROUP BY ALL) SELECT metric, bucket, round(sum(r), 6) AS rate FROM r GROUP BY ALL""")
def series_semi_filter(spark, d):
    """Rate of the series that an attribute of the series table picks (semi join on two keys)."""
    points = _counter(spark, d)
    series = points.select("user_id", "metric", "namespace").distinct().filter("namespace = 'ns2'")
    rows = points.drop("namespace").join(series, ["user_id", "metric"], "left_semi")
    return M.counter_rate(rows, ["user_id", "metric"], ["metric"], "s", "total", DAY, "event_id").withColumn("rate", F.round("rate", 6))


_RESET = EV + """, rn AS (SELECT *, (row_number() OVER (PARTITION BY user_id, metric ORDER BY us, event_id) - 1) // 5 AS part FROM ev),
ct AS (SELECT *, sum(value) OVER (PARTITION BY user_id, metric, part ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS total FROM rn),
g AS (SELECT *, greatest(coalesce(total - lag(total) OVER (PARTITION BY user_id, metric ORDER BY us, event_id), 0), 0) AS rate FROM ct)
"""


@query(_RESET + f"SELECT metric, s - s % {DAY} AS bucket, round(sum(rate), 3) AS rate, count(*) AS n FROM g GROUP BY ALL")
def counter_clamped_delta(spark, d):
    rows = M.clamped_rate(_counter(spark, d, reset=5), ["user_id", "metric"], ["us", "event_id"], "total")
    return rows.groupBy("metric", bucket(F.col("s"), DAY).alias("bucket")).agg(F.round(F.sum("rate"), 3).alias("rate"), F.count("*").alias("n"))


@query(EV + f"""SELECT metric, s - s % {DAY} AS bucket, round(sum(run), 2) AS running FROM (SELECT metric, user_id, s - s % {DAY} AS s, arg_max(total, (us, event_id)) AS run FROM
  (SELECT *, sum(value) OVER (PARTITION BY user_id, metric ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS total FROM ev) GROUP BY ALL) GROUP BY metric, bucket""")
def running_sum(spark, d):
    rows = M.clamped_rate(logs(spark, d), ["user_id", "metric"], ["us", "event_id"], "value", delta=True)
    last = rows.groupBy("metric", "user_id", bucket(F.col("s"), DAY).alias("bucket")).agg(F.max_by("running", F.struct("us", "event_id")).alias("r"))
    return last.groupBy("metric", "bucket").agg(F.round(F.sum("r"), 2).alias("running"))


def _histograms(spark, d, reset=None):
    p = M.histogram_points(logs(spark, d), ["user_id", "cluster"], "s", "value", HOUR, BOUNDS)
    return M.running_counts(p, ["user_id"], len(BOUNDS) + 1, reset)


_B = "list_value(" + ", ".join(f"{b}::DOUBLE" for b in BOUNDS) + ")"
_HB = EV + f""", b AS (SELECT user_id, cluster, s - s % 3600 AS t, 1 + len(list_filter({_B}, lambda x: value > x)) AS i, count(*) AS c FROM ev GROUP BY ALL),
p0 AS (SELECT DISTINCT user_id, cluster, t FROM b),
f AS (SELECT p0.user_id, p0.cluster, p0.t, x.i, coalesce(b.c, 0) AS c FROM p0 CROSS JOIN (SELECT unnest(range(1, {len(BOUNDS) + 2})) AS i) x LEFT JOIN b ON b.user_id = p0.user_id AND b.t = p0.t AND b.i = x.i)
"""


@query(_HB + f""", h AS (SELECT user_id, t, i, sum(c) OVER (PARTITION BY user_id, i ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM f),
g AS (SELECT user_id, t - t % {DAY} AS bucket, i, arg_max(c, t) - arg_min(c, t) AS d FROM h GROUP BY ALL),
k AS (SELECT bucket, i, sum(d) AS d FROM g GROUP BY ALL),
c AS (SELECT bucket, i, sum(d) OVER (PARTITION BY bucket ORDER BY i) AS run, sum(d) OVER (PARTITION BY bucket) AS total FROM k)
SELECT bucket, {_B}[min(i) FILTER (run >= 0.9::DOUBLE * total)] AS q FROM c GROUP BY bucket""")
def hist_p99_bounds(spark, d):
    return M.quantile_by_bound(_histograms(spark, d), ["user_id"], DAY, BOUNDS, 0.9)


@query(_HB + f""", n AS (SELECT *, (row_number() OVER (PARTITION BY user_id, i ORDER BY t) - 1) // 7 AS part FROM f),
h AS (SELECT user_id, cluster, t, i, sum(c) OVER (PARTITION BY user_id, i, part ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM n),
o AS (SELECT *, lag(c) OVER (PARTITION BY user_id, i ORDER BY t) AS old FROM h),
e AS (SELECT *, bool_or(c < old) OVER (PARTITION BY user_id, t) AS fell FROM o),
g AS (SELECT cluster, t - t % {DAY} AS bucket, i, sum(CASE WHEN old IS NULL THEN 0 WHEN fell THEN c ELSE c - old END) AS d FROM e GROUP BY ALL),
c AS (SELECT *, sum(d) OVER (PARTITION BY cluster, bucket ORDER BY i) AS run, sum(d) OVER (PARTITION BY cluster, bucket) AS total FROM g),
m AS (SELECT cluster, bucket, i, d, run, total, 0.95::DOUBLE * total AS rank FROM c WHERE total > 0),
u AS (SELECT *, row_number() OVER (PARTITION BY cluster, bucket ORDER BY i) AS nth FROM m WHERE run > rank)
SELECT cluster, bucket, round(CASE WHEN i = {len(BOUNDS) + 1} THEN {BOUNDS[-1]}::DOUBLE ELSE
  (CASE WHEN i = 1 THEN 0::DOUBLE ELSE {_B}[i - 1] END) + ({_B}[i] - (CASE WHEN i = 1 THEN 0::DOUBLE ELSE {_B}[i - 1] END)) * ((rank - (run - d)) / d) END, 5) AS q
FROM u WHERE nth = 1""")
def hist_quantile_interp(spark, d):
    out = M.histogram_quantile(_histograms(spark, d, reset=7), ["user_id"], ["cluster"], DAY, BOUNDS, 0.95)
    return out.withColumn("q", F.round("q", 5))


@query(EV + "SELECT user_id, round(avg(value), 6) AS v FROM ev WHERE metric = 'events.view' GROUP BY user_id ORDER BY v DESC, user_id LIMIT 10")
def topk_gauge(spark, d):
    return M.top_k(logs(spark, d, metric="events.view"), "user_id", "value", 10)


@query(EV + "SELECT cluster, round(avg(v), 6) AS v FROM (SELECT cluster, user_id, avg(value) AS v FROM ev WHERE metric = 'events.view' GROUP BY ALL) GROUP BY cluster ORDER BY v DESC, cluster LIMIT 10")
def topk_by_series(spark, d):
    return M.top_k(logs(spark, d, metric="events.view"), "cluster", "value", 10, series=["user_id"])


_ROLL = "count(value) AS n, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, arg_max(value, (s, event_id)) AS last"


@query(EV + f"SELECT user_id, metric, s - s % 300 AS bucket, {_ROLL} FROM ev GROUP BY user_id, metric, bucket")
def rollup_5m(spark, d):
    out = M.rollup(logs(spark, d), ["user_id", "metric"], "s", "value", 300, "event_id")
    return out.withColumn("sum", F.round("sum", 4)).withColumn("last", F.col("last.v"))


@query(EV + f"SELECT cluster, metric, s - s % 3600 AS bucket, {_ROLL} FROM ev GROUP BY cluster, metric, bucket")
def rollup_merge(spark, d):
    fine = M.rollup(logs(spark, d), ["cluster", "metric", "user_id"], "s", "value", 300, "event_id")
    out = M.merge_rollup(fine.drop("user_id"), ["cluster", "metric"], HOUR)
    return out.withColumn("sum", F.round("sum", 4)).withColumn("last", F.col("last.v"))


_KV = EV + """, kv AS (SELECT s - s % 900 AS bucket, 'severity' AS "column", 'severity' AS key, severity AS value FROM ev UNION ALL
SELECT s - s % 900, 'cluster', 'cluster', cluster FROM ev UNION ALL SELECT s - s % 900, 'attributes', 'k', k FROM ev UNION ALL SELECT s - s % 900, 'attributes', 'ns', namespace FROM ev)
"""


def _kv(spark, d):
    rows = logs(spark, d).withColumn("attributes", F.create_map(F.lit("k"), "k", F.lit("ns"), "namespace"))
    return L.key_values(rows, "s", ["severity", "cluster"], ["attributes"])


@query(_KV + """SELECT bucket, "column", key, value, count(*) AS n FROM kv WHERE value <> '' GROUP BY ALL""")
def kv_rollup_15m(spark, d):
    return _kv(spark, d)


@query(EV + "SELECT DISTINCT metric, s - s % 3600 AS hour, event_type AS service FROM ev")
def metric_names_hourly(spark, d):
    return logs(spark, d).select("metric", bucket(F.col("s"), HOUR).alias("hour"), F.col("event_type").alias("service")).distinct()


@query(_KV + """SELECT "column", key, count(*) AS n FROM kv WHERE value <> '' GROUP BY ALL ORDER BY n DESC, "column", key LIMIT 1000""")
def discover_keys(spark, d):
    return L.discover_keys(_kv(spark, d))


@query(_KV + """, v AS (SELECT DISTINCT "column", key, value FROM kv WHERE value <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY "column", key ORDER BY value) AS n FROM v)
SELECT "column", key, string_agg(value, ',' ORDER BY value) AS vals FROM r WHERE n <= 20 GROUP BY ALL""")
def discover_values(spark, d):
    return L.discover_values(_kv(spark, d))


_SID = "md5('{\"user_id\":' || user_id || ',\"metric\":\"' || metric || '\",\"cluster\":\"' || cluster || '\"}')"


@query(EV + f"SELECT DISTINCT {_SID} AS series_id, user_id, metric, cluster FROM ev")
def series_split(spark, d):
    return M.split_series(logs(spark, d), ["user_id", "metric", "cluster"], ["s", "value"])[0]


@query(EV + f"SELECT coalesce(CASE WHEN user_id % 10 <> 0 THEN cluster END, '') AS cluster, count(*) AS n, round(sum(value), 3) AS total FROM ev GROUP BY 1")
def series_rejoin_any_left(spark, d):
    """Points beside their series, of which a tenth is missing and the rest stands there twice."""
    series, points = M.split_series(logs(spark, d), ["user_id", "metric", "cluster"], ["value"])
    series = series.filter("user_id % 10 <> 0")
    out = M.rejoin_any(points, series.unionByName(series), ["series_id"])
    return out.groupBy(F.coalesce("cluster", F.lit("")).alias("cluster")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(EV + f"SELECT 'severity' AS chart, severity AS x, count(*) AS n FROM ev WHERE cluster IN ('c0', 'c1') GROUP BY x UNION ALL SELECT 'cluster', cluster, count(*) FROM ev WHERE severity IN ('ERROR') GROUP BY cluster UNION ALL SELECT 'time', CAST(s - s % {DAY} AS VARCHAR), count(*) FROM ev WHERE cluster IN ('c0', 'c1') AND severity IN ('ERROR') GROUP BY s - s % {DAY}")
def crossfilter_chart(spark, d):
    charts = L.cross_filtered(logs(spark, d), {"severity": ["ERROR"], "cluster": ["c0", "c1"]}, {"severity": ("severity", None), "cluster": ("cluster", None), "time": ("s", DAY)})
    parts = [df.select(F.lit(k).alias("chart"), F.col("x").cast("string").alias("x"), "n") for k, df in charts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(EV + "SELECT 'left' AS side, count(*) AS n FROM (SELECT user_id, severity FROM ev EXCEPT ALL SELECT user_id, severity FROM ev WHERE event_id % 11 <> 0) UNION ALL SELECT 'right', count(*) FROM (SELECT user_id, severity FROM ev WHERE event_id % 11 <> 0 EXCEPT ALL SELECT user_id, severity FROM ev)")
def set_equivalence(spark, d):
    rows = logs(spark, d)
    pick = lambda df: df.select("user_id", "severity", F.create_map(F.lit("u"), F.col("user_id").cast("string")).alias("m"))
    return L.equivalence(pick(rows), pick(rows.filter("event_id % 11 <> 0")))


@query(_CT + f""", x AS (SELECT *, lag(total) OVER (PARTITION BY user_id, metric ORDER BY us) AS old FROM ct WHERE us >= {LO}000000 AND us < {HI}000000)
SELECT user_id, metric, round(sum(CASE WHEN old IS NULL THEN 0 WHEN total < old THEN total ELSE total - old END) / greatest(max(us) - min(us), 1) * 1000000, 6) AS rate FROM x GROUP BY user_id, metric""")
def promql_rate(spark, d):
    out = M.promql_rate(_counter(spark, d), ["user_id", "metric"], "us", "total", LO * 1_000_000, HI * 1_000_000)
    return out.withColumn("rate", F.round(F.col("rate") * 1_000_000, 6))


@query(_HB + """, h AS (SELECT t, user_id::VARCHAR AS u, i, sum(c) OVER (PARTITION BY user_id, t ORDER BY i) AS run FROM f)
SELECT 'http_duration_bucket' AS name, u, CASE WHEN i = 8 THEN '+Inf' ELSE list_value('1', '5', '10', '25', '50', '100', '250')[i] END AS le, t, run::DOUBLE AS value FROM h UNION ALL
SELECT 'http_duration_count', u, NULL, t, run::DOUBLE FROM h WHERE i = 8 UNION ALL
SELECT 'http_duration_sum', user_id::VARCHAR, NULL, s - s % 3600, round(sum(value), 3) FROM ev GROUP BY user_id, s - s % 3600""")
def prometheus_samples(spark, d):
    rows = logs(spark, d)
    sums = rows.groupBy("user_id", bucket(F.col("s"), HOUR).alias("t")).agg(F.round(F.sum("value"), 3).alias("sum"), F.array(*M.bucket_counts(F.col("value"), BOUNDS)).alias("counts"))
    return M.prometheus_samples(sums.withColumn("u", F.col("user_id").cast("string")), "http.duration", "u", BOUNDS)


@query(EV + "SELECT severity, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (value > 50) AS big, round(quantile_cont(value, 0.95), 5) AS p95, min(user_id) AS some FROM ev GROUP BY severity HAVING count(*) > 10")
def aggregate_functions(spark, d):
    out = logs(spark, d).groupBy("severity").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("big"), F.round(F.expr("percentile(value, 0.95)"), 5).alias("p95"), F.min("user_id").alias("some"))
    return out.filter("n > 10")


@query(EV + "SELECT cluster, severity, count(*) AS n FROM ev GROUP BY ROLLUP (cluster, severity)")
def grouping_rollup(spark, d):
    return logs(spark, d).rollup("cluster", "severity").agg(F.count("*").alias("n"))


@query(EV + "SELECT user_id, event_id, us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id) AS n FROM ev) WHERE n = 1")
def limit_one_by(spark, d):
    return L.latest_by(logs(spark, d), ["user_id"], F.desc("us"), "event_id").select("user_id", "event_id", "us")


@query(EV + f"SELECT s - s % {DAY} AS day, count(*) AS new_users FROM (SELECT user_id, min(s) AS s FROM ev GROUP BY user_id) GROUP BY day")
def resource_churn(spark, d):
    first = logs(spark, d).groupBy("user_id").agg(F.min("s").alias("first"))
    return first.groupBy(bucket(F.col("first"), DAY).alias("day")).agg(F.count("*").alias("new_users"))
