"""Queries over ranges of steps, mergeable states, samples of all kinds, ingest, snapshots, plans and bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control as C
from ..operators import entities as E
from ..operators import logs as L
from ..operators import postings
from ..operators import ranges as R
from ..operators import sketches
from ..operators.offload import Policy, offload
from ..operators.samples import samples
from ..operators.work import scratch, written
from ..sources import feeds
from ..sources.tables import DAY, HOUR, LOGS, T0, logs, read, with_
from ..streaming.ingest import Sink, checked_receive_time, content_key, swap_days
from ..streaming.snapshots import Snapshots

QUERIES, SQL = {}, {}
EV = with_(LOGS)
START, STEP, WINDOW, STEPS = T0 + 2 * DAY, 4 * HOUR, 12 * HOUR, 60
END = START + (STEPS - 1) * STEP
BOUNDS = [1.0, 5.0, 20.0, 60.0, 150.0]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f
    return add


# Ranges of steps


def _counters(spark, d):
    """Counters by cluster and metric that begin again every 20 points."""
    e = R.running(logs(spark, d).select("cluster", "metric", "s", "us", "event_id"), ["cluster", "metric"], "us", ["event_id"], {"nth": F.lit(True)}, HOUR * 1_000_000)
    return e.select("cluster", "metric", "s", ((F.col("nth") - 1) % 20 + 1).cast("double").alias("v"))


_WINDOWS = f"""k AS (SELECT unnest(range({START}, {END + 1}, {STEP})) AS stamp)"""
_COUNTERS = EV + f""", p AS (SELECT cluster, metric, s, max(v) AS v FROM (SELECT cluster, metric, s, ((row_number() OVER (PARTITION BY cluster, metric ORDER BY us, event_id) - 1) % 20 + 1)::DOUBLE AS v FROM ev) GROUP BY ALL),
d AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL THEN 0 WHEN v < lag(v) OVER w THEN v ELSE v - lag(v) OVER w END AS d FROM p WINDOW w AS (PARTITION BY cluster, metric ORDER BY s)),
{_WINDOWS},
x AS (SELECT cluster, metric, stamp, count(*) AS n, min(s) AS ft, arg_min(v, s) AS fv, max(s) AS lt, sum(v) AS total, sum(d) - arg_min(d, s) AS grown FROM d JOIN k ON s > stamp - {WINDOW} AND s <= stamp GROUP BY ALL),
y AS (SELECT *, (lt - ft)::DOUBLE AS sampled, (lt - ft)::DOUBLE / (n - 1) AS mean, ft - (stamp - {WINDOW}) AS b, stamp - lt AS e FROM x WHERE n > 1 AND lt > ft),
r AS (SELECT cluster, metric, stamp, grown * (sampled + least(CASE WHEN b >= mean * 1.1::DOUBLE THEN mean / 2 ELSE b END, CASE WHEN grown > 0 AND fv >= 0 THEN sampled * fv / grown ELSE 1e300::DOUBLE END)
  + CASE WHEN e >= mean * 1.1::DOUBLE THEN mean / 2 ELSE e END) / sampled / {WINDOW} AS v FROM y)
"""


@query(_COUNTERS + "SELECT cluster, stamp, round(sum(v), 9) AS v FROM r GROUP BY cluster, stamp")
def range_rate(spark, d):
    """sum by (cluster) (rate(counter[12h])) at 60 steps of four hours."""
    states = R.windows(_counters(spark, d), ["cluster", "metric"], "s", "v", START, END, STEP, WINDOW)
    return R.by(R.rate(states, WINDOW), ["cluster"]).withColumn("v", F.round("v", 9))


@query(_COUNTERS + "SELECT stamp, metric, round(v, 9) AS v, rank FROM (SELECT stamp, metric, avg(total / n) AS v, row_number() OVER (PARTITION BY stamp ORDER BY round(avg(total / n), 9) DESC, metric) AS rank FROM x GROUP BY stamp, metric) WHERE rank <= 3")
def range_top_average(spark, d):
    """topk(3, avg by (metric) (avg_over_time(counter[12h])))"""
    states = R.windows(_counters(spark, d), ["cluster", "metric"], "s", "v", START, END, STEP, WINDOW)
    return R.top(R.by(R.avg_over_time(states), ["metric"], "avg").withColumn("v", F.round("v", 9)), 3, ["metric"])


_LE = ", ".join(f"{b}::DOUBLE" for b in BOUNDS)


@query(EV + f""", q AS (SELECT cluster, s, us, event_id, value, unnest([{_LE}, 'inf'::DOUBLE]) AS le FROM ev),
p AS (SELECT cluster, le, s, max(v) AS v FROM (SELECT cluster, le, s, count(*) FILTER (value <= le) OVER (PARTITION BY cluster, le ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS v FROM q) GROUP BY ALL),
{_WINDOWS},
g AS (SELECT cluster, le, stamp, (max(v) - min(v))::DOUBLE AS v FROM p JOIN k ON s > stamp - {WINDOW} AND s <= stamp GROUP BY ALL HAVING count(*) > 1),
h AS (SELECT cluster, stamp, list(le ORDER BY le) AS b, list(v ORDER BY le) AS c FROM g GROUP BY ALL HAVING max(v) > 0),
i AS (SELECT *, 0.9::DOUBLE * c[-1] AS rank, list_position(list_transform(c, lambda x: x >= 0.9::DOUBLE * c[-1]), true) AS i FROM h)
SELECT cluster, stamp, round(CASE WHEN i = len(b) THEN b[len(b) - 1] ELSE coalesce(b[i - 1], 0) + (b[i] - coalesce(b[i - 1], 0)) * ((rank - coalesce(c[i - 1], 0)) / (c[i] - coalesce(c[i - 1], 0))) END, 6) AS v FROM i""")
def range_histogram_quantile(spark, d):
    """histogram_quantile(0.9, sum by (cluster, le) (increase of the buckets within 12h))"""
    le = {f"le{i}": F.lit(True) if b is None else F.coalesce(F.col("value") <= b, F.lit(False)) for i, b in enumerate([*BOUNDS, None])}
    e = R.running(logs(spark, d).select("cluster", "s", "us", "event_id", "value"), ["cluster"], "us", ["event_id"], le, HOUR * 1_000_000)
    # of a second's points the largest counts: one row for it
    e = e.groupBy("cluster", "s").agg(*(F.max(k).alias(k) for k in le))
    counts = [F.struct(F.lit("+Inf" if b is None else repr(b)).alias("le"), F.col(k).alias("v")) for k, b in zip(le, [*BOUNDS, None], strict=True)]
    points = e.select("cluster", "s", F.explode(F.array(*counts)).alias("c")).select("cluster", "s", "c.le", F.col("c.v").cast("double").alias("v"))
    states = R.windows(points, ["cluster", "le"], "s", "v", START, END, STEP, WINDOW).filter("n > 1").withColumn("v", F.col("grown"))
    return R.quantile(R.by(states, ["cluster", "le"]), 0.9, "le", ["cluster"]).filter("v is not null").withColumn("v", F.round("v", 6))


# States that merge


@query(EV + f"SELECT cluster, s - s % {DAY} AS bucket, count(*) AS n, count(DISTINCT user_id) AS users, true AS near FROM ev GROUP BY ALL")
def merged_distinct(spark, d):
    """Different users of days, merged from sketches of hours and metrics, within 5 % of the exact number that stands beside."""
    e = logs(spark, d)
    hours = written(sketches.rollup(e, ["cluster", "metric"], "s", HOUR, distinct="user_id"), "sketches")
    days = sketches.merge(hours, ["cluster"], DAY).withColumn("estimate", sketches.distinct_count())
    exact = e.groupBy("cluster", (F.col("s") - F.col("s") % DAY).alias("bucket")).agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.05)
    return days.join(exact, ["cluster", "bucket"]).select("cluster", "bucket", "n", "users", near.alias("near"))


@query(EV + "SELECT metric, count(*) AS n, true AS near FROM ev GROUP BY metric")
def merged_quantiles(spark, d):
    """The 90th percentile of a metric, merged from sketches of hours and clusters: its true rank is within 3 % of 0.9."""
    e = logs(spark, d)
    hours = written(sketches.rollup(e, ["cluster", "metric"], "s", HOUR, value="value"), "sketches")
    p = sketches.merge(hours, ["metric"]).select("metric", "n", sketches.quantile(0.9).alias("p"))
    rank = e.join(F.broadcast(p), "metric").groupBy("metric", "n").agg(F.avg((F.col("value") <= F.col("p")).cast("double")).alias("hi"), F.avg((F.col("value") < F.col("p")).cast("double")).alias("lo"))
    return rank.select("metric", "n", ((F.col("lo") <= 0.93) & (F.col("hi") >= 0.87)).alias("near"))


# Ingest and snapshots

_CONTENT = ["event_id", "us", "user_id", "metric", "value"]


@query(EV + f"""SELECT received_day, late_part, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT CASE WHEN event_id % 3 = 0 THEN received + {40 * DAY} ELSE received END // {DAY} AS received_day,
  CASE WHEN s < CASE WHEN event_id % 3 = 0 THEN max(s) OVER (PARTITION BY batch_id) ELSE max(s) FILTER (event_id % 3 <> 0) OVER (PARTITION BY batch_id) END - 900 THEN 1 ELSE 0 END AS late_part, value FROM ev) GROUP BY ALL""")
def ingest_across_days(spark, d):
    """Two thirds of all rows, then all rows forty days later: the sink takes each content key once, on its first day."""
    e = logs(spark, d)
    table = scratch(spark, "ingested")
    sink = Sink(table, 900)
    sink(content_key(e.filter("event_id % 3 <> 0"), _CONTENT), 0)
    sink(content_key(e.withColumn("received", F.col("received") + 40 * DAY), _CONTENT), 1)
    sink(content_key(e.filter("event_id % 3 <> 0").withColumn("received", F.col("received") + 90 * DAY), _CONTENT), 2)
    rows = spark.read.parquet(table).select(F.col("received_day").cast("long").alias("received_day"), F.col("late_part").cast("int").alias("late_part"), "value")
    return rows.groupBy("received_day", "late_part").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(EV + f"SELECT s // {DAY} AS day, metric, count(*) AS n, CASE WHEN s // {DAY} % 2 = 0 THEN 1 ELSE 0 END AS build FROM ev GROUP BY ALL")
def rollup_swapped(spark, d):
    """Daily counts, of which the even days are built again and swapped in at once."""
    e = logs(spark, d).withColumn("day", F.floor(F.col("s") / DAY).cast("long"))
    path = scratch(spark, "rollup")
    built = lambda rows, n: rows.groupBy("day", "metric").agg(F.count("*").alias("n")).withColumn("build", F.lit(n))
    swap_days(built(e, 0), path, "day")
    swap_days(built(e.filter("day % 2 = 0"), 1), path, "day")
    return Snapshots(path, "day").read(spark).select("day", "metric", "n", "build")


@query(EV + "SELECT batch_id, count(*) AS n, min(received) AS received FROM ev GROUP BY batch_id")
def receive_times_asserted(spark, d):
    """Batches whose rows all carry the receive time that was announced for them; another one fails the query."""
    e = logs(spark, d)
    announced = e.groupBy("batch_id").agg(F.min("received").alias("received"))
    rows = e.drop("received").join(announced, "batch_id")
    return checked_receive_time(rows, announced).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("received").alias("received"))


# Plans of files


@query(EV + f"SELECT s // {DAY} AS day, count(*) AS n FROM ev WHERE s >= {T0 + 3 * DAY} AND s < {T0 + 9 * DAY} GROUP BY day")
def planned_scan(spark, d):
    """Rows of a window out of exactly the files that a plan over their times names, planned again if one has gone."""
    path = scratch(spark, "files")
    logs(spark, d).select("s", F.floor(F.col("s") / DAY).cast("long").alias("day")).repartition(8, "day").sortWithinPartitions("s").write.option("maxRecordsPerFile", 2000).parquet(path)
    lo, hi = T0 + 3 * DAY, T0 + 9 * DAY
    files = feeds.manifest(spark, path).select("path", F.lit("data").alias("kind"), F.lit("c").alias("cluster"), "min_time", "max_time", F.unix_timestamp("last_modified").alias("last_modified"))
    rows = C.answered(lambda: C.prune(files, lo, hi), lambda plan: C.scan(spark, plan, "s long, day long"))
    return rows.filter((F.col("s") >= lo) & (F.col("s") < hi)).groupBy("day").agg(F.count("*").alias("n"))


# Samples of all kinds


def _metric_tables(spark, d):
    """Gauges, sums, histograms, exponential histograms and summaries by user and day out of the events."""
    e = logs(spark, d).withColumn("day", F.floor(F.col("s") / DAY).cast("long"))
    one = e.groupBy("user_id", "cluster", "day").agg(F.round(F.sum("value"), 3).alias("sum"), F.count("*").alias("count"), F.round(F.max("value"), 3).alias("top"), F.array(*(F.count_if((F.col("value") > lo) & (F.col("value") <= hi)) for lo, hi in ((-1e300, 5.0), (5.0, 60.5), (60.5, 1e300)))).alias("counts"))
    one = written(one, "points")  # five tables read it
    base = one.select(F.create_map(F.lit("k8s.cluster"), F.col("cluster"), F.lit("user"), F.lit("resource")).alias("resource"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("attributes"), (F.col("day") * DAY * 1_000_000_000).alias("time_ns"), "sum", "count", "top", "counts")
    metric = lambda name: F.lit(name).alias("metric")
    return {
        "gauge": base.select("resource", "attributes", "time_ns", metric("http.top"), F.col("top").alias("value")),
        "sum": base.select("resource", "attributes", "time_ns", metric("2xx"), F.col("count").cast("double").alias("value"), F.lit(True).alias("monotonic")),
        "histogram": base.select("resource", "attributes", "time_ns", metric("http.time"), "count", "sum", "counts", F.array(F.lit(5.0), F.lit(60.5)).alias("bounds")),
        "exponentialHistogram": base.select("resource", "attributes", "time_ns", metric("http.exp"), "count", "sum"),
        "summary": base.select("resource", "attributes", "time_ns", metric("http.sum"), "count", "sum", F.array(F.struct(F.lit(0.5).alias("quantile"), F.col("top").alias("value"))).alias("quantiles")),
    }


@query(EV + f""", a AS (SELECT user_id, cluster, s // {DAY} AS day, round(sum(value), 3) AS sum, count(*) AS n, round(max(value), 3) AS top, count(*) FILTER (value <= 5) AS b1, count(*) FILTER (value <= 60.5) AS b2 FROM ev GROUP BY ALL),
l AS (SELECT *, day * {DAY * 1000} AS t, sum(n) OVER w AS rn, sum(sum) OVER w AS rs FROM a WINDOW w AS (PARTITION BY user_id, cluster ORDER BY day))
SELECT x.name, cluster, user_id::VARCHAR AS "user", x.label AS label, t, round(x.v, 3) AS value FROM (SELECT cluster, user_id, t, unnest([{{'name': 'http_top', 'label': '', 'v': top::DOUBLE}}, {{'name': '_2xx_total', 'label': '', 'v': n::DOUBLE}},
  {{'name': 'http_time_bucket', 'label': 'le=5', 'v': b1::DOUBLE}}, {{'name': 'http_time_bucket', 'label': 'le=60.5', 'v': b2::DOUBLE}}, {{'name': 'http_time_bucket', 'label': 'le=+Inf', 'v': n::DOUBLE}}, {{'name': 'http_time_sum', 'label': '', 'v': sum::DOUBLE}}, {{'name': 'http_time_count', 'label': '', 'v': n::DOUBLE}},
  {{'name': 'http_exp_sum', 'label': '', 'v': rs::DOUBLE}}, {{'name': 'http_exp_count', 'label': '', 'v': rn::DOUBLE}}, {{'name': 'http_sum', 'label': 'quantile=0.5', 'v': top::DOUBLE}}, {{'name': 'http_sum_sum', 'label': '', 'v': sum::DOUBLE}}, {{'name': 'http_sum_count', 'label': '', 'v': n::DOUBLE}}]) AS x FROM l)""")
def prometheus_all_kinds(spark, d):
    out = samples(_metric_tables(spark, d))
    label = F.when(F.col("labels").getItem("le").isNotNull(), F.concat(F.lit("le="), F.col("labels").getItem("le"))).when(F.col("labels").getItem("quantile").isNotNull(), F.concat(F.lit("quantile="), F.col("labels").getItem("quantile"))).otherwise("")
    return out.select("name", F.col("labels").getItem("k8s_cluster").alias("cluster"), F.col("labels").getItem("user").alias("user"), label.alias("label"), "t", F.round("value", 3).alias("value"))


# Payloads


_SECRET = "a key of the test"


def _offloaded(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumn("row", F.concat_ws("-", F.format_string("%09d", "conv_id"), F.format_string("%05d", "turn")))
    attrs = F.create_map(F.lit("prompt"), F.col("text"), F.lit("password"), F.concat(F.lit("p"), F.col("turn")), F.lit("parts"), F.concat(F.lit('["a","'), F.col("turn").cast("string"), F.lit('"]')), F.lit("note"), F.lit("short"))
    policy = Policy(keys=["prompt", "parts"], redact=["password"], split=["parts"], most=200)
    return offload(c.withColumn("attributes", attrs), policy, F.concat(F.lit("ns"), F.col("conv_id") % 5), F.col("conv_id") % 30, _SECRET, "row")


_OFFLOADED = f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, 'ns' || (conv_id % 5) AS tenant, (conv_id % 30)::VARCHAR AS day FROM conversations),
k AS (SELECT *, left(text, list_max(list_filter(range(0, 201), lambda k: strlen(left(text, k)) <= 200))::INT) AS cut,
  unhex(sha256(encode('{_SECRET}') || unhex(sha256(encode('{_SECRET}') || encode(tenant || chr(31) || day))))) AS key FROM c),
r AS (SELECT *, CASE WHEN text <> '' THEN sha256(key || unhex(sha256(key || encode(cut)))) END AS ref,
  sha256(key || unhex(sha256(key || encode('a')))) AS part1, sha256(key || unhex(sha256(key || encode(turn::VARCHAR)))) AS part2 FROM k)
"""


@query(_OFFLOADED + """SELECT conv_id, turn, CASE WHEN ref IS NULL THEN '' ELSE '["h:' || ref || '"]' END AS prompt, '' AS password, '["h:' || part1 || '","h:' || part2 || '"]' AS parts, 'short' AS note,
  CASE WHEN ref IS NOT NULL THEN strlen(cut)::VARCHAR END AS bytes, CASE WHEN strlen(cut) < strlen(text) THEN strlen(text)::VARCHAR END AS truncated_from, strlen('p' || turn)::VARCHAR AS redacted_from, '2' AS elements,
  CASE WHEN ref IS NULL THEN 0 ELSE 1 END + 2 AS refs FROM r""")
def payload_offload(spark, d):
    """Attributes with references and markers in place of payloads."""
    rows, _ = _offloaded(spark, d)
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    mark = lambda k, what: at(f"otel.payload.{k}.{what}").alias(what)
    return rows.select("conv_id", "turn", *(at(k).alias(k) for k in ("prompt", "password", "parts", "note")), mark("prompt", "bytes"), mark("prompt", "truncated_from"), mark("password", "redacted_from"), mark("parts", "elements"), F.size("payload_refs").alias("refs"))


@query(_OFFLOADED + """, f AS (SELECT ref, cut AS content, conv_id, turn FROM r WHERE ref IS NOT NULL UNION ALL SELECT part1, 'a', conv_id, turn FROM r UNION ALL SELECT part2, turn::VARCHAR, conv_id, turn FROM r)
SELECT ref, any_value(content) AS content, min(printf('%09d', conv_id) || '-' || printf('%05d', turn)) AS first_row FROM f GROUP BY ref""")
def payload_first_rows(spark, d):
    """Each payload once, with the first row that refers to it."""
    return _offloaded(spark, d)[1]


# Attributes that facts carry, bounds of a scope, pages out of few files


@query(EV + """, kv AS (SELECT DISTINCT user_id, event_type AS value FROM ev WHERE event_id % 10 = 0 AND user_id % 3 <> 0)
SELECT count(*) FILTER (CASE WHEN event_id % 4 = 0 THEN severity = 'ERROR' ELSE user_id IN (SELECT user_id FROM kv WHERE value = 'error') END) AS equal,
  count(*) FILTER (CASE WHEN event_id % 4 = 0 THEN severity <> 'ERROR' ELSE user_id NOT IN (SELECT user_id FROM kv WHERE value = 'error') END) AS unequal, count(*) FILTER (event_id % 4 = 0 AND severity = 'ERROR') AS uncovered FROM ev""")
def attr_filter_residual(spark, d):
    """An attribute that some rows carry and the catalog has for others: both count, each for its own."""
    e = logs(spark, d)
    kv = e.filter("event_id % 10 = 0 AND user_id % 3 <> 0").select(F.lit("kind").alias("key"), F.col("event_type").alias("value"), "user_id").distinct()
    upper = F.when(F.col("severity") == "ERROR", "error").otherwise("other")
    facts = e.select("event_id", "user_id", F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("kind"), upper)).otherwise(F.create_map().cast("map<string,string>")).alias("residual"))
    n = lambda name, *how, **more: E.attribute_filter(facts, kv, "user_id", "kind", *how, residual="residual", **more).agg(F.count("*").alias(name))
    return n("equal", "=", ["error"]).crossJoin(n("unequal", "!=", ["error"])).crossJoin(n("uncovered", "=", ["error"], covered=["service"]))  # three rows of one


@query(EV + f""", p AS (SELECT cluster, event_type AS signal, max(received) AS value FROM ev WHERE cluster <> 'c2' GROUP BY ALL), a AS (SELECT cluster, min(value) AS value FROM p GROUP BY cluster), f AS (SELECT min(value) AS value FROM a)
SELECT x.cluster, greatest(f.value, coalesce(a.value, {T0 + DAY}), (SELECT min(value) FROM p WHERE p.cluster = x.cluster AND signal IN ('error', 'view'))) AS complete_through FROM (SELECT unnest(['c0', 'c1', 'c2']) AS cluster) x CROSS JOIN f LEFT JOIN a ON a.cluster = x.cluster""")
def watermark_of_scope(spark, d):
    """Bounds of three clusters for two signals, one cluster unlisted, out of what fleet and clusters have published."""
    per = logs(spark, d).filter("cluster <> 'c2'").groupBy("cluster", F.col("event_type").alias("signal")).agg(F.max("received").alias("value"))
    own = per.groupBy("cluster").agg(F.min("value").alias("value"))
    published = per.unionByName(own.withColumn("signal", F.lit(None).cast("string"))).unionByName(own.agg(F.min("value").alias("value")).withColumns({"cluster": F.lit(None).cast("string"), "signal": F.lit(None).cast("string")}))
    return C.scoped_watermark(published, ["c0", "c1", "c2"], ["error", "view"], T0 + DAY)


@query(EV + f"SELECT cluster, count(*) AS n FROM ev WHERE received >= {T0 + 2 * DAY} AND received < {T0 + 6 * DAY} GROUP BY cluster")
def basis_of_fleet(spark, d):
    """Rows at one bound for all clusters that an earlier basis did not have."""
    now, before = C.Basis({"c0": T0 + 8 * DAY, "c1": T0 + 6 * DAY, "c2": T0 + 9 * DAY}), C.Basis({"c0": T0 + 2 * DAY, "c1": T0 + 3 * DAY})
    return logs(spark, d).filter(C.fleet_predicate(now, "received", before)).groupBy("cluster").agg(F.count("*").alias("n"))


@query(EV + "SELECT event_id, s, severity FROM ev ORDER BY s DESC, event_id LIMIT 50")
def newest_by_files(spark, d):
    """The last 50 rows out of files by their times, the latest first, no more of them than that takes."""
    path = scratch(spark, "files")
    logs(spark, d).select("event_id", "s", "severity").repartitionByRange(16, "s").write.parquet(path)
    plan = feeds.manifest(spark, path).select("path", F.col("max_time"))
    page, _ = L.newest_by_files(plan, 50, "s", ["event_id"], lambda paths: spark.read.schema("event_id long, s long, severity string").parquet(*paths), first=2)
    return page


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'apache license')")
def index_postings(spark, d):
    """Substring search behind postings of groups of ten documents."""
    docs = read(spark, d, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 10).alias("file"))
    numbers = written(postings.numbered(docs), "numbers")
    path = scratch(spark, "postings")
    postings.write(postings.build(docs.join(numbers, "file"), "text"), path)
    hit = numbers.join(postings.candidates(spark.read.parquet(path), "apache license"), "ordinal", "left_semi")
    return docs.join(hit.select("file"), "file", "left_semi").filter(F.lower("text").contains("apache license")).select("doc_id")
