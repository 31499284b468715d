"""Queries over counts in scope, index shards, histogram roll-ups, lanes of entities, audits and payload references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import bucket, bucket_index, items, map_get, nice_step
from ..operators import control as C
from ..operators import entities as E
from ..operators import index as I
from ..operators import lanes
from ..operators import metrics as M
from ..operators import scope as S
from ..operators import traces as T
from ..operators.work import scratch
from ..sources import feeds
from ..sources.tables import DAY, HOUR, LLM, LOGS, SCORES, SPANS, T0, llm_spans, logs, read, scores, spans, with_
from .observe import _HB, BOUNDS, _histograms

QUERIES, SQL = {}, {}
LO, HI = T0 + 5 * DAY, T0 + 12 * DAY
LATENESS = 600
EV = with_(LOGS)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f
    return add


@query(EV + f"SELECT count(*) AS n FROM ev WHERE cluster = 'c1' AND namespace IN ('ns1', 'ns2') AND s >= {LO} AND s < {HI} AND received > s + {LATENESS}")
def scoped_counts(spark, d):
    """Late rows as the query service counts them: in the window, of the tables that are read, in the caller's scope."""
    from .service import Service

    service = Service(spark, {"logs": logs(spark, d, LO, HI)}, {"c0": HI, "c1": HI, "c2": HI}, LATENESS)
    late = service.query([("c1", "ns1"), ("c1", "ns2")], "SELECT count(*) AS n FROM logs", LO, HI).late
    return spark.createDataFrame([(late["logs"],)], "n long")


@query(EV + "SELECT user_id FROM ev WHERE cluster = 'c1' AND severity = 'ERROR' INTERSECT SELECT user_id FROM ev WHERE cluster = 'c1' AND severity = 'WARN' EXCEPT SELECT user_id FROM ev WHERE cluster = 'c1' AND value > 240")
def scoped_set_operations(spark, d):
    sql = "SELECT user_id FROM logs WHERE severity = 'ERROR' INTERSECT SELECT user_id FROM logs WHERE severity = 'WARN' EXCEPT SELECT user_id FROM logs WHERE value > 240"
    return S.scoped_sql(spark, sql, {"logs": logs(spark, d)}, [("c1", "*")])


@query(EV + "SELECT cluster, namespace, count(*) AS n FROM ev WHERE cluster IN ('c0', 'c2') AND (namespace = 'ns1' OR cluster = 'c2') GROUP BY ALL")
def scope_narrowed(spark, d):
    grants = S.narrowed([("*", "ns1"), ("c2", "*"), ("c1", "ns3")], {"c0", "c2"})
    return S.in_scope(logs(spark, d), grants).groupBy("cluster", "namespace").agg(F.count("*").alias("n"))


_HR = _HB + f""", z AS (SELECT user_id, min(t) AS t0 FROM f GROUP BY user_id),
g AS (SELECT cluster, t - t % {DAY} AS bucket, i, sum(CASE WHEN t = t0 THEN 0 ELSE c END) AS c, count(*) AS n FROM f JOIN z USING (user_id) GROUP BY ALL)
SELECT cluster, bucket, max(n) AS n, sum(c) AS total, sum(c) FILTER (i = 1) AS low, sum(c) FILTER (i = {len(BOUNDS) + 1}) AS high FROM g GROUP BY ALL"""


@query(_HR)
def hist_rollup(spark, d):
    """Cumulative histograms rolled up by the hour, and the hours of all series of a cluster merged into days."""
    size = len(BOUNDS) + 1
    hours = M.histogram_rollup(_histograms(spark, d), ["user_id", "cluster"], HOUR, size)
    days = M.merge_histograms(hours, ["cluster"], DAY, size)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return days.select("cluster", "bucket", "n", total.alias("total"), F.get("counts", 0).alias("low"), F.get("counts", size - 1).alias("high"))


@query(EV + f"SELECT user_id, metric, round(avg(value), 6) AS avg FROM ev WHERE s >= {LO} AND s < {HI} GROUP BY ALL")
def avg_over_time(spark, d):
    return M.avg_over_time(logs(spark, d, LO, HI), ["user_id", "metric"], "s", "value", LO, HI).withColumn("avg", F.round("avg", 6))


@query(EV + "SELECT event_type, abs(count(DISTINCT event_id) - count(*)) <= 0.1 * count(*) AS near FROM ev GROUP BY event_type")
def approximate_distinct(spark, d):
    """Approximate counts of different ids are within a tenth."""
    n = logs(spark, d).groupBy("event_type").agg(F.approx_count_distinct("event_id", 0.02).alias("a"), F.count("*").alias("n"))
    return n.select("event_type", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


@query(EV + f"SELECT (s - {LO}) // {nice_step(LO, HI)} AS i, count(*) AS n FROM ev WHERE s >= {LO} AND s < {HI} GROUP BY ALL")
def window_buckets(spark, d):
    """Steps counted from the window's beginning, of the readable length that gives at most 60."""
    rows = logs(spark, d, LO, HI)
    return rows.groupBy(bucket_index(F.col("s"), LO, HI, nice_step(LO, HI)).alias("i")).agg(F.count("*").alias("n"))


@query(EV + "SELECT user_id, count(*) AS n FROM ev WHERE k = '1' AND namespace = 'ns2' GROUP BY user_id")
def map_items_equal(spark, d):
    """Equality of map entries by k=v items."""
    m = items(F.create_map(F.lit("k"), "k", F.lit("ns"), "namespace"))
    rows = logs(spark, d).filter(F.array_contains(m, "k=1") & F.array_contains(m, "ns=ns2"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"))


@query(EV + "SELECT cluster, count(*) AS n, round(sum(value), 3) AS total FROM ev WHERE user_id % 10 <> 0 GROUP BY cluster")
def series_rejoin_any_inner(spark, d):
    """Points beside their series, of which some are missing and the rest stands there twice; only points with one stay."""
    series, points = M.split_series(logs(spark, d), ["user_id", "metric", "cluster"], ["value"])
    series = series.filter("user_id % 10 <> 0")
    out = M.rejoin_any(points, series.unionByName(series), ["series_id"], "inner")
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(EV + "SELECT * FROM (SELECT event_id, us FROM ev ORDER BY us DESC, event_id LIMIT 20 OFFSET 40)")
def page_of_newest(spark, d):
    return logs(spark, d).orderBy(F.desc("us"), "event_id").offset(40).limit(20).select("event_id", "us")


@query(EV + "SELECT cluster, severity, count(*) AS n FROM ev GROUP BY ALL")
def group_by_all(spark, d):
    return S.scoped_sql(spark, "SELECT cluster, severity, count(*) AS n FROM logs GROUP BY ALL", {"logs": logs(spark, d)}, [("*", "*")])


# Sources


@query(with_(SPANS) + "SELECT trace_id, span_id, parent_id, name, service, start * 1000000000 AS time_ns, duration * 1000 AS duration_ns, status FROM sp WHERE name = 'order'")
def otlp_span_rows(spark, d):
    """Spans out of export requests."""
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value"))
    sp = spans(spark, d).filter("name = 'order'")
    start = F.col("start") * 1_000_000_000
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_id").alias("parentSpanId"), "name", start.cast("string").alias("startTimeUnixNano"),
        (start + F.col("duration") * 1000).cast("string").alias("endTimeUnixNano"), F.struct(F.when(F.col("status") == "Error", 2).otherwise(1).alias("code")).alias("status"),
    )
    resource = F.struct(F.array(text("service.name", F.col("service"))).alias("attributes"))
    request = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    rows = feeds.otlp_spans(sp.select(F.to_json(request).alias("value")))
    return rows.select("trace_id", "span_id", "parent_id", "name", "service", "time_ns", "duration_ns", "status")


@query(EV + f"""SELECT event_id, 'negative' AS side, -(event_id % 3)::BIGINT AS "offset", event_id % 5 AS first FROM ev WHERE event_type = 'view' AND s < {LO}
UNION ALL SELECT event_id, 'positive', event_id % 4, event_id % 7 FROM ev WHERE event_type = 'view' AND s < {LO}""")
def otlp_exponential_rows(spark, d):
    """Both sides of exponential histograms out of export requests."""
    e = logs(spark, d, hi=LO, metric="events.view")
    i = F.col("event_id")
    side = lambda offset, first: F.struct(offset.cast("int").alias("offset"), F.array(first.cast("string"), F.lit("1")).alias("bucketCounts"))
    point = F.struct(F.array(F.struct(F.lit("id").alias("key"), F.struct(i.cast("string").alias("stringValue")).alias("value"))).alias("attributes"), F.lit("9").alias("count"), side(i % 4, i % 7).alias("positive"), side(-(i % 3), i % 5).alias("negative"))
    metric = F.struct(F.lit("m").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("exponentialHistogram"))
    request = F.struct(F.array(F.struct(F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    rows = feeds.otlp_metrics(e.select(F.to_json(request).alias("value")))["exponentialHistogram"]
    rows = rows.withColumn("event_id", map_get("attributes", "id").cast("long"))
    both = F.explode(F.array(F.struct(F.lit("positive").alias("side"), "offset", "counts"), F.struct(F.lit("negative").alias("side"), F.col("negative_offset").alias("offset"), F.col("negative_counts").alias("counts")))).alias("x")
    return rows.select("event_id", both).select("event_id", "x.side", F.col("x.offset").cast("long").alias("offset"), F.get("x.counts", 0).alias("first"))


# Lanes and entities


@query(EV + "SELECT batch_id, count(*) AS n, min(m.slot) AS slot FROM ev JOIN (SELECT DISTINCT batch_id, 'slot ' || batch_id AS slot FROM ev WHERE batch_id % 4 <> 0) m USING (batch_id) GROUP BY batch_id")
def manifest_attached(spark, d):
    """Rows beside what the manifest says of their file; files that it doesn't name are left out."""
    e = logs(spark, d)
    manifest = e.filter("batch_id % 4 <> 0").select("batch_id").distinct().withColumn("slot", F.concat(F.lit("slot "), "batch_id"))
    return lanes.attach(e, manifest, "batch_id", ["slot"]).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("slot").alias("slot"))


@query(EV + "SELECT batch_id, count(*) + (batch_id % 3 = 0)::BIGINT AS rows, count(*) AS there FROM ev GROUP BY batch_id HAVING batch_id % 3 = 0")
def batches_verified(spark, d):
    """Batches of which the manifest says another number of rows."""
    from ..streaming.ingest import verified

    e = logs(spark, d)
    said = e.groupBy("batch_id").agg((F.count("*") + (F.col("batch_id") % 3 == 0).cast("long")).alias("rows"))
    return verified(e, said).select("batch_id", "rows", "there")


def _lanes(spark, d):
    """Rows as records of lanes: an object for each hour and cluster, every twelfth a sync, gaps where batches end in 7."""
    e = logs(spark, d)
    hour = F.floor((F.col("s") - T0) / HOUR).cast("long")
    kind = F.when(hour % 12 == 0, "sync").otherwise("delta")
    gone = (F.col("event_type") == "error") & (kind == "delta")
    own = e.select(F.col("cluster").alias("lane"), hour.alias("n"), F.col("event_id").alias("o"), kind.alias("kind"), F.col("user_id").cast("string").alias("entity"), F.when(~gone, F.col("event_type")).alias("version"), (F.lit(T0) + hour * HOUR).alias("t"), F.lit(None).cast("long").alias("until"))
    # a sync holds an entity once, at the sync's time
    syncs = own.filter("kind = 'sync'").groupBy("lane", "n", "kind", "entity").agg(F.max("o").alias("o"), F.max_by("version", "o").alias("version"))
    syncs = syncs.select("lane", "n", "o", "kind", "entity", "version", (F.lit(T0) + F.col("n") * HOUR).alias("t"), F.lit(None).cast("long").alias("until"))
    gaps = e.filter("event_id % 700 = 7").select(F.col("cluster").alias("lane"), hour.alias("n"), F.col("event_id").alias("o"), F.lit("gap").alias("kind"), F.lit(None).cast("string").alias("entity"), F.lit(None).cast("string").alias("version"), (F.lit(T0) + hour * HOUR).alias("t"), (F.lit(T0) + hour * HOUR + 300 + F.col("event_id") % 900).alias("until"))
    return own.filter("kind = 'delta'").unionByName(syncs).unionByName(gaps)


@query(EV + f""", x AS (SELECT cluster AS lane, (s - {T0}) // {HOUR} AS n, event_id AS o, user_id::VARCHAR AS entity, event_type AS v, {T0} + (s - {T0}) // {HOUR} * {HOUR} AS t FROM ev),
r AS (SELECT lane, n, o, entity, CASE WHEN v <> 'error' THEN v END AS v, t FROM x WHERE n % 12 <> 0
  UNION ALL SELECT lane, n, max(o), entity, arg_max(v, o), {T0} + n * {HOUR} FROM x WHERE n % 12 = 0 GROUP BY lane, n, entity),
sy AS (SELECT DISTINCT lane, n, {T0} + n * {HOUR} AS t FROM x WHERE n % 12 = 0),
a AS (SELECT r.*, lead(n) OVER w AS n2, (SELECT min(sy.n) FROM sy WHERE sy.lane = r.lane AND sy.n > r.n) AS ns FROM r WINDOW w AS (PARTITION BY lane, entity ORDER BY n, o)),
b AS (SELECT *, v IS NOT NULL AND ns IS NOT NULL AND (n2 IS NULL OR ns < n2) AS lapsed FROM a),
g AS (SELECT cluster AS lane, (s - {T0}) // {HOUR} AS n, event_id AS o, {T0} + (s - {T0}) // {HOUR} * {HOUR} AS t FROM ev WHERE event_id % 700 = 7),
k AS (SELECT g.lane, g.n, g.o, c.entity, arg_max(c.v IS NOT NULL, (c.n, c.o)) AS alive FROM g JOIN
  (SELECT lane, n, o, entity, v, t FROM r UNION ALL SELECT lane, ns, -1, entity, NULL, {T0} + ns * {HOUR} FROM b WHERE lapsed) c ON c.lane = g.lane AND (c.n < g.n OR (c.n = g.n AND c.o < g.o)) AND c.t <= g.t GROUP BY ALL)
SELECT lane, entity, CASE WHEN v IS NULL THEN 'retract' ELSE 'assert' END AS kind, (n * 16777216 + o + 1)::BIGINT AS seq, v AS version, t AS valid_from, NULL::BIGINT AS valid_to FROM b
UNION ALL SELECT lane, entity, 'retract', (ns * 16777216)::BIGINT, NULL, {T0} + ns * {HOUR}, NULL FROM b WHERE lapsed
UNION ALL SELECT lane, entity, 'unknown', (n * 16777216 + o + 1)::BIGINT, NULL, {T0} + n * {HOUR}, {T0} + n * {HOUR} + 300 + o % 900 FROM k WHERE alive""")
def lane_claims(spark, d):
    """Claims out of lanes with closes, syncs and gaps."""
    return E.claims_from_lanes(_lanes(spark, d)).select("lane", "entity", "kind", "seq", "version", "valid_from", "valid_to")


@query(EV + f"SELECT user_id, min(s) AS first, max(s) AS last, count(DISTINCT producer) AS producers, count(*) AS n FROM ev WHERE s >= {LO} AND s < {HI} GROUP BY user_id")
def announced_resources(spark, d):
    rows = logs(spark, d, LO, HI)
    return rows.groupBy("user_id").agg(F.min("s").alias("first"), F.max("s").alias("last"), F.count_distinct("producer").alias("producers"), F.count("*").alias("n"))


@query(EV + "SELECT DISTINCT s - s % 3600 AS hour, user_id, metric FROM ev")
def series_announced_hourly(spark, d):
    """Each series once for each hour in which it has points."""
    rows = logs(spark, d).withColumn("hour", bucket(F.col("s"), HOUR))
    return rows.dropDuplicates(["hour", "user_id", "metric"]).select("hour", "user_id", "metric")


# Completeness, plans and audits

_BOUNDS = {"c0": T0 + 8 * DAY, "c1": T0 + 12 * DAY, "c2": T0 + 3 * DAY}


@query(EV + f"""SELECT producer, cluster, max(received) AS lost_through FROM ev WHERE batch_id % 6 = 0 AND received < CASE cluster WHEN 'c0' THEN {_BOUNDS['c0']} WHEN 'c1' THEN {_BOUNDS['c1']} ELSE {_BOUNDS['c2']} END GROUP BY ALL""")
def basis_expired(spark, d):
    slots = logs(spark, d).select("producer", "cluster", F.col("batch_id").alias("seq"), "received", (F.col("batch_id") % 6 == 0).alias("deleted"))
    return C.basis_expired(slots, ["producer"], _BOUNDS)


@query(EV + f""", st AS (SELECT cluster, received AS seen, max(s) AS c FROM ev WHERE event_id % 90 = 0 GROUP BY cluster, received),
h AS (SELECT cluster, x AS hour, arg_max(c, seen) AS c, max(seen) AS seen FROM st JOIN (SELECT unnest(range({LO}, {HI}, {HOUR})) AS x) ON seen < x + {HOUR} GROUP BY ALL)
SELECT cluster, hour, c, seen, hour + {HOUR} <= {HI - DAY} AS final FROM h""")
def watermark_hours(spark, d):
    steps = logs(spark, d).filter("event_id % 90 = 0").groupBy("cluster", F.col("received").alias("at")).agg(F.max("s").alias("c"))
    return C.hourly_history(steps, ["cluster"], LO, HI, HI - DAY).withColumnRenamed("at", "seen")


@query(EV + ", w AS (SELECT batch_id, row_ordinal FROM ev UNION ALL SELECT batch_id, row_ordinal FROM ev WHERE event_id % 150 = 0) SELECT batch_id, count(*) - count(DISTINCT row_ordinal) AS extra FROM w GROUP BY batch_id HAVING count(*) > count(DISTINCT row_ordinal)")
def ordinals_repeated(spark, d):
    e = logs(spark, d)
    return C.repeated_ordinals(e.unionByName(e.filter("event_id % 150 = 0")), "batch_id", "row_ordinal")


@query(EV + ", k AS (SELECT event_type || (event_id % 4000) AS key, count(DISTINCT batch_id) AS batches FROM ev GROUP BY key) SELECT batches, count(*) AS keys FROM k WHERE batches > 1 GROUP BY batches")
def keys_ingested_twice(spark, d):
    rows = logs(spark, d).withColumn("key", F.concat("event_type", (F.col("event_id") % 4000).cast("string")))
    return C.groups_ingested_twice(rows, "batch_id", "key")


_ASKED = ("license", "apache", "que", "nosuchword")


@query(f"SELECT DISTINCT t.key, doc_id % 40 AS file FROM documents JOIN (SELECT unnest({list(_ASKED)}) AS key) t ON regexp_matches(lower(text), '(^|[^a-z0-9_])' || t.key || '([^a-z0-9_]|$)') WHERE doc_id % 40 < 24")
def index_shards(spark, d):
    """Files that hold words, by an hourly index of which the first day has been merged into shards and the second has not."""
    rows = read(spark, d, "documents").select("text", (F.col("doc_id") % 40).alias("file"))
    hours = T0 + F.col("file") * 2 * HOUR  # two days of hours
    entries = I.terms(rows, "text").withColumn("hour", hours)
    path = scratch(spark, "index")
    I.write_hours(entries, path)
    I.merge_day(spark, path, T0)
    out = I.look_up(spark, path, list(_ASKED), T0, T0 + 2 * DAY, {T0})
    return out.filter("cast(file as long) < 24").select("key", F.col("file").cast("long").alias("file"))


# Model calls


@query(with_(SCORES, LLM) + """, m AS (SELECT DISTINCT trace_id, model FROM ls), f AS (SELECT score_id, arg_max(trace_id, (received, ordinal)) AS trace_id, arg_max(name, (received, ordinal)) AS name, arg_max(value, (received, ordinal)) AS value, arg_max(kind, (received, ordinal)) AS kind FROM sc GROUP BY score_id)
SELECT model, name, count(*) AS n, round(avg(value), 6) AS mean FROM f JOIN m USING (trace_id) WHERE kind = 'assert' GROUP BY ALL""")
def score_mean_by_model(spark, d):
    facts = T.resolve_scores(scores(spark, d), 1 << 60)
    return T.score_means(facts, llm_spans(spark, d))


_SECRET = "a key of the test"


@query(f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, 'ns' || (conv_id % 5) AS tenant, (conv_id % 30)::VARCHAR AS day FROM conversations),
k AS (SELECT *, unhex(sha256(encode('{_SECRET}') || unhex(sha256(encode('{_SECRET}') || encode(tenant || chr(31) || day))))) AS key FROM c)
SELECT conv_id, turn, sha256(key || unhex(sha256(key || encode(text)))) AS ref FROM k""")
def payload_keyed_refs(spark, d):
    c = read(spark, d, "conversations")
    tenant = F.concat(F.lit("ns"), F.col("conv_id") % 5)
    return c.select("conv_id", "turn", T.keyed_ref(F.coalesce("text", F.lit("")), tenant, F.col("conv_id") % 30, _SECRET).alias("ref"))


@query("SELECT conv_id, turn, left(t, list_max(list_filter(range(0, 41), lambda k: strlen(left(t, k)) <= 40))::INT) AS body FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)")
def payload_cut(spark, d):
    """Payloads cut at 40 bytes, never inside a character."""
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", T.prepared_payload(F.coalesce("text", F.lit("")), [], 40).alias("body"))
