"""Queries that pass rows through a source's or sink's own form and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import content_id, map_get, overlay
from ..operators import entities as E
from ..operators import traces as T
from ..operators.work import spread
from ..sources import feeds as S
from ..sources.protobuf import requests_of
from ..sources.tables import DAY, LLM, LOGS, SCORES, T0, llm_spans, logs, read, scores, with_

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f
    return add


def _text(key: str, value) -> "F.Column":
    return F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("stringValue")).alias("value"))


_LOG_ROWS = with_(LOGS) + "SELECT event_id, us * 1000 AS time_ns, severity, event_type AS service, 'value ' || k AS body, cluster FROM ev"


def _log_requests(spark, d):
    """Each row as an export request in JSON."""
    e = spread(logs(spark, d).select("event_id", "us", "severity", "event_type", "k", "cluster"))
    record = F.struct((F.col("us") * 1000).cast("string").alias("timeUnixNano"), F.col("severity").alias("severityText"), F.struct(F.concat(F.lit("value "), "k").alias("stringValue")).alias("body"), F.array(_text("event_id", F.col("event_id"))).alias("attributes"))
    request = F.struct(F.array(F.struct(F.struct(F.array(_text("service.name", F.col("event_type")), _text("cluster", F.col("cluster"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    return e.select(F.to_json(request).alias("value"))


def _log_rows(rows):
    return rows.select(map_get("attributes", "event_id").cast("long").alias("event_id"), "time_ns", "severity", "service", "body", map_get("resource", "cluster").alias("cluster"))


@query(_LOG_ROWS)
def otlp_log_rows(spark, d):
    """Requests in JSON, walked back into rows."""
    return _log_rows(S.otlp_logs(_log_requests(spark, d)))


@query(_LOG_ROWS)
def otlp_protobuf_rows(spark, d):
    """The same requests in protobuf."""
    return _log_rows(S.otlp_logs(requests_of(_log_requests(spark, d), "resourceLogs")))


@query(with_(LOGS) + "SELECT metric, us * 1000 AS time_ns, value, user_id::VARCHAR AS u FROM ev WHERE event_type IN ('view', 'click')")
def otlp_metric_rows(spark, d):
    """Gauges and sums out of export requests."""
    e = logs(spark, d).filter("event_type in ('view', 'click')")
    point = F.array(F.struct(F.array(_text("user", F.col("user_id"))).alias("attributes"), (F.col("us") * 1000).cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble")))
    gauge = F.when(F.col("event_type") == "view", F.struct(point.alias("dataPoints")))
    total = F.when(F.col("event_type") == "click", F.struct(point.alias("dataPoints"), F.lit(2).alias("aggregationTemporality"), F.lit(True).alias("isMonotonic")))
    request = F.struct(F.array(F.struct(F.array(F.struct(F.array(F.struct(F.col("metric").alias("name"), gauge.alias("gauge"), total.alias("sum"))).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    kinds = S.otlp_metrics(e.select(F.to_json(request).alias("value")))
    parts = [kinds[k].select("metric", "time_ns", "value", map_get("attributes", "user").alias("u")) for k in ("gauge", "sum")]
    return parts[0].unionByName(parts[1])


@query(with_(LLM) + "SELECT trace_id, span_id, CASE WHEN role = 'user' THEN 'SPAN' ELSE 'GENERATION' END AS type, model, CASE WHEN role = 'user' THEN 0 ELSE tokens END AS output_tokens FROM ls")
def llm_mapping(spark, d):
    """Typed columns out of attributes of which some are missing or empty."""
    s = llm_spans(spark, d)
    chat = F.col("role") != "user"
    m = F.create_map(F.lit("gen_ai.operation.name"), F.when(chat, "chat").otherwise("invoke_agent"), F.lit("gen_ai.response.model"), F.when(chat, F.lit("")).otherwise(F.col("model")), F.lit("gen_ai.request.model"), F.col("model"), F.lit("gen_ai.usage.output_tokens"), F.when(chat, F.col("tokens").cast("string")).otherwise("none"))
    return T.map_llm(s.withColumn("attributes", m)).select("trace_id", "span_id", "type", "model", "output_tokens")


@query(with_(SCORES) + "SELECT score_id, trace_id, name, round(value, 6) AS value, kind, received FROM sc WHERE kind = 'assert'")
def score_facts(spark, d):
    """Log records of scores as facts; records without a number are left out."""
    s = scores(spark, d)
    m = F.create_map(F.lit("name"), "name", F.lit("value"), F.when(F.col("kind") == "assert", F.col("value").cast("string")).otherwise("none"), F.lit("id"), "score_id")
    rows = s.select("trace_id", "kind", "received", m.alias("a"))
    return rows.select(map_get("a", "id").alias("score_id"), "trace_id", map_get("a", "name").alias("name"), F.round(map_get("a", "value").try_cast("double"), 6).alias("value"), "kind", "received").filter("value is not null")


_AT = "user_id, 'z' || (user_id % 2) AS zone, CASE WHEN user_id % 4 = 0 THEN '' ELSE 't' || (user_id % 3) END AS tier"


@query(with_(LOGS) + f"SELECT count(DISTINCT (zone, tier)) AS resources, count(*) AS n FROM (SELECT {_AT} FROM ev)")
def resource_ids(spark, d):
    """Resources have as many ids as there are different covered attributes, empty ones left out."""
    tier = F.when(F.col("user_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("t"), F.col("user_id") % 3))
    m = F.create_map(F.lit("zone"), F.concat(F.lit("z"), F.col("user_id") % 2), F.lit("tier"), tier, F.lit("own"), F.col("event_id").cast("string"))
    rows = E.resource_ids(logs(spark, d).withColumn("attributes", m), "attributes", ["zone", "tier"])
    return rows.agg(F.count_distinct("resource_id").alias("resources"), F.count_if(F.map_contains_key("residual", F.lit("own"))).alias("n"))


@query(with_(LOGS) + "SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'over' ELSE 'z' || (user_id % 2) END AS zone, count(*) AS n FROM ev GROUP BY user_id")
def attr_overlay(spark, d):
    """Attributes of the catalog under those of the row: the row's win."""
    own = F.when(F.col("user_id") % 5 == 0, F.create_map(F.lit("zone"), F.lit("over"))).otherwise(F.create_map().cast("map<string,string>"))
    m = overlay(F.create_map(F.lit("zone"), F.concat(F.lit("z"), F.col("user_id") % 2)), own)
    return logs(spark, d).groupBy("user_id", map_get(m, "zone").alias("zone")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(DISTINCT md5(coalesce(text, ''))) AS parts, count(*) AS n FROM conversations GROUP BY conv_id")
def payload_parts(spark, d):
    """A JSON array of a conversation's texts, split into payloads, and references counted."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    rows = c.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])).alias("messages"))
    rows, _ = T.offload_parts(rows, "messages")
    return rows.select("conv_id", F.size(F.array_distinct("refs")).cast("long").alias("parts"), F.size("refs").cast("long").alias("n"))


@query(with_(LOGS) + f"SELECT batch_id, min(s) AS min_time, max(s) AS max_time, count(*) AS n FROM ev WHERE s < {T0 + 20 * DAY} GROUP BY batch_id")
def batch_manifest(spark, d):
    """What the manifest of a batch says."""
    return logs(spark, d).filter(F.col("s") < T0 + 20 * DAY).groupBy("batch_id").agg(F.min("s").alias("min_time"), F.max("s").alias("max_time"), F.count("*").alias("n"))


@query(with_(LOGS) + "SELECT n, count(*) AS k FROM (SELECT count(*) AS n FROM ev GROUP BY user_id, severity) GROUP BY n")
def group_by_map(spark, d):
    """Groups by the content of a map, whatever the order of its entries."""
    a = F.create_map(F.lit("u"), F.col("user_id").cast("string"), F.lit("s"), F.col("severity"))
    b = F.create_map(F.lit("s"), F.col("severity"), F.lit("u"), F.col("user_id").cast("string"))
    rows = logs(spark, d).withColumn("m", F.when(F.col("event_id") % 2 == 0, a).otherwise(b))
    return rows.groupBy(content_id("m").alias("id")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))


@query("SELECT o_orderkey, coalesce(c_nationkey::VARCHAR, '') AS nation, coalesce(r_name, '') AS region FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 7 <> 0 LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def dictionary_chain(spark, d):
    """Order to customer to nation to region, an empty text where the chain breaks."""
    c = read(spark, d, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nation"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("rk"))
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("region"))
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"))
    return E.lookup_chain(o, [(c, "cust", "nation"), (n, "nation", "rk"), (r, "rk", "region")]).select("o_orderkey", "nation", "region")


_GAPS = with_(LOGS) + f", g AS (SELECT user_id, s AS lo, s + 7200 AS hi FROM ev WHERE event_id % 25 = 0), v AS (SELECT user_id, event_id AS version, s AS valid_from, lead(s) OVER (PARTITION BY user_id ORDER BY us, event_id) AS closed_at FROM ev WHERE event_id % 3 = 0)\n"


@query(_GAPS + "SELECT user_id, version, EXISTS (SELECT 1 FROM g WHERE g.user_id = v.user_id AND ((v.valid_from >= lo AND v.valid_from < hi) OR (v.closed_at >= lo AND v.closed_at < hi))) AS uncertain FROM v")
def versions_in_gaps(spark, d):
    from pyspark.sql import Window

    e = logs(spark, d)
    gaps = e.filter("event_id % 25 = 0").select("user_id", F.col("s").alias("lo"), (F.col("s") + 7200).alias("hi"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    v = e.filter("event_id % 3 = 0").withColumn("closed_at", F.lead("s").over(w)).select("user_id", F.col("event_id").alias("version"), F.col("s").alias("valid_from"), "closed_at")
    return E.in_gaps(v, gaps, "user_id").select("user_id", "version", "uncertain")


@query(with_(LOGS) + "SELECT cluster, CASE WHEN producer = 'p2' AND received >= 1705276800 AND cluster <> 'c1' THEN 'recovered' ELSE 'live' END AS place, count(*) AS n FROM ev GROUP BY ALL")
def retired_lanes(spark, d):
    from ..operators.lanes import recovered

    e = logs(spark, d)
    lanes = e.select("cluster", "producer").distinct().withColumn("retired_at", F.when(F.col("producer") == "p2", T0 + 14 * DAY)).withColumn("admitted", F.col("cluster") == "c1")
    live, away = recovered(e, lanes, ["cluster", "producer"])
    both = live.withColumn("place", F.lit("live")).unionByName(away.withColumn("place", F.col("source")).drop("source"))
    return both.groupBy("cluster", "place").agg(F.count("*").alias("n"))


@query(with_(LOGS) + f", m AS (SELECT cluster, max(batch_id) AS h FROM ev WHERE received <= {T0 + 20 * DAY} AND batch_id % 5 = 0 GROUP BY cluster) SELECT DISTINCT ev.cluster, batch_id AS seq FROM ev JOIN m ON m.cluster = ev.cluster AND batch_id <= h")
def collectable_slots(spark, d):
    from ..operators.lanes import collectable

    e = logs(spark, d)
    slots = e.select("cluster", F.col("batch_id").alias("seq")).distinct()
    marks = e.filter("batch_id % 5 = 0").select("cluster", F.col("batch_id").alias("position"), F.col("received").alias("at"))
    return collectable(slots, marks, ["cluster"], T0 + 25 * DAY, 5 * DAY)


@query("SELECT conv_id, turn, md5(left(regexp_replace(coalesce(text, ''), '[0-9]{4,}', '[redacted]', 'g'), 1000000)) AS body FROM conversations")
def payload_redacted(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.md5(T.prepared_payload(F.coalesce("text", F.lit("")), ["[0-9]{4,}"])).alias("body"))


@query(with_(LOGS) + "SELECT s - s % 3600 AS hour, bool_or(received - s > 600) AS any_tail, count(*) AS n FROM ev GROUP BY hour")
def tail_buckets(spark, d):
    from ..operators.lanes import marked_buckets

    e = logs(spark, d).withColumns({"hour": F.col("s") - F.col("s") % 3600, "tail": F.col("received") - F.col("s") > 600})
    return marked_buckets(e, "hour").groupBy("hour", "any_tail").agg(F.count("*").alias("n"))


@query(with_(LOGS) + "SELECT user_id AS person, count(*) AS n FROM ev WHERE user_id IN (SELECT user_id FROM ev WHERE namespace = 'ns1') OR user_id = 8 GROUP BY user_id")
def persons_visible(spark, d):
    e = logs(spark, d)
    persons = e.groupBy(F.col("user_id").cast("string").alias("person")).agg(F.count("*").alias("n"))
    seen = e.select(F.col("user_id").cast("string").alias("person"), "namespace")
    return E.visible_persons(persons, seen, "8", ["ns1"]).select(F.col("person").cast("long").alias("person"), "n")


@query(with_(LOGS) + "SELECT user_id, count(DISTINCT version) AS versions, min(s) AS first, max(s) + 3601 AS last FROM (SELECT user_id, event_type AS version, s FROM ev) GROUP BY user_id")
def announced_claims(spark, d):
    seen = logs(spark, d).select(F.col("user_id").alias("entity"), F.col("event_type").alias("version"), F.col("s").alias("t"))
    out = E.claims_from_announcements(seen, 3600)
    return out.groupBy(F.col("entity").alias("user_id")).agg(F.count_distinct("version").alias("versions"), F.min("valid_from").alias("first"), F.max("valid_to").alias("last"))
