"""Queries over traces, model calls, entities and scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import scope as S
from ..operators import traces as T
from ..sources.tables import DAY, LLM, LOGS, PRICES, SCORES, SPANS, T0, llm_spans, logs, prices, read, scores, spans, with_

QUERIES, SQL = {}, {}
BASIS = T0 + 2 * DAY


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f
    return add


SP = with_(SPANS)


@query(SP + "SELECT trace_id, span_id, name, service, start, duration, status FROM sp WHERE trace_id = md5('17')")
def trace_by_id(spark, d):
    return spans(spark, d).filter(F.col("trace_id") == F.md5(F.lit("17"))).drop("parent_id")


@query(SP + "SELECT trace_id, min(start) AS first, max(start) AS last, count(*) AS n FROM sp WHERE trace_id <> '' GROUP BY trace_id")
def trace_time_ranges(spark, d):
    return T.time_ranges(spans(spark, d))


@query("""SELECT md5(l_orderkey::VARCHAR) AS trace_id, l_orderkey || '-' || l_linenumber AS span_id, 'o' || l_orderkey AS parent_id,
  epoch_us(l_shipdate) // 1000000 - epoch_us(o_orderdate) // 1000000 AS after,
  CASE WHEN o_orderkey IS NULL THEN NULL WHEN o_orderstatus = 'F' THEN 'Error' ELSE 'Ok' END AS parent_status FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def span_parent_child(spark, d):
    """Lines beside the orders that they belong to: only orders can be parents."""
    all_ = spans(spark, d)
    rows = T.parent_child(all_, all_.filter("name = 'order'"))
    return rows.select("trace_id", "span_id", "parent_id", (F.col("start") - F.col("parent_start")).alias("after"), "parent_status")


@query(SP + "SELECT d AS depth, count(*) AS n FROM (SELECT CASE WHEN s.parent_id = '' THEN 0 WHEN p.span_id IS NOT NULL THEN 1 END AS d FROM sp s LEFT JOIN sp p ON p.trace_id = s.trace_id AND p.span_id = s.parent_id AND s.parent_id <> '') GROUP BY d")
def span_depths(spark, d):
    return T.depths(spans(spark, d)).groupBy("depth").agg(F.count("*").alias("n"))


@query(with_(SPANS, LOGS) + "SELECT sp.trace_id, count(*) AS spans, any_value(e.n) AS logs FROM sp JOIN (SELECT md5((event_id % 500)::VARCHAR) AS trace_id, count(*) AS n FROM ev WHERE severity = 'ERROR' GROUP BY 1) e ON e.trace_id = sp.trace_id GROUP BY sp.trace_id")
def trace_log_correlate(spark, d):
    errors = logs(spark, d).filter("severity = 'ERROR'").groupBy(F.md5((F.col("event_id") % 500).cast("string")).alias("trace_id")).agg(F.count("*").alias("logs"))
    return spans(spark, d).groupBy("trace_id").agg(F.count("*").alias("spans")).join(errors, "trace_id")


@query(SP + "SELECT service, status, count(*) AS n, round(quantile_cont(duration, 0.95), 4) AS p95 FROM sp GROUP BY ALL")
def trace_latency(spark, d):
    return spans(spark, d).groupBy("service", "status").agg(F.count("*").alias("n"), F.round(F.expr("percentile(duration, 0.95)"), 4).alias("p95"))


_PRICED = with_(LLM, PRICES) + f""", ok AS (SELECT * FROM pr WHERE system_from < {BASIS}),
px AS (SELECT ls.*, (SELECT arg_max(price, (valid_from, system_from, price_id)) FROM ok WHERE ok.model = ls.model AND ok.valid_from <= ls.start) AS price FROM ls)
"""


def _priced(spark, d):
    return T.price_as_of(llm_spans(spark, d), prices(spark, d), ["model"], "start", BASIS, ["system_from", "price_id"], span=(T0, T0 + 7 * DAY))


@query(_PRICED + "SELECT span_id, model, tokens, round(price, 9) AS price, round(tokens * price, 9) AS cost FROM px")
def cost_asof_price(spark, d):
    return _priced(spark, d).select("span_id", "model", "tokens", F.round("price", 9).alias("price"), F.round(F.col("tokens") * F.col("price"), 9).alias("cost"))


@query(_PRICED + f"SELECT (start - start % {DAY}) AS day, model, sum(tokens) AS tokens, round(sum(tokens * price), 6) AS cost FROM px GROUP BY ALL")
def cost_by_model_day(spark, d):
    return _priced(spark, d).groupBy((F.col("start") - F.col("start") % DAY).alias("day"), "model").agg(F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("tokens") * F.col("price")), 6).alias("cost"))


@query(_PRICED + "SELECT session_id, count(DISTINCT trace_id) AS traces, min(start) AS first, max(start + duration) AS last, sum(tokens) AS tokens, round(sum(tokens * price), 6) AS cost FROM px GROUP BY session_id ORDER BY last DESC, session_id LIMIT 50")
def sessions(spark, d):
    out = _priced(spark, d).groupBy("session_id").agg(F.count_distinct("trace_id").alias("traces"), F.min("start").alias("first"), F.max(F.col("start") + F.col("duration")).alias("last"), F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("tokens") * F.col("price")), 6).alias("cost"))
    return out.orderBy(F.desc("last"), "session_id").limit(50)


_SCORES = f""", rs AS (SELECT score_id, f.trace_id AS trace_id, f.name AS name, f.value AS value FROM (SELECT score_id, arg_max({{'trace_id': trace_id, 'name': name, 'value': value, 'kind': kind}}, (received, ordinal)) AS f
  FROM sc WHERE received < {BASIS} GROUP BY score_id) WHERE f.kind = 'assert')
"""


@query(with_(SCORES) + _SCORES + "SELECT score_id, trace_id, name, round(value, 6) AS value FROM rs")
def score_resolve_at_basis(spark, d):
    return T.resolve_scores(scores(spark, d), BASIS).withColumn("value", F.round("value", 6))


@query(with_(SCORES) + _SCORES + "SELECT name, floor(round(value * 10, 6))::BIGINT AS bucket, count(*) AS n FROM rs GROUP BY ALL")
def score_histogram(spark, d):
    return T.score_distribution(T.resolve_scores(scores(spark, d), BASIS))


@query(_PRICED + "," + SCORES + _SCORES + """, tr AS (SELECT trace_id, min(start) AS ts, max(start + duration) - min(start) AS latency, sum(tokens) AS tokens, round(sum(tokens * price), 6) AS cost FROM px GROUP BY trace_id ORDER BY ts DESC, trace_id LIMIT 50)
SELECT tr.*, s.score FROM tr LEFT JOIN (SELECT trace_id, round(avg(value), 6) AS score FROM rs GROUP BY trace_id) s USING (trace_id)""")
def trace_list(spark, d):
    rows = _priced(spark, d).withColumn("cost", F.col("tokens") * F.col("price"))
    return T.trace_list(rows, T.resolve_scores(scores(spark, d), BASIS), 50)


LS = with_(LLM)


@query(LS + "SELECT ref, count(*) AS uses, any_value(octet_length(encode(content))) AS bytes FROM ls GROUP BY ref")
def payload_dedup(spark, d):
    rows, payloads = T.offload(llm_spans(spark, d).drop("ref"), "content", -1)
    return rows.groupBy("ref").agg(F.count("*").alias("uses")).join(payloads.select("ref", F.octet_length("content").cast("long").alias("bytes")), "ref")


def _refs(spark, d):
    """Traces with the references of their turns in order, and the payloads."""
    rows = llm_spans(spark, d)
    refs = rows.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "ref"))), lambda x: x["ref"]).alias("refs"))
    return refs, rows.select("ref", "content").dropDuplicates(["ref"])


@query(LS + "SELECT trace_id, md5(string_agg(content, ',' ORDER BY start)) AS content FROM ls GROUP BY trace_id")
def payload_resolve(spark, d):
    refs, payloads = _refs(spark, d)
    return T.resolve(refs, payloads, "trace_id", "refs").withColumn("content", F.md5("content"))


@query(LS + "SELECT trace_id, ref FROM ls WHERE substr(ref, 1, 1) = 'a'")
def payload_dangling(spark, d):
    refs, payloads = _refs(spark, d)
    return T.dangling(refs, payloads.filter("substr(ref, 1, 1) <> 'a'"), "trace_id", "refs")


@query(LS + "SELECT DISTINCT trace_id FROM ls WHERE contains(lower(content), 'que')")
def payload_search(spark, d):
    refs, payloads = _refs(spark, d)
    return T.spans_holding(refs, payloads, "trace_id", "refs", F.lower("content").contains("que")).select("trace_id")


# Catalog: region is the cluster, nation the namespace, customer the pod, supplier the node.


@query("SELECT c_custkey AS pod, r_name AS cluster, n_name AS namespace, s_name AS node, i AS container FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN supplier ON s_suppkey = c_custkey % 10 CROSS JOIN (SELECT unnest(range(0, 3)) AS i) WHERE i <= c_custkey % 3")
def catalog_star_join(spark, d):
    c, n, r, s = (read(spark, d, t) for t in ("customer", "nation", "region", "supplier"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).join(s, s.s_suppkey == c.c_custkey % 10)
    container = F.explode(F.sequence(F.lit(0).cast("long"), F.col("c_custkey") % 3)).alias("container")
    return rows.select(F.col("c_custkey").alias("pod"), F.col("r_name").alias("cluster"), F.col("n_name").alias("namespace"), F.col("s_name").alias("node"), container)


_VERSIONS = with_(LOGS) + ", ve AS (SELECT user_id, event_id, event_type AS version, s AS valid_from, lead(s) OVER (PARTITION BY user_id ORDER BY us, event_id) AS valid_to FROM ev)\n"


def _versions(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = logs(spark, d).withColumn("valid_to", F.lead("s").over(w))
    return rows.select("user_id", "event_id", F.col("event_type").alias("version"), F.col("s").alias("valid_from"), "valid_to")


@query(_VERSIONS + f"SELECT user_id, event_id, version, valid_from FROM ve WHERE valid_from <= {T0 + 9 * DAY} AND (valid_to IS NULL OR valid_to > {T0 + 9 * DAY})")
def catalog_scd2_asof(spark, d):
    return E.as_of(_versions(spark, d), T0 + 9 * DAY).select("user_id", "event_id", "version", "valid_from")


@query(_VERSIONS + f", q AS (SELECT o_orderkey, o_custkey % 150 AS user_id, {T0} + o_orderkey % 2500000 AS t FROM orders) SELECT o_orderkey, q.user_id, event_id, version FROM q LEFT JOIN ve ON ve.user_id = q.user_id AND valid_from <= t AND (valid_to IS NULL OR valid_to > t)")
def catalog_join_asof(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), (F.lit(T0) + F.col("o_orderkey") % 2_500_000).alias("t"))
    return E.join_as_of(o, _versions(spark, d), ["user_id"], "t", span=(T0, T0 + 30 * DAY)).select("o_orderkey", "user_id", "event_id", "version")


@query(_VERSIONS + "SELECT user_id, version, min(valid_from) AS valid_from, arg_max({'v': valid_to}, event_id).v AS closed_at, max(event_id % 2) AS uncertain, min(event_id) AS attrs FROM (SELECT *, coalesce(valid_to, 0) AS v FROM ve) GROUP BY ALL")
def catalog_versions_merge(spark, d):
    rows = _versions(spark, d).withColumns({"closed_at": F.col("valid_to"), "observed": F.col("event_id"), "uncertain": F.col("event_id") % 2, "attrs": F.col("event_id")})
    return E.merge_versions(rows, ["user_id", "version"])


@query(with_(LOGS) + f""", co AS (SELECT user_id, min(s) AS valid_from, NULL::BIGINT AS valid_to FROM ev WHERE severity = 'ERROR' AND user_id % 3 <> 0 GROUP BY user_id),
an AS (SELECT user_id, min(s) AS f, max(s) AS l FROM ev GROUP BY user_id)
SELECT user_id, valid_from, valid_to, false AS uncertain FROM co UNION ALL SELECT user_id, f, l + 7200, true FROM an WHERE user_id NOT IN (SELECT user_id FROM co)""")
def catalog_merge_announced(spark, d):
    rows = logs(spark, d)
    controller = rows.filter("severity = 'ERROR' and user_id % 3 <> 0").groupBy("user_id").agg(F.min("s").alias("valid_from")).withColumn("valid_to", F.lit(None).cast("long"))
    announced = rows.groupBy("user_id").agg(F.min("s").alias("first_seen"), F.max("s").alias("last_seen"))
    return E.with_announced(controller, announced, "user_id", 7200)


@query(with_(LOGS) + f", li AS (SELECT user_id, min(s) AS a, max(s) + 1 AS b FROM ev GROUP BY user_id) SELECT x AS bucket, count(*) AS n FROM (SELECT unnest(range({T0}, {T0 + 30 * DAY}, {DAY})) AS x) JOIN li ON a < x + {DAY} AND b > x GROUP BY x")
def lifetime_buckets(spark, d):
    dim = logs(spark, d).groupBy("user_id").agg(F.min("s").alias("valid_from"), (F.max("s") + 1).alias("valid_to"))
    return E.lifetimes_in_buckets(dim, DAY, T0, T0 + 30 * DAY).groupBy("bucket").agg(F.count("*").alias("n"))


def _attributes(spark, d):
    """Users with attributes of which some are missing."""
    u = logs(spark, d).select("user_id").distinct()
    tier = F.when(F.col("user_id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("t"), F.col("user_id") % 3))
    m = F.map_filter(F.create_map(F.lit("tier"), tier, F.lit("zone"), F.concat(F.lit("z"), F.col("user_id") % 2)), lambda k, v: v.isNotNull())
    return E.attribute_rows(u.withColumn("attributes", m), "user_id", "attributes")


_TIER = "CASE WHEN user_id % 4 = 0 THEN '' ELSE 't' || (user_id % 3) END"


@query(with_(LOGS) + f"SELECT user_id, count(*) AS n FROM ev WHERE {_TIER} = 't1' GROUP BY user_id")
def attr_filter_eq(spark, d):
    return E.attribute_filter(logs(spark, d), _attributes(spark, d), "user_id", "tier", "=", ["t1"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query(with_(LOGS) + f"SELECT user_id, count(*) AS n FROM ev WHERE {_TIER} <> 't1' GROUP BY user_id")
def attr_filter_neq_missing(spark, d):
    return E.attribute_filter(logs(spark, d), _attributes(spark, d), "user_id", "tier", "!=", ["t1"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query(with_(LOGS) + f"SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM ev WHERE {_TIER} NOT LIKE 't%'")
def attr_filter_not_like(spark, d):
    return E.attribute_filter(logs(spark, d), _attributes(spark, d), "user_id", "tier", "not like", ["t%"]).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


# Bitemporal claims made of events.
TRUST = 3600


def _claims(spark, d):
    e = logs(spark, d)
    kind, src = F.col("event_type"), F.col("event_id") % 3
    return e.select(
        F.col("user_id").alias("entity"), F.when(kind == "error", "retract").when(kind == "signup", "unknown").when((kind == "click") & (F.col("event_id") % 40 == 0), "pseudonymise").otherwise("assert").alias("kind"),
        F.when(src == 0, "controller").when(src == 1, "overseer").otherwise("announce").alias("source"), F.col("event_id").alias("seq"), F.concat(F.lit("v"), F.col("event_id")).alias("version"),
        (F.col("s") - F.col("s") % 60).alias("valid_from"), (F.col("s") - F.col("s") % 60 + (F.col("event_id") % 7 + 1) * DAY).alias("valid_to"), F.col("received").alias("system_from"),
    )


_CLAIMS = with_(LOGS) + f""", cl AS (SELECT user_id AS entity, CASE WHEN event_type = 'error' THEN 'retract' WHEN event_type = 'signup' THEN 'unknown' WHEN event_type = 'click' AND event_id % 40 = 0 THEN 'pseudonymise' ELSE 'assert' END AS kind,
  CASE event_id % 3 WHEN 0 THEN 'controller' WHEN 1 THEN 'overseer' ELSE 'announce' END AS source, event_id AS seq, 'v' || event_id AS version,
  s - s % 60 AS valid_from, s - s % 60 + (event_id % 7 + 1) * {DAY} AS valid_to, received AS system_from FROM ev)
"""


def _resolve_sql(points: str, st: int) -> str:
    """points: entity, p. For each the answer by scalar choice, not by aggregation of structs."""
    return f""", ax AS (SELECT q.entity, q.p, c.* EXCLUDE (entity), system_from + CASE WHEN source = 'controller' THEN {TRUST} ELSE 0 END AS eff
  FROM ({points}) q JOIN cl c ON c.entity = q.entity AND c.valid_from <= q.p AND c.valid_to > q.p AND c.system_from <= {st} AND c.kind <> 'pseudonymise'),
au AS (SELECT *, row_number() OVER (PARTITION BY entity, p ORDER BY eff DESC, (source = 'controller') DESC, seq DESC) AS n FROM ax WHERE source <> 'announce'),
an AS (SELECT *, row_number() OVER (PARTITION BY entity, p ORDER BY system_from DESC, seq DESC) AS n FROM ax WHERE source = 'announce' AND kind = 'assert'),
re AS (SELECT k.entity, k.p, CASE WHEN a.kind = 'assert' THEN 'asserted' WHEN a.kind = 'retract' THEN 'retracted' WHEN o.seq IS NOT NULL THEN 'announced' WHEN a.kind = 'unknown' THEN 'unknown' ELSE 'absent' END AS status,
  CASE WHEN a.kind = 'assert' THEN a.version WHEN a.kind = 'retract' THEN NULL ELSE o.version END AS version, coalesce(a.kind = 'unknown' AND o.seq IS NOT NULL, false) AS uncertain
  FROM (SELECT DISTINCT entity, p FROM ax) k LEFT JOIN au a ON a.entity = k.entity AND a.p = k.p AND a.n = 1 LEFT JOIN an o ON o.entity = k.entity AND o.p = k.p AND o.n = 1)
"""


VT, ST = T0 + 12 * DAY, T0 + 20 * DAY


@query(_CLAIMS + _resolve_sql(f"SELECT DISTINCT entity, {VT} AS p FROM cl", ST) + "SELECT entity, status, version, uncertain FROM re")
def bitemp_point(spark, d):
    return E.point(_claims(spark, d), VT, ST, TRUST)


@query(_CLAIMS + _resolve_sql(f"SELECT DISTINCT entity, {VT} AS p FROM cl", ST) + ", ps AS (SELECT entity, arg_min(version, (system_from, seq)) AS name FROM cl WHERE kind = 'pseudonymise' GROUP BY entity) SELECT re.entity, status, CASE WHEN status = 'asserted' AND name IS NOT NULL THEN name ELSE version END AS version, uncertain FROM re LEFT JOIN ps ON ps.entity = re.entity")
def bitemp_redacted(spark, d):
    claims = _claims(spark, d)
    return E.redacted(E.point(claims, VT, ST, TRUST), claims)


@query(_CLAIMS + f", ed AS (SELECT entity, valid_from AS p FROM cl WHERE system_from <= {ST} UNION SELECT entity, valid_to FROM cl WHERE system_from <= {ST}), sl AS (SELECT entity, p, lead(p) OVER (PARTITION BY entity ORDER BY p) AS hi FROM ed)"
       + _resolve_sql("SELECT entity, p FROM sl WHERE hi IS NOT NULL", ST)
       + """, jo AS (SELECT re.*, sl.hi FROM re JOIN sl ON sl.entity = re.entity AND sl.p = re.p),
mk AS (SELECT *, CASE WHEN p = lag(hi) OVER w AND status = lag(status) OVER w AND version IS NOT DISTINCT FROM lag(version) OVER w AND uncertain = lag(uncertain) OVER w THEN 0 ELSE 1 END AS new FROM jo WINDOW w AS (PARTITION BY entity ORDER BY p)),
ru AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY p) AS run FROM mk)
SELECT entity, status, version, uncertain, min(p) AS lo, max(hi) AS hi FROM ru GROUP BY entity, run, status, version, uncertain""")
def bitemp_range(spark, d):
    return E.intervals(_claims(spark, d), ST, TRUST)


@query(with_(LOGS) + "SELECT cluster, namespace, count(*) AS n FROM ev WHERE cluster = 'c0' OR (cluster IN ('c1', 'c2') AND namespace IN ('ns1', 'ns3')) GROUP BY ALL")
def scope_pairs(spark, d):
    grants = [("c0", "*"), ("c0", "ns1"), ("c1", "ns1"), ("c1", "ns3"), ("c2", "ns3"), ("c2", "ns1")]
    return logs(spark, d).filter(S.predicate(grants)).groupBy("cluster", "namespace").agg(F.count("*").alias("n"))


@query(with_(LOGS) + "SELECT user_id, count(*) AS n FROM ev WHERE cluster = 'c1' AND namespace = 'ns1' GROUP BY user_id")
def scope_semi_catalog(spark, d):
    rows = logs(spark, d)
    catalog = rows.select("user_id", "cluster", "namespace").distinct()
    return S.in_catalog(rows.drop("cluster", "namespace"), catalog, [("c1", "ns1")], "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query(with_(LOGS) + "SELECT severity, count(*) AS n FROM ev WHERE cluster = 'c1' AND value > 10 GROUP BY severity")
def scoped_sql(spark, d):
    return S.scoped_sql(spark, "WITH big AS (SELECT * FROM logs WHERE value > 10) SELECT severity, count(*) AS n FROM big GROUP BY severity", {"logs": logs(spark, d)}, [("c1", "*")])


@query(with_(LOGS) + "SELECT key, count(*) AS n, count(DISTINCT value) AS different, round(avg(length(value)), 6) AS avg_len FROM (SELECT 'k' AS key, k AS value FROM ev UNION ALL SELECT 'ns', namespace FROM ev) GROUP BY key")
def attr_key_stats(spark, d):
    rows = logs(spark, d).select(F.explode(F.create_map(F.lit("k"), "k", F.lit("ns"), "namespace")).alias("key", "value"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("different"), F.round(F.avg(F.length("value")), 6).alias("avg_len"))
