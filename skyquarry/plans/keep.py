"""Queries over completeness, lake plans, ingest, alerts and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import bucket, fold_col
from ..operators import alerts as A
from ..operators import control as C
from ..sources.tables import DAY, HOUR, LOGS, T0, logs, read, with_

QUERIES, SQL = {}, {}
LO, HI = T0 + 5 * DAY, T0 + 12 * DAY
BOUNDS = {"c0": T0 + 10 * DAY, "c1": T0 + 12 * DAY, "c2": T0 + 8 * DAY}
EARLIER = {"c0": T0 + 9 * DAY, "c1": T0 + 9 * DAY, "c2": T0 + 7 * DAY}
LATENESS = 600
EV = with_(LOGS)
_C = f"CASE cluster WHEN 'c0' THEN {BOUNDS['c0']} WHEN 'c1' THEN {BOUNDS['c1']} ELSE {BOUNDS['c2']} END"
_E = f"CASE cluster WHEN 'c0' THEN {EARLIER['c0']} WHEN 'c1' THEN {EARLIER['c1']} ELSE {EARLIER['c2']} END"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f
    return add


@query(EV + f"SELECT cluster, count(*) AS n, max(received) AS last FROM ev WHERE received < {_C} GROUP BY cluster")
def basis_rows(spark, d):
    return logs(spark, d).filter(C.Basis(BOUNDS).predicate("received", "cluster")).groupBy("cluster").agg(F.count("*").alias("n"), F.max("received").alias("last"))


@query(EV + f"SELECT cluster, severity, count(*) AS n FROM ev WHERE received < {_C} AND received >= {_E} GROUP BY ALL")
def basis_delta(spark, d):
    return logs(spark, d).filter(C.Basis(BOUNDS).predicate("received", "cluster", EARLIER)).groupBy("cluster", "severity").agg(F.count("*").alias("n"))


@query(EV + f"SELECT cluster, producer, count(*) AS n FROM ev WHERE received > s + {LATENESS} GROUP BY ALL")
def late_rows(spark, d):
    return C.late_rows(logs(spark, d), LATENESS).groupBy("cluster", "producer").agg(F.count("*").alias("n"))


@query(EV + ", m AS (SELECT *, max(s) OVER (PARTITION BY batch_id) AS hi FROM ev) SELECT batch_id, CASE WHEN hi >= 7200 AND s < hi - 7200 THEN 1 ELSE 0 END AS late_part, count(*) AS n FROM m GROUP BY ALL")
def late_split(spark, d):
    return C.late_split(logs(spark, d), ["batch_id"], "s", 7200).groupBy("batch_id", "late_part").agg(F.count("*").alias("n"))


_LOWEST = min(BOUNDS.values())


@query(EV + f""", b AS (SELECT {LO} + (s - {LO}) // {HOUR * 6} * {HOUR * 6} AS lo, count(*) AS n, max(CASE WHEN received >= {_C} THEN 1 ELSE 0 END) AS tail FROM ev WHERE s >= {LO} AND s < {HI} GROUP BY 1)
SELECT lo, n, CASE WHEN tail = 1 OR least(lo + {HOUR * 6}, {HI}) > {_LOWEST - LATENESS} THEN 'incomplete' ELSE 'complete' END AS state FROM b""")
def bucket_states(spark, d):
    rows = logs(spark, d).filter((F.col("s") >= LO) & (F.col("s") < HI))
    step, said = HOUR * 6, C.label(min(BOUNDS.values()), LATENESS, LO, HI)
    tail = ~C.Basis(BOUNDS).predicate("received", "cluster")
    b = rows.groupBy(bucket(F.col("s"), step, LO).alias("lo")).agg(F.count("*").alias("n"), F.max(tail).alias("tail"))
    return b.select("lo", "n", C.bucket_state(said, F.col("lo"), F.least(F.col("lo") + step, F.lit(HI)), F.col("tail")).alias("state"))


def _slots(spark, d):
    """Batches as slots of lanes: the first 7 in 10 are passed; the metadata of every 31st to come is unknown."""
    e = logs(spark, d)
    s = e.groupBy("cluster", "producer", "batch_id").agg(F.min("received").alias("first"), F.max("s").alias("low"))
    last = e.agg(F.max("batch_id")).first()[0]
    passed = F.col("batch_id") * 10 <= F.lit(last) * 7
    return s.select("cluster", "producer", "batch_id", passed.alias("passed"), "low", F.when(passed | (F.col("batch_id") % 31 != 0) | (F.col("producer") != "p3"), F.col("first")).alias("received"))


_SLOTS = EV + """, sl AS (SELECT cluster, producer, batch_id, batch_id * 10 <= (SELECT max(batch_id) FROM ev) * 7 AS passed, max(s) AS low,
  CASE WHEN batch_id * 10 <= (SELECT max(batch_id) FROM ev) * 7 OR batch_id % 31 <> 0 OR producer <> 'p3' THEN min(received) END AS received FROM ev GROUP BY cluster, producer, batch_id),
wm AS (SELECT cluster, producer, CASE WHEN count(*) FILTER (NOT passed AND received IS NULL) > 0 THEN NULL
  ELSE least(max(low) FILTER (passed), coalesce(min(received) FILTER (NOT passed), max(low) FILTER (passed))) END AS watermark FROM sl GROUP BY ALL)
"""


@query(_SLOTS + "SELECT * FROM wm")
def lane_watermark(spark, d):
    return C.lane_watermarks(_slots(spark, d), ["cluster", "producer"])


@query(_SLOTS + f"SELECT cluster, greatest(least(min(CASE WHEN producer = 'p3' AND cluster = 'c2' THEN {C.NEVER} ELSE coalesce(watermark, 0) END), {T0 + 25 * DAY - 60}), {T0 + DAY}) AS c FROM wm GROUP BY cluster")
def complete_through(spark, d):
    lanes = C.lane_watermarks(_slots(spark, d), ["cluster", "producer"]).withColumn("retired", (F.col("producer") == "p3") & (F.col("cluster") == "c2"))
    before = lanes.select("cluster").distinct().withColumn("c", F.lit(T0 + DAY))
    return C.complete_through(lanes, ["cluster"], T0 + 25 * DAY, 60, before)


@query(EV + f"SELECT cluster, arg_max(c, h) AS c, max(h) AS \"at\" FROM (SELECT cluster, s - s % {HOUR} AS h, max(received) AS c FROM ev GROUP BY ALL) WHERE h <= {T0 + 11 * DAY} GROUP BY cluster")
def watermark_asof(spark, d):
    steps = logs(spark, d).groupBy("cluster", bucket(F.col("s"), HOUR).alias("at")).agg(F.max("received").alias("c"))
    return C.history_as_of(steps, ["cluster"], T0 + 11 * DAY)


@query(EV + ", m AS (SELECT cluster, producer, batch_id // 4 AS seq, batch_id % 9 <> 5 AS done FROM ev GROUP BY ALL), k AS (SELECT cluster, producer, seq, bool_and(done) AS done FROM m GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY cluster, producer ORDER BY seq) - 1 AS n FROM k) SELECT cluster, producer, coalesce(min(n) FILTER (NOT done OR seq <> n), count(*)) - 1 AS position FROM n GROUP BY ALL")
def lane_checkpoint(spark, d):
    slots = logs(spark, d).groupBy("cluster", "producer", F.floor(F.col("batch_id") / 4).alias("seq")).agg(F.expr("bool_and(batch_id % 9 <> 5)").alias("done"))
    return C.checkpoints(slots, ["cluster", "producer"])


def _files(spark, d):
    """Batches of a cluster as files; some lack their times."""
    e = logs(spark, d).groupBy("cluster", "batch_id").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.min("received").alias("r"), F.max("received").alias("last_modified"))
    known = F.col("batch_id") % 13 != 0
    return e.select("cluster", "batch_id", F.concat_ws("/", "cluster", "batch_id").alias("path"), F.when(known, F.col("a")).alias("min_time"), F.when(known, F.col("b")).alias("max_time"), F.when(known, F.col("r")).alias("received"), "last_modified", F.when(F.col("batch_id") % 17 == 0, "beat").otherwise("data").alias("kind"))


_FILES = EV + ", fi AS (SELECT cluster, batch_id, CASE WHEN batch_id % 13 <> 0 THEN min(s) END AS min_time, CASE WHEN batch_id % 13 <> 0 THEN max(s) END AS max_time, CASE WHEN batch_id % 13 <> 0 THEN min(received) END AS received, max(received) AS last_modified, CASE WHEN batch_id % 17 = 0 THEN 'beat' ELSE 'data' END AS kind FROM ev GROUP BY cluster, batch_id)\n"


@query(_FILES + f"SELECT cluster || '/' || batch_id AS path FROM fi WHERE kind = 'data' AND cluster IN ('c0', 'c1') AND coalesce(max_time >= {LO}, true) AND coalesce(min_time < {HI}, true) AND last_modified >= {LO - 60}")
def plan_prune(spark, d):
    return C.prune(_files(spark, d), LO, HI, 60, ["c0", "c1"]).select("path")


@query(_FILES + f", p AS (SELECT *, {_C} AS c FROM fi) SELECT cluster || '/' || batch_id AS path, CASE WHEN last_modified > {T0 + 28 * DAY + 120} THEN 'tail' WHEN received >= c THEN 'tail' WHEN received < c THEN 'basis' WHEN last_modified + 60 < c THEN 'basis' ELSE 'check' END AS place, coalesce(received - min_time > 60, false) AS late FROM p")
def plan_tail(spark, d):
    return C.place(_files(spark, d), BOUNDS, 60, T0 + 28 * DAY).select("path", "place", "late")


@query(EV + "SELECT DISTINCT batch_id FROM ev WHERE user_id = 7")
def index_trace_prune(spark, d):
    """Files with a trace: the index narrows, and the rows themselves decide."""
    rows = logs(spark, d).withColumn("trace_id", F.md5(F.col("user_id").cast("string")))
    fp = F.pmod(F.xxhash64(F.md5(F.lit("7"))), F.lit(1 << 32))
    files = C.trace_index(rows, "batch_id").filter(F.col("fp") == fp).select("batch_id")
    return rows.join(files, "batch_id", "left_semi").filter(F.col("trace_id") == F.md5(F.lit("7"))).select("batch_id").distinct()


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'apache license')")
def index_term_prune(spark, d):
    """Substring search behind a term index of groups of ten documents."""
    docs = read(spark, d, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 10).alias("file"))
    files = docs.select("file").distinct().withColumn("covered", F.lit(True))
    hit = C.files_with_text(files, C.term_index(docs, "text"), "apache license")
    return docs.join(hit.select("file"), "file", "left_semi").filter(F.lower("text").contains("apache license")).select("doc_id")


@query("SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9_]', ' ', 'g'), ' +'), lambda x: x <> '')))::BIGINT AS tokens FROM documents")
def token_fold(spark, d):
    toks = F.array_distinct(F.filter(F.split(fold_col(F.col("text")), " +"), lambda x: x != ""))
    return read(spark, d, "documents").select("doc_id", F.size(toks).cast("long").alias("tokens"))


@query(EV + "SELECT cluster, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY cluster")
def ingest_dedup(spark, d):
    """Rows of which every third was delivered twice: the content key lets each in once."""
    from ..streaming.ingest import content_key

    e = logs(spark, d)
    twice = e.unionByName(e.filter("event_id % 3 = 0").withColumn("batch_id", F.col("batch_id") + 1))
    rows = content_key(twice, ["event_id", "us", "user_id", "metric", "value"]).dropDuplicates(["content_key"])
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(EV + f"SELECT k AS key, count(DISTINCT (s - s % {DAY})) AS parts FROM ev WHERE k <> '' GROUP BY k HAVING parts > 1")
def dup_audit(spark, d):
    rows = logs(spark, d).filter("k <> ''").select(F.col("k").alias("key"), bucket(F.col("s"), DAY).alias("day"))
    return C.duplicate_ingest(rows, "key", ["day"])


@query(EV + "SELECT (count(*) - count(DISTINCT (user_id, metric, s - s % 3600)))::BIGINT AS extra, count(DISTINCT (user_id, metric, s - s % 3600)) AS ids FROM ev")
def dup_rows_identity(spark, d):
    return C.duplicate_rows(logs(spark, d).withColumn("h", bucket(F.col("s"), HOUR)), ["user_id", "metric", "h"])


RULE = A.Rule("errors", window=HOUR, every=HOUR, op=">=", threshold=2, hold=2 * HOUR)
_HOLD = EV + f", h AS (SELECT cluster, s - s % {HOUR} + {HOUR} AS e, count(*)::DOUBLE AS value FROM ev WHERE severity = 'ERROR' GROUP BY ALL HAVING count(*) >= 2)\n"


def _errors(spark, d):
    return logs(spark, d).filter("severity = 'ERROR'")


@query(_HOLD + "SELECT cluster, e AS \"end\", value FROM h")
def alert_windows(spark, d):
    return A.evaluate(_errors(spark, d), RULE, "s", ["cluster"])


@query(EV + f""", w AS (SELECT cluster, unnest(range(s - s % {HOUR} + {HOUR}, s + {3 * HOUR} + 1, {HOUR})) AS e FROM ev WHERE severity = 'ERROR')
SELECT cluster, e AS "end", count(*)::DOUBLE AS value FROM w GROUP BY ALL HAVING count(*) > 5""")
def alert_hopping(spark, d):
    return A.evaluate(_errors(spark, d), A.Rule("burst", window=3 * HOUR, every=HOUR, op=">", threshold=5), "s", ["cluster"])


_RUNS = f", r AS (SELECT *, e - {HOUR} * row_number() OVER (PARTITION BY cluster ORDER BY e) AS run FROM h)\n"


@query(_HOLD + _RUNS + f"SELECT cluster, min(e) AS since, max(e) AS until, count(*) AS windows, CASE WHEN max(e) - min(e) >= {2 * HOUR} THEN min(e) + {2 * HOUR} END AS fired_at FROM r GROUP BY cluster, run")
def alert_for_runs(spark, d):
    return A.episodes(A.evaluate(_errors(spark, d), RULE, "s", ["cluster"]), RULE, ["cluster"])


@query(EV + f"SELECT e AS \"end\" FROM (SELECT unnest(range({T0 + HOUR}, {T0 + 30 * DAY + 1}, {HOUR})) AS e) WHERE e NOT IN (SELECT s - s % {HOUR} + {HOUR} FROM ev WHERE event_type = 'signup' AND user_id % 10 = 0)")
def alert_absence(spark, d):
    rows = logs(spark, d).filter("event_type = 'signup' and user_id % 10 = 0")
    return A.absent(rows, RULE, "s", T0, T0 + 30 * DAY)


@query(EV + f""", o AS (SELECT cluster, s - s % {HOUR} + {HOUR} AS e FROM ev WHERE severity = 'ERROR' AND received <= s + {LATENESS} GROUP BY ALL HAVING count(*) >= 2),
h AS (SELECT cluster, s - s % {HOUR} + {HOUR} AS e FROM ev WHERE severity = 'ERROR' GROUP BY ALL HAVING count(*) >= 2)"""
       + _RUNS + f""", f AS (SELECT cluster, e FROM h EXCEPT SELECT cluster, e FROM o), g AS (SELECT cluster, run, min(e) AS since, max(e) AS until FROM r GROUP BY ALL)
SELECT g.cluster, since, until, CASE WHEN until - since >= {2 * HOUR} THEN since + {2 * HOUR} END AS fired_at, count(*) AS added FROM g JOIN f ON f.cluster = g.cluster AND f.e BETWEEN since AND until GROUP BY ALL""")
def alert_late_reeval(spark, d):
    rows = _errors(spark, d)
    on_time = A.evaluate(rows.filter(F.col("received") <= F.col("s") + LATENESS), RULE, "s", ["cluster"])
    return A.late_changes(on_time, A.evaluate(rows, RULE, "s", ["cluster"]), RULE, ["cluster"])


@query(EV + "SELECT event_type AS signal, s - s % 3600 AS hour, count(*) AS n, round(count(*) / 3600.0::DOUBLE, 6) AS per_second FROM ev GROUP BY ALL")
def rates_by_hour(spark, d):
    n = logs(spark, d).groupBy(F.col("event_type").alias("signal"), bucket(F.col("s"), HOUR).alias("hour")).agg(F.count("*").alias("n"))
    return n.withColumn("per_second", F.round(F.col("n") / 3600.0, 6))


@query(EV + ", n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id) SELECT count(*) AS keys, round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.99), 4) AS p99, round(max(n) / sum(n)::DOUBLE, 6) AS top_share FROM n")
def resource_skew(spark, d):
    return C.skew(logs(spark, d), "user_id")


@query(EV + "SELECT producer, min(received - s) AS least, round(quantile_cont(received - s, 0.5), 4) AS p50, max(received - s) AS most FROM ev GROUP BY producer")
def clock_skew(spark, d):
    lag = F.col("received") - F.col("s")
    return logs(spark, d).withColumn("lag", lag).groupBy("producer").agg(F.min("lag").alias("least"), F.round(F.expr("percentile(lag, 0.5)"), 4).alias("p50"), F.max("lag").alias("most"))


@query(EV + "SELECT count(*) FILTER (c IS NULL) AS missing, count(*) FILTER (s >= t) AS after_end FROM ev LEFT JOIN (SELECT c_custkey AS c, 1704067200 + c_custkey * 20000 AS t FROM customer WHERE c_custkey % 5 <> 0) ON c = user_id")
def catalog_misses(spark, d):
    c = read(spark, d, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("user_id"), (F.lit(T0) + F.col("c_custkey") * 20_000).alias("valid_to"), F.lit(True).alias("there"))
    rows = logs(spark, d).select("user_id", "s").join(c, "user_id", "left")
    return rows.agg(F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("s") >= F.col("valid_to")).alias("after_end"))
