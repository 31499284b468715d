"""Completeness: watermarks, labels, bases, lateness. Times are numbers in one unit; `received` is when a row arrived."""

from __future__ import annotations

import hashlib
import hmac
import json
import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import written

NEVER = 1 << 62


@dataclass(frozen=True)
class Label:
    """Whether an answer over [lo, hi) is complete, and from when it is not."""

    state: str
    partial: bool
    incomplete_from: int | None = None
    lo: int | None = None
    hi: int | None = None
    settled: int | None = None


def label(c: int | None, max_lateness: int, lo: int | None, hi: int | None, ok: bool = True) -> Label:
    """c: everything received before it is here. Event times before c - max_lateness are settled."""
    if c is None:
        return Label("unknown", True, None, lo, hi)
    settled = max(c - max_lateness, -NEVER)
    if not ok:
        return Label("unknown", True, None, lo, hi, settled)
    if hi is None or hi > settled:
        return Label("partial", True, max(settled, lo) if lo is not None else settled, lo, hi, settled)
    return Label("complete", False, None, lo, hi, settled)


def incomplete_start(x: Label) -> int | None:
    """From which event time on rows may be missing; None if nowhere in the window."""
    if x.state == "unknown" or x.settled is None:
        return x.lo
    if x.state == "complete" and x.settled >= x.hi:
        return None
    s = max(min(x.settled, x.incomplete_from if x.incomplete_from is not None else x.settled), x.lo)
    return None if s >= x.hi else s


def bucket_state(x: Label, lo: Column, hi: Column, tail: Column) -> Column:
    """unknown, incomplete or complete for the bucket [lo, hi); tail: does it hold a row beyond the basis?"""
    if x.state == "unknown":
        return F.lit("unknown")
    s = incomplete_start(x)
    return F.when(tail | (F.lit(False) if s is None else hi > s), "incomplete").otherwise("complete")


def result_state(x: Label, missing_reads: bool = False, tail_rows: bool = False, start_complete: bool = True) -> str:
    if missing_reads:
        return "incomplete"
    if x.state == "unknown":
        return "unknown"
    return "incomplete" if tail_rows or not start_complete or incomplete_start(x) is not None else "complete"


@dataclass(frozen=True)
class Basis:
    """A repeatable read: rows received before each cluster's bound, and before no other time."""

    bounds: dict[str, int]
    max_lateness: int = 0
    signals: tuple[str, ...] = ()
    expires: int = NEVER
    extra: dict = field(default_factory=dict)

    def token(self, secret: bytes) -> str:
        body = json.dumps({"b": self.bounds, "l": self.max_lateness, "s": self.signals, "e": self.expires}, sort_keys=True, separators=(",", ":"))
        return body + "." + hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()

    @classmethod
    def of(cls, token: str, secret: bytes, now: int, complete_through: dict[str, int], clusters: set[str] | None = None, signal: str | None = None) -> Basis:
        """Refused if forged, expired, ahead of what is complete, or out of scope."""
        body, _, mac = token.rpartition(".")
        if not hmac.compare_digest(mac, hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()):
            raise PermissionError("basis token is not ours")
        d = json.loads(body)
        out = cls(d["b"], d["l"], tuple(d["s"]), d["e"])
        if now >= out.expires:
            raise ValueError("basis has expired")
        if any(c not in complete_through or v > complete_through[c] for c, v in out.bounds.items()):
            raise ValueError("basis is ahead of what is complete")
        if clusters is not None and not set(out.bounds) <= clusters:
            raise PermissionError("basis names clusters out of scope")
        if signal and out.signals and signal not in out.signals:
            raise ValueError(f"basis does not cover {signal}")
        return out

    def predicate(self, received: str | None, cluster: str | None, since: dict[str, int] | None = None) -> Column:
        """Rows before the bounds; since: and not before others (what was added between two bases)."""
        if received is None or cluster is None:
            raise ValueError("a table without receive time or cluster can't be read at a basis")
        out = F.lit(False)
        for c, bound in sorted(self.bounds.items()):
            one = (F.col(cluster) == c) & (F.col(received) < bound)
            out = out | (one & (F.col(received) >= since[c]) if since and c in since else one)
        return out


def fleet_predicate(basis: Basis, received: str, since: Basis | None = None) -> Column:
    """The basis as one bound for all clusters, the least of its own, for tables that don't say whose their rows are.

    It may leave out rows that the bounds of single clusters would let in, and never lets in others. since: and not before
    the least bound of an earlier basis. A basis of no cluster has no rows.
    """
    if not basis.bounds:
        return F.lit(False)
    out = F.col(received) < min(basis.bounds.values())
    return out & (F.col(received) >= min(since.bounds.values())) if since and since.bounds else out


def mint(complete_through: dict[str, int], clusters: set[str], max_lateness: int, signals: tuple[str, ...] = (), expires: int = NEVER) -> Basis:
    if missing := clusters - set(complete_through):
        raise ValueError(f"nothing is complete for {sorted(missing)}")
    return Basis({c: complete_through[c] for c in sorted(clusters)}, max_lateness, signals, expires)


def late_rows(df: DataFrame, max_lateness: int, event: str = "s", received: str = "received") -> DataFrame:
    return df.filter(F.col(received) > F.col(event) + max_lateness)


def late_split(df: DataFrame, batch: list[str], time: str, allowed: int) -> DataFrame:
    """df with late_part 1 for rows more than `allowed` before the last one of their batch."""
    hi = F.max(time).over(Window.partitionBy(*batch))
    if allowed <= 0:
        return df.withColumn("late_part", F.lit(0))
    return df.withColumn("late_part", F.when((hi >= allowed) & (F.col(time) < hi - allowed), 1).otherwise(0))


def checkpoints(slots: DataFrame, lane: list[str]) -> DataFrame:
    """slots (lane.., seq, done) -> how far each lane has come: the last of the done ones without a gap, -1 for none."""
    n = F.row_number().over(Window.partitionBy(*lane).orderBy("seq")) - 1
    rows = slots.withColumn("stop_", F.when(~F.col("done") | (F.col("seq") != n), n))
    return rows.groupBy(*lane).agg((F.coalesce(F.min("stop_"), F.count("*")) - 1).cast("long").alias("position"))


def lane_watermarks(slots: DataFrame, lane: list[str]) -> DataFrame:
    """slots (lane.., passed, low, received) -> watermark: nothing received before it is still to come.

    The highest low of passed slots, but no later than the first receive time of slots to come. Null if one of these has
    unknown metadata, or if no slot has been passed.
    """
    pending = ~F.col("passed")
    low = F.max(F.when(F.col("passed"), F.col("low")))
    first = F.min(F.when(pending, F.col("received")))
    unknown = F.max(F.when(pending & F.col("received").isNull(), 1).otherwise(0))
    return slots.groupBy(*lane).agg(F.when(unknown == 0, F.least(low, F.coalesce(first, low))).alias("watermark"))


def complete_through(lanes: DataFrame, by: list[str], listed: int, skew: int, before: DataFrame | None = None) -> DataFrame:
    """The least watermark of the lanes (0 for one without, none for a retired one), no later than listed - skew, and never
    below what it was before."""
    wm = F.when(F.col("retired"), F.lit(NEVER)).otherwise(F.coalesce("watermark", F.lit(0)))
    out = lanes.groupBy(*by).agg(F.least(F.min(wm), F.lit(listed - skew)).alias("c"))
    if before is not None:
        out = out.join(before.withColumnRenamed("c", "old_"), by, "full").select(*by, F.greatest(F.coalesce("c", F.lit(0)), F.coalesce("old_", F.lit(0))).alias("c"))
    return out


def history_as_of(steps: DataFrame, by: list[str], t: int) -> DataFrame:
    """The last value at or before t."""
    return steps.filter(F.col("at") <= t).groupBy(*by).agg(F.max_by("c", "at").alias("c"), F.max("at").alias("at"))


# Lake planning: a manifest has a row for each file.


def prune(files: DataFrame, lo: int, hi: int, skew: int = 0, clusters: list[str] | None = None) -> DataFrame:
    """Files that may hold rows of [lo, hi). Unknown times keep a file: a plan may read too much, never too little."""
    keep = F.coalesce(F.col("max_time") >= lo, F.lit(True)) & F.coalesce(F.col("min_time") < hi, F.lit(True)) & F.coalesce(F.col("last_modified") >= lo - skew, F.lit(True))
    out = files.filter((F.col("kind") == "data") & keep)
    return out.filter(F.col("cluster").isin(clusters)) if clusters is not None else out


def place(files: DataFrame, bounds: dict[str, int], skew: int, issue: int) -> DataFrame:
    """files with place: basis, tail, or check where only the file itself can tell."""
    c = F.lit(None).cast("long")
    for k, v in bounds.items():
        c = F.when(F.col("cluster") == k, F.lit(v)).otherwise(c)
    received, written = F.col("received"), F.col("last_modified")
    where = F.when(written > issue + 2 * skew, "tail").when(received >= c, "tail").when(received < c, "basis").when(written + skew < c, "basis").otherwise("check")
    return files.withColumn("place", where).withColumn("late", F.coalesce(received - F.col("min_time") > skew, F.lit(False)))


def plan_hash(keys: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(keys)).encode()).hexdigest()


def scan(spark, files: DataFrame, schema, path: str = "path", most: int = 100_000) -> DataFrame:
    """Rows of exactly the planned files, each with the file's name; a file that is gone fails the query."""
    rows = files.select(path).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a plan of over {most} files; read the table by partition instead")
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreMissingFiles", "false").parquet(*(r[0] for r in rows)).withColumn("_path", F.col("_metadata.file_path"))


class Failed(RuntimeError):
    """Files of a plan were gone, and of the plans made again too."""


def answered(plan, ask, times: int = 3):
    """ask(plan()), planned again if a file of the plan has gone meanwhile (collected, or merged into another).

    An answer is of one plan as a whole or there is none: after `times` plans it fails. ask must run the query (collect,
    write), not only build it.
    """
    for _ in range(times):
        try:
            return ask(plan())
        except Exception as e:
            gone = ("FAILED_READ_FILE.FILE_NOT_EXIST", "FileNotFoundException", "PATH_NOT_FOUND", "does not exist")
            if not any(x in str(e) for x in gone):
                raise
            last = e
    raise Failed(f"files of {times} plans were gone: {str(last).splitlines()[0][:200]}")


def basis_expired(slots: DataFrame, lane: list[str], bounds: dict[str, int]) -> DataFrame:
    """Lanes (with cluster) whose deleted slots held rows before the bound of their cluster: a read at that basis would lack
    them. slots: lane.., cluster, seq, received, deleted."""
    c = F.lit(None).cast("long")
    for k, v in bounds.items():
        c = F.when(F.col("cluster") == k, F.lit(v)).otherwise(c)
    gone = slots.filter("deleted").withColumn("bound_", c).filter(F.col("received").isNull() | (F.col("received") < F.col("bound_")))
    return gone.groupBy(*lane, "cluster").agg(F.max("received").alias("lost_through"))


def hourly_history(steps: DataFrame, by: list[str], lo: int, hi: int, final: int, step: int = 3600) -> DataFrame:
    """(by.., hour, c, at, final): the last value at or before the end of each hour in [lo, hi), carried on from earlier ones.

    An hour is final if it ended at or before `final`, the time up to which steps are known. One row for each hour in which
    a value is known; steps (by.., at, c) are compared with their own hour only, and hours are filled in order.
    """
    end = F.greatest(F.lit(lo), F.col("at") - F.pmod("at", F.lit(step)))
    last = steps.filter(F.col("at") < hi).groupBy(*by, end.cast("long").alias("hour")).agg(F.max(F.struct("at", "c")).alias("x"))
    w = Window.partitionBy(*by).orderBy("hour")
    last = last.withColumn("next_", F.coalesce(F.lead("hour").over(w), F.lit(hi)))
    rows = last.withColumn("hour", F.explode(F.sequence("hour", F.col("next_") - step, F.lit(step))))
    return rows.select(*by, "hour", "x.c", "x.at", (F.col("hour") + step <= final).alias("final"))


def trace_index(rows: DataFrame, file: str = "file") -> DataFrame:
    """(fp, file): a 32-bit fingerprint of each trace id. Two ids may share one, so a look-up may only over-read."""
    return rows.select(F.pmod(F.xxhash64("trace_id"), F.lit(1 << 32)).alias("fp"), file).distinct()


def term_index(rows: DataFrame, text: str, file: str = "file", most: float = 0.5) -> DataFrame:
    """(term, file): words of each file; a term in more than `most` of all files keeps one row with a null file (all)."""
    from ..functions.columns import tokens_col

    # texts are cut into words once, into a table that the rest reads
    terms = written(rows.select(F.explode(tokens_col(F.col(text))).alias("term"), file).distinct(), "terms")
    n = rows.select(file).distinct().count()
    often = terms.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") > most * n).select("term")
    # they are at most 1 / most times as many as a file has words on average
    often = written(often, "terms-often")
    return terms.join(F.broadcast(often), "term", "left_anti").unionByName(often.withColumn(file, F.lit(None).cast(dict(terms.dtypes)[file])))


def files_with_text(files: DataFrame, index: DataFrame, query: str, file: str = "file") -> DataFrame:
    """Files that can hold the query, by the index; files that the index doesn't cover (covered false) are kept."""
    from ..functions.columns import term_constraints, term_matches

    wanted = term_constraints(query)
    each = [F.when(term_matches(F.col("term"), kind, run), F.lit(i)) for i, (kind, run) in enumerate(wanted)]
    # rows of other terms go first, at the index's files
    asked = reduce(operator.or_, (term_matches(F.col("term"), kind, run) for kind, run in wanted)) if wanted else None
    rows = index.filter(asked).select(file, F.explode(F.array_compact(F.array(*each))).alias("c")) if wanted else None
    # constraints that a term of all files meets narrow nothing
    every = {r["c"] for r in rows.filter(F.col(file).isNull()).select("c").distinct().collect()} if wanted else set()
    need = sorted(set(range(len(wanted))) - every)
    if not need:
        return files
    met = rows.filter(F.col(file).isNotNull() & F.col("c").isin(need)).groupBy(file).agg((F.count_distinct("c") == len(need)).alias("met_"))
    return files.join(met, file, "left").filter(F.coalesce("met_", F.lit(False)) | ~F.col("covered")).drop("met_")


# Audits


def duplicate_ingest(rows: DataFrame, key: str, part: list[str]) -> DataFrame:
    """Content keys that stand in more than one partition."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*part)).alias("parts")).filter("parts > 1")


def duplicate_rows(rows: DataFrame, identity: list[str]) -> DataFrame:
    """How many rows there are beyond one for each identity."""
    return rows.groupBy(*identity).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("extra"), F.count("*").alias("ids"))


def repeated_ordinals(rows: DataFrame, batch: str, ordinal: str) -> DataFrame:
    """Batches that hold an ordinal more than once, with how many rows they have beyond one for each."""
    n = rows.groupBy(batch).agg(F.count("*").alias("n"), F.count_distinct(ordinal).alias("ordinals"))
    return n.filter("n > ordinals").select(batch, (F.col("n") - F.col("ordinals")).alias("extra"))


def groups_ingested_twice(rows: DataFrame, batch: str, key: str) -> DataFrame:
    """Content keys that came in more than one batch: how many there are for each number of batches."""
    n = rows.groupBy(key).agg(F.count_distinct(batch).alias("batches"))
    return n.filter("batches > 1").groupBy("batches").agg(F.count("*").alias("keys"))


def skew(rows: DataFrame, key: str) -> DataFrame:
    """How unevenly rows fall on keys: quantiles of rows a key, and the largest share."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("keys"), F.round(F.expr("percentile(n, 0.5)"), 4).alias("p50"), F.round(F.expr("percentile(n, 0.99)"), 4).alias("p99"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"))


def scoped_watermark(published: DataFrame, clusters: list[str] | None = None, signals: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """(cluster, complete_through) for each cluster of a scope: the highest of the bounds that are sound for it. Their least is the scope's.

    published: cluster (null: all of the fleet), signal (null: all signals; "": signals that are not listed), value. A bound of a
    superset of the scope's lanes is sound: the fleet's, the cluster's, the cluster's for the signals asked for (their least, where
    an unlisted one has the value of ""). A cluster without any, where others have some, began after `cap`, the time of the listing.
    clusters None: one row, for the fleet, with a null cluster.
    """
    of = lambda cond: F.max(F.when(cond, F.col("value")))
    each = [of(F.col("signal") == x).alias(f"s{i}_") for i, x in enumerate(signals or [])]
    by = published.groupBy("cluster").agg(of(F.col("signal").isNull()).alias("all_"), of(F.col("signal") == "").alias("rest_"), *each)
    one = [F.coalesce(f"s{i}_", "rest_") for i in range(len(each))]
    sig = F.lit(None).cast("long")
    if one:
        known = one[0].isNotNull()
        for x in one[1:]:
            known = known & x.isNotNull()
        sig = F.when(known, F.least(*one) if len(one) > 1 else one[0])
    by = by.select("cluster", "all_", sig.alias("sig_"))
    fleet = by.filter("cluster is null")
    if clusters is None:
        return fleet.select("cluster", F.greatest("all_", "sig_").alias("complete_through"))
    asked = published.sparkSession.createDataFrame([(c,) for c in sorted(set(clusters))], "cluster string")
    own = asked.join(by, "cluster", "left").crossJoin(F.broadcast(by.agg(F.max(F.when(F.col("cluster").isNull(), F.col("all_"))).alias("fleet_"), F.count_if(F.col("cluster").isNotNull()).alias("n_"))))  # one row
    born = F.when((F.col("n_") > 0) & F.col("all_").isNull() & F.col("sig_").isNull(), F.lit(cap).cast("long"))
    return own.select("cluster", F.greatest("fleet_", "all_", "sig_", born).alias("complete_through"))


def file_skew(df: DataFrame, received: str, by: list[str]) -> DataFrame:
    """(by.., least, median, most): seconds from the receive time of a file's rows to the time the file was written, file by file.

    df is read from files; clocks that agree give what the writer takes.
    """
    m = F.col("_metadata")
    files = df.select(*by, F.col(received).alias("r_"), m["file_path"].alias("f_"), F.unix_seconds(m["file_modification_time"]).alias("w_"))
    files = files.groupBy(*by, "f_").agg((F.max("w_") - F.max("r_")).alias("d_"))
    return files.groupBy(*by).agg(F.min("d_").alias("least"), F.percentile("d_", F.lit(0.5)).alias("median"), F.max("d_").alias("most"))
