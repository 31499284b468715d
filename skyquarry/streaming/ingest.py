"""Streaming ingest: files of a lane land once, dimensions before facts, derived tables with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.control import late_split
from .snapshots import KeyLedger, SlotTaken, Snapshots, commit_slot, exists

__all__ = ["KeyLedger", "Sink", "SlotTaken", "Snapshots", "commit_slot"]


def file_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder, each row with its file's name."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path).withColumn("_path", F.col("_metadata.file_path"))


def content_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with content_key: what a batch holds decides whether it is here already, not where it came from."""
    return df.withColumn("content_key", F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns))))


#: Batches after which a ledger that lets go of old keys does so.
COMPACT_EVERY = 100


class Sink:
    """A table that takes each content key once, whenever and how often it is delivered, and the tables derived from it.

    A batch is known by what it holds (ingest_id), whatever its number. Its rows are those whose keys no other batch has
    claimed in the ledger (snapshots.py), which knows keys of all receive days that it still holds. Claims come first, all
    of a batch or none; so that set is the same when the batch is delivered again, before or after any of its later writes,
    what is derived from it is written again as it was, and the table gets only the rows that it still lacks.

    ledger: its folder, beside the table if not given; a table that has none yet gives it its own keys. keep: days that keys
    stay in the ledger, counted back from the newest one there; a key that comes again later than that is new. None: for ever.
    """

    def __init__(self, table: str, allowed: int, derived: dict[str, Callable[[DataFrame], DataFrame]] | None = None, before: dict[str, Callable[[DataFrame], DataFrame]] | None = None, day: int = 86_400, ledger: str | None = None, keep: int | None = None):
        self.table, self.allowed, self.derived, self.before, self.day = table, allowed, derived or {}, before or {}, day
        self.ledger, self.keep = KeyLedger(ledger or f"{table.rstrip('/')}-keys"), keep

    def prepared(self, batch: DataFrame) -> DataFrame:
        split = late_split(batch, ["batch_id"], "s", self.allowed)
        return split.withColumn("received_day", F.floor(F.col("received") / self.day).cast("long"))

    def __call__(self, batch: DataFrame, batch_no: int) -> None:
        spark = batch.sparkSession
        rows = self.prepared(batch).dropDuplicates(["content_key"]).persist()
        try:
            ident = ingest_id(rows)
            if exists(spark, self.table) and self.ledger.snapshots.latest(spark) < 0:
                self.ledger.claim(spark.read.parquet(self.table), "first")
            own = self.ledger.unclaimed(rows, ident).select(*rows.columns)
            self.ledger.claim(own.withColumn("ingest_id", F.lit(ident)), ident)
            # delivered again at another time, a row keeps the day on which it was claimed, where the table has it
            own = own.drop("received_day").join(self.ledger.claimed(own, ident), "content_key").select(*rows.columns)
            lacking = own
            if exists(spark, self.table):
                days = [r[0] for r in own.select("received_day").distinct().limit(10_001).collect()]
                there = spark.read.parquet(self.table).select("content_key", "ingest_id", "received_day")
                if len(days) <= 10_000:
                    there = there.filter(F.col("received_day").isin(days))
                lacking = own.join(there.filter(F.col("ingest_id") == ident).select("content_key"), "content_key", "left_anti").select(*rows.columns)
            for path, make in self.before.items():
                _append_new(spark, make(own), path)
            # derived rows have a folder of their batch: writing them again replaces them
            for path, make in self.derived.items():
                make(own).write.mode("overwrite").parquet(f"{path}/ingest_id={ident}")
            lacking = lacking.withColumn("ingest_id", F.lit(ident))
            lacking.sortWithinPartitions("s").write.mode("append").partitionBy("received_day", "late_part").parquet(self.table)
            if self.keep is not None and batch_no % COMPACT_EVERY == COMPACT_EVERY - 1:
                self.ledger.compacted(spark, self.keep)
        finally:
            rows.unpersist()


def ingest_id(rows: DataFrame) -> str:
    """What a batch holds, as one text: the number of its content keys and two sums of their hashes, in any order."""
    part = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
    r = rows.agg(F.concat_ws("-", F.count("*"), part(F.xxhash64("content_key")), part(F.xxhash64("content_key", F.lit(1)))).alias("k")).select(F.md5("k")).first()
    return r[0]


def _append_new(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Rows of a dimension (column id) that it lacks."""
    rows = rows.dropDuplicates(["id"])
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select("id"), "id", "left_anti")
    rows.write.mode("append").parquet(path)


def run(stream: DataFrame, sink: Sink, checkpoint: str) -> None:
    """Take what is there and stop; a later run goes on after it."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def verified(written: DataFrame, manifest: DataFrame) -> DataFrame:
    """Batches of which fewer or more rows are here than the manifest (batch_id, rows) says."""
    n = written.groupBy("batch_id").agg(F.count("*").alias("there"))
    return manifest.join(n, "batch_id", "left").filter(F.coalesce("there", F.lit(0)) != F.col("rows"))


def checked_receive_time(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """df, failing the query if a row's receive time isn't the one its batch was announced with."""
    m = manifest.select("batch_id", F.col("received").alias("said_"))
    ok = F.assert_true(F.col("received").eqNullSafe(F.col("said_")), F.lit("receive time differs from the manifest"))
    return df.join(m, "batch_id", "left").withColumn("ok_", ok).filter(F.col("ok_").isNull()).drop("ok_", "said_")


def windowed_counts(stream: DataFrame, time: str, window: str, every: str, by: list[str], lateness: str) -> DataFrame:
    """Counts in tumbling or hopping windows of a stream; rows later than `lateness` are left to the late audit."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window, every), *by).agg(F.count("*").alias("n"))


def write_sorted(df: DataFrame, path: str, sort: list[str], bloom: list[str] = (), rows: int = 1_000_000, delta: list[str] = ()) -> None:
    """Parquet with zstd, files sorted, and bloom filters on columns that are looked up by value.

    delta: columns of whole numbers that are stored as differences (times, ordinals) instead of through a dictionary.
    """
    w = df.sortWithinPartitions(*sort).write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", rows)
    if delta:
        w = w.option("parquet.writer.version", "PARQUET_2_0")
    for c in delta:
        w = w.option(f"parquet.enable.dictionary#{c}", "false")
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(rows))
    w.parquet(path)


def replace_days(df: DataFrame, path: str, day: str) -> None:
    """Rebuilt days take the place of old ones, other days stay. A reader may see days half replaced; swap_days() has no such moment."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def swap_days(df: DataFrame, path: str, day: str) -> int:
    """The same for a table of snapshots, all days at once. Snapshots(path, day).read() is the table, before or after; returns the manifest's number."""
    return Snapshots(path, day).replace(df)
