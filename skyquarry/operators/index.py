"""An index of files by key (a term, a fingerprint of a trace id): hourly parts, merged into shards of a day.

Hours are indexed as they are complete and can be looked up at once; once a day is over, its hours are merged and dealt to
shards by hash, so that a look-up reads one shard for each key and not all hours. Files may be over-read, never missed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import tokens_col

SHARDS = 64
HOUR, DAY = 3600, 86_400


def terms(rows: DataFrame, text: str, file: str = "file") -> DataFrame:
    """(key, file): the words of each file."""
    return rows.select(F.explode(tokens_col(F.col(text))).alias("key"), file)


def fingerprints(rows: DataFrame, trace: str = "trace_id", file: str = "file") -> DataFrame:
    """(key, file): a 32-bit fingerprint of each trace id, as text. Two ids may share one."""
    return rows.select(fingerprint(F.col(trace)).alias("key"), file)


def fingerprint(trace):
    return F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(trace), F.lit(1 << 32)))), 8, "0")


def shard(key, shards: int = SHARDS):
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def write_hours(entries: DataFrame, path: str) -> None:
    """entries (key, file, hour): each key once for each file, hour by hour. An hour that is built again is replaced."""
    rows = entries.select("key", "file", "hour").distinct().withColumn("day", F.col("hour") - F.pmod("hour", F.lit(DAY)))
    rows = rows.repartition("day", "hour").sortWithinPartitions("day", "hour", "key", "file")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "hour").parquet(f"{path}/hours")


def merge_day(spark: SparkSession, path: str, day: int, shards: int = SHARDS) -> None:
    """The hours of a day as shards, sorted by key. Replaces the day's shards, so it may run again when hours were rebuilt."""
    rows = spark.read.parquet(f"{path}/hours").filter(F.col("day") == day).select("key", "file").distinct()
    rows = rows.withColumns({"day": F.lit(day).cast("long"), "shard": shard(F.col("key"), shards)})
    rows = rows.repartition("shard").sortWithinPartitions("shard", "key", "file")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "shard").parquet(f"{path}/days")


def look_up(spark: SparkSession, path: str, keys: list[str], lo: int, hi: int, merged: set[int], shards: int = SHARDS) -> DataFrame:
    """(key, file) of the keys in [lo, hi): from the shards of merged days, which hold whole days, and from the hours of others.

    Both are filtered by their partitions, so that only these are listed and read.
    """
    days = list(range(lo - lo % DAY, hi, DAY))
    whole, rest = [d for d in days if d in merged], [d for d in days if d not in merged]
    out = spark.createDataFrame([], "key string, file string")
    if whole:
        numbers = sorted({r[0] for r in spark.createDataFrame([(k,) for k in keys], "key string").select(shard(F.col("key"), shards)).collect()})
        at = F.col("day").isin(whole) & F.col("shard").isin(numbers)
        out = out.unionByName(spark.read.parquet(f"{path}/days").filter(at & F.col("key").isin(keys)).select("key", F.col("file").cast("string")))
    if rest:
        at = F.col("day").isin(rest) & (F.col("hour") > lo - HOUR) & (F.col("hour") < hi)
        out = out.unionByName(spark.read.parquet(f"{path}/hours").filter(at & F.col("key").isin(keys)).select("key", F.col("file").cast("string")))
    return out.distinct()
