"""Lanes of files: what a manifest adds to rows, retired lanes, and slots that can go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, manifest: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Rows with their file's columns of the manifest; rows of files it doesn't know are left out."""
    return rows.join(manifest.select(by, *columns), by)


def recovered(rows: DataFrame, lanes: DataFrame, lane: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of live lanes, rows of retired ones). lanes: lane.., retired_at (null: live), admitted.

    Rows of a retired lane that came before it was retired, and those of an admitted lane, count as live.
    """
    known = rows.join(lanes.select(*lane, "retired_at", "admitted"), lane, "left")
    away = F.col("retired_at").isNotNull() & (F.col("received") >= F.col("retired_at")) & ~F.coalesce("admitted", F.lit(False))
    plain = lambda df: df.drop("retired_at", "admitted")
    return plain(known.filter(~away | F.col("retired_at").isNull())), plain(known.filter(away).withColumn("source", F.lit("recovered")))


def collectable(slots: DataFrame, marks: DataFrame, lane: list[str], now: int, keep: int) -> DataFrame:
    """Slots at or before the last mark of their lane that is at least `keep` old. marks: lane.., position, at."""
    old = marks.filter(F.col("at") <= now - keep).groupBy(*lane).agg(F.max("position").alias("horizon_"))
    return slots.join(old, lane).filter(F.col("seq") <= F.col("horizon_")).drop("horizon_")


def truncated(slots: DataFrame, lane: list[str], lo: int) -> DataFrame:
    """Lanes whose first slot left begins after lo although it isn't the lane's first: a plan from lo on is partial."""
    first = slots.groupBy(*lane).agg(F.min("seq").alias("seq"), F.min_by("min_time", "seq").alias("min_time"))
    return first.filter((F.col("seq") > 0) & (F.col("min_time") > lo)).select(*lane)


def marked_buckets(rows: DataFrame, bucket: str) -> DataFrame:
    """rows with any_tail: does the row's bucket hold one that came after the basis?"""
    from pyspark.sql import Window

    return rows.withColumn("any_tail", F.bool_or("tail").over(Window.partitionBy(bucket)))
