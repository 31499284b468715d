"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one in a local run and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="skyquarry-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: later plans start from files that outlive executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to as many tasks as shuffles have, for work that costs much a row: a few files or row groups may hold all of it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def digits(x: Column) -> Column:
    """The number of binary digits of x, 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def blocks(b: Column, e: Column) -> Column:
    """[b, e) as blocks (level, i), each of the 2**level numbers from i * 2**level on; at most two of a level."""

    def of(level: Column) -> Column:
        low = F.call_function("shiftright", b + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        high = F.call_function("shiftright", e, level)
        block = lambda i: F.struct(level.alias("level"), i.alias("i"))
        return F.array(F.when((low < high) & (low % 2 == 1), block(low)), F.when((low < high) & (high % 2 == 1), block(high - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), digits(e)), of)))


#: Slices into which a range of numbers is cut for joins by block, a power of two.
SLICES = 1 << 12


class Slices:
    """A range of numbers in SLICES slices, so that intervals meet points by (key, block) instead of by key alone.

    An interval stands in the blocks that cover its slices, two of each size at most; a point in the blocks that its slice lies
    in, one of each size. They share at least one block if the point is in the interval, and just one; what else shares it is
    in a slice at the interval's ends, so the exact condition follows the join.
    """

    def __init__(self, lo: int, hi: int, slices: int = SLICES):
        self.lo, self.slices, self.width = lo, slices, max(1, -(-(hi - lo + 1) // slices))

    @classmethod
    def of(cls, df: DataFrame, column: str, slices: int = SLICES) -> Slices:
        r = df.agg(F.min(column), F.max(column)).first()
        return cls(r[0] or 0, r[1] or 0, slices)

    def number(self, x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(self.slices - 1), F.floor((x - self.lo) / self.width))).cast("long")

    def intervals(self, df: DataFrame, start: Column, end: Column) -> DataFrame:
        """df with level_ and block_, a row for each block of [start, end]; a null end is the last number's."""
        last = F.when(end.isNull(), F.lit(self.slices - 1).cast("long")).otherwise(self.number(end))
        return df.withColumn("at_", F.explode(blocks(self.number(start), last + 1))).withColumns({"level_": F.col("at_.level"), "block_": F.col("at_.i")}).drop("at_")

    def points(self, df: DataFrame, at: Column) -> DataFrame:
        levels = F.sequence(F.lit(0), F.lit(self.slices.bit_length()))
        df = df.withColumn("level_", F.explode(levels))
        return df.withColumn("block_", F.call_function("shiftright", self.number(at), F.col("level_")))


ON = ["level_", "block_"]
