"""Roll-ups whose states merge: distinct counts and quantiles, over steps and over series, without their points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket

#: Logarithm of a distinct-count sketch's registers (error about 1.04 / 2**6 = 1.6 %), and the size of a quantile sketch (rank error about 1 %).
REGISTERS, SIZE = 12, 400


def rollup(points: DataFrame, by: list[str], time: str, step: int, distinct: str | None = None, value: str | None = None) -> DataFrame:
    """(by.., bucket, n, [ids], [values]): a sketch of the different `distinct` and one of `value` in each step.

    Both are aggregates with states of bounded size, so tasks combine them before the shuffle. Nulls are left out.
    """
    states = [F.count("*").alias("n")]
    if distinct:
        states.append(F.hll_sketch_agg(F.col(distinct), F.lit(REGISTERS)).alias("ids"))
    if value:
        states.append(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SIZE)).alias("values"))
    return points.groupBy(*by, bucket(F.col(time), step).alias("bucket")).agg(*states)


def merge(rolled: DataFrame, by: list[str], step: int | None = None) -> DataFrame:
    """Roll-ups of shorter steps, parts of steps or more series as one; without step, of all time."""
    states = [F.sum("n").alias("n")]
    if "ids" in rolled.columns:
        states.append(F.hll_union_agg("ids").alias("ids"))
    if "values" in rolled.columns:
        states.append(F.kll_merge_agg_double("values").alias("values"))
    keys = [*by, *([bucket(F.col("bucket"), step).alias("bucket")] if step else [])]
    return rolled.groupBy(*keys).agg(*states)


def distinct_count(ids: str = "ids") -> Column:
    return F.hll_sketch_estimate(ids)


def quantile(q: float, values: str = "values") -> Column:
    """The value at rank q."""
    return F.kll_sketch_get_quantile_double(values, F.lit(q))
