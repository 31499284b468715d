"""Metrics: rates, quantiles of histograms, roll-ups, series and points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket, prometheus_name, sum_for_each


def cumulative_counter(points: DataFrame, series: list[str], order: list[str], value: str = "value", reset: int | None = None) -> DataFrame:
    """points with the running sum `total` of each series; it restarts every `reset` points if given."""
    w = Window.partitionBy(*series).orderBy(*order)
    if reset:
        points = points.withColumn("part_", F.floor((F.row_number().over(w) - 1) / reset))
        w = Window.partitionBy(*series, "part_").orderBy(*order)
    return points.withColumn("total", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def counter_rate(points: DataFrame, series: list[str], labels: list[str], time: str, value: str, step: int, tie: str) -> DataFrame:
    """Last less first value of each series in a step, by the seconds between (1 at least), summed by labels.

    Resets are not looked for. labels are functions of the series, so the series' sums are combined without its rows.
    """
    at = F.struct(time, tie)
    each = points.groupBy(*series, *[c for c in labels if c not in series], bucket(F.col(time), step).alias("bucket")).agg(
        ((F.max_by(value, at) - F.min_by(value, at)) / F.greatest(F.max(time) - F.min(time), F.lit(1))).alias("r")
    )
    return each.groupBy(*labels, "bucket").agg(F.sum("r").alias("rate"))


def clamped_rate(points: DataFrame, series: list[str], order: list[str], value: str, delta: Column | bool = False) -> DataFrame:
    """points with `rate`, the growth since the series' point before, 0 at the first and where it falls; and `running`.

    delta: where points already hold growth, rate is the value and running its sum; else running is the value.
    """
    w = Window.partitionBy(*series).orderBy(*order)
    grown = F.greatest(F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)), F.lit(0.0))
    is_delta = delta if isinstance(delta, Column) else F.lit(delta)
    total = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return points.withColumn("rate", F.when(is_delta, F.col(value)).otherwise(grown)).withColumn("running", F.when(is_delta, total).otherwise(F.col(value)))


def chart(points: DataFrame, by: list[str], time: str, value: str, step: int) -> DataFrame:
    """n, sum, min and max in each step; avg is sum / n once all parts are merged."""
    return points.groupBy(*by, bucket(F.col(time), step).alias("bucket")).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))


def rollup(points: DataFrame, series: list[str], time: str, value: str, step: int, tie: str) -> DataFrame:
    """A chart of each series that can be rolled up again: last is a state of (time, tie, value)."""
    last = F.max(F.struct(F.col(time).alias("t"), F.col(tie).alias("i"), F.col(value).alias("v")))
    return points.groupBy(*series, bucket(F.col(time), step).alias("bucket")).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), last.alias("last"))


def merge_rollup(rolled: DataFrame, series: list[str], step: int) -> DataFrame:
    """Roll-ups of shorter steps (or of parts of a step) combined into longer ones."""
    return rolled.groupBy(*series, bucket(F.col("bucket"), step).alias("bucket")).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.max("last").alias("last"))


def top_k(points: DataFrame, by: str, value: str, k: int, series: list[str] | None = None) -> DataFrame:
    """The k groups with the highest mean; series: a mean of the means of series, which weighs series alike."""
    if series:
        points = points.groupBy(by, *[c for c in series if c != by]).agg(F.avg(value).alias(value))
    return points.groupBy(by).agg(F.round(F.avg(value), 6).alias("v")).orderBy(F.desc("v"), by).limit(k)


def bucket_counts(value: Column, bounds: list[float]) -> list[Column]:
    """Aggregates: how many values lie in each bucket, upper bounds included, the last one without bound."""
    edges = [None, *bounds, None]
    return [F.count_if((value > F.lit(lo) if lo is not None else F.lit(True)) & (value <= F.lit(hi) if hi is not None else F.lit(True)) & value.isNotNull()) for lo, hi in zip(edges, edges[1:])]


def histogram_points(points: DataFrame, series: list[str], time: str, value: str, step: int, bounds: list[float]) -> DataFrame:
    """counts: an array for each series and step."""
    return points.groupBy(*series, bucket(F.col(time), step).alias("t")).agg(F.array(*bucket_counts(F.col(value), bounds)).alias("counts"))


def running_counts(points: DataFrame, series: list[str], size: int, reset: int | None = None) -> DataFrame:
    """Histogram points with counts that grow with each series, from nothing every `reset` points."""
    w = Window.partitionBy(*series).orderBy("t")
    if reset:
        points = points.withColumn("part_", F.floor((F.row_number().over(w) - 1) / reset))
        w = Window.partitionBy(*series, "part_").orderBy("t")
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("counts", F.array(*(F.sum(F.get("counts", i)).over(w) for i in range(size)))).drop("part_")


def bound_at(counts: Column, bounds: Column, q: float) -> Column:
    """The bound of the first bucket in which the running count reaches q of all; null beyond the last bound."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    sums = F.transform(F.sequence(F.lit(1), F.size(counts)), lambda n: F.aggregate(F.slice(counts, 1, n), F.lit(0).cast("long"), lambda a, x: a + x) >= F.lit(q) * total)
    return F.get(bounds, (F.array_position(sums, True) - 1).cast("int"))


def quantile_by_bound(points: DataFrame, series: list[str], step: int, bounds: list[float], q: float) -> DataFrame:
    """From cumulative histogram points: growth of each series in a step, summed over series, then bound_at.

    Buckets are columns until the last step, so that no array is built for a point.
    """
    n = len(bounds) + 1
    grown = [(F.max_by(F.get("counts", i), "t") - F.min_by(F.get("counts", i), "t")).alias(f"d{i}") for i in range(n)]
    each = points.groupBy(*series, bucket(F.col("t"), step).alias("bucket")).agg(*grown)
    total = each.groupBy("bucket").agg(F.array(*(F.sum(f"d{i}") for i in range(n))).alias("counts"))
    return total.select("bucket", bound_at(F.col("counts"), F.array(*map(F.lit, bounds)), q).alias("q"))


def deltas(points: DataFrame, series: list[str], size: int, cumulative: Column | bool = True, bounds: str | None = None) -> DataFrame:
    """Histogram points with d0, d1, ...: what each added to each of `size` buckets.

    Cumulative ones add nothing at a series' first point, all they hold after a reset (any bucket fell) or a change of
    bounds, else the difference; others add all they hold.
    """
    w = Window.partitionBy(*series).orderBy("t")
    now, old = [F.get("counts", i) for i in range(size)], [F.col(f"o{i}") for i in range(size)]
    before = {f"o{i}": F.lag(now[i]).over(w) for i in range(size)} | {"n_": F.lag("t").over(w)}
    changed = {"changed_": (F.col(bounds) != F.lag(bounds).over(w)) if bounds else F.lit(False)}
    rows = points.withColumns(before | changed)
    fell = reduce(lambda a, b: a | b, (x < y for x, y in zip(now, old)))
    is_sum = cumulative if isinstance(cumulative, Column) else F.lit(cumulative)
    rows = rows.withColumn("fell_", fell | F.col("changed_"))
    added = lambda x, y: F.when(is_sum & F.col("n_").isNull(), x * 0).when(~is_sum | F.col("fell_"), x).otherwise(x - y)
    return rows.withColumns({f"d{i}": added(now[i], old[i]) for i in range(size)}).drop(*before, "changed_", "fell_")


def histogram_rollup(points: DataFrame, series: list[str], step: int, size: int, cumulative: Column | bool = True) -> DataFrame:
    """(series.., bucket, n, counts, last_t): what histogram points added in each step, as a state that merge_histograms()
    combines further."""
    rows = deltas(points, series, size, cumulative)
    added = F.array(*(F.sum(f"d{i}") for i in range(size))).alias("counts")
    return rows.groupBy(*series, bucket(F.col("t"), step).alias("bucket")).agg(F.count("*").alias("n"), added, F.max("t").alias("last_t"))


def merge_histograms(rolled: DataFrame, by: list[str], step: int, size: int) -> DataFrame:
    """Roll-ups of shorter steps, of parts of a step or of several series as one."""
    return rolled.groupBy(*by, bucket(F.col("bucket"), step).alias("bucket")).agg(F.sum("n").alias("n"), F.array(*sum_for_each(F.col("counts"), size)).alias("counts"), F.max("last_t").alias("last_t"))


def interpolated(counts: Column, bounds: list[float], q: float) -> Column:
    """Quantile with linear interpolation inside the bucket where the running count passes q of all.

    The bucket without upper bound gives the bound below it; the first one starts at 0 if its bound is positive and gives
    its bound otherwise. Null if there are no counts.
    """
    n = len(bounds) + 1
    sums = [reduce(lambda a, b: a + b, [F.get(counts, j) for j in range(i + 1)]) for i in range(n)]
    rank = F.lit(q) * sums[-1]
    out = F.lit(None).cast("double")
    for i in range(n - 1, -1, -1):
        below = sums[i - 1] if i else F.lit(0)
        if i == n - 1:
            v = F.lit(float(bounds[-1]))
        elif i == 0 and bounds[0] <= 0:
            v = F.lit(float(bounds[0]))
        else:
            lo = float(bounds[i - 1]) if i else 0.0
            v = F.lit(lo) + F.lit(float(bounds[i]) - lo) * ((rank - below) / (sums[i] - below))
        out = F.when(sums[i] > rank, v).otherwise(out)
    return F.when(sums[-1] > 0, out)


def histogram_quantile(points: DataFrame, series: list[str], by: list[str], step: int, bounds: list[float], q: float, cumulative: bool = True) -> DataFrame:
    n = len(bounds) + 1
    added = F.array(*(F.sum(f"d{i}") for i in range(n))).alias("counts")
    total = deltas(points, series, n, cumulative).groupBy(*by, bucket(F.col("t"), step).alias("bucket")).agg(added)
    return total.withColumn("q", interpolated(F.col("counts"), bounds, q)).filter("q is not null").drop("counts")


def split_series(wide: DataFrame, identity: list[str], value: list[str], id_name: str = "series_id") -> tuple[DataFrame, DataFrame]:
    """Wide points -> (series, points): identity columns once for each series, under a hash of their values."""
    sid = F.md5(F.to_json(F.struct(*identity)))
    wide = wide.withColumn(id_name, sid)
    return wide.select(id_name, *identity).distinct(), wide.select(id_name, *value)


def rejoin_any(points: DataFrame, series: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """At most one series for each point: repeated dimension rows are folded before the join."""
    return points.join(series.dropDuplicates(keys), keys, how)


def prometheus_samples(points: DataFrame, name: str, labels: str, bounds: list[float]) -> DataFrame:
    """Histogram points (t, labels, counts, sum) -> samples (name, labels, t, value): buckets with le, then _sum and _count."""
    base = prometheus_name(name)
    les = [repr(b).removesuffix(".0") for b in bounds] + ["+Inf"]
    run = lambda i: F.aggregate(F.slice("counts", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    sample = lambda n, le, v: F.struct(F.lit(n).alias("name"), F.lit(le).alias("le"), v.alias("value"))
    all_ = [sample(f"{base}_bucket", le, run(i)) for i, le in enumerate(les)] + [sample(f"{base}_sum", None, F.col("sum").cast("double")), sample(f"{base}_count", None, run(len(bounds)))]
    return points.select("t", labels, F.explode(F.array(*all_)).alias("s")).select("s.name", labels, "s.le", "t", "s.value")


def promql_rate(points: DataFrame, series: list[str], time: str, value: str, lo: int, hi: int) -> DataFrame:
    """Growth a second over [lo, hi) with resets added back; no extrapolation to the edges."""
    w = Window.partitionBy(*series).orderBy(time)
    before = F.lag(value).over(w)
    step = F.when(before.isNull(), F.lit(0.0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    rows = points.filter((F.col(time) >= lo) & (F.col(time) < hi)).withColumn("d_", step)
    return rows.groupBy(*series).agg((F.sum("d_") / F.greatest(F.max(time) - F.min(time), F.lit(1))).alias("rate"))


def avg_over_time(points: DataFrame, series: list[str], time: str, value: str, lo: int, hi: int) -> DataFrame:
    """Mean of the points of each series in [lo, hi), each point alike."""
    return points.filter((F.col(time) >= lo) & (F.col(time) < hi)).groupBy(*series).agg(F.avg(value).alias("avg"))
