"""Log search: filters, histograms, newest rows, token search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket


def in_window(df: DataFrame, time: str, lo: int, hi: int) -> DataFrame:
    """Half open: lo <= time < hi."""
    return df.filter((F.col(time) >= lo) & (F.col(time) < hi))


def with_severity(df: DataFrame, severities, column: str = "severity") -> DataFrame:
    """Rows of the severities, compared in upper case; none named means all."""
    return df.filter(F.upper(column).isin([s.upper() for s in severities])) if severities else df


def containing(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """Rows whose text holds another, in any case."""
    return df.filter(F.lower(column).contains(text.lower())) if text else df


def histogram(df: DataFrame, by: str, time: str, step: int, origin: int = 0) -> DataFrame:
    return df.groupBy(bucket(F.col(time), step, origin).alias("bucket"), by).agg(F.count("*").alias("n"))


def newest(df: DataFrame, n: int, time: str, *ties: str) -> DataFrame:
    """The last n rows by time; ties break the rest, so the answer is one. Spark keeps n rows a task."""
    return df.orderBy(F.desc(time), *ties).limit(n)


def newest_by_files(files: DataFrame, n: int, time: str, ties: list[str], read, first: int = 4, most: int = 100_000) -> tuple[DataFrame, int]:
    """The last n rows by time, as newest() gives them, out of as few files as their times allow; and how many were read.

    files: path, max_time (null: not known), planned, so a bounded list; read(paths) gives their rows. Files are read in waves from the
    latest on, each twice as many as the last, until the n-th row so far is later than all that is in the files left.
    """
    rows = files.select("path", "max_time").orderBy(F.desc_nulls_first("max_time"), "path").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a plan of over {most} files")
    left, wave, done, page = [(r["path"], r["max_time"]) for r in rows], first, 0, None
    if not left:
        raise ValueError("a plan of no files")
    while left:
        now, left = left[:wave], left[wave:]
        done, wave = done + len(now), wave * 2
        df = read([p for p, _ in now])
        got = newest(df if page is None else df.unionByName(page), n, time, *ties).collect()  # a page of rows
        page = files.sparkSession.createDataFrame(got, df.schema)
        if len(got) == n and left and left[0][1] is not None and got[-1][time] > left[0][1]:
            break
    return newest(page, n, time, *ties), done


def newest_then_details(df: DataFrame, n: int, time: str, key: str) -> DataFrame:
    """Late materialisation: the keys of the newest rows first, then the wide columns of just these n."""
    keys = newest(df.select(key, time), n, time, key).select(key)
    return df.join(F.broadcast(keys), key, "left_semi")


def latest_by(df: DataFrame, keys, *order) -> DataFrame:
    """One row for each key, the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_", F.row_number().over(w)).filter("rank_ = 1").drop("rank_")


def union_matching(spark, pattern: str) -> DataFrame:
    """All catalog tables whose names match a pattern, missing columns null."""
    import re

    names = sorted(t.name for t in spark.catalog.listTables() if re.fullmatch(pattern, t.name))
    if not names:
        raise ValueError(f"no table matches {pattern!r}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.table(n) for n in names))


def cross_filtered(df: DataFrame, selections: dict, charts: dict[str, tuple[str, int | None]]) -> dict[str, DataFrame]:
    """Charts of a dashboard: each counts rows by its column under every selection but its own.

    selections: column -> values. charts: name -> (column, step or None).
    """
    out = {}
    for name, (column, step) in charts.items():
        rows = df
        for c, values in selections.items():
            if c != column:
                rows = rows.filter(F.col(c).isin(values))
        out[name] = rows.groupBy((bucket(F.col(column), step) if step else F.col(column)).alias("x")).agg(F.count("*").alias("n"))
    return out


def key_values(df: DataFrame, time: str, columns: list[str], maps: list[str] = (), step: int = 900) -> DataFrame:
    """Roll-up of attributes: (bucket, column, key, value, n) over plain columns and over the entries of maps.

    One pass: a row becomes an array of its entries; counts are combined before the shuffle.
    """
    entry = lambda c, k, v: F.struct(F.lit(c).alias("column"), k.cast("string").alias("key"), v.cast("string").alias("value"))
    plain = F.array(*(entry(c, F.lit(c), F.col(c)) for c in columns))
    of_map = lambda m: F.transform(F.map_entries(m), lambda e: entry(m, e["key"], e["value"]))
    all_ = reduce(lambda a, m: F.concat(a, of_map(m)), maps, plain)
    rows = df.select(bucket(F.col(time), step).alias("bucket"), F.explode(all_).alias("e")).select("bucket", "e.*").filter("value <> ''")
    return rows.groupBy("bucket", "column", "key", "value").agg(F.count("*").alias("n"))


def discover_keys(rollup: DataFrame, most: int = 1000) -> DataFrame:
    return rollup.groupBy("column", "key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "column", "key").limit(most)


def discover_values(rollup: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` different values of each key."""
    w = Window.partitionBy("column", "key").orderBy("value")
    first = rollup.select("column", "key", "value").distinct().withColumn("rank_", F.row_number().over(w)).filter(F.col("rank_") <= most)
    return first.groupBy("column", "key").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("vals"))


def equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one that the other lacks, counted by side; maps are compared as sorted entries."""
    def plain(df):
        return df.select(*(F.array_sort(F.map_entries(c)).alias(c) if t.startswith("map") else F.col(c) for c, t in sorted(df.dtypes)))

    a, b = plain(a), plain(b)
    return a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit("left").alias("side"), "n").unionByName(b.exceptAll(a).agg(F.count("*").alias("n")).select(F.lit("right").alias("side"), "n"))
