"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only.

Each source has a target number of words. A document is taken floor(target / size of source) times, and once more if its
hash lies below the source's threshold. The threshold comes from histograms: words are summed by source and hash bucket,
the bucket in which the budget runs out is split by the next digits of the hash, and so on; only that bucket's rows are
read again, and rows are never sorted. The hash is MD5 of id, source and text, so runs agree, a larger budget takes a
superset, and only rows that are alike move together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, n_words_col, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEATS = 2
#: Hexadecimal digits of the hash in a level of the histogram, and levels.
DIGITS = 3
LEVELS = 3


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MAX_REPEATS) -> DataFrame:
    """Water-filling: (source, source_size) -> the same with target.

    Sources in code-point order, null last, weigh `weights` in turn and divide share * all words; no target is above most *
    its source's words, and what that leaves over goes to the rest by weight. Sorted by most * size / weight, the sources
    at their limit come first, so one running sum finds them. The input has one row for each source.
    """
    everything = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = by_source.withColumn("weight_", weight).withColumn("limit_", most * F.col("source_size"))
    df = df.withColumn("ratio_", F.col("limit_") / F.col("weight_")).withColumn("total_", share * F.sum("source_size").over(everything))
    rising = Window.partitionBy(F.lit(0)).orderBy("ratio_", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit_").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight_").over(rising.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level_", (F.col("total_") - before) / rest).withColumn("full_", F.col("ratio_") <= F.col("level_"))
    level = F.max(F.when(~F.col("full_"), F.col("level_"))).over(everything)  # of the first source below its limit
    target = F.when(F.col("full_"), F.col("limit_")).otherwise(F.col("weight_") * level)
    return df.withColumn("target", target).select("source", "source_size", "target")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of docs.

    Null and empty texts have size 0 and are taken 0 times. Rows with equal ids, null ones too, have hashes of their own
    where source or text differ; rows alike in all three are taken alike. Null sources form one source. Texts count whole,
    however long. An empty table gives an empty result.
    """
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, source)]
    digest = F.md5(F.concat(known[0], F.lit("|"), known[1], F.lit("|"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words_col(F.col(text)).alias("size"), digest.alias("hash_"))
    rows = written(rows.withColumn("hash_", F.substring("hash_", 1, DIGITS * LEVELS)), "mix-rows")

    known = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("name_", _name(F.col("source"))).drop("source"), "mix-targets")
    known = known.withColumn("whole_", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    # words still wanted from documents that are taken once more
    known = known.withColumn("budget_", F.col("target") - F.col("whole_") * F.col("source_size"))
    rows = rows.withColumn("name_", _name(F.col("source")))

    found = known.withColumn("prefix_", F.lit("")).withColumn("left_", F.col("budget_"))
    for level in range(LEVELS):
        found = written(_refine(rows, found, level), f"mix-level{level}")
    # the last bucket holds few rows: it is taken if that comes nearer to the target
    found = found.withColumn("last_in_", F.col("at_") - F.col("left_") < F.col("left_"))
    out = join_small(rows, found, "name_", "left", spread="hash_")
    more = (F.col("hash_") < F.col("prefix_")) | ((F.col("hash_") == F.col("prefix_")) & F.col("last_in_"))
    times = F.col("whole_") + F.when((F.col("budget_") > 0) & more, 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def _name(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def _refine(rows: DataFrame, found: DataFrame, level: int) -> DataFrame:
    """found: for each source the prefix in which its budget runs out, and the words left when it begins.

    Returns the same with a prefix of DIGITS more digits; at_ are the words in that bucket.
    """
    wide = DIGITS * (level + 1)
    inside = join_small(rows, found.select("name_", "prefix_"), "name_", "inner", spread="hash_") if level else rows.withColumn("prefix_", F.lit(""))
    if level:
        inside = inside.filter(F.substring("hash_", 1, DIGITS * level) == F.col("prefix_"))
    # a map-side sum comes before the shuffle, so a source with a third of all rows sends 16 ** DIGITS rows a task at most
    sums = inside.groupBy("name_", F.substring("hash_", 1, wide).alias("bucket_")).agg(F.sum("size").alias("at_"))
    sums = join_small(sums, found.drop("at_"), "name_", "inner", spread="bucket_")
    running = Window.partitionBy("name_").orderBy("bucket_")
    sums = sums.withColumn("upto_", F.sum("at_").over(running))
    # the first bucket that reaches the budget, or the last one if rounding lets none reach it
    sums = sums.withColumn("end_", F.max("bucket_").over(Window.partitionBy("name_")))
    reach = (F.col("upto_") >= F.col("left_")) | (F.col("bucket_") == F.col("end_"))
    sums = sums.filter(reach).withColumn("rank_", F.row_number().over(running)).filter("rank_ = 1")
    return sums.select("name_", "source_size", "target", "whole_", "budget_", F.col("bucket_").alias("prefix_"), (F.col("left_") - (F.col("upto_") - F.col("at_"))).alias("left_"), "at_")


def op2_mixing(spark, sf_dir):
    from .common import table

    return mix(table(spark, sf_dir, "documents"))


#: Not by levels: one running sum over the nine digits, in DuckDB's SQL.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(concat(coalesce(doc_id::VARCHAR, ''), '|', coalesce(source, ''), '|', md5(coalesce(text, '')))), 1, 9) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
      2.0::DOUBLE * source_size AS lim, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s),
r AS (SELECT *, lim / weight AS ratio FROM w),
l AS (SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
t AS (SELECT source, source_size, CASE WHEN ratio <= lev THEN lim ELSE weight * max(CASE WHEN NOT (ratio <= lev) THEN lev END) OVER () END AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
      target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS budget FROM t),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto, max(h) OVER (PARTITION BY source) AS last_h FROM g),
f AS (SELECT c.source, c.h, c.n AS at_n, b.budget - (upto - c.n) AS rest,
      row_number() OVER (PARTITION BY c.source ORDER BY c.h) AS nth
      FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE upto >= budget OR c.h = last_h)
SELECT d.doc_id, d.size, b.source_size, b.target,
  (d.size * (b.whole + CASE WHEN b.budget > 0 AND (d.h < f.h OR (d.h = f.h AND f.at_n - f.rest < f.rest)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN f ON d.source IS NOT DISTINCT FROM f.source AND f.nth = 1
"""
