"""Postings of terms as bitmaps of file numbers: which files can hold a text, by bitmap operations of Spark.

A term in few files keeps their numbers; others a bitmap for each 32,768 numbers, which Parquet packs as they are sparse. The
table is sorted by term, so the statistics of its pages fence it: a whole term or a prefix reads the pages that can have it.
Words longer than LONG bytes are under the empty term, which every look-up asks for too. Files may be over-read, never missed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import term_constraints, term_matches, tokens_col
from .work import written

LONG, FEW = 64, 32


def numbered(files: DataFrame, file: str = "file") -> DataFrame:
    """(file, ordinal): different files, numbered from 0 in their order. Parts of the order are numbered apart; only their sizes meet."""
    parts = files.select(file).distinct().repartitionByRange(file).sortWithinPartitions(file).select(file, F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().alias("id_"))
    parts = parts.withColumn("nth_", F.col("id_").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = parts.groupBy("part_").agg(F.count("*").alias("n_"))  # a row for each partition
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(sizes.select("part_", before.alias("before_"))), "part_").select(file, (F.col("before_") + F.col("nth_")).alias("ordinal"))


def build(rows: DataFrame, text: str, ordinal: str = "ordinal", long: int = LONG, few: int = FEW) -> DataFrame:
    """Rows of files (text, ordinal) -> (term, n, few, many): in how many files a term is, and in which."""
    token = F.explode(tokens_col(F.col(text))).alias("term")
    terms = rows.select(token, F.col(ordinal).cast("long").alias("o")).withColumn("term", F.when(F.octet_length("term") > long, "").otherwise(F.col("term"))).distinct()
    terms = written(terms, "terms")  # texts are cut into words once: counts, rare and frequent terms and the ranges of the sort read it
    n = terms.groupBy("term").agg(F.count("*").alias("n"))
    rare = terms.join(n.filter(F.col("n") <= few), "term").groupBy("term", "n").agg(F.sort_array(F.collect_list("o")).alias("o"))
    # numbers as the gaps between them, which pack better
    rare = rare.select("term", "n", F.transform("o", lambda x, i: (x - F.coalesce(F.get("o", i - 1), F.lit(0))).cast("int")).alias("few"))
    often = terms.join(n.filter(F.col("n") > few), "term").groupBy("term", "n", _bucket("o").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("o") + 1)).alias("bits"))
    often = often.groupBy("term", "n").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("many"))
    out = rare.withColumn("many", F.lit(None).cast(often.schema["many"].dataType)).unionByName(often.withColumn("few", F.lit(None).cast("array<int>")))
    return written(out, "postings-unsorted").repartitionByRange("term").sortWithinPartitions("term")


def _bucket(o: str):
    return F.bitmap_bucket_number(F.col(o) + 1)


def _numbers(few: str):
    """Gaps -> numbers; there are FEW at most."""
    return F.transform(few, lambda _, i: F.aggregate(F.slice(few, 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x))


def write(postings: DataFrame, path: str) -> None:
    postings.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)


def candidates(postings: DataFrame, query: str) -> DataFrame | None:
    """(ordinal): files whose words can make a text that holds the query, in any case; None if the query says nothing of words.

    Of each constraint the bitmaps of its terms are or-ed, and those of all constraints and-ed, a bucket of files at a time.
    """
    wanted = term_constraints(query)
    if not wanted:
        return None
    each = []
    for i, (kind, run) in enumerate(wanted):
        hit = postings.filter(term_matches(F.col("term"), kind, run)).unionByName(postings.filter(F.col("term") == ""))
        rare = hit.select(F.explode(_numbers("few")).alias("o")).groupBy(_bucket("o").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("o") + 1)).alias("bits"))
        often = hit.select(F.explode("many").alias("m")).select("m.bucket", "m.bits")
        each.append(rare.unionByName(often).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("c", F.lit(i)))
    met = reduce(DataFrame.unionByName, each).groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits")).filter(F.col("n") == len(wanted))
    # bytes that are not zero, then their bits
    octets = F.filter(F.transform(F.sequence(F.lit(1), F.lit(4096)), lambda i: F.struct(i.alias("i"), F.conv(F.hex(F.substring(F.col("bits"), i, F.lit(1))), 16, 10).cast("int").alias("v"))), lambda x: x["v"] > 0)
    rows = met.select("bucket", F.explode(octets).alias("x")).select("bucket", "x.i", "x.v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    rows = rows.filter(F.expr("shiftright(v, bit) % 2 = 1"))
    return rows.select(((F.col("bucket") - 1) * 32_768 + (F.col("i") - 1) * 8 + F.col("bit")).cast("long").alias("ordinal"))
