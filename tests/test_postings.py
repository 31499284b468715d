"""Postings: a superset of brute force, near it, and smaller than rows of terms and files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from skyquarry.operators import control as C
from skyquarry.operators import postings as P

WORDS = [f"w{i}" for i in range(400)] + ["error", "Errors", "terror", "café", "x" * 90, "y" * 70 + "error"]


@pytest.fixture(scope="module")
def files(spark):
    r = random.Random(6)
    rows = [(f"f{i:04d}", " ".join(r.choices(WORDS, k=r.randint(1, 25))) + r.choice(["", " time out", " timeout error"])) for i in range(300) for _ in range(2)]
    return spark.createDataFrame(rows, "file string, text string").cache()


def size(path):
    return sum(os.path.getsize(f"{path}/{x}") for x in os.listdir(path) if x.endswith(".parquet"))


@pytest.mark.parametrize("few", [0, 32])
def test_candidates(spark, files, tmp_path, few):
    numbers = P.numbered(files)
    assert sorted(r["ordinal"] for r in numbers.collect()) == list(range(300))
    path = str(tmp_path / "postings")
    P.write(P.build(files.join(numbers, "file"), "text", few=few), path)
    index = spark.read.parquet(path)
    texts = {r["file"]: [x.lower() for x in r["t"]] for r in files.groupBy("file").agg(F.collect_list("text").alias("t")).collect()}
    name = {r["ordinal"]: r["file"] for r in numbers.collect()}
    tight = 0
    for query in ("error", "time out", "meout err", " error ", "w17", "rror", "café", "nosuchword", "x" * 80, "w1 w2"):
        got = {name[r["ordinal"]] for r in P.candidates(index, query).collect()}
        want = {f for f, ts in texts.items() if any(query in t for t in ts)}
        assert want <= got, query
        tight += len(got) < 300
    assert tight >= 6 and P.candidates(index, "  ") is None


def test_smaller_than_rows(spark, tmp_path):
    """2,000 words in up to 3,000 files."""
    rows = spark.range(3000).select(F.col("id").alias("file"), F.concat_ws(" ", *(F.concat(F.lit("t"), F.floor(F.pow(F.rand(i), 4) * 2000).cast("int")) for i in range(60))).alias("text"))
    rows.write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    C.term_index(rows, "text", most=1.0).coalesce(2).sortWithinPartitions("term", "file").write.option("compression", "zstd").parquet(str(tmp_path / "rows"))
    P.write(P.build(rows, "text", "file").coalesce(2), str(tmp_path / "postings"))
    assert size(str(tmp_path / "postings")) < 0.9 * size(str(tmp_path / "rows")), (size(str(tmp_path / "postings")), size(str(tmp_path / "rows")))


def test_terms_reach_the_scan(spark, files, tmp_path):
    path = str(tmp_path / "p")
    P.write(P.build(files.join(P.numbered(files), "file"), "text"), path)
    plan = P.candidates(spark.read.parquet(path), " error time")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,error)" in plan and "StringStartsWith(term,time)" in plan


def test_texts_are_cut_into_words_once(spark, tmp_path):
    """The plans of both indexes start from a table of terms, whatever reads it and however often; the look-up's terms reach its files."""
    rows = spark.createDataFrame([(i, f"all some{i % 3} word{i} Apache") for i in range(40)], "file long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    index = C.term_index(rows, "text")
    for df in (index, P.build(rows, "text", "file")):
        assert "split(" not in plan(df) and "Generate" not in plan(df)
    files = rows.select("file").withColumn("covered", F.lit(True))
    hit = C.files_with_text(files, index, "some1 word4 apache")
    assert [r["file"] for r in hit.collect()] == [4]
    assert "PushedFilters: [Or" in plan(hit) or "StringEndsWith" in plan(hit)
