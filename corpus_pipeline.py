"""From documents to a mix for training: quality rules, near duplicates, benchmark passages, secrets, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's as Parquet and reads it again as
the next one's docs. All but the last return the columns of docs, whatever their names. An empty table passes through all stages.
Texts are read whole in each. Null and empty texts have no words, so the first stage drops them; a later one, given them, lets them
stay (of equal texts, null and empty ones too, near_duplicates keeps one) and the mix takes 0 words of them. Rows alike in all
columns are judged alike by the rules, decontamination and secrets; near_duplicates keeps the one with the smallest id (a null id
is larger than any), of equal ids one; mixing takes rows alike in id, source and text alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyquarry.llm.common import drop_tables, own_tables, table, written
from skyquarry.llm.decontamination import clean
from skyquarry.llm.mixing import mix
from skyquarry.llm.quality_rules import kept_documents
from skyquarry.llm.secrets import redacted
from skyquarry.llm.simhash import deduplicated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. References are learned from all of docs."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes <secret>; all documents stay."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]
#: Fingerprints, learned models and templates are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Once a stage is written, what it and the ones before it have written goes; the result's own
    table stays until drop_written(). Tables of other queries of the driver are left alone."""
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with own_tables() as own:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_tables(spark, held + own[:-1])
        held = own[-1:]
    return docs
