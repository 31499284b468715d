import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.maxMetadataStringLength": "2000", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same_rows(df, duck, sql):
    """Both sides as sorted rows, columns by name."""
    columns = sorted(df.columns)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    ours = sorted((plain(tuple(r[c] for c in columns)) for r in df.collect()), key=repr)
    rel = duck.sql(sql)
    at = [rel.columns.index(c) for c in columns]
    assert len(rel.columns) == len(columns)
    theirs = sorted((plain(tuple(r[i] for i in at)) for r in rel.fetchall()), key=repr)
    assert ours == theirs
