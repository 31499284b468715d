"""Each stage of the pipeline on what the one before kept, against brute force where there is one."""

from collections import Counter

import corpus_pipeline as P
from conftest import SF
from pyspark.sql import functions as F
from test_advice import brute_copies
from test_exact import brute_quality

from skyquarry.llm.common import table, words_of, written
from skyquarry.llm.mixing import mix


def test_stages(spark):
    docs = table(spark, SF, "documents").withColumn("uid_", F.lit("mine"))
    columns, seen = docs.columns, [docs]
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        seen.append(docs)
    first, quality, dedup, clean, secrets, out = seen
    assert all(d.columns == columns for d in seen[:-1])
    rows = [{r["doc_id"]: r["text"] for r in d.collect()} for d in seen[:-1]]
    assert set(rows[1]) <= {i for i, t in rows[0].items() if not brute_quality(t)[5]}
    good = {r["doc_id"] for r in table(spark, SF, "labels").filter("quality = 1 and toxic = 0").collect()}
    long = {i for i in good if i in rows[0] and not brute_quality(rows[0][i])[5]}
    assert len(long & set(rows[1])) >= 0.98 * len(long)
    assert sorted(rows[2]) == brute_copies(list(rows[1].items()))
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    assert not any(b in t for t in rows[3].values() for b in items)
    gone = {i for i in rows[2] if i not in rows[3]}
    assert all(any(" ".join(words_of(b)[k : k + 6]) in " ".join(words_of(rows[2][i])) for b in items for k in range(max(1, len(words_of(b)) - 5))) for i in gone)
    assert set(rows[4]) == set(rows[3]) and all(t == rows[3][i] or "<secret>" in t for i, t in rows[4].items())
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, mix(secrets).collect()))


def test_run_and_empty(spark, tmp_path):
    for t in ("documents", "benchmark"):
        table(spark, SF, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_run_with_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, equal ids, a very long text and clashing columns pass through all stages, and the
    stages' own tables are gone afterwards."""
    from test_exact import clash

    from skyquarry.llm.common import n_written

    docs = table(spark, SF, "documents").limit(60)
    first = docs.filter("n_chars > 800").first()
    long = " ".join(f"{first['text']} part{i}" for i in range(40))
    odd = [(None, None, None, None, None), (None, first["text"] + " but other words end this one here", None, None, None), (first["doc_id"], first["text"], first["lang"], first["source"], 1), (first["doc_id"], first["text"], None, None, 1), (-1, long, "en", None, 1), (-2, "", "en", "a", 0), (-3, " \n", "xx", "a", 0)]
    rows = clash(docs.unionByName(spark.createDataFrame(odd, docs.schema)))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SF, "benchmark").withColumn("k", F.lit("mine")).write.parquet(str(tmp_path / "benchmark.parquet"))
    before = n_written()
    out = P.run(spark, str(tmp_path)).collect()
    assert n_written() == before + 1
    got = Counter(r["doc_id"] for r in out)
    assert got[first["doc_id"]] <= 1 and got[-2] == got[-3] == 0 and all(r["size"] >= 50 for r in out)
    kept = P.quality(spark, table(spark, str(tmp_path), "documents"), str(tmp_path))
    assert kept.columns == rows.columns


def test_written_tables_can_go(spark):
    from skyquarry.llm.common import _WRITTEN, drop_written

    path_before = len(_WRITTEN)
    df = written(spark.range(3), "gone")
    assert df.count() == 3 and len(_WRITTEN) == path_before + 1
    assert drop_written(spark) == path_before + 1 and not _WRITTEN
