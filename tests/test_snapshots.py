"""Snapshots and the ledger of content keys: all or nothing, once and only once."""

import pytest
from pyspark.sql import functions as F

from skyquarry.streaming import ingest as I
from skyquarry.streaming import snapshots
from skyquarry.streaming.snapshots import KeyLedger, SlotTaken, Snapshots

KEYS = "content_key string, ingest_id string, received_day long"


def rows(spark, days, v):
    return spark.createDataFrame([(d, f"{d}-{i}", v) for d in days for i in range(5)], "day long, k string, v long")


def test_days_are_swapped_at_once(spark, tmp_path, monkeypatch):
    """A reader during a rebuild sees the old table or the new one, at whatever moment it looks; a plan made before reads on."""
    path = str(tmp_path / "rollup")
    I.swap_days(rows(spark, [1, 2, 3], 0), path, "day")
    table, seen, plain = Snapshots(path, "day"), [], snapshots.commit_slot
    before = table.read(spark)

    def slow(spark_, *args):
        seen.append({r["v"] for r in Snapshots(path, "day").read(spark).collect()})
        out = plain(spark_, *args)
        seen.append({(r["day"], r["v"]) for r in Snapshots(path, "day").read(spark).collect()})
        return out

    monkeypatch.setattr(snapshots, "commit_slot", slow)
    assert I.swap_days(rows(spark, [2, 3, 4], 9), path, "day") == 1
    assert seen == [{0}, {(1, 0), (2, 9), (3, 9), (4, 9)}]
    assert {r["v"] for r in before.collect()} == {0} and before.count() == 15
    assert table.read(spark, 0).count() == 15 and table.read(spark).count() == 20
    assert sorted({r["day"] for r in table.read(spark, only=[1, 4]).collect()}) == [1, 4]
    assert table.drop_old(spark, keep=2) == [] and table.read(spark).count() == 20


def test_old_files_go(spark, tmp_path):
    table = Snapshots(str(tmp_path / "t"))
    assert table.read(spark) is None and table.latest(spark) == -1
    for v in range(3):
        table.replace(rows(spark, [1], v))
    assert {r["v"] for r in table.read(spark).collect()} == {2} and {r["v"] for r in table.read(spark, 1).collect()} == {1}
    assert len(table.drop_old(spark, keep=1)) == 2 and {r["v"] for r in table.read(spark).collect()} == {2}


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second of two writers decides again: nothing that the first has committed is lost."""
    path, plain, other = str(tmp_path / "t"), snapshots.commit_slot, []
    Snapshots(path, "day").append(rows(spark, [1], 0))

    def raced(spark_, *args):
        if not other:
            other.append(1)
            Snapshots(path, "day").append(rows(spark, [2], 0))
        return plain(spark_, *args)

    monkeypatch.setattr(snapshots, "commit_slot", raced)
    Snapshots(path, "day").append(rows(spark, [3], 0))
    assert sorted({r["day"] for r in Snapshots(path, "day").read(spark).collect()}) == [1, 2, 3]
    with pytest.raises(SlotTaken):
        Snapshots(path, "day").commit(spark, 0, [("x", "day=1")], "{}")


def test_ledger(spark, tmp_path):
    ledger = KeyLedger(str(tmp_path / "keys"), buckets=8)
    batch = lambda ks, ident, day: spark.createDataFrame([(f"k{k}", ident, day) for k in ks], KEYS)
    ledger.claim(batch(range(50), "a", 1), "a")
    ledger.claim(batch(range(50), "a", 1), "a")
    assert ledger.unclaimed(batch(range(40, 60), "b", 9), "b").count() == 10 and ledger.unclaimed(batch(range(40, 60), "a", 9), "a").count() == 20
    ledger.claim(batch(range(50, 60), "b", 9), "b")
    assert ledger.snapshots.read(spark).count() == 60
    assert ledger.compacted(spark) == 2 and ledger.snapshots.read(spark).count() == 60
    assert ledger.snapshots.read(spark, only=[0]).count() == ledger.snapshots.read(spark).filter(F.col("bucket") == 0).count()
    ledger.claim(batch(range(50), "a", 1), "a")  # delivered again after its claims were merged with others
    assert ledger.snapshots.read(spark).count() == 60
    ledger.compacted(spark, keep=3)  # day 1 is older than day 9 less 3
    assert sorted(r["ingest_id"] for r in ledger.snapshots.read(spark).select("ingest_id").distinct().collect()) == ["b"]
    assert ledger.unclaimed(batch([1, 55], "c", 9), "c").count() == 1


def test_a_key_comes_once_on_any_day(spark, tmp_path):
    """Before, keys were only looked for among those received on the batch's own days."""
    table = str(tmp_path / "table")
    sink = I.Sink(table, 900)
    at = lambda received, ids: I.content_key(spark.createDataFrame([(i, 86_000, received, 1) for i in ids], "event_id long, s long, received long, batch_id long"), ["event_id", "s"])
    sink(at(86_399, [1, 2]), 0)
    sink(at(86_401, [1, 2, 3]), 1)
    sink(at(86_400 * 40, [1, 3, 4]), 2)
    sink(at(86_400 * 90, [1, 2]), 3)  # just what the first batch held, so the same batch
    assert sorted((r["event_id"], r["received"]) for r in spark.read.parquet(table).collect()) == [(1, 86_399), (2, 86_399), (3, 86_401), (4, 86_400 * 40)]


def test_a_table_without_a_ledger_gets_one(spark, tmp_path):
    table = str(tmp_path / "table")
    sink = I.Sink(table, 900)
    batch = I.content_key(spark.createDataFrame([(1, 5, 10, 1)], "event_id long, s long, received long, batch_id long"), ["event_id", "s"])
    sink(batch, 0)
    fresh = I.Sink(table, 900, ledger=str(tmp_path / "elsewhere"))
    fresh(batch.withColumn("received", F.lit(86_400 * 3).cast("long")).unionByName(I.content_key(spark.createDataFrame([(2, 5, 10, 1)], "event_id long, s long, received long, batch_id long"), ["event_id", "s"])), 1)
    assert sorted(r["event_id"] for r in spark.read.parquet(table).collect()) == [1, 2]


def test_days_apart_and_killed(spark, tmp_path, monkeypatch):
    """Batches of two days that share keys, killed after each write and delivered again, leave the table of a clean run."""
    from pyspark.sql import DataFrameWriter

    class Killed(BaseException):
        pass

    def ingest(where, kill_at):
        table, agg = str(tmp_path / where / "table"), str(tmp_path / where / "agg")
        sink, writes, plain = I.Sink(table, 900, {agg: lambda r: r.groupBy("received_day").agg(F.count("*").alias("n"))}), [], DataFrameWriter.parquet

        def parquet(self, *args, **kwargs):
            plain(self, *args, **kwargs)
            writes.append(args)
            if len(writes) == kill_at:
                raise Killed

        monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
        for no, (received, ids) in enumerate([(86_399, range(6)), (86_401, range(4, 9)), (300_000, range(12))]):
            batch = I.content_key(spark.createDataFrame([(i, 86_000 + i, received, 1) for i in ids], "event_id long, s long, received long, batch_id long"), ["event_id", "s"])
            for _ in range(3):
                try:
                    sink(batch, no)
                except Killed:
                    continue
        monkeypatch.setattr(DataFrameWriter, "parquet", plain)
        return [sorted(map(str, spark.read.parquet(x).drop("ingest_id").collect())) for x in (table, agg)], len(writes)

    want, n = ingest("clean", None)
    assert len(want[0]) == 12
    for k in range(1, n, 2):
        assert ingest(f"killed{k}", k)[0] == want, k
