"""Tables whose contents change at once: numbered manifests of files, and a ledger of content keys kept in one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


class SlotTaken(RuntimeError):
    """The slot holds another content."""


def commit_slot(spark: SparkSession, folder: str, slot: int, content: bytes) -> bool:
    """Put an object into a numbered slot of a lane, which takes one object ever. False if this very object is there.

    The object is written aside and renamed into the slot, which fails if the slot is taken; so readers see whole objects
    only, and of two writers one is told. Needs a file system whose rename is atomic.
    """
    if len(content) == 0:
        raise ValueError("an empty object says nothing")
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path
    target, aside = path(f"{folder}/{slot:012d}"), path(f"{folder}/.{slot:012d}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    fs.mkdirs(path(folder))
    out = fs.create(aside, False)
    out.write(bytearray(content))
    out.close()
    try:
        no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files.rename(aside, target, no_overwrite)
        return True
    except Exception:
        fs.delete(aside, False)
        if not fs.exists(target):
            raise
    stream = fs.open(target)
    try:
        there = bytes(stream.readAllBytes())
    finally:
        stream.close()
    if there != content:
        raise SlotTaken(f"slot {slot} of {folder} holds another object")
    return False


#: A manifest: folders of files, by version and by partition ("" where the table has none).
Entry = tuple[str, str]


class Snapshots:
    """A table as a row of manifests, each a whole list of its parts; the last one is the table.

    Files are written aside, under a version of their own; a commit puts the next manifest into its slot, which takes one only. So
    a reader has one manifest or another, never a mixture, and of two writers one is told and decides again.
    """

    def __init__(self, folder: str, part: str | None = None):
        self.folder, self.part = folder.rstrip("/"), part

    def latest(self, spark: SparkSession) -> int:
        """The number of the last manifest; -1 if there is none."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests")
        fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            return -1
        return max((int(x.getPath().getName()) for x in fs.listStatus(path) if x.getPath().getName().isdigit()), default=-1)

    def manifest(self, spark: SparkSession, number: int) -> dict:
        """{"parts": entries, "schema": DDL, "note": what the writer said}; an empty one before the first."""
        if number < 0:
            return {"parts": [], "schema": None, "note": None}
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests/{number:012d}")
        stream = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def write(self, df: DataFrame, version: str | None = None) -> tuple[list[Entry], str]:
        """Files of a version that no manifest has yet (written again, they are replaced) -> its entries and schema."""
        spark, version = df.sparkSession, version or uuid.uuid4().hex
        at = f"{self.folder}/data/version={version}"
        w = df.write.mode("overwrite")
        (w.partitionBy(self.part) if self.part else w).parquet(at)
        if not self.part:
            return [(version, "")], df.schema.json()
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        names = [x.getPath().getName() for x in path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)]
        return [(version, x) for x in sorted(names) if x.startswith(f"{self.part}=")], df.schema.json()

    def commit(self, spark: SparkSession, number: int, parts: list[Entry], schema: str, note: str | None = None) -> int:
        """Make these parts the manifest after `number`. SlotTaken if another writer was first."""
        content = json.dumps({"parts": sorted(map(list, parts)), "schema": schema, "note": note})
        commit_slot(spark, f"{self.folder}/manifests", number + 1, content.encode())
        return number + 1

    def change(self, df: DataFrame, parts: Callable[[list[Entry], list[Entry]], list[Entry]], version: str | None = None, note: str | None = None, times: int = 20) -> int:
        """Write df and commit parts(old entries, new ones), decided again if another writer came first."""
        spark = df.sparkSession
        new, schema = self.write(df, version)
        for _ in range(times):
            n = self.latest(spark)
            old = [(v, p) for v, p in self.manifest(spark, n)["parts"]]
            after = parts(old, new)
            if sorted(after) == sorted(old) and n >= 0:
                return n
            try:
                return self.commit(spark, n, after, schema, note)
            except SlotTaken:
                continue
        raise SlotTaken(f"{times} other writers came first")

    def append(self, df: DataFrame, version: str | None = None) -> int:
        return self.change(df, lambda old, new: sorted({*old, *new}), version)

    def replace(self, df: DataFrame, version: str | None = None) -> int:
        """df takes the place of all of the table, or, in a table with partitions, of those that it has rows in; others stay."""
        return self.change(df, lambda old, new: [x for x in old if self.part and x[1] not in {p for _, p in new}] + new, version)

    def read(self, spark: SparkSession, number: int | None = None, only: list | None = None) -> DataFrame | None:
        """The table at a manifest (the last one), or only some of its partitions; None if it has never been written."""
        m = self.manifest(spark, self.latest(spark) if number is None else number)
        if m["schema"] is None:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(m["schema"]))
        wanted = None if only is None else {f"{self.part}={x}" for x in only}
        paths = [f"{self.folder}/data/version={v}" + (f"/{p}" if p else "") for v, p in m["parts"] if wanted is None or p in wanted]
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.folder}/data").parquet(*paths).select(*schema.names)

    def drop_old(self, spark: SparkSession, keep: int = 1) -> list[str]:
        """Delete files that the last `keep` manifests don't name; a reader of an older one then fails. Returns their versions.

        Not while another writer is between its files and its manifest.
        """
        n = self.latest(spark)
        held = {v for k in range(max(0, n - keep + 1), n + 1) for v, _ in self.manifest(spark, k)["parts"]}
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data")
        fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        gone = []
        for x in fs.listStatus(path) if fs.exists(path) else []:
            version = x.getPath().getName().removeprefix("version=")
            if version not in held:
                fs.delete(x.getPath(), True)
                gone.append(version)
        return sorted(gone)


class KeyLedger:
    """Which batch brought each content key, whatever the day it was received on.

    Keys lie in buckets by their hash, so a batch reads only the buckets of its own keys. A batch's claims become visible at
    once. compacted() makes one set of files of all, each bucket sorted with a bloom filter on its keys, and lets go of those that
    are older than they are kept.
    """

    def __init__(self, folder: str, buckets: int = 64):
        self.snapshots, self.buckets = Snapshots(folder, "bucket"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("content_key"), F.lit(self.buckets)).cast("int")

    def _there(self, rows: DataFrame) -> DataFrame | None:
        """The ledger's rows in the buckets of rows; there are `buckets` at most."""
        own = [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]
        return self.snapshots.read(rows.sparkSession, only=own)

    def unclaimed(self, rows: DataFrame, ident: str) -> DataFrame:
        """The rows (with content_key) whose keys no batch but `ident` has brought."""
        there = self._there(rows)
        if there is None:
            return rows
        others = there.filter(F.col("ingest_id") != ident).select("content_key")
        return rows.join(others, "content_key", "left_anti")

    def claimed(self, rows: DataFrame, ident: str) -> DataFrame:
        """(content_key, received_day) of what `ident` has claimed, in the buckets of rows."""
        return self._there(rows).filter(F.col("ingest_id") == ident).groupBy("content_key").agg(F.min("received_day").alias("received_day"))

    def claim(self, rows: DataFrame, ident: str) -> None:
        """Enter rows (content_key, ingest_id, received_day) as brought by the batch `ident`; again, it changes nothing."""
        spark = rows.sparkSession
        n = self.snapshots.latest(spark)
        if ident in {v for v, _ in self.snapshots.manifest(spark, n)["parts"]}:
            return
        entries = rows.select("content_key", "ingest_id", "received_day", self._bucket().alias("bucket"))
        there = self._there(rows)
        if there is not None:  # a batch that compacted() has merged
            entries = entries.join(there.filter(F.col("ingest_id") == ident).select("content_key"), "content_key", "left_anti").select("content_key", "ingest_id", "received_day", "bucket")
        # a file a bucket
        self.snapshots.append(entries.repartition("bucket"), ident)

    def compacted(self, spark: SparkSession, keep: int | None = None, times: int = 20) -> int:
        """One version of all claims; with keep, without those of days before the newest less `keep`. Returns the manifest's number."""
        for _ in range(times):
            n = self.snapshots.latest(spark)
            rows = self.snapshots.read(spark, n)
            if rows is None:
                return -1
            if keep is not None:
                newest = rows.agg(F.max("received_day")).first()[0]
                rows = rows.filter(F.col("received_day") >= (newest or 0) - keep)
            rows = rows.dropDuplicates(["content_key", "ingest_id"]).repartition("bucket").sortWithinPartitions("bucket", "content_key")
            version = uuid.uuid4().hex
            at = f"{self.snapshots.folder}/data/version={version}"
            w = rows.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#content_key", "true")
            w.partitionBy("bucket").parquet(at)
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            names = [x.getPath().getName() for x in path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)]
            try:
                return self.snapshots.commit(spark, n, [(version, x) for x in names if x.startswith("bucket=")], rows.schema.json())
            except SlotTaken:  # a batch was claimed meanwhile
                continue
        raise SlotTaken(f"{times} other writers came first")
