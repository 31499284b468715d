"""Streams: once and only once, whatever is delivered again."""

from pyspark.sql import functions as F

from skyquarry.operators import metrics as M
from skyquarry.operators import traces as T
from skyquarry.operators.control import Basis
from skyquarry.plans.service import Service, render
from skyquarry.sources import feeds
from skyquarry.streaming import ingest as I

SCHEMA = "event_id long, s long, received long, batch_id long, service string"


def _rows(spark, batches):
    return spark.createDataFrame([(b * 10 + i, b * 1000 + i - (5000 if i == 9 else 0), b * 1000 + 50, b, f"s{i % 2}") for b in batches for i in range(10)], SCHEMA)


def test_ingest_once(spark, tmp_path):
    src, table, dim, agg = (str(tmp_path / x) for x in ("in", "table", "dim", "agg"))
    _rows(spark, [1, 2]).write.parquet(src)
    sink = I.Sink(table, 900, {agg: lambda r: r.groupBy("service").agg(F.count("*").alias("n"))}, {dim: lambda r: r.select(F.col("service").alias("id")).distinct()})
    key = lambda: I.content_key(I.file_stream(spark, src, SCHEMA), ["event_id", "s", "service"])
    I.run(key(), sink, str(tmp_path / "cp"))
    _rows(spark, [2, 3]).write.mode("append").parquet(src)  # batch 2 again, in another file
    I.run(key(), sink, str(tmp_path / "cp"))
    out = spark.read.parquet(table)
    assert out.count() == 30 and out.select("event_id").distinct().count() == 30
    assert out.filter("late_part = 1").count() == 3
    assert sorted(r["id"] for r in spark.read.parquet(dim).collect()) == ["s0", "s1"]
    assert spark.read.parquet(agg).agg(F.sum("n")).first()[0] == 30
    sink(I.content_key(_rows(spark, [3]), ["event_id", "s", "service"]), 1)  # the same batch once more
    assert spark.read.parquet(table).count() == 30
    m = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "batch_id long, rows long")
    assert [r["batch_id"] for r in I.verified(out, m).collect()] == [3]


class Killed(BaseException):
    pass


def test_ingest_survives_a_kill_after_each_write(spark, tmp_path, monkeypatch):
    """Killed after any of its writes and delivered again, a batch leaves the table and all derived tables of a clean run."""
    from pyspark.sql import DataFrameWriter

    tables = ("table", "dim", "agg", "agg2")

    def ingest(where, kill_at):
        path = {t: str(tmp_path / where / t) for t in tables}
        derived = {path["agg"]: lambda r: r.groupBy("service").agg(F.count("*").alias("n")), path["agg2"]: lambda r: r.select("event_id", "s")}
        sink, writes, plain = I.Sink(path["table"], 900, derived, {path["dim"]: lambda r: r.select(F.col("service").alias("id"))}), [], DataFrameWriter.parquet

        def parquet(self, *args, **kwargs):
            plain(self, *args, **kwargs)
            writes.append(args)
            if len(writes) == kill_at:
                raise Killed

        monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
        for no, batches in ((0, [1, 2]), (1, [2, 3])):
            batch = I.content_key(_rows(spark, batches), ["event_id", "s", "service"])
            for _ in range(3):  # delivered until it has been taken, and once more
                try:
                    sink(batch, no)
                except Killed:
                    continue
        monkeypatch.setattr(DataFrameWriter, "parquet", plain)
        return {t: sorted(map(str, spark.read.parquet(path[t]).drop("ingest_id").collect())) for t in tables}, len(writes)

    want, n = ingest("clean", None)
    assert len(want["table"]) == 30 and len(want["agg2"]) == 30 and n == 26
    for k in range(1, 11):
        assert ingest(f"killed{k}", k)[0] == want, k


def test_slots_take_one_object(spark, tmp_path):
    import pytest

    folder = str(tmp_path / "lane")
    assert I.commit_slot(spark, folder, 7, b"abc") and not I.commit_slot(spark, folder, 7, b"abc")
    with pytest.raises(I.SlotTaken):
        I.commit_slot(spark, folder, 7, b"abd")
    assert I.commit_slot(spark, folder, 8, b"abd")
    assert sorted(x.name for x in (tmp_path / "lane").iterdir() if not x.name.startswith(".")) == [f"{7:012d}", f"{8:012d}"]
    with pytest.raises(ValueError):
        I.commit_slot(spark, folder, 9, b"")


def test_stream_windows(spark, tmp_path):
    """Counts of the windows that the watermark has closed equal those of a batch query."""
    src, schema = str(tmp_path / "in"), "service string, t timestamp"
    rows = lambda ts: spark.createDataFrame([(f"s{i % 2}", t) for i, t in enumerate(ts)], "service string, s long").select("service", F.timestamp_seconds("s").alias("t"))
    rows([0, 30, 299, 300, 301, 650, 899]).coalesce(1).write.parquet(src)
    rows([7200]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = I.windowed_counts(stream, "t", "10 minutes", "5 minutes", ["service"], "1 minute").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = {(int(r["b"]), r["service"]): r["n"] for r in spark.table("w").select(F.unix_timestamp("window.start").alias("b"), "service", "n").collect()}
    want = {}
    for i, t in enumerate([0, 30, 299, 300, 301, 650, 899]):
        for b in range(-300, 901, 300):
            if b <= t < b + 600:
                want[b, f"s{i % 2}"] = want.get((b, f"s{i % 2}"), 0) + 1
    assert got == want


def test_receive_time_is_checked(spark):
    import pytest

    good = spark.createDataFrame([(1, 1050), (2, 2050)], "batch_id long, received long")
    assert I.checked_receive_time(_rows(spark, [1, 2]), good).count() == 20
    with pytest.raises(Exception, match="receive time"):
        I.checked_receive_time(_rows(spark, [1, 2]), good.withColumn("received", F.lit(0).cast("long"))).collect()


def test_replace_days(spark, tmp_path):
    p = str(tmp_path / "r")
    df = spark.createDataFrame([(1, 10), (2, 20)], "day long, v long")
    I.replace_days(df, p, "day")
    I.replace_days(df.filter("day = 2").withColumn("v", F.lit(99).cast("long")), p, "day")
    assert sorted((r["day"], r["v"]) for r in spark.read.parquet(p).collect()) == [(1, 10), (2, 99)]


def test_service(spark):
    df = _rows(spark, [1, 2, 3]).withColumn("cluster", F.concat(F.lit("c"), F.col("batch_id") % 2)).withColumn("namespace", F.lit("n"))
    s = Service(spark, {"logs": df}, {"c0": 5000, "c1": 3050}, 100)
    a = s.query([("*", "*")], "SELECT cluster, count(*) AS n FROM logs GROUP BY cluster", 0, 2950)
    assert a.label.state == "complete" and a.basis.bounds == {"c0": 5000, "c1": 3050}
    assert {r["cluster"]: r["n"] for r in a.rows.collect()} == {"c0": 9, "c1": 9}
    b = s.query([("c0", "*")], "SELECT count(*) AS n FROM logs", -9000, 9000)
    assert b.rows.first()["n"] == 10 and b.label.state == "partial"
    assert b.late == {"logs": 1}  # the rows of c1 are not counted
    assert s.query([("c1", "*")], "SELECT 1 AS x FROM logs", -9000, 9000).late == {"logs": 2}
    assert s.query([("zz", "*")], "SELECT 1 AS x FROM logs", -9000, 9000).late == {"logs": 0}
    since = s.query([("c0", "*")], "SELECT 1 AS x FROM logs", -9000, 9000, basis=Basis({"c0": 0, "c1": 0})).basis
    assert s.query([("c0", "*")], "SELECT 1 AS x FROM logs", -9000, 9000, since=since).added == {"logs": 10}
    few = s.query([("c0", "*")], "SELECT cluster FROM logs", 0, 9000, sample=3)
    assert few.label.state == "sample" and [r["cluster"] for r in few.rows.collect()] == ["c0"] * 3
    assert render(a.rows.orderBy("cluster"), "JSONEachRow") == '{"cluster":"c0","n":9}\n{"cluster":"c1","n":9}'


def test_otlp_spans(spark):
    line = '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"a"}},{"key":"x","value":{"doubleValue":2.0}},{"key":"x","value":{"intValue":"7"}}]},"scopeSpans":[{"spans":[{"traceId":"t","spanId":"s","name":"n","kind":2,"startTimeUnixNano":"1700000000000000001","endTimeUnixNano":"1700000000000000011","status":{"code":2},"events":[{"timeUnixNano":"5","name":"e"}]}]}]}]}'
    r = feeds.otlp_spans(spark.createDataFrame([(line,)], "value string")).first()
    assert (r["time_ns"], r["duration_ns"], r["kind"], r["status"], r["service"], r["resource"]["x"], r["parent_id"], r["events"][0]["name"]) == (1700000000000000001, 10, "Server", "Error", "a", "7", "", "e")


def test_files_and_lanes(spark, tmp_path):
    _rows(spark, [1, 2]).repartition(1).write.parquet(str(tmp_path / "f"))
    m = feeds.manifest(spark, str(tmp_path / "f"))
    assert [r["rows"] for r in m.collect()] == [20]
    from skyquarry.operators.control import scan

    assert scan(spark, m, SCHEMA).count() == 20
    spark.createDataFrame([("l", 1, "delta", "e", "v", 5)], "lane string, n long, kind string, entity string, version string, t long").write.option("compression", "gzip").json(str(tmp_path / "lane"))
    from skyquarry.operators.entities import claims_from_lanes

    assert claims_from_lanes(feeds.entity_lane(spark, str(tmp_path / "lane"))).count() == 1


def test_offload(spark):
    df = spark.createDataFrame([(1, "x" * 50), (2, "y"), (3, "x" * 50), (4, None)], "id long, t string")
    rows, payloads = T.offload(df, "t", 10)
    assert payloads.count() == 1 and rows.filter("ref is not null and t is null").count() == 2
    rows, parts = T.offload_parts(spark.createDataFrame([(1, '["a","b","a"]'), (2, "no"), (3, None)], "id long, t string"), "t")
    assert parts.count() == 2 and {r["id"]: r["t"] for r in rows.collect()} == {1: None, 2: "no", 3: None}
    back = T.resolve(rows.filter("refs is not null"), parts, "id", "refs").first()
    assert back["content"] == "a,b,a"


def test_clamped_rate_and_reset(spark):
    p = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 9.0), ("a", 3, 2.0), ("a", 4, 4.0)], "k string, t long, v double")
    assert [r["rate"] for r in M.clamped_rate(p, ["k"], ["t"], "v").orderBy("t").collect()] == [0.0, 4.0, 0.0, 2.0]
    assert abs(M.promql_rate(p, ["k"], "t", "v", 0, 9).first()["rate"] - (4 + 2 + 2) / 3) < 1e-9


def test_window_of(spark):
    from skyquarry.plans.service import window_of

    w = lambda q: window_of(spark, q)
    assert w("SELECT * FROM logs WHERE s >= 5 AND s < 9 AND x = 1") == (5, 9)
    assert w("SELECT * FROM logs WHERE s > 5 AND s <= 9") == (6, 10)
    assert w("SELECT * FROM logs WHERE s >= 5") is None
    assert w("SELECT * FROM logs WHERE s >= 5 AND s < 9 UNION ALL SELECT * FROM logs WHERE s >= 5 AND s < 8") is None
    assert w("WITH a AS (SELECT * FROM logs WHERE s >= 5 AND s < 9) SELECT * FROM a WHERE s >= 0 AND s < 1") == (5, 9)
    assert w("SELECT * FROM logs WHERE s >= 5 OR s < 9") is None


def test_payload_cut(spark):
    df = spark.createDataFrame([("a" * 10,), ("éé€😀😀",), ("",), (None,), ("😀" * 50,)], "t string")
    for most in (0, 3, 5, 7, 11, 12, 100):
        for r in df.select("t", T.prepared_payload(F.col("t"), [], most).alias("p")).collect():
            want = None if r["t"] is None else r["t"].encode()[:most].decode("utf-8", "ignore")
            assert r["p"] == want


def test_results_are_kept(spark):
    from skyquarry.operators.control import Basis
    from skyquarry.plans.service import Results

    made = []
    kept = Results(most=1)
    make = lambda: made.append(1) or spark.range(3)
    for b in (1, 1, 2, 1):
        assert kept.get(Basis({"c": b}), "q", make).count() == 3
    assert len(made) == 3


def test_written_encodings(spark, tmp_path):
    import pyarrow.parquet as pq

    p = tmp_path / "t"
    I.write_sorted(spark.range(5000).selectExpr("id", "id * 1000 AS s", "cast(id % 7 as string) AS k"), str(p), ["s"], ["k"], delta=["s"])
    meta = pq.ParquetFile(next(p.glob("*.parquet"))).metadata.row_group(0)
    of = {meta.column(i).path_in_schema: meta.column(i).encodings for i in range(3)}
    assert "DELTA_BINARY_PACKED" in of["s"] and not any("DICTIONARY" in x for x in of["s"]) and any("DICTIONARY" in x for x in of["k"])
    assert meta.column(0).compression == "ZSTD" and spark.read.parquet(str(p)).agg(F.sum("s")).first()[0] == 12_497_500_000


def test_dangling_by_day(spark):
    rows = spark.createDataFrame([(1, 10, ["a", "b"]), (2, 13, ["a", "c"])], "id long, day long, refs array<string>")
    payloads = spark.createDataFrame([("a", 9), ("b", 12), ("c", 13)], "ref string, day long")
    assert sorted((r["id"], r["ref"]) for r in T.dangling(rows, payloads, "id", "refs", "day").collect()) == [(1, "b"), (2, "a")]
    assert T.dangling(rows, payloads.drop("day"), "id", "refs").count() == 0


def test_answers_say_if_they_are_at_their_basis(spark):
    df = _rows(spark, [1, 2, 3]).withColumn("cluster", F.lit("c0")).withColumn("namespace", F.lit("n"))
    s = Service(spark, {"logs": df}, {"c0": 2050}, 100)
    first = s.query([("c0", "*")], "SELECT count(*) AS n FROM logs", 0, 9000, expires=77)
    again = s.query([("c0", "*")], "SELECT count(*) AS n FROM logs", 0, 9000, basis=first.basis)
    assert (first.at_basis, again.at_basis, first.basis.expires) == (False, True, 77)
    assert first.rows.first()["n"] == 27 and again.rows.first()["n"] == 9
