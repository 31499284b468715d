"""The streamed alert machine says what the batch query says."""

import random

from pyspark.sql import functions as F

from skyquarry.operators import control as C
from skyquarry.operators.alerts import Rule, episodes, evaluate
from skyquarry.streaming.stateful import lane_progress, notices

RULE = Rule("r", 20, 10, ">", 1, hold=10)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(g, t) for g in ("a", "b", None) for t in range(1000, 1600) if rng.random() < (0.12 if t % 200 < 100 else 0.01)]
    src = str(tmp_path / "in")
    for i in range(0, 700, 100):  # rows of a hundred seconds a file
        part = [(g, t) for g, t in rows if 1000 + i <= t < 1100 + i]
        spark.createDataFrame(part + [("end", 1000 + i + 99)], "g string, t long").coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("end", 5000)], "g string, t long").coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("end", 5001)], "g string, t long").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("g string, t long").option("maxFilesPerTrigger", 1).parquet(src)
    got = notices(stream.withColumn("at", F.timestamp_seconds("t")), RULE, "g", "at", "10 seconds")
    q = got.writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    said = spark.table("alerts").filter("group <> 'end' or group is null").collect()
    df = spark.createDataFrame(rows, "g string, t long")
    runs = [r for r in episodes(evaluate(df, RULE, "t", ["g"]), RULE, ["g"]).collect() if r["fired_at"] is not None]
    assert runs
    assert sorted((str(r["group"]), r["since"], r["at"]) for r in said if r["kind"] == "firing") == sorted((str(r["g"]), r["since"], r["fired_at"]) for r in runs)
    assert sorted((str(r["group"]), r["since"]) for r in said if r["kind"] == "resolved") == sorted((str(r["g"]), r["since"]) for r in runs)


def test_lane_progress_is_that_of_the_batch_functions(spark, tmp_path):
    """Slots in any order, again and again, some of them first seen before they are passed; with gaps and unknown receive times."""
    r = random.Random(11)
    slots = {(lane, seq): (r.random() < 0.8, seq * 10 + r.randint(0, 30), None if lane == "c" and seq == 7 else seq * 10 + 5) for lane in "abc" for seq in range(25) if not (lane == "b" and seq == 9)}
    slots["c", 7] = (False, 75, None)
    news = [(*k, passed, low, received) for k, (passed, low, received) in slots.items()]
    news += [(lane, seq, False, low, received) for lane, seq, passed, low, received in r.sample(news, 40)] + r.sample(news, 30)
    r.shuffle(news)
    schema = "lane string, seq long, passed boolean, low long, received long"
    for i in range(0, len(news), 15):
        spark.createDataFrame(news[i : i + 15], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    lane_progress(stream, ["lane"]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    rows = sorted((tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select("lane", "version", "position", "watermark", "complete", "open").collect()), key=lambda x: x[:2])
    last = {x[0]: x for x in rows}
    final = spark.createDataFrame([(*k, *v) for k, v in slots.items()], schema)
    marks = {x["lane"]: x["watermark"] for x in C.lane_watermarks(final, ["lane"]).collect()}
    places = {x["lane"]: x["position"] for x in C.checkpoints(final.withColumn("done", F.col("passed")), ["lane"]).collect()}
    assert len(rows) > 10 and {k: (v[2], v[3]) for k, v in last.items()} == {k: (places[k], marks[k]) for k in "abc"}
    for lane in "abc":
        seen = [x[4] for x in rows if x[0] == lane and x[4] is not None]
        assert seen == sorted(seen) and last[lane][5] == sum(not p for (x, _), (p, _, _) in slots.items() if x == lane)
