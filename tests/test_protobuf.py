"""Requests in protobuf give the rows that the same requests give in JSON."""

import base64
import json
import random
import struct

import pytest

from skyquarry.sources import feeds, protobuf


def varint(x):
    x &= (1 << 64) - 1
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def encoded(name, value):
    """A message from its JSON: the inverse of the decoder, for tests."""
    out = b""
    block = lambda n, b: varint(n << 3 | 2) + varint(len(b)) + b
    for n, (field, kind) in protobuf.MESSAGES[name].items():
        if field not in value:
            continue
        v = value[field]
        if kind.rstrip("+") in protobuf.MESSAGES:
            for x in v if kind.endswith("+") else [v]:
                out += block(n, encoded(kind.rstrip("+"), x))
        elif kind in ("fixed64+", "double+"):
            out += block(n, b"".join(struct.pack("<Q", int(x)) if kind == "fixed64+" else struct.pack("<d", x) for x in v))
        elif kind == "varint+":
            out += block(n, b"".join(varint(int(x)) for x in v))
        elif kind in ("int", "flag", "long", "sint"):
            x = int(v)
            out += varint(n << 3) + varint((x << 1) ^ (x >> 63) if kind == "sint" else x)
        elif kind in ("fixed64", "sfixed64", "double"):
            out += varint(n << 3 | 1) + (struct.pack("<d", v) if kind == "double" else struct.pack("<Q" if kind == "fixed64" else "<q", int(v)))
        else:
            out += block(n, v.encode() if kind == "text" else bytes.fromhex(v) if kind == "hex" else base64.b64decode(v))
    return out


R = random.Random(2)
VALUES = [{"stringValue": "é"}, {"intValue": "-7"}, {"intValue": "9007199254740993"}, {"doubleValue": 2.0}, {"doubleValue": 0.25}, {"boolValue": True}, {"bytesValue": "AAH/"}, {"arrayValue": {"values": [{"stringValue": "a"}, {"intValue": "1"}]}}, {"kvlistValue": {"values": [{"key": "k", "value": {"boolValue": False}}]}}]
attrs = lambda n: [{"key": f"k{i}", "value": R.choice(VALUES)} for i in range(n)]
head = lambda name, inner: {"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "s"}}, *attrs(2)]}, name: [{"scope": {"name": "lib", "version": "1"}, **inner}, inner]}


def span(i):
    return {"traceId": f"{i:032x}", "spanId": f"{i:016x}", "parentSpanId": "00000000000000ff", "name": f"n{i}", "kind": i % 6, "startTimeUnixNano": str(1700000000000000001 + i), "endTimeUnixNano": str(1700000000000000011 + i), "attributes": attrs(3), "status": {"code": i % 3, "message": "m"}, "events": [{"timeUnixNano": "5", "name": "e", "attributes": attrs(1)}], "links": [{"traceId": "0a", "spanId": "0b"}]}


def metrics():
    point = {"attributes": attrs(2), "startTimeUnixNano": "1", "timeUnixNano": "1700000000000000000"}
    return [
        {"name": "g", "unit": "1", "gauge": {"dataPoints": [{**point, "asDouble": 1.5}, {**point, "asInt": "-3"}]}},
        {"name": "s", "sum": {"dataPoints": [{**point, "asInt": "4"}], "aggregationTemporality": 2, "isMonotonic": True}},
        {"name": "h", "histogram": {"dataPoints": [{**point, "count": "6", "sum": 3.5, "bucketCounts": ["1", "2", "3"], "explicitBounds": [0.5, 10.0]}], "aggregationTemporality": 1}},
        {"name": "e", "exponentialHistogram": {"dataPoints": [{"attributes": attrs(1), "timeUnixNano": "7", "count": "9", "sum": 2.5, "scale": -2, "zeroCount": "1", "positive": {"offset": -3, "bucketCounts": ["1", "300"]}, "negative": {"offset": 2, "bucketCounts": ["5"]}}], "aggregationTemporality": 1}},
        {"name": "q", "summary": {"dataPoints": [{"attributes": attrs(1), "timeUnixNano": "8", "count": "2", "sum": 2.0, "quantileValues": [{"quantile": 0.5, "value": 1.0}]}]}},
    ]


REQUESTS = {
    "traces": [{"resourceSpans": [head("scopeSpans", {"spans": [span(i), span(i + 1)]})]} for i in range(5)],
    "logs": [{"resourceLogs": [head("scopeLogs", {"logRecords": [{"timeUnixNano": "12", "traceId": "0a", "spanId": "0b", "severityNumber": 9, "severityText": "INFO", "body": v, "attributes": attrs(2)} for v in VALUES]})]}],
    "metrics": [{"resourceMetrics": [head("scopeMetrics", {"metrics": metrics()})]}],
}


def both(spark, kind):
    text = spark.createDataFrame([(json.dumps(x, separators=(",", ":"), ensure_ascii=False),) for x in REQUESTS[kind]], "value string")
    data = spark.createDataFrame([(encoded(kind, x),) for x in REQUESTS[kind]], "value binary")
    return text, data


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("kind, read", [("traces", feeds.otlp_spans), ("logs", feeds.otlp_logs)])
def test_like_json(spark, kind, read):
    text, data = both(spark, kind)
    assert rows(read(data)) == rows(read(text)) and read(data).count() == {"traces": 20, "logs": 18}[kind]


def test_metrics_like_json(spark):
    text, data = (feeds.otlp_metrics(x) for x in both(spark, "metrics"))
    assert len(text) == 5
    for kind, want in text.items():
        assert rows(data[kind]) == rows(want) and want.count() == (4 if kind == "gauge" else 2)


def test_files_once_and_as_a_stream(spark, tmp_path):
    for i, x in enumerate(REQUESTS["traces"]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.pb").write_bytes(encoded("traces", x))
    path = str(tmp_path / "in")
    want = rows(feeds.otlp_spans(both(spark, "traces")[0]))
    assert rows(feeds.otlp_spans(feeds.requests(spark, path))) == want
    for _ in range(2):  # the second run finds nothing new
        stream = feeds.otlp_spans(feeds.requests(spark, path, stream=True, files_a_batch=2))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)


def test_unknown_and_broken(spark):
    extra = encoded("traces", REQUESTS["traces"][0]) + protobuf_field(99, b"later") + bytes([0x98, 6, 5])
    assert feeds.otlp_spans(spark.createDataFrame([(extra,), (b"",), (None,)], "value binary")).count() == 4
    for bad in (b"\x0a\xff", b"\xff" * 12, b"\x0b"):
        with pytest.raises(protobuf.Malformed):
            protobuf.message("traces", bad)


def protobuf_field(n, b):
    return varint(n << 3 | 2) + varint(len(b)) + b


def test_written_requests(spark):
    """The library's writer against the plain one of this test, and bytes known from the format."""
    for kind, requests in REQUESTS.items():
        assert [protobuf.encoded(kind, x) for x in requests] == [encoded(kind, x) for x in requests]
    lines = spark.createDataFrame([(json.dumps(x),) for x in REQUESTS["traces"]], "value string")
    assert rows(feeds.otlp_spans(protobuf.requests_of(lines, "resourceSpans"))) == rows(feeds.otlp_spans(both(spark, "traces")[0]))
    assert protobuf.encoded("KeyValue", {"key": "a", "value": {"intValue": "300"}}) == bytes.fromhex("0a01611203" + "18ac02")
    assert protobuf.message("Value", b"") == {}


def test_rows_are_dealt_out(spark):
    """One file of one row group is not one task: requests are made, written and read in all of them."""
    from conftest import SF

    from skyquarry.plans import feeds as plans

    assert spark.read.parquet(f"{SF}/events.parquet").rdd.getNumPartitions() == 1
    assert plans.otlp_protobuf_rows(spark, SF).rdd.getNumPartitions() == 4


def test_wrong_wire_types_fail():
    for data in (b"\x08\x01", b"\x0d\x00\x00\x00\x00"):  # a number, and four bytes, where a message stands
        with pytest.raises(protobuf.Malformed):
            protobuf.message("logs", data)
