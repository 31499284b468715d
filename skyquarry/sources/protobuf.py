"""Export requests of telemetry in protobuf, as the same nested columns that JSON requests give.

Each message is a table of its fields; a decoder walks the bytes of a request by these tables, in tasks, an Arrow batch at a
time. Unknown fields are passed over, and what is missing is null, as in JSON. A request that can't be read fails the query.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

# Fields of the messages by number, (name in JSON, kind). Kinds: a message's name, with + for a list of them; text, hex (bytes
# as hexadecimal digits), base64; int (a varint), flag, long (a varint as text), sint (zigzag); fixed64 (as text), double; and fixed64+,
# double+, varint+ for packed lists. A value's kinds say which of its fields is set.
MESSAGES: dict[str, dict[int, tuple[str, str]]] = {
    "traces": {1: ("resourceSpans", "ResourceSpans+")},
    "logs": {1: ("resourceLogs", "ResourceLogs+")},
    "metrics": {1: ("resourceMetrics", "ResourceMetrics+")},
    "ResourceSpans": {1: ("resource", "Resource"), 2: ("scopeSpans", "ScopeSpans+")},
    "ResourceLogs": {1: ("resource", "Resource"), 2: ("scopeLogs", "ScopeLogs+")},
    "ResourceMetrics": {1: ("resource", "Resource"), 2: ("scopeMetrics", "ScopeMetrics+")},
    "Resource": {1: ("attributes", "KeyValue+")},
    "ScopeSpans": {1: ("scope", "Scope"), 2: ("spans", "Span+")},
    "ScopeLogs": {1: ("scope", "Scope"), 2: ("logRecords", "LogRecord+")},
    "ScopeMetrics": {1: ("scope", "Scope"), 2: ("metrics", "Metric+")},
    "Scope": {1: ("name", "text"), 2: ("version", "text"), 3: ("attributes", "KeyValue+")},
    "KeyValue": {1: ("key", "text"), 2: ("value", "Value")},
    "Value": {1: ("stringValue", "text"), 2: ("boolValue", "flag"), 3: ("intValue", "long"), 4: ("doubleValue", "double"), 5: ("arrayValue", "Array"), 6: ("kvlistValue", "Map"), 7: ("bytesValue", "base64")},
    "Array": {1: ("values", "Value+")},
    "Map": {1: ("values", "KeyValue+")},
    "Span": {
        1: ("traceId", "hex"), 2: ("spanId", "hex"), 4: ("parentSpanId", "hex"), 5: ("name", "text"), 6: ("kind", "int"), 7: ("startTimeUnixNano", "fixed64"), 8: ("endTimeUnixNano", "fixed64"),
        9: ("attributes", "KeyValue+"), 11: ("events", "Event+"), 13: ("links", "Link+"), 15: ("status", "Status"),
    },
    "Event": {1: ("timeUnixNano", "fixed64"), 2: ("name", "text"), 3: ("attributes", "KeyValue+")},
    "Link": {1: ("traceId", "hex"), 2: ("spanId", "hex"), 3: ("traceState", "text"), 4: ("attributes", "KeyValue+")},
    "Status": {2: ("message", "text"), 3: ("code", "int")},
    "LogRecord": {1: ("timeUnixNano", "fixed64"), 2: ("severityNumber", "int"), 3: ("severityText", "text"), 5: ("body", "Value"), 6: ("attributes", "KeyValue+"), 9: ("traceId", "hex"), 10: ("spanId", "hex")},
    "Metric": {1: ("name", "text"), 3: ("unit", "text"), 5: ("gauge", "Gauge"), 7: ("sum", "Sum"), 9: ("histogram", "Histogram"), 10: ("exponentialHistogram", "Exponential"), 11: ("summary", "Summary")},
    "Gauge": {1: ("dataPoints", "Number+")},
    "Sum": {1: ("dataPoints", "Number+"), 2: ("aggregationTemporality", "int"), 3: ("isMonotonic", "flag")},
    "Histogram": {1: ("dataPoints", "HistogramPoint+"), 2: ("aggregationTemporality", "int")},
    "Exponential": {1: ("dataPoints", "ExponentialPoint+"), 2: ("aggregationTemporality", "int")},
    "Summary": {1: ("dataPoints", "SummaryPoint+")},
    "Number": {2: ("startTimeUnixNano", "fixed64"), 3: ("timeUnixNano", "fixed64"), 4: ("asDouble", "double"), 6: ("asInt", "sfixed64"), 7: ("attributes", "KeyValue+")},
    "HistogramPoint": {
        2: ("startTimeUnixNano", "fixed64"), 3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 6: ("bucketCounts", "fixed64+"), 7: ("explicitBounds", "double+"), 9: ("attributes", "KeyValue+"),
    },
    "ExponentialPoint": {
        1: ("attributes", "KeyValue+"), 3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 6: ("scale", "sint"), 7: ("zeroCount", "fixed64"), 8: ("positive", "Buckets"), 9: ("negative", "Buckets"),
    },
    "Buckets": {1: ("offset", "sint"), 2: ("bucketCounts", "varint+")},
    "SummaryPoint": {3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 6: ("quantileValues", "AtQuantile+"), 7: ("attributes", "KeyValue+")},
    "AtQuantile": {1: ("quantile", "double"), 2: ("value", "double")},
}
#: What a message's number in a request is by default, where JSON always has the field.
REQUEST = {"resourceSpans": "traces", "resourceLogs": "logs", "resourceMetrics": "metrics"}


class Malformed(ValueError):
    """Bytes that are no request."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Malformed("a number that does not end")
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field of a message: whole numbers, or bytes of fixed or stated length."""
    at = 0
    end = len(data)
    while at < end:
        key, at = (data[at], at + 1) if data[at] < 128 else _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = 8 if kind == 1 else 4 if kind == 5 else None
            if kind == 2:
                size, at = (data[at], at + 1) if at < end and data[at] < 128 else _varint(data, at)
            if size is None or at + size > end:
                raise Malformed(f"field {key >> 3} of type {kind}")
            value, at = data[at : at + size], at + size
        yield key >> 3, kind, value


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _packed(kind: str, wire: int, value) -> list:
    """A list's values, packed or one at a time."""
    if kind == "varint+":
        out, at = [value] if wire == 0 else [], 0
        while wire == 2 and at < len(value):
            x, at = _varint(value, at)
            out.append(x)
        return [str(x) for x in out]
    if len(value) % 8:
        raise Malformed("a list of eight bytes each")
    form = "Q" if kind == "fixed64+" else "d"
    out = struct.unpack(f"<{len(value) // 8}{form}", value)
    return [str(x) for x in out] if form == "Q" else list(out)


@cache
def _reader(name: str, texts: bool = False) -> Callable[[bytes], dict]:
    """What reads a message; a message's table is looked up once, not for each field. texts: lists and maps of a value become JSON."""
    table = {n: _field_reader(field, kind, texts and name == "Value" and kind in ("Array", "Map"), texts) for n, (field, kind) in MESSAGES[name].items()}

    def read(data: bytes) -> dict:
        out: dict = {}
        for number, wire, value in fields(data):
            known = table.get(number)
            if known is not None:
                known(out, wire, value)
        return {**_DEFAULTS[name], **out} if name in _DEFAULTS else out

    # a resource is the same in many requests
    return lru_cache(4096)(read) if name == "Resource" else read


def _field_reader(field: str, kind: str, as_text: bool, texts: bool) -> Callable[[dict, int, int | bytes], None]:
    many, one = kind.endswith("+"), kind.removesuffix("+")
    if one in MESSAGES:

        def put(out, wire, value):
            if wire != 2:
                raise Malformed(f"type {wire} for {kind}")
            x = _reader(one, texts and not as_text)(value)
            if many:
                out.setdefault(field, []).append(x)
            elif as_text:
                out[field] = json.dumps(x, separators=(",", ":"), ensure_ascii=False)
            else:
                out[field] = {**out[field], **x} if field in out else x

    elif many:

        def put(out, wire, value):
            out.setdefault(field, []).extend(_packed(kind, wire, value))

    elif kind == "text":

        def put(out, wire, value):
            out[field] = value.decode("utf-8", "replace") if wire == 2 else _scalar(kind, wire, value)

    else:

        def put(out, wire, value):
            out[field] = _scalar(kind, wire, value)

    return put


def message(name: str, data: bytes) -> dict:
    """A message as JSON would have it: numbers of 64 bits as text, ids as hexadecimal digits, bytes as base64."""
    return _reader(name)(data)


def _scalar(kind: str, wire: int, value):
    if (wire == 0) != (kind in ("int", "flag", "long", "sint")) or (wire == 1) != (kind in ("fixed64", "sfixed64", "double")):
        raise Malformed(f"type {wire} for {kind}")
    if kind == "text":
        return value.decode("utf-8", "replace")
    if kind == "hex":
        return value.hex()
    if kind == "base64":
        return base64.b64encode(value).decode()
    if kind == "flag":
        return bool(value)
    if kind == "int":
        return _signed(value)
    if kind == "long":
        return str(_signed(value))
    if kind == "sint":
        return (value >> 1) ^ -(value & 1)
    if kind == "double":
        return struct.unpack("<d", value)[0]
    return str(struct.unpack("<q" if kind == "sfixed64" else "<Q", value)[0])


#: Fields that protobuf leaves out where they are 0 or empty, and the value that JSON writes.
_DEFAULTS = {
    "KeyValue": {"key": ""}, "Number": {"timeUnixNano": "0"}, "HistogramPoint": {"timeUnixNano": "0", "count": "0"}, "ExponentialPoint": {"timeUnixNano": "0", "count": "0", "scale": 0, "zeroCount": "0"},
    "SummaryPoint": {"timeUnixNano": "0", "count": "0", "sum": 0.0}, "AtQuantile": {"quantile": 0.0, "value": 0.0}, "Span": {"startTimeUnixNano": "0", "endTimeUnixNano": "0", "name": ""}, "LogRecord": {"timeUnixNano": "0"}, "Metric": {"name": ""}, "Sum": {"isMonotonic": False},
    "Buckets": {"offset": 0}, "Event": {"timeUnixNano": "0", "name": ""},
}


@cache
def _writer(name: str) -> Callable[[dict], bytes]:
    """What writes a message, by its table. Packed lists, fields in the order of the table."""
    steps = [(field, _field_writer(n, kind)) for n, (field, kind) in MESSAGES[name].items()]

    def write(value: dict) -> bytes:
        get = value.get
        return b"".join([step(v) for field, step in steps if (v := get(field)) is not None])

    return write


def _field_writer(n: int, kind: str) -> Callable[..., bytes]:
    one, block, varint = kind.removesuffix("+"), _number(n << 3 | 2), _number(n << 3)
    sized = lambda b: block + _number(len(b)) + b
    if one in MESSAGES:
        if kind.endswith("+"):
            return lambda v: b"".join([sized(b) for b in map(_writer(one), v)])
        return lambda v: sized(_writer(one)(v))
    if kind.endswith("+"):
        each = {"varint": lambda x: _number(int(x)), "fixed64": lambda x: struct.pack("<Q", int(x)), "double": lambda x: struct.pack("<d", x)}[one]
        return lambda v: sized(b"".join(map(each, v)))
    if kind == "sint":
        return lambda v: varint + _number((int(v) << 1) ^ (int(v) >> 63))
    if kind in ("int", "flag", "long"):
        return lambda v: varint + _number(int(v))
    if kind in ("fixed64", "sfixed64", "double"):
        fixed, form = _number(n << 3 | 1), struct.Struct({"fixed64": "<Q", "sfixed64": "<q", "double": "<d"}[kind]).pack
        return (lambda v: fixed + form(v)) if kind == "double" else (lambda v: fixed + form(int(v)))
    raw = {"text": str.encode, "hex": bytes.fromhex, "base64": base64.b64decode}[kind]
    return lambda v: sized(raw(v))


def encoded(name: str, value: dict) -> bytes:
    """The bytes of a message from its JSON."""
    return _writer(name)(value)


def _number(x: int) -> bytes:
    if 0 <= x < 128:
        return _SMALL[x]
    x, out = x & 0xFFFFFFFFFFFFFFFF, b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


_SMALL = [bytes([i]) for i in range(128)]


def requests_of(lines: DataFrame, outer: str) -> DataFrame:
    """lines (value: requests in JSON) -> (value: the same in protobuf)."""

    def each(batches):
        for batch in batches:
            write = _writer(REQUEST[outer])
            out = [None if x is None else write(json.loads(x)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return lines.select("value").mapInArrow(each, "value binary")


def decoded(rows: DataFrame, outer: str, schema: str) -> DataFrame:
    """rows (value: bytes of a request) -> b, the request as a struct of the schema of its JSON."""
    kind: StructType = _parse_datatype_string(f"b struct<{schema.replace(' array', ':array', 1)}>")

    def each(batches):
        arrow = to_arrow_type(kind["b"].dataType)
        for batch in batches:
            read = _reader(REQUEST[outer], True)
            out = [None if x is None else read(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, arrow)], names=["b"])

    return rows.select("value").mapInArrow(each, kind)
