"""Sources beyond plain Parquet: OTLP JSON, entity lanes, nanosecond files, generated rows, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .protobuf import decoded

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,bytesValue:string,arrayValue:string,kvlistValue:string>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_RESOURCE = f"resource:struct<attributes:{_ATTRS}>"
_SCOPE = f"scope:struct<name:string,version:string,attributes:{_ATTRS}>"
SPAN_BATCH = f"""resourceSpans array<struct<{_RESOURCE},scopeSpans:array<struct<{_SCOPE},spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,
  startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRS},status:struct<code:int,message:string>,events:array<struct<timeUnixNano:string,name:string,attributes:{_ATTRS}>>,
  links:array<struct<traceId:string,spanId:string,traceState:string,attributes:{_ATTRS}>>>>>>>>"""
LOG_BATCH = f"""resourceLogs array<struct<{_RESOURCE},scopeLogs:array<struct<{_SCOPE},logRecords:array<struct<timeUnixNano:string,traceId:string,spanId:string,severityNumber:int,
  severityText:string,body:{_VALUE},attributes:{_ATTRS}>>>>>>"""
_NUMBER = f"dataPoints:array<struct<attributes:{_ATTRS},startTimeUnixNano:string,timeUnixNano:string,asDouble:double,asInt:string>>"
_HIST = f"dataPoints:array<struct<attributes:{_ATTRS},startTimeUnixNano:string,timeUnixNano:string,count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>>>,aggregationTemporality:int"
_EXP = f"dataPoints:array<struct<attributes:{_ATTRS},timeUnixNano:string,count:string,sum:double,scale:int,zeroCount:string,positive:struct<offset:int,bucketCounts:array<string>>,negative:struct<offset:int,bucketCounts:array<string>>>>,aggregationTemporality:int"
_SUMMARY = f"dataPoints:array<struct<attributes:{_ATTRS},timeUnixNano:string,count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>>>"
METRIC_BATCH = f"""resourceMetrics array<struct<{_RESOURCE},scopeMetrics:array<struct<{_SCOPE},metrics:array<struct<name:string,unit:string,gauge:struct<{_NUMBER}>,
  sum:struct<{_NUMBER},aggregationTemporality:int,isMonotonic:boolean>,histogram:struct<{_HIST}>,exponentialHistogram:struct<{_EXP}>,summary:struct<{_SUMMARY}>>>>>>>"""
#: Names of span kinds and of status codes, by number.
KINDS = ("Unspecified", "Internal", "Server", "Client", "Producer", "Consumer")
STATUS = ("Unset", "Ok", "Error")


def rendered(v: Column) -> Column:
    """An attribute's value as text: whole floats without a fraction, lists and maps as JSON, bytes as base64."""
    d = v["doubleValue"]
    number = F.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("long").cast("string")).otherwise(d.cast("string"))
    return F.coalesce(v["stringValue"], v["intValue"], number, v["boolValue"].cast("string"), v["bytesValue"], v["arrayValue"], v["kvlistValue"], F.lit(""))


def attributes(a: Column) -> Column:
    """key -> text; the last of repeated keys wins, null is no attribute."""
    kept = F.filter(F.coalesce(a, F.array().cast(_ATTRS)), lambda x, i: ~F.exists(F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["key"], rendered(x["value"]))))


def _walk(df: DataFrame, schema: str, outer: str, middle: str, inner: str) -> DataFrame:
    """One row for each innermost element, with its resource and scope. Requests are JSON texts (value), or protobuf (bytes)."""
    rows = decoded(df, outer, schema) if dict(df.dtypes)["value"] == "binary" else df.select(F.from_json("value", schema).alias("b"))
    rows = rows.select(F.explode(f"b.{outer}").alias("r"))
    rows = rows.select(attributes(F.col("r.resource.attributes")).alias("resource"), F.explode(f"r.{middle}").alias("s"))
    return rows.select("resource", F.coalesce("s.scope.name", F.lit("")).alias("scope"), F.explode(f"s.{inner}").alias("x"))


def otlp_spans(lines: DataFrame) -> DataFrame:
    """lines (value: an export request, as JSON or in bytes as protobuf) -> span rows; times stay whole nanoseconds."""
    rows = _walk(lines, SPAN_BATCH, "resourceSpans", "scopeSpans", "spans")
    start, end = F.col("x.startTimeUnixNano").cast("long"), F.col("x.endTimeUnixNano").cast("long")
    name = lambda of, i: F.coalesce(F.get(F.array(*map(F.lit, of)), i), F.lit(of[0]))
    event = lambda e: F.struct(e["timeUnixNano"].cast("long").alias("time"), e["name"].alias("name"), attributes(e["attributes"]).alias("attributes"))
    return rows.select(
        start.alias("time_ns"), F.coalesce("x.traceId", F.lit("")).alias("trace_id"), F.coalesce("x.spanId", F.lit("")).alias("span_id"), F.coalesce("x.parentSpanId", F.lit("")).alias("parent_id"), F.col("x.name").alias("name"),
        name(KINDS, F.coalesce("x.kind", F.lit(0))).alias("kind"), F.coalesce(F.try_element_at("resource", F.lit("service.name")), F.lit("")).alias("service"), "resource", "scope", attributes(F.col("x.attributes")).alias("attributes"),
        F.greatest(end - start, F.lit(0)).alias("duration_ns"), name(STATUS, F.coalesce("x.status.code", F.lit(0))).alias("status"), F.coalesce("x.status.message", F.lit("")).alias("message"),
        F.transform(F.coalesce("x.events", F.array()), event).alias("events"), F.transform(F.coalesce("x.links", F.array()), lambda e: F.struct(e["traceId"].alias("trace_id"), e["spanId"].alias("span_id"))).alias("links"),
    )


def otlp_logs(lines: DataFrame) -> DataFrame:
    rows = _walk(lines, LOG_BATCH, "resourceLogs", "scopeLogs", "logRecords")
    return rows.select(
        F.col("x.timeUnixNano").cast("long").alias("time_ns"), F.coalesce("x.traceId", F.lit("")).alias("trace_id"), F.coalesce("x.spanId", F.lit("")).alias("span_id"), F.coalesce("x.severityText", F.lit("")).alias("severity"),
        F.coalesce("x.severityNumber", F.lit(0)).alias("severity_number"), F.coalesce(F.try_element_at("resource", F.lit("service.name")), F.lit("")).alias("service"), rendered(F.col("x.body")).alias("body"), "resource", "scope", attributes(F.col("x.attributes")).alias("attributes"),
    )


def otlp_metrics(lines: DataFrame) -> dict[str, DataFrame]:
    """A DataFrame for each of the five kinds of metric."""
    rows = _walk(lines, METRIC_BATCH, "resourceMetrics", "scopeMetrics", "metrics")
    common = ["resource", "scope", F.col("x.name").alias("metric")]
    long = lambda c: F.col(c).cast("long")
    value = F.coalesce("p.asDouble", F.col("p.asInt").cast("double")).alias("value")
    out = {}
    for kind in ("gauge", "sum", "histogram", "exponentialHistogram", "summary"):
        extra = [F.col(f"x.{kind}.aggregationTemporality").alias("temporality")] if kind not in ("gauge", "summary") else []
        extra += [F.col("x.sum.isMonotonic").alias("monotonic")] if kind == "sum" else []
        p = rows.select(*common, *extra, F.explode(f"x.{kind}.dataPoints").alias("p"))
        names = [c for c in p.columns if c != "p"]
        longs = lambda c: F.transform(F.col(c), lambda v: v.cast("long"))
        own = {
            "gauge": [value], "sum": [value],
            "histogram": [long("p.count").alias("count"), F.col("p.sum").alias("sum"), longs("p.bucketCounts").alias("counts"), F.col("p.explicitBounds").alias("bounds")],
            "exponentialHistogram": [long("p.count").alias("count"), F.col("p.sum").alias("sum"), F.col("p.scale").alias("scale"), long("p.zeroCount").alias("zero"), F.col("p.positive.offset").alias("offset"), longs("p.positive.bucketCounts").alias("counts"), F.col("p.negative.offset").alias("negative_offset"), longs("p.negative.bucketCounts").alias("negative_counts")],
            "summary": [long("p.count").alias("count"), F.col("p.sum").alias("sum"), F.col("p.quantileValues").alias("quantiles")],
        }[kind]
        out[kind] = p.select(*names, attributes(F.col("p.attributes")).alias("attributes"), long("p.timeUnixNano").alias("time_ns"), *own)
    return out


def requests(spark: SparkSession, path: str, stream: bool = False, files_a_batch: int = 100) -> DataFrame:
    """(value, path) of a folder of export requests in protobuf, one a file: once, or as a stream that goes on where it was."""
    if stream:
        rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_a_batch).load(path)
    else:
        rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.col("content").alias("value"), "path")


def entity_lane(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of JSON (gzip by suffix) of an entity lane, with the file each came from."""
    schema = "lane string, n long, o long, kind string, entity string, version string, t long, until long, attrs map<string,string>"
    rows = spark.read.schema(schema).json(list(paths)).withColumn("_path", F.col("_metadata.file_path"))
    return rows.withColumn("o", F.coalesce("o", F.lit(0).cast("long")))


def nanosecond_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Files with nanosecond timestamps: these read as whole numbers."""
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    return spark.read.parquet(path)


def micros_of(ns: Column) -> Column:
    """A timestamp for display; comparisons stay in nanoseconds."""
    return F.timestamp_micros(F.floor(ns / 1000).cast("long"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, last_modified, rows, min_time, max_time) of Parquet files with a column s: one aggregate over one column."""
    m = F.col("_metadata")
    df = spark.read.parquet(path).select("s", m["file_path"].alias("path"), m["file_modification_time"].alias("last_modified"))
    return df.groupBy("path").agg(F.max("last_modified").alias("last_modified"), F.count("*").alias("rows"), F.min("s").alias("min_time"), F.max("s").alias("max_time"))


def generated(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    return spark.range(0, n, 1, partitions)


def expired(df: DataFrame, day: str, keep: int, today: int) -> DataFrame:
    """Days whose retention is over, to be dropped as partitions."""
    return df.select(day).distinct().filter(F.col(day) < today - keep)


