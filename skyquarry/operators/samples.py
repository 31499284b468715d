"""Metric points of five kinds as samples of a time-series database: (name, labels, t, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_name(c: Column) -> Column:
    """Letters, digits, _ and : stay, anything else is _; a leading digit gets one before it."""
    c = F.regexp_replace(c, "[^a-zA-Z0-9_:]", "_")
    return F.when(c.rlike("^[0-9]"), F.concat(F.lit("_"), c)).otherwise(c)


def _one_by_one(entries: Column) -> Column:
    """Entries with clean names -> a map; of the same name twice the last counts. One at a time, for names that are odd."""
    named = F.transform(entries, lambda e: F.named_struct(F.lit("key"), clean_name(e["key"]), F.lit("value"), e["value"]))
    kept = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.array_sort(kept))


def labels_of(resource: Column, attributes: Column) -> Column:
    """Labels with clean names; of the same name twice, a point's attribute counts before its resource's, and of those the last.

    All names are cleaned as one text, a line each, which takes no expression for each entry. Where that gives other lines
    than names (none at all, or a line feed in a name), entries are taken one at a time.
    """
    keys, values = F.concat(F.map_keys(resource), F.map_keys(attributes)), F.concat(F.map_values(resource), F.map_values(attributes))
    text = F.regexp_replace(F.array_join(keys, "\n"), "[^a-zA-Z0-9_:\n]", "_")
    names = F.split(F.regexp_replace(text, "(^|\n)([0-9])", "$1_$2"), "\n", -1)
    entries = F.arrays_zip(names.alias("key"), values.alias("value"))
    # an entry stays if its name, from the end, is first met there
    bound = F.array(F.struct(F.reverse(names).alias("back"), entries.alias("entries")))
    last = F.get(F.transform(bound, lambda o: F.filter(o["entries"], lambda x, i: F.array_position(o["back"], x["key"]) + i == F.size(o["back"]))), 0)
    plain = F.when(F.size(F.array_distinct(names)) == F.size(names), entries).otherwise(last)
    one_by_one = _one_by_one(F.concat(F.map_entries(resource), F.map_entries(attributes)))
    return F.when(F.size(names) == F.size(keys), F.map_from_entries(F.sort_array(plain))).otherwise(one_by_one)


def number_text(x: Column) -> Column:
    """A bound as the shortest text: 0.5, 10, +Inf."""
    text = F.regexp_replace(x.cast("string"), r"\.0$", "")
    return F.when(x == float("inf"), "+Inf").otherwise(text)


def _sample(name: Column, value: Column, label: str | None = None, of: Column | None = None) -> Column:
    return F.named_struct(F.lit("name"), name, F.lit("label"), F.lit(label).cast("string"), F.lit("of"), (of if of is not None else F.lit(None)).cast("string"), F.lit("value"), value.cast("double"))


def _rows(points: DataFrame, samples: Column) -> DataFrame:
    """points with their labels (l_) -> a row for each sample; its own label replaces one of the same name."""
    rows = points.select(F.col("l_").alias("l"), F.floor(F.col("time_ns") / 1_000_000).cast("long").alias("t"), F.explode(samples).alias("s"))
    own, there = F.named_struct(F.lit("key"), F.col("s.label"), F.lit("value"), F.col("s.of")), F.map_entries("l")
    others = F.when(F.map_contains_key("l", F.col("s.label")), F.filter(there, lambda e: e["key"] != F.col("s.label"))).otherwise(there)
    labels = F.when(F.col("s.label").isNull(), F.col("l")).otherwise(F.map_from_entries(F.sort_array(F.array_append(others, own))))
    return rows.select("s.name", labels.alias("labels"), "t", "s.value")


def samples(metrics: dict[str, DataFrame]) -> DataFrame:
    """The five tables of sources.feeds.otlp_metrics() -> (name, labels, t in milliseconds, value).

    gauge: the value under its name; sum: the same, with _total if it only rises. histogram: _bucket for each bound (label
    le) with the count up to it, _sum and _count. exponentialHistogram: _count and _sum, added up over the points of a
    series in the order of their times, as those hold growth. summary: the value at each quantile (label quantile), _sum and _count.
    """
    name = clean_name(F.col("metric"))
    out = []
    for kind, rows in metrics.items():
        # once for a point, whatever follows
        rows = rows.withColumn("l_", labels_of(F.col("resource"), F.col("attributes"))).drop("resource", "attributes")
        total = [_sample(F.concat(name, F.lit("_sum")), F.col("sum")), _sample(F.concat(name, F.lit("_count")), F.col("count"))] if kind not in ("gauge", "sum") else []
        if kind == "gauge":
            each = F.array(_sample(name, F.col("value")))
        elif kind == "sum":
            each = F.array(_sample(F.when(F.col("monotonic"), F.concat(name, F.lit("_total"))).otherwise(name), F.col("value")))
        elif kind == "histogram":
            upto = lambda i: F.aggregate(F.slice("counts", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x)
            le = lambda i: number_text(F.coalesce(F.get("bounds", i), F.lit(float("inf"))))
            places = F.when(F.size("counts") > 0, F.sequence(F.lit(0), F.size("counts") - 1)).otherwise(F.array().cast("array<int>"))
            buckets = F.transform(places, lambda i: _sample(F.concat(name, F.lit("_bucket")), upto(i), "le", le(i)))
            each = F.concat(F.coalesce(buckets, F.array().cast(buckets_type())), F.array(*total))
        elif kind == "exponentialHistogram":
            w = Window.partitionBy("metric", "series_").orderBy("time_ns", "count", "sum").rowsBetween(Window.unboundedPreceding, 0)
            rows = rows.withColumn("series_", F.to_json("l_"))
            rows = rows.withColumns({"count": F.sum("count").over(w), "sum": F.sum("sum").over(w)})
            each = F.array(*total)
        else:
            at = F.transform(F.coalesce("quantiles", F.array().cast(rows.schema["quantiles"].dataType)), lambda x: _sample(name, x["value"], "quantile", number_text(x["quantile"])))
            each = F.concat(at, F.array(*total))
        out.append(_rows(rows, each))
    all_ = out[0]
    for more in out[1:]:
        all_ = all_.unionByName(more)
    return all_


def buckets_type() -> str:
    return "array<struct<name:string,label:string,of:string,value:double>>"
