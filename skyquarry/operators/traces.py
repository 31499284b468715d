"""Traces and model calls: hierarchies, lists, costs, scores, payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import join_as_of
from .logs import latest_by
from .work import written


def time_ranges(spans: DataFrame) -> DataFrame:
    """First and last start of each trace with an id."""
    return spans.filter("trace_id <> ''").groupBy("trace_id").agg(F.min("start").alias("first"), F.max("start").alias("last"), F.count("*").alias("n"))


def parent_child(spans: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Each span with a parent, beside the parent; spans whose parent is missing keep nulls.

    parents: the spans that can be parents, where that is known (roots of two-level traces, server spans), so that the
    others are not sent through the join once more.
    """
    up = (spans if parents is None else parents).select("trace_id", F.col("span_id").alias("parent_id"), F.col("name").alias("parent_name"), F.col("start").alias("parent_start"), F.col("status").alias("parent_status"))
    return spans.filter("parent_id <> ''").join(up, ["trace_id", "parent_id"], "left")


def depths(spans: DataFrame) -> DataFrame:
    """Spans with their depth under the root; null for those that lead to no root (a lost parent, or a ring).

    By pointer doubling: each span points to an ancestor, and in each round to that one's, so a trace of depth d takes log2(d)
    joins, each on (trace, span) and of a written table. Spans that still point on when pointers span the largest trace are in
    a ring or below one. A span id that a trace holds more than once counts once, with its smallest parent.
    """
    up = spans.groupBy("trace_id", "span_id").agg(F.min("parent_id").alias("up"))
    # up: the ancestor `depth` levels above; null once that is a root
    far = up.select("trace_id", "span_id", F.when(F.col("up") != "", F.col("up")).alias("up"), F.when(F.col("up") != "", 1).otherwise(0).alias("depth"))
    far = written(far, "span-pointers")
    first, most, reach = far, 1, 1
    # what has reached its root is in the round that it did; only pointers that go on are joined and written again
    done, going = [far.filter("up is null")], far.filter("up is not null")
    while reach <= most and not going.isEmpty():
        there = reduce(DataFrame.unionByName, [*done, going]).select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2_"), F.col("depth").alias("depth2_"))
        # an inner join: what points to a span that is not there goes
        far = written(going.join(there, ["trace_id", "up"]).select("trace_id", "span_id", F.col("up2_").alias("up"), (F.col("depth") + F.col("depth2_")).alias("depth")), "span-pointers")
        done, going, reach = [*done, far.filter("up is null")], far.filter("up is not null"), reach * 2
        if reach == 2 and not going.isEmpty():  # only if one round is not enough for all
            most = first.groupBy("trace_id").count().agg(F.max("count")).first()[0]
    return spans.join(reduce(DataFrame.unionByName, done).select("trace_id", "span_id", "depth"), ["trace_id", "span_id"], "left")


def waterfall(spans: DataFrame, logs: DataFrame, trace_id: str) -> DataFrame:
    """Spans and logs of a trace as one list."""
    a = spans.filter(F.col("trace_id") == trace_id).select(F.lit("span").alias("kind"), "start", "span_id", F.col("name").alias("body"), "service")
    b = logs.filter(F.col("trace_id") == trace_id).select(F.lit("log").alias("kind"), "start", "span_id", "body", "service")
    return a.unionByName(b)


def price_as_of(rows: DataFrame, prices: DataFrame, keys: list[str], start: str, basis: int, order: list[str], span: tuple[int, int] | None = None) -> DataFrame:
    """rows with the price last valid at their start and recorded before the basis; null if there is none.

    Prices become validity intervals by one window over the small side; join_as_of() then compares a row with those of its
    slice of `span` only.
    """
    known = prices.filter(F.col("system_from") < basis)
    one = latest_by(known, [*keys, "valid_from"], *[F.desc(c) for c in order])
    w = Window.partitionBy(*keys).orderBy("valid_from")
    versions = one.select(*keys, "valid_from", F.lead("valid_from").over(w).alias("valid_to"), "price")
    return join_as_of(rows, versions, keys, start, span=span).drop("valid_from", "valid_to")


def resolve_scores(facts: DataFrame, basis: int) -> DataFrame:
    """The last fact of each score received before the basis; a retraction hides the score."""
    last = F.max_by(F.struct("trace_id", "name", "value", "kind"), F.struct("received", "ordinal")).alias("f")
    return facts.filter(F.col("received") < basis).groupBy("score_id").agg(last).filter("f.kind = 'assert'").select("score_id", "f.trace_id", "f.name", "f.value")


def trace_list(spans: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """The newest n traces with duration, tokens, cost and mean score. Scores are joined to n traces only."""
    tr = spans.groupBy("trace_id").agg(F.min("start").alias("ts"), (F.max(F.col("start") + F.col("duration")) - F.min("start")).alias("latency"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))
    tr = tr.orderBy(F.desc("ts"), "trace_id").limit(n)
    return tr.join(scores.groupBy("trace_id").agg(F.round(F.avg("value"), 6).alias("score")), "trace_id", "left")


def score_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("name", F.floor(F.round(F.col("value") * 10, 6)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def offload(rows: DataFrame, column: str, most: int, ref: str = "ref") -> tuple[DataFrame, DataFrame]:
    """Texts longer than `most` bytes become references to payloads: (rows, payloads with one row for each content)."""
    big = F.octet_length(column) > most
    h = F.md5(column)
    payloads = rows.filter(big).select(h.alias(ref), F.col(column).alias("content")).dropDuplicates([ref])
    return rows.withColumn(ref, F.when(big, h)).withColumn(column, F.when(~big, F.col(column))), payloads


def offload_parts(rows: DataFrame, column: str, ref: str = "refs") -> tuple[DataFrame, DataFrame]:
    """The elements of a JSON array become payloads, and the column an array of references in their order.

    Texts that are no JSON array are left as they are, with null references.
    """
    parts = F.from_json(column, "array<string>")
    ok = F.col(column).startswith("[") & parts.isNotNull()
    out = rows.withColumn(ref, F.when(ok, F.transform(parts, F.md5)))
    payloads = rows.filter(ok).select(F.explode(parts).alias("content")).select(F.md5("content").alias("ref"), "content").dropDuplicates(["ref"])
    return out.withColumn(column, F.when(~ok | ok.isNull(), F.col(column))), payloads


def resolve(rows: DataFrame, payloads: DataFrame, key: str, refs: str) -> DataFrame:
    """(key, content): the contents of an array of references, joined in order; missing ones are left out."""
    one = rows.select(key, F.posexplode(refs).alias("pos", "ref")).join(payloads.dropDuplicates(["ref"]), "ref", "left")
    return one.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), ",").alias("content"))


def dangling(rows: DataFrame, payloads: DataFrame, key: str, refs: str, day: str | None = None) -> DataFrame:
    """References without a payload; day: without one of their day, the day before or the day after."""
    if day is None:
        return rows.select(key, F.explode(refs).alias("ref")).join(payloads, "ref", "left_anti")
    near = payloads.select("ref", F.explode(F.array(F.col(day) - 1, F.col(day), F.col(day) + 1)).alias(day)).distinct()
    return rows.select(key, day, F.explode(refs).alias("ref")).join(near, ["ref", day], "left_anti")


def spans_holding(rows: DataFrame, payloads: DataFrame, key: str, refs: str, wanted: Column) -> DataFrame:
    """Rows, by their key, with a reference to a payload that satisfies a condition: an array-overlap join, as semi joins."""
    hits = payloads.filter(wanted).select("ref").distinct()
    keys = rows.select(key, F.explode(refs).alias("ref")).join(hits, "ref", "left_semi").select(key).distinct()
    return rows.join(keys, key, "left_semi")


def map_llm(spans: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Typed columns of model calls from a map of attributes; the first that is not empty counts."""
    from ..functions.columns import map_get

    first = lambda *keys: F.coalesce(*(F.nullif(map_get(attributes, k), F.lit("")) for k in keys))
    number = lambda *keys: F.coalesce(F.expr("1").cast("long") * first(*keys).try_cast("long"), F.lit(0).cast("long"))
    return spans.filter(F.exists(F.map_keys(attributes), lambda k: k.startswith("gen_ai."))).select(
        "trace_id", "span_id", first("gen_ai.operation.name").alias("operation"), first("gen_ai.response.model", "gen_ai.request.model").alias("model"),
        number("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens").alias("input_tokens"), number("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens").alias("output_tokens"),
        F.when(first("gen_ai.operation.name").isin("chat", "text_completion", "generate_content"), "GENERATION").when(first("gen_ai.operation.name") == "execute_tool", "TOOL").otherwise("SPAN").alias("type"),
    )


def prepared_payload(text: Column, patterns: list[str], most: int = 8 << 20) -> Column:
    """What is stored of a payload: secrets by pattern redacted first, then cut at `most` bytes, never inside a character."""
    out = text
    for p in patterns:
        out = F.regexp_replace(out, p, "[redacted]")
    return F.when(F.octet_length(out) <= most, out).otherwise(fit_bytes(out, most))


def fit_bytes(text: Column, most: int) -> Column:
    """The longest beginning of at most `most` bytes.

    A character has four bytes at most, so a step may drop a quarter of the bytes too many, in characters, and never drops
    one too many; a step leaves three quarters of the excess at most, so 80 steps are enough for any text.
    """
    steps = F.sequence(F.lit(0), F.lit(80))
    return F.aggregate(steps, text, lambda t, _: F.when(F.octet_length(t) <= most, t).otherwise(F.left(t, (F.length(t) - F.ceil((F.octet_length(t) - most) / 4)).cast("int"))))


def keyed_ref(content: Column, tenant: Column, day: Column, secret: str) -> Column:
    """Reference to a payload that only holders of the secret can make: equal contents of a tenant and day share it, and
    nobody else can test a guess of a content. SHA-256 under a key of the tenant and day, twice, so that none is extended."""
    hashed = lambda *parts: F.unhex(F.sha2(F.concat(*parts), 256))
    named = F.concat_ws("\x1f", tenant, day.cast("string")).cast("binary")
    master = F.lit(secret).cast("binary")
    key = hashed(master, hashed(master, named))
    return F.lower(F.hex(hashed(key, hashed(key, content.cast("binary")))))


def score_means(scores: DataFrame, spans: DataFrame) -> DataFrame:
    """(model, name, n, mean): scores by the models of their traces; a trace's model counts once.

    Values are added as decimals, so a mean that lies between two roundings doesn't depend on the order of rows. Where a
    value is beyond decimals (1e16, or no number), its group has the mean of doubles.
    """
    models = spans.select("trace_id", "model").distinct()
    exact = F.col("value").try_cast("decimal(28,12)")
    whole = F.count("value") == F.count(exact)
    mean = F.when(whole, F.try_divide(F.sum(exact), F.count(exact)).cast("decimal(38,12)")).alias("exact")
    means = scores.join(models, "trace_id").groupBy("model", "name").agg(F.count("*").alias("n"), mean, F.avg("value").alias("mean"))
    return means.select("model", "name", "n", F.coalesce(F.round("exact", 6).cast("double"), F.round("mean", 6)).alias("mean"))
