"""Payloads out of attributes: redacted, cut, split, and replaced by references, with markers that say so.

Row by row in column functions; only the payloads, each once for all rows that refer to it, go through a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .traces import fit_bytes, keyed_ref

#: Fixed value: what the keys of markers begin with.
MARKER = "otel.payload."


@dataclass(frozen=True)
class Policy:
    """keys: attributes that are always payloads; others are if longer than threshold bytes. redact: attributes that are emptied.
    split: attributes whose value, if a JSON array, gives a payload for each element. most: bytes that are kept of a value."""

    keys: Sequence[str] = ()
    redact: Sequence[str] = ()
    split: Sequence[str] = ()
    threshold: int = 2048
    most: int = 8 << 20
    elements: int = 4096


def _in(key: Column, names: Sequence[str]) -> Column:
    return key.isin(list(names)) if names else F.lit(False)


def _entry(key: Column, value: Column) -> Column:
    return F.named_struct(F.lit("key"), key, F.lit("value"), value)


def offload(rows: DataFrame, policy: Policy, tenant: Column, day: Column, secret: str, order: str, attributes: str = "attributes") -> tuple[DataFrame, DataFrame]:
    """rows with a map of attributes -> (rows, payloads).

    In the rows, a redacted value is empty and a payload's value is the JSON array of its references, "h:" and the keyed digest
    that equal contents of a tenant and day share; markers follow the attributes: bytes (kept), truncated_from, elements,
    redacted_from. payload_refs lists a row's different references in the order met. payloads: (ref, content, first_row), once
    for each reference, from the first row by `order` that has it. Markers that come in are dropped; null values stay.
    """
    key, value = lambda e: e["key"], lambda e: e["value"]
    size = lambda e: F.octet_length(value(e))
    hidden = lambda e: _in(key(e), policy.redact) & (size(e) > 0)
    away = lambda e: ~_in(key(e), policy.redact) & ((size(e) > policy.threshold) | (_in(key(e), policy.keys) & (size(e) > 0)))
    name = lambda e, what: F.concat(F.lit(MARKER), key(e), F.lit(f".{what}"))

    def taken(e: Column) -> Column:
        """(key, value, cut, parts, refs) of an entry; parts and refs are null for what stays."""
        cut = F.when(away(e), F.when(size(e) <= policy.most, value(e)).otherwise(fit_bytes(value(e), policy.most)))
        return F.named_struct(F.lit("key"), key(e), F.lit("value"), value(e), F.lit("hidden"), F.coalesce(hidden(e), F.lit(False)), F.lit("cut"), cut)

    entries = F.filter(F.map_entries(F.coalesce(attributes, F.create_map().cast("map<string,string>"))), lambda e: ~key(e).startswith(MARKER))
    df = rows.withColumns({"tenant_": tenant, "day_": day}).withColumn("e_", F.transform(entries, taken))
    array = lambda e: F.from_json(e["cut"], "array<string>")
    is_split = lambda e: _in(e["key"], policy.split) & e["cut"].startswith("[") & array(e).isNotNull() & (F.size(array(e)) <= policy.elements) & F.forall(array(e), lambda x: x.isNotNull())
    parts = lambda e: F.when(e["cut"].isNotNull(), F.when(F.coalesce(is_split(e), F.lit(False)), array(e)).otherwise(F.array(e["cut"])))
    df = df.withColumn("p_", F.transform("e_", lambda e: F.named_struct(F.lit("key"), e["key"], F.lit("value"), e["value"], F.lit("hidden"), e["hidden"], F.lit("cut"), e["cut"], F.lit("split"), F.coalesce(is_split(e), F.lit(False)), F.lit("parts"), parts(e))))
    ref = lambda x: keyed_ref(x, F.col("tenant_"), F.col("day_"), secret)
    df = df.withColumn("r_", F.transform("p_", lambda e: F.transform(e["parts"], ref)))
    both = F.arrays_zip(F.col("p_").alias("p"), F.col("r_").alias("r"))
    document = lambda refs: F.concat(F.lit("["), F.array_join(F.transform(refs, lambda r: F.concat(F.lit('"h:'), r, F.lit('"'))), ","), F.lit("]"))
    stored = F.transform(both, lambda x: _entry(x["p"]["key"], F.when(x["p"]["hidden"], F.lit("")).when(x["r"].isNotNull(), document(x["r"])).otherwise(x["p"]["value"])))

    def marks(e: Column) -> Column:
        bytes_ = F.octet_length(e["cut"])
        one = lambda when, what, n: F.when(when, _entry(name(e, what), n.cast("string")))
        return F.array_compact(F.array(
            one(e["hidden"], "redacted_from", F.octet_length(e["value"])), one(e["cut"].isNotNull(), "bytes", bytes_),
            one(bytes_ < F.octet_length(e["value"]), "truncated_from", F.octet_length(e["value"])), one(e["split"] & e["cut"].isNotNull(), "elements", F.size(e["parts"])),
        ))

    out = df.withColumns({attributes: F.map_from_entries(F.concat(stored, F.flatten(F.transform("p_", marks)))), "payload_refs": F.array_distinct(F.flatten(F.filter("r_", lambda r: r.isNotNull())))})
    found = df.select(F.col(order).alias("first_row"), F.explode(F.filter(both, lambda x: x["r"].isNotNull())).alias("x")).select("first_row", F.explode(F.arrays_zip(F.col("x.r").alias("ref"), F.col("x.p.parts").alias("content"))).alias("x"))
    payloads = found.select("first_row", "x.ref", "x.content").groupBy("ref").agg(F.min_by("content", "first_row").alias("content"), F.min("first_row").alias("first_row"))
    return out.drop("tenant_", "day_", "e_", "p_", "r_"), payloads
