"""Column functions with the conventions of telemetry data."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Readable steps in seconds.
STEPS = (1, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 21600, 43200, 86400)


def bucket(seconds: Column, step: int, origin: int = 0) -> Column:
    """Start of the step that holds a time; steps begin at origin."""
    return seconds - F.pmod(seconds - origin, F.lit(step))


def bucket_index(t: Column, lo: int, hi: int, step: int) -> Column:
    """Number of the step in [lo, hi), the last one cut at hi; -1 outside."""
    return F.when((t >= lo) & (t < hi), F.floor((t - lo) / step)).otherwise(-1).cast("long")


def nice_step(lo: int, hi: int, most: int = 60) -> int:
    """The smallest readable step that gives at most `most` whole buckets, in seconds; the largest if none does."""
    return next((s for s in STEPS if (hi - lo) // s <= most), STEPS[-1])


def map_get(m: Column | str, key: str) -> Column:
    """A missing key reads as an empty text, not as null."""
    return F.coalesce(F.try_element_at(F.col(m) if isinstance(m, str) else m, F.lit(key)), F.lit(""))


def items(m: Column | str) -> Column:
    """k=v texts of a map, sorted."""
    return F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])))


def canonical(m: Column | str) -> Column:
    """Text that equal maps share, whatever the order of their entries: entries sorted, as JSON."""
    return F.to_json(F.array_sort(F.map_entries(m)))


def content_id(m: Column | str) -> Column:
    """Identity of a map by content, empty values left out."""
    return F.md5(canonical(F.map_filter(m, lambda _, v: v != "")))


def overlay(base: Column, over: Column) -> Column:
    """Union of maps; the second wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def sum_for_each(values: Column, size: int) -> list[Column]:
    """Elementwise sums of arrays of a known size: aggregates, one an element."""
    return [F.sum(F.get(values, i)) for i in range(size)]


#: What may follow a number in a comparison of an alert rule.
COMPARE = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__", "!=": "__ne__"}


def compare(column: Column, op: str, value: float) -> Column:
    if op not in COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    return getattr(column, COMPARE[op])(value)


def fold(text: str) -> str:
    """ASCII letters, digits and _ lower-cased; every other character one space. U+0130 reads as i and a space, U+212A as k."""
    return re.sub(r"[^a-z0-9_]", " ", "".join({"\u0130": "i ", "\u212a": "k"}.get(c, c.lower() if c.isascii() else " ") for c in text))


def fold_col(text: Column) -> Column:
    # of other characters none is an ASCII one in lower case, so lower() does for all of Unicode
    plain = F.replace(F.replace(text, F.lit("\u0130"), F.lit("i ")), F.lit("\u212a"), F.lit("k"))
    return F.regexp_replace(F.lower(plain), "[^a-z0-9_]", " ")


def tokens_col(text: Column) -> Column:
    """Different words of the folded text."""
    return F.array_except(F.split(fold_col(text), " +"), F.array(F.lit("")))  # one pass by hash: no empty word, each word once


def has_tokens(text: Column, words: list[str]) -> Column:
    """Every word stands in the text as a whole word; the text is cut into words once."""
    return F.size(F.array_except(F.array(*map(F.lit, words)), tokens_col(text))) == 0


def term_constraints(query: str) -> list[tuple[str, str]]:
    """(kind, run): what words of a text must be like for it to hold the query as a substring.

    Inner runs are whole words (full). The first may continue one to the left (suffix) unless a separator precedes it, the
    last one to the right (prefix); a single open run may lie inside a word (infix). No run: nothing is known.
    """
    text = fold(query)
    runs = text.split()
    out = []
    for i, run in enumerate(runs):
        left, right = i == 0 and not text.startswith(" "), i == len(runs) - 1 and not text.endswith(" ")
        out.append(("infix" if left and right else "suffix" if left else "prefix" if right else "full", run))
    return out


def term_matches(term: Column, kind: str, run: str) -> Column:
    return {"full": term == run, "prefix": term.startswith(run), "suffix": term.endswith(run), "infix": term.contains(run)}[kind]


def empty_matches(op: str, values: list[str]) -> bool:
    """Whether an empty text, which a missing key reads as, satisfies `op values`."""
    like = lambda p: not p.strip("%")
    return {"=": "" in values, "in": "" in values, "!=": "" not in values, "not in": "" not in values, "like": like(values[0]), "ilike": like(values[0]), "not like": not like(values[0]), "not ilike": not like(values[0])}[op]


def matches(value: Column, op: str, values: list[str]) -> Column:
    positive = {"=": lambda: value.isin(values), "in": lambda: value.isin(values), "like": lambda: value.like(values[0]), "ilike": lambda: value.ilike(values[0])}
    if op in positive:
        return positive[op]()
    return ~positive[{"!=": "=", "not in": "in", "not like": "like", "not ilike": "ilike"}[op]]()


def prometheus_name(name: str) -> str:
    """Letters, digits, _ and : stay; anything else is _; a leading digit gets one before it."""
    name = re.sub(r"[^a-zA-Z0-9_:]", "_", name)
    return "_" + name if name[:1].isdigit() else name
