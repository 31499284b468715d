"""The query service: scope, basis, query, label, and the counts that go with an answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.control import NEVER, Basis, Label, label, late_rows, mint
from ..operators.logs import in_window
from ..operators.scope import Grant, check_sql, in_scope, narrowed, scoped_sql


@dataclass
class Answer:
    """at_basis: were the rows read at the basis? Else it is minted with them, for a later read that is to be repeatable."""

    rows: DataFrame
    label: Label
    basis: Basis | None
    late: dict[str, int]
    added: dict[str, int] | None
    at_basis: bool = False


class Service:
    """tables: name -> DataFrame with cluster, namespace, s (event time) and received.

    The watermark is read before the query runs, so a label never promises more than the rows could hold.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], complete_through: dict[str, int], max_lateness: int):
        self.spark, self.tables, self.complete, self.max_lateness = spark, tables, complete_through, max_lateness
        self.audit: list[tuple[str, str]] = []

    def query(self, grants: list[Grant], sql: str, lo: int, hi: int, clusters: set[str] | None = None, basis: Basis | None = None, since: Basis | None = None, sample: int | None = None, expires: int = NEVER) -> Answer:
        """since: count what was added between two bases. sample: read so many rows of each table, labelled as a sample."""
        grants = narrowed(grants, clusters) if clusters else grants
        scope = clusters or {c for c, _ in grants if c != "*"} or set(self.complete)
        views = {n: in_window(t, "s", lo, hi) for n, t in self.tables.items()}
        at_basis = basis is not None
        if basis:
            views = {n: v.filter(basis.predicate("received", "cluster")) for n, v in views.items()}
        elif scope <= set(self.complete):
            basis = mint(self.complete, scope, self.max_lateness, expires=expires)
        used = check_sql(self.spark, sql, set(self.tables)).tables
        # what the caller may see of the tables that the query reads; counts and samples are of nothing else
        views = {n: in_scope(v, grants, n) for n, v in views.items() if n.lower() in used}
        late = {n: late_rows(v, self.max_lateness).count() for n, v in views.items()}
        if sample:
            views = {n: v.limit(sample) for n, v in views.items()}
        self.audit.append(("run", sql))
        bounds = basis.bounds if basis else self.complete
        c = min((bounds[x] for x in scope if x in bounds), default=None) if scope <= set(bounds) else None
        rows = scoped_sql(self.spark, sql, views, grants)
        said = label(c, self.max_lateness, lo, hi)
        if sample:
            said = Label("sample", True, said.incomplete_from, lo, hi, said.settled)
        added = None
        if since and basis:
            between = basis.predicate("received", "cluster", since.bounds)
            added = {n: in_scope(in_window(t, "s", lo, hi), grants, n).filter(between).count() for n, t in self.tables.items() if n.lower() in used}
        return Answer(rows, said, basis, late, added, at_basis)


def window_of(spark: SparkSession, sql: str, time: str = "s") -> tuple[int, int] | None:
    """[lo, hi) of whole numbers from the conditions on `time`, if every SELECT over a table has the same; else None."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    found: list[tuple[int | None, int | None]] = []

    def conjuncts(e):
        if e.getClass().getSimpleName() == "And":
            return conjuncts(e.left()) + conjuncts(e.right())
        return [e]

    def bounds(filters):
        lo = hi = None
        for e in filters:
            kind = e.getClass().getSimpleName()
            if kind not in ("GreaterThanOrEqual", "GreaterThan", "LessThan", "LessThanOrEqual"):
                continue
            column, value = e.left().sql(), e.right().sql()
            if column.strip("`") != time or not value.rstrip("L").lstrip("-").isdigit():
                continue
            v = int(value.rstrip("L"))
            if kind.startswith("Greater"):
                lo = v + (kind == "GreaterThan") if lo is None else max(lo, v + (kind == "GreaterThan"))
            else:
                hi = v + (kind == "LessThanOrEqual") if hi is None else min(hi, v + (kind == "LessThanOrEqual"))
        return lo, hi

    def walk(p, filters, ctes):
        kind = p.getClass().getSimpleName()
        if kind == "UnresolvedRelation" and p.tableName().lower() not in ctes:
            found.append(bounds(filters))
        if kind == "Filter":
            filters = filters + conjuncts(p.condition())
        elif kind in ("Project", "Aggregate", "SubqueryAlias", "UnresolvedSubqueryColumnAliases") and filters and kind != "SubqueryAlias":
            filters = []
        if kind == "UnresolvedWith":
            it = p.cteRelations().iterator()
            while it.hasNext():
                x = it.next()
                ctes = ctes | {str(x._1()).lower()}
                walk(x._2(), [], ctes)
        for of in (p.children(), p.subqueries()):
            it = of.iterator()
            while it.hasNext():
                walk(it.next(), filters, ctes)

    walk(plan, [], set())
    ok = len(set(found)) == 1 and None not in found[0]
    return found[0] if ok else None


class Results:
    """Answers at a basis, kept by basis and query; what lies beyond a basis is never kept."""

    def __init__(self, most: int = 32):
        self.most, self.kept = most, {}

    def get(self, basis: Basis, sql: str, make) -> DataFrame:
        key = (tuple(sorted(basis.bounds.items())), sql)
        if key not in self.kept:
            while len(self.kept) >= self.most:
                self.kept.pop(next(iter(self.kept))).unpersist()
            self.kept[key] = make().persist()
        return self.kept[key]


def render(df: DataFrame, form: str, most: int = 100_000) -> str:
    """Result text; more than `most` rows are an error, never cut off."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    if form == "JSONEachRow":
        return "\n".join(rows)
    if form == "JSON":
        import json

        return json.dumps({"meta": [{"name": n, "type": t} for n, t in df.dtypes], "data": [json.loads(r) for r in rows], "rows": len(rows)})
    if form == "JSONCompact":
        import json

        return json.dumps({"meta": [{"name": n, "type": t} for n, t in df.dtypes], "data": [[json.loads(r).get(c) for c in df.columns] for r in rows], "rows": len(rows)})
    raise ValueError(f"unknown format {form!r}")


def system_tables(spark: SparkSession, allowed: dict[str, list[str]]) -> DataFrame:
    """Names and allowed columns of the catalog's tables."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() if t.name in allowed for c in spark.catalog.listColumns(t.name) if c.name in allowed[t.name]]
    return spark.createDataFrame(rows, "name string, column string, type string")


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """One row in n, by hash: the same rows each time."""
    return df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == 0)
