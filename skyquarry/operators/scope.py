"""Access scopes: grants as predicates, and SQL of users over scoped views only."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A pair (cluster, namespace); "*" stands for any.
Grant = tuple[str, str]
MOST_BYTES = 65_536
#: Groups of Spark's functions that a user's query may call. Others (misc_funcs among them, with java_method and reflect)
#: and functions that users registered reach beyond the rows of the views.
GROUPS = ("agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "operator_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "window_funcs")
#: A database without tables: names that are no view find nothing there.
EMPTY = "scope_without_tables"
#: What a user's text may be parsed to, by class: plans and expressions of a query without names that are computed later, parameters,
#: commands, table functions, scripts and versions of tables. Whatever is not here is refused.
PLANS = frozenset(
    """Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator
    Pivot Project RepartitionByExpression Sample Sort SubqueryAlias Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedWith Unpivot WithWindowDefinition""".split()
)
EXPRESSIONS = frozenset(
    """Add AggregateExpression Alias And AnyValue AttributeReference BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Coalesce Collate Concat
    CreateNamedStruct Cube CurrentRow$ Divide EqualNullSafe EqualTo Exists First GreaterThan GreaterThanOrEqual GroupingSets ILike In InSubquery
    IntegralDivide IsNotNull IsNull LambdaFunction Last LateralSubquery LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal Multiply
    MultiAlias Not NotLikeAll NotLikeAny Or Overlay PipeExpression RLike Remainder Rollup ScalarSubquery ShiftLeft ShiftRight ShiftRightUnsigned
    SortOrder SpecifiedWindowFrame StringLocate StringTrim StringTrimLeft StringTrimRight Substring Subtract TimestampAdd TimestampDiff UnaryMinus
    UnaryPositive UnboundedFollowing$ UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute UnresolvedCollation UnresolvedExtractValue
    UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedRegex UnresolvedStar
    UnresolvedStarExceptOrReplace UnresolvedSubqueryColumnAliases UnresolvedWindowExpression UnspecifiedFrame$ WindowExpression
    WindowSpecDefinition""".split()
)
#: Leaves of an analysed query outside the views: rows that the text itself holds, and its own CTEs.
OWN_LEAVES = frozenset(("OneRowRelation", "LocalRelation", "CTERelationRef"))
#: Parts of names of expressions that run code from outside Spark's list of functions.
FOREIGN = ("UDF", "UDAF", "Reflect", "Python")


def normalised(grants: list[Grant]) -> list[Grant]:
    """Without repeats and pairs that another covers."""
    out = set(grants)
    return sorted(g for g in out if not any(h != g and h[0] in ("*", g[0]) and h[1] in ("*", g[1]) for h in out))


def narrowed(grants: list[Grant], clusters: set[str]) -> list[Grant]:
    """The parts of grants that lie in the clusters."""
    return normalised([(c, n) for a, n in grants for c in (sorted(clusters) if a == "*" else [a] if a in clusters else [])])


def predicate(grants: list[Grant], cluster: str = "cluster", namespace: str = "namespace") -> Column:
    """Clusters with equal sets of namespaces share a term; never the product of all clusters and all namespaces."""
    by: dict[str, set[str]] = defaultdict(set)
    for c, n in normalised(grants):
        by[c].add(n)
    sets: dict[frozenset[str], list[str]] = defaultdict(list)
    for c, ns in by.items():
        sets[frozenset(ns)].append(c)
    out = F.lit(False)
    for ns, cs in sorted(sets.items(), key=lambda x: sorted(x[1])):
        one = F.lit(True) if "*" in cs else F.col(cluster).isin(sorted(cs))
        out = out | (one if "*" in ns else one & F.col(namespace).isin(sorted(ns)))
    return out


def unrestricted(grants: list[Grant]) -> bool:
    return ("*", "*") in grants


def in_catalog(facts: DataFrame, catalog: DataFrame, grants: list[Grant], key: str) -> DataFrame:
    """Facts without own cluster and namespace: those whose catalog row is in scope."""
    return facts.join(catalog.filter(predicate(grants)).select(key).distinct(), key, "left_semi")


class Refused(ValueError):
    pass


@dataclass
class Checked:
    tables: set[str]


def _each(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def check_sql(spark: SparkSession, text: str, tables: set[str]) -> Checked:
    """One query over the tables and its own CTEs; anything else is refused before it is analysed.

    Every plan and expression that the text is parsed to must be of a listed class. A table has a name of one part. A CTE's name
    stands for it where it is visible: in the CTEs after it and in the query that it belongs to, subqueries included, and
    nowhere outside. Functions are looked up in Spark's own list and must be of GROUPS.
    """
    if len(text.encode()) > MOST_BYTES:
        raise Refused("too long")
    if "\0" in text:
        raise Refused("NUL")
    state = spark._jsparkSession.sessionState()
    try:
        plan = state.sqlParser().parsePlan(text)
    except Exception as e:
        raise Refused(f"not one statement of SQL: {str(e).splitlines()[0][:200]}") from None
    known, used, functions = {t.lower() for t in tables}, set(), set()

    def calls(e):
        kind = e.getClass().getSimpleName()
        if kind not in EXPRESSIONS:
            raise Refused(f"not allowed: {kind}")
        if kind == "UnresolvedFunction":
            functions.add(tuple(_each(e.nameParts())))
        elif kind == "UnresolvedGenerator":
            functions.add((e.name().funcName(),) if e.name().database().isEmpty() else (e.name().unquotedString(), ""))
        for c in _each(e.children()):
            calls(c)

    def walk(p, visible: frozenset):
        kind = p.getClass().getSimpleName().removesuffix("$")
        if kind not in PLANS:
            raise Refused(f"not allowed: {kind}")
        if kind == "UnresolvedWith":
            for x in _each(p.cteRelations()):
                name = str(x._1()).lower()
                if name in known:
                    raise Refused(f"a CTE hides the table {name}")
                walk(x._2(), visible)
                visible |= {name}
        elif kind == "UnresolvedRelation":
            parts = [str(x).lower() for x in _each(p.multipartIdentifier())]
            if len(parts) != 1 or p.isStreaming():
                raise Refused(f"no such table: {'.'.join(parts)}")
            if parts[0] not in visible:
                if parts[0] not in known:
                    raise Refused(f"no such table: {parts[0]}")
                used.add(parts[0])
        for e in _each(p.expressions()):
            calls(e)
        for q in (*_each(p.children()), *_each(p.subqueries())):
            walk(q, visible)

    walk(plan, frozenset())
    for name in sorted(functions):
        if len(name) != 1 or not _allowed(spark, state, name[0]):
            raise Refused(f"function {'.'.join(name)} is not allowed")
    return Checked(used)


def prove(answer: DataFrame, views: dict[str, DataFrame]) -> None:
    """Refuse an analysed query if any leaf is outside the views given, or a view's plan is another than the one given.

    Names don't count here: a view in the analysed plan must read what its DataFrame reads.
    """
    plans = {name.lower(): df._jdf.queryExecution().analyzed() for name, df in views.items()}

    def calls(e):
        kind = e.getClass().getName()
        if not kind.startswith("org.apache.spark.sql.catalyst.") or any(x in kind.rpartition(".")[2] for x in FOREIGN):
            raise Refused(f"not allowed: {kind.rpartition('.')[2]}")
        for c in _each(e.children()):
            calls(c)

    def walk(p):
        kind = p.getClass().getSimpleName().removesuffix("$")
        if kind == "View":
            name = p.desc().identifier()
            plan = plans.get(name.table().lower()) if p.isTempView() and name.database().isEmpty() else None
            if plan is None or not p.child().sameResult(plan):
                raise Refused(f"not a view of this query: {name.unquotedString()}")
            return
        if p.children().isEmpty() and kind not in OWN_LEAVES:
            raise Refused(f"not in a view of this query: {kind}")
        for e in _each(p.expressions()):
            calls(e)
        for q in (*_each(p.children()), *_each(p.subqueries())):
            walk(q)

    walk(answer._jdf.queryExecution().analyzed())


def _allowed(spark: SparkSession, state, name: str) -> bool:
    try:
        known = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name.lower())
        if not state.functionRegistry().functionExists(known):
            return False
        info = state.functionRegistry().lookupFunction(known).get()
    except Exception:
        return False
    return info.getSource() == "built-in" and info.getGroup() in GROUPS


def in_scope(df: DataFrame, grants: list[Grant], name: str = "") -> DataFrame:
    """The rows that the grants cover. A table without cluster and namespace is refused but to those who may see all."""
    if {"cluster", "namespace"} <= set(df.columns):
        return df.filter(predicate(grants))
    if unrestricted(grants):
        return df
    raise Refused(f"table {name} holds rows of all scopes and has no column for them")


def scoped_sql(spark: SparkSession, text: str, views: dict[str, DataFrame], grants: list[Grant]) -> DataFrame:
    """Run a user's query in a session of its own that has just the views it names, filtered by the grants.

    The filter is part of the view, so it is pushed down to the files whatever the text says. The text is checked as it is
    parsed, and the query again as Spark has analysed it: all that it reads must lie in these views. The session's database
    is empty as well, so that a plain name finds nothing else.
    """
    used = check_sql(spark, text, set(views)).tables
    scoped = {name: in_scope(df, grants, name) for name, df in views.items() if name.lower() in used}
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    session.sql(f"CREATE DATABASE IF NOT EXISTS {EMPTY}")
    session.catalog.setCurrentDatabase(EMPTY)
    for name, df in scoped.items():
        _register(session, df, name)
    answer = session.sql(text)
    prove(answer, scoped)
    return answer


def _register(session: SparkSession, df: DataFrame, name: str) -> None:
    """The same plan as a temporary view of another session."""
    jvm = session._jvm
    other = jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.logicalPlan())
    other.createOrReplaceTempView(name)
