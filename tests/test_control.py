"""Completeness, plans, scopes, alerts: properties against brute force."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyquarry.functions.columns import empty_matches, fold, nice_step, prometheus_name, term_constraints
from skyquarry.operators import alerts as A
from skyquarry.operators import control as C
from skyquarry.operators import entities as E
from skyquarry.operators import scope as S

times = st.integers(0, 1000)


@given(times, st.integers(0, 200), times, times)
def test_label_is_sound(c, lateness, a, b):
    lo, hi = min(a, b), max(a, b) + 1
    x = C.label(c, lateness, lo, hi)
    # a row of the window that arrives at c or later while within the allowed lateness may be missing
    missing = any(t + lateness >= c for t in range(lo, hi))
    if x.state == "complete":
        assert not any(t + lateness >= c and t < hi and t + lateness > c + lateness for t in (hi - 1,)) and hi <= c - lateness
    else:
        assert x.state == "partial" and x.incomplete_from == max(c - lateness, lo) and missing


def test_label_edges():
    assert C.label(100, 10, 0, 90).state == "complete"
    assert C.label(100, 10, 0, 91).state == "partial"
    assert C.label(None, 10, 0, 5).state == "unknown"
    assert C.label(100, 10, 0, 5, ok=False).state == "unknown"
    assert C.incomplete_start(C.label(100, 10, 0, 95)) == 90
    assert C.incomplete_start(C.label(100, 10, 0, 90)) is None
    assert C.result_state(C.label(None, 1, 0, 5), missing_reads=True) == "incomplete"


def test_same_basis_same_answer(spark):
    rows = [(i, i, f"c{i % 2}") for i in range(100)]
    basis = C.mint({"c0": 60, "c1": 40}, {"c0", "c1"}, 0)
    first = spark.createDataFrame(rows, "s long, received long, cluster string")
    later = first.unionByName(spark.createDataFrame([(5, 70, "c0"), (6, 40, "c1")], first.schema))
    p = basis.predicate("received", "cluster")
    assert sorted(first.filter(p).collect()) == sorted(later.filter(p).collect())
    since = basis.predicate("received", "cluster", {"c0": 50, "c1": 30})
    assert first.filter(since).count() == sum(1 for _, r, c in rows if (50, 30)[c == "c1"] <= r < (60, 40)[c == "c1"])
    with pytest.raises(ValueError):
        basis.predicate(None, "cluster")


def test_basis_token():
    b = C.Basis({"c0": 10}, 5, ("logs",), 100)
    t = b.token(b"k")
    assert C.Basis.of(t, b"k", 1, {"c0": 10}).bounds == {"c0": 10}
    for args in ((b"other", 1, {"c0": 10}), (b"k", 100, {"c0": 10}), (b"k", 1, {"c0": 9})):
        with pytest.raises((ValueError, PermissionError)):
            C.Basis.of(t, *args)
    with pytest.raises(PermissionError):
        C.Basis.of(t, b"k", 1, {"c0": 10}, clusters={"c1"})
    with pytest.raises(ValueError):
        C.Basis.of(t, b"k", 1, {"c0": 10}, signal="traces")


def test_watermarks(spark):
    slots = spark.createDataFrame([("a", True, 10, 11), ("a", True, 20, 22), ("a", False, 30, 15), ("b", True, 5, 6), ("b", False, 9, None), ("c", False, 1, 2), ("d", True, 7, 7)], "lane string, passed boolean, low long, received long")
    got = {r["lane"]: r["watermark"] for r in C.lane_watermarks(slots, ["lane"]).collect()}
    assert got["a"] == 15 and got["b"] is None and got["d"] == 7
    seqs = spark.createDataFrame([("a", 0, True), ("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, True), ("c", 0, True)], "lane string, seq long, done boolean")
    assert {r["lane"]: r["position"] for r in C.checkpoints(seqs, ["lane"]).collect()} == {"a": 1, "b": -1, "c": 0}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(times, times, st.booleans()), min_size=1, max_size=20), times, times)
def test_plan_is_a_superset(spark, files, a, b):
    lo, hi = min(a, b), max(a, b) + 1
    rows = [(i, "data", "c0", None if u else min(x, y), None if u else max(x, y), None) for i, (x, y, u) in enumerate(files)]
    df = spark.createDataFrame(rows, "id long, kind string, cluster string, min_time long, max_time long, last_modified long")
    kept = {r["id"] for r in C.prune(df, lo, hi).collect()}
    assert kept == {i for i, (x, y, u) in enumerate(files) if u or any(lo <= t < hi for t in range(min(x, y), max(x, y) + 1))}


text = st.text(alphabet="abAB_1 .,-İKé", max_size=14)


@given(text, text, text)
def test_term_constraints_never_miss(before, query, after):
    body = before + query + after
    words = set(fold(body).split())
    ok = {"full": lambda r: r in words, "prefix": lambda r: any(w.startswith(r) for w in words), "suffix": lambda r: any(w.endswith(r) for w in words), "infix": lambda r: any(r in w for w in words)}
    assert all(ok[k](r) for k, r in term_constraints(query))


def test_small_functions():
    assert nice_step(0, 3600) == 60 and nice_step(0, 60) == 1 and nice_step(0, 10**9) == 86400
    assert prometheus_name("1http.server-x") == "_1http_server_x"
    assert empty_matches("!=", ["a"]) and not empty_matches("=", ["a"]) and empty_matches("like", ["%"]) and not empty_matches("not like", ["%"])
    assert A.template("{{value}} on {{labels.pod}}{{labels.no}}", 3.0, {"pod": "p1"}) == "3 on p1"


def test_grants():
    assert S.normalised([("a", "x"), ("a", "*"), ("b", "y"), ("b", "y")]) == [("a", "*"), ("b", "y")]
    assert S.narrowed([("*", "x"), ("b", "y")], {"b"}) == [("b", "x"), ("b", "y")]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab*"), st.sampled_from("xy*")), max_size=4))
def test_scope_predicate(spark, grants):
    rows = [(c, n) for c in "abc" for n in "xyz"]
    got = {tuple(r) for r in spark.createDataFrame(rows, "cluster string, namespace string").filter(S.predicate(grants)).collect()}
    assert got == {(c, n) for c, n in rows if any(a in ("*", c) and b in ("*", n) for a, b in grants)}


#: A CTE's name is only known where it is visible.
NO_CTE = [
    "SELECT x FROM secret WHERE 1 IN (WITH secret AS (SELECT 1 AS y) SELECT y FROM secret)", "SELECT * FROM (WITH secret AS (SELECT 1) SELECT * FROM secret), secret",
    "WITH a AS (WITH secret AS (SELECT 1 AS x) SELECT * FROM secret) SELECT * FROM a JOIN secret USING (x)", "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
    "(WITH secret AS (SELECT 1) SELECT * FROM secret) UNION ALL SELECT * FROM secret", "SELECT (WITH secret AS (SELECT 1 AS x) SELECT x FROM secret) FROM secret", "WITH a AS (SELECT 1) SELECT * FROM default.a",
]
NO_FUNCTION = [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM logs", "SELECT try_reflect('a', 'b') FROM logs", "SELECT `java_method`('a', 'b') FROM logs", "SELECT /* x */ java_method /* y */ ('a', 'b') FROM logs",
    "SELECT input_file_name() FROM logs", "SELECT s FROM logs ORDER BY raise_error('x')", "SELECT transform(array(1), x -> reflect('a', 'b')) FROM logs", "SELECT nosuch(1) FROM logs", "SELECT current_user() FROM logs", "SELECT system.builtin.max(s) FROM logs",
]


@pytest.mark.parametrize("sql", ["DROP TABLE logs", "SET a=b", "SELECT * FROM parquet.`/x`", "SELECT * FROM other", "SELECT 1; SELECT 2", "INSERT INTO logs SELECT 1", "SELECT * FROM range(10)", "WITH logs AS (SELECT 1) SELECT * FROM logs", "SELECT java_method('a','b')", "SELECT (SELECT max(x) FROM secret)", "SELECT 1 WHERE EXISTS (SELECT * FROM secret)", "x" * 70_000, "SHOW TABLES", "SELECT * FROM logs WHERE s IN (SELECT s FROM secret)", *NO_CTE, *NO_FUNCTION])
def test_refused_sql(spark, sql):
    with pytest.raises(S.Refused):
        S.check_sql(spark, sql, {"logs"})


def test_accepted_sql(spark):
    assert S.check_sql(spark, "WITH a AS (SELECT * FROM logs) SELECT * FROM a JOIN logs USING (s) WHERE s IN (SELECT s FROM logs) ORDER BY 1 LIMIT 3", {"logs"}).tables == {"logs"}


ACCEPTED = [
    "WITH a AS (SELECT * FROM logs), b AS (SELECT * FROM a) SELECT * FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.s = b.s)", "SELECT * FROM logs WHERE s IN (WITH x AS (SELECT max(s) AS m FROM logs) SELECT m FROM x)",
    "SELECT s, row_number() OVER (ORDER BY s) AS n, count(*) FILTER (WHERE s > 1) OVER () AS c FROM logs INTERSECT SELECT s, 1, 2 FROM logs EXCEPT SELECT 1, 2, 3",
    "SELECT explode(map('a', s)), upper('x'), date_trunc('day', timestamp_seconds(s)), from_json('{}', 'a INT'), md5('a'), percentile(s, 0.5) FROM logs GROUP BY s", "SELECT aggregate(array(1, 2), 0, (a, x) -> a + x), get_json_object('{}', '$.a') FROM logs",
]


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted_forms(spark, sql):
    assert S.check_sql(spark, sql, {"logs"}).tables == {"logs"}


def test_hidden_tables_stay_hidden(spark):
    """A table of the catalog is not reached, neither by a text that is checked nor by a session that would run it."""
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "cluster string, namespace string, v long")
    spark.range(3).selectExpr("id AS x").write.mode("overwrite").saveAsTable("secret")
    try:
        for sql in NO_CTE:
            with pytest.raises(S.Refused):
                S.scoped_sql(spark, sql, {"logs": df}, [("a", "*")])
        session = spark.newSession()
        S.scoped_sql(spark, "SELECT 1 AS x FROM logs", {"logs": df}, [("a", "*")])
        session.catalog.setCurrentDatabase(S.EMPTY)
        with pytest.raises(Exception, match="secret"):
            session.sql("SELECT * FROM secret").collect()
    finally:
        spark.sql("DROP TABLE secret")


def test_tables_without_scope_are_refused(spark):
    df = spark.createDataFrame([(1,)], "v long")
    with pytest.raises(S.Refused):
        S.scoped_sql(spark, "SELECT * FROM fleet", {"fleet": df}, [("a", "*")])
    assert S.scoped_sql(spark, "SELECT * FROM fleet", {"fleet": df}, [("*", "*")]).count() == 1


def test_scoped_session(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "cluster string, namespace string, v long")
    assert [r[0] for r in S.scoped_sql(spark, "SELECT v FROM logs", {"logs": df}, [("a", "*")]).collect()] == [1]
    assert "logs" not in {t.name for t in spark.catalog.listTables()}


@given(st.lists(st.booleans(), max_size=30), st.integers(0, 3))
def test_alert_machine_and_runs_agree(holds, hold):
    rule = A.Rule("r", 1, 1, ">", 0, hold)
    state, fired, resolved = A.State(1), [], 0
    for h in holds:
        state, notices = state.advance({"g"} if h else set(), rule)
        fired += [n for n in notices if n[0] == "firing"]
        resolved += sum(n[0] == "resolved" for n in notices)
    runs, start = [], None
    for i, h in enumerate([*holds, False], 1):
        if h and start is None:
            start = i
        if not h and start is not None:
            runs.append((start, i - 1))
            start = None
    assert [n[2] for n in fired] == [a for a, b in runs if b - a >= hold]
    assert resolved == sum(b - a >= hold and b < len(holds) for a, b in runs)


def test_alert_gate():
    r = A.Rule("r", 10, 10, ">", 0, service_late=5, rule_late=5)
    assert A.verdict(True, False, True, True, 110, 100, r) == "complete"
    assert A.verdict(True, False, True, True, 107, 100, r) == "partial"
    assert A.verdict(True, False, True, True, 104, 100, r) == "unknown"
    with pytest.raises(ValueError):
        A.Rule("r", 10, 20, ">", 0)
    assert A.State(10).due(100, r, 3).next_end == 80


claim = st.tuples(st.sampled_from([None, 0, 1]), st.sampled_from(["assert", "retract", "unknown"]), st.sampled_from(["controller", "overseer", "announce"]), st.integers(0, 8), st.integers(1, 6), st.integers(0, 8))


def _brute(claims, entity, vt, at, trust):
    here = [c for c in claims if c["entity"] in (None, entity) and c["valid_from"] <= vt < c["valid_to"] and c["system_from"] <= at]
    auth = [c for c in here if c["source"] != "announce"]
    said = [c for c in here if c["source"] == "announce" and c["kind"] == "assert"]
    top = max(auth, key=lambda c: (c["system_from"] + trust * (c["source"] == "controller"), c["source"] == "controller", c["seq"]), default=None)
    note = max(said, key=lambda c: (c["system_from"], c["seq"]), default=None)
    if top and top["kind"] == "assert":
        return "asserted", top["version"], False
    if top and top["kind"] == "retract":
        return "retracted", None, False
    if note:
        return "announced", note["version"], bool(top)
    return ("unknown" if top else "absent"), None, False


@settings(max_examples=6, deadline=None)
@given(st.lists(claim, min_size=1, max_size=12), st.integers(0, 9))
def test_bitemporal_ranges_equal_points(spark, raw, at):
    claims = [{"entity": e, "kind": k, "source": s, "seq": i, "version": f"v{i}", "valid_from": a, "valid_to": a + n, "system_from": y} for i, (e, k, s, a, n, y) in enumerate(raw)]
    schema = "entity long, kind string, source string, seq long, version string, valid_from long, valid_to long, system_from long"
    df = E.spread_all(spark.createDataFrame([tuple(c.values()) for c in claims], schema))
    names = {c["entity"] for c in claims} - {None}
    got = {}
    for r in E.intervals(df, at, 2).collect():
        for t in range(r["lo"], r["hi"]):
            assert (r["entity"], t) not in got  # disjoint
            got[r["entity"], t] = (r["status"], r["version"], r["uncertain"])
    for e in names:
        for t in range(16):
            want = _brute(claims, e, t, at, 2)
            assert got.get((e, t), ("absent", None, False)) == want, (e, t)


def test_index_never_misses(spark):
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(["Red fox", "redwood Tree", "a red-hot fox", "none", "KKelvin"])], "file long, text string")
    files = docs.select("file").withColumn("covered", F.col("file") != 3)
    index = C.term_index(docs.filter("file <> 3"), "text", most=0.9)
    for q in ("red", "Red fox", "fox", "wood t", "-", "kelvin", "d f"):
        kept = {r["file"] for r in C.files_with_text(files, index, q).collect()}
        assert {r["file"] for r in docs.filter(F.lower("text").contains(q.lower())).collect()} <= kept and 3 in kept
