"""The wall around a user's SQL: what the text is parsed to, and what the analysed query reads."""

import pytest

from skyquarry.operators import scope as S

SCHEMA = "cluster string, namespace string, v long, xs array<long>"

#: Each reached a hidden table, or ran code of the JVM, before plans and expressions were listed.
ESCAPES = [
    "SELECT * FROM IDENTIFIER('default.' || 'secret')",
    "SELECT x FROM (SELECT * FROM IDENTIFIER('default.secret'))",
    "SELECT v FROM logs UNION ALL SELECT x FROM IDENTIFIER('default.secret')",
    "WITH a AS (SELECT * FROM logs) SELECT a.v FROM a, IDENTIFIER('default.' || 'secret') s",
    "WITH a AS (SELECT * FROM IDENTIFIER('default.secret')) SELECT * FROM a",
    "SELECT v FROM logs WHERE v IN (SELECT x FROM IDENTIFIER('default.secret'))",
    "EXECUTE IMMEDIATE 'SELECT * FROM default.secret'",
    "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'java.version')",
    "SELECT v FROM logs WHERE IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'java.version') IS NULL",
    "SELECT transform(xs, x -> IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'a')) FROM logs",
    "WITH `default.secret` AS (SELECT 1 AS x) SELECT * FROM default.secret",
    "SELECT * FROM default.secret", "SELECT * FROM spark_catalog.default.secret", "SELECT * FROM secret", "SELECT * FROM global_temp.hidden", "TABLE secret", "FROM secret |> SELECT x", "FROM logs |> JOIN secret ON v = x",
    "SELECT :p FROM logs", "SELECT * FROM logs TIMESTAMP AS OF '2024-01-01'", "SELECT TRANSFORM(v) USING 'cat' FROM logs", "SELECT * FROM explode(array(1))", "SELECT * FROM logs LATERAL VIEW stack_of_user(1) t AS a",
    "BEGIN SELECT 1; END", "DECLARE x INT", "EXPLAIN SELECT 1", "SELECT * FROM STREAM logs", "SELECT reflect('java.lang.System', 'getProperty', 'a')", "SELECT try_reflect('java.lang.System', 'getProperty', 'a')", "SELECT input_file_name() FROM logs",
    "SELECT system.builtin.java_method('java.lang.System', 'getProperty', 'a')", "SELECT * FROM sql_keywords()", "SELECT raise_error('x') FROM logs",
]

LEGAL = [
    ("SELECT v FROM logs ORDER BY v", [1, 2]),
    ("SELECT v FROM LOGS ORDER BY v", [1, 2]),
    ("WITH big AS (SELECT * FROM logs WHERE v > 1), b2(y) AS (SELECT v FROM big) SELECT y FROM b2", [2]),
    ("SELECT a.v + b.v FROM logs a JOIN logs b ON a.v = b.v ORDER BY 1", [2, 4]),
    ("SELECT count(*) FROM logs a, LATERAL (SELECT v FROM logs WHERE v = a.v)", [2]),
    ("SELECT sum(v) OVER (PARTITION BY cluster ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM logs ORDER BY s", [1, 3]),
    ("SELECT sum(v) OVER w AS s FROM logs WINDOW w AS (ORDER BY v RANGE BETWEEN 1 PRECEDING AND UNBOUNDED FOLLOWING) ORDER BY s", [3, 3]),
    ("SELECT v FROM logs UNION ALL SELECT v FROM logs EXCEPT (SELECT 1L INTERSECT SELECT v FROM logs)", [2]),
    ("SELECT count(*) FROM logs WHERE v IN (SELECT max(v) FROM logs) AND EXISTS (SELECT 1 FROM logs x WHERE x.v = logs.v) AND v > (SELECT avg(v) FROM logs)", [1]),
    ("SELECT aggregate(transform(filter(xs, (x, i) -> x > i), x -> x + 1), 0L, (a, x) -> a + x) AS n FROM logs ORDER BY n", [9, 9]),
    ("SELECT x FROM logs LATERAL VIEW explode(xs) t AS x WHERE v = 1 ORDER BY x", [1, 2, 3]),
    ("SELECT explode(xs) AS x FROM logs WHERE v = 1", [1, 2, 3]),
    ("SELECT n FROM VALUES (1), (2) AS t(n)", [1, 2]),
    ("SELECT n FROM (SELECT grouping(cluster) AS g, count(*) FILTER (WHERE v BETWEEN 1 AND 2 AND namespace LIKE '%' AND NOT v IN (5, 6)) AS n FROM logs GROUP BY ROLLUP (cluster) HAVING count(*) > 0) WHERE g = 1", [2]),
    ("SELECT n FROM (SELECT cluster, v FROM logs) UNPIVOT (n FOR k IN (v)) ORDER BY n", [1, 2]),
    ("SELECT a FROM (SELECT cluster, v FROM logs) PIVOT (sum(v) FOR cluster IN ('a'))", [3]),
    ("FROM logs |> WHERE v > 1 |> SELECT v", [2]),
    ("SELECT CASE WHEN v = 1 THEN EXTRACT(HOUR FROM TIMESTAMP '2024-01-01 05:00:00') ELSE timestampdiff(HOUR, DATE '2024-01-01', DATE '2024-01-02') END AS h FROM logs ORDER BY h", [5, 24]),
    ("SELECT /*+ BROADCAST(logs) */ * EXCEPT (cluster, namespace, xs) FROM logs ORDER BY ALL LIMIT 1 OFFSET 1", [2]),
    ("SELECT 7", [7]),
]


@pytest.fixture(scope="module")
def logs(spark):
    spark.range(3).selectExpr("id AS x").write.mode("overwrite").saveAsTable("secret")
    spark.range(3).selectExpr("id AS x").createOrReplaceGlobalTempView("hidden")
    yield spark.createDataFrame([("a", "x", 1, [1, 2, 3]), ("a", "y", 2, [1, 2, 3]), ("b", "y", 9, [])], SCHEMA)
    spark.sql("DROP TABLE secret")
    spark.catalog.dropGlobalTempView("hidden")


@pytest.mark.parametrize("sql", ESCAPES)
def test_escapes_are_refused(spark, logs, sql):
    with pytest.raises(S.Refused):
        S.scoped_sql(spark, sql, {"logs": logs}, [("a", "*")])


@pytest.mark.parametrize("sql, want", LEGAL)
def test_legal_queries_run(spark, logs, sql, want):
    assert [r[0] for r in S.scoped_sql(spark, sql, {"logs": logs}, [("a", "*")]).collect()] == want


def test_the_plan_is_proved(spark, logs):
    """What gets past the parsed form, by whatever name, is refused by what it reads."""
    views = {"logs": S.in_scope(logs, [("a", "*")])}
    for sql in ("SELECT * FROM default.secret", "SELECT * FROM IDENTIFIER('default.secret')", "SELECT * FROM global_temp.hidden", "SELECT 1 WHERE EXISTS (SELECT * FROM default.secret)", "SELECT java_method('java.lang.System', 'getProperty', 'a')", "SELECT * FROM range(3)"):
        with pytest.raises(S.Refused):
            S.prove(spark.sql(sql), views)
    other = spark.newSession()
    S._register(other, logs, "logs")  # the right name, but all rows
    with pytest.raises(S.Refused):
        S.prove(other.sql("SELECT * FROM logs"), views)
    S._register(other, views["logs"], "logs")
    S.prove(other.sql("SELECT * FROM logs"), views)
