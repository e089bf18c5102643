"""The SQL policy: verdicts, rewriting, guarded execution."""

import pytest

from palisade.plans.execute import guarded_sql, operation_scan, with_verdicts
from palisade.plans.policy import PolicyEngine, SQLPolicy, Verdict


def policy(**more):
    base = {"permitted_operations": ["SELECT"], "permitted_tables": ["products", "orders", "reviews", "customers"], "restricted_columns": {"employees": ["salary", "password_hash"], "customers": ["email", "phone"]}, "scoped_tables": ["orders"], "max_rows": 50}
    return SQLPolicy(**base | more)


BLOCKED = {
    "DROP TABLE users": "Forbidden operation: DROP", "DELETE FROM orders": "Forbidden operation: DELETE", "TRUNCATE TABLE products": "Forbidden operation: TRUNCATE", "ALTER TABLE users ADD COLUMN x TEXT": "Forbidden operation: ALTER",
    "INSERT INTO products VALUES (1, 'test')": "Forbidden operation: INSERT", "UPDATE products SET price = 0": "Forbidden operation: UPDATE", "CREATE TABLE evil (id INT)": "Forbidden operation: CREATE", "": "Empty query", "   ": "Empty query", None: "Empty query",
    "SELECT * FROM products": "Wildcard * is not allowed by policy", "SELECT COUNT(*) FROM products": "Wildcard SELECT (COUNT(*)) is not allowed by policy", "SELECT p.* FROM products p": "Wildcard * is not allowed by policy",
    "SELECT * FROM information_schema.tables": "Forbidden table: tables", "SELECT * FROM sqlite_master": "Forbidden table: sqlite_master", "SELECT p.name FROM products p JOIN employees e ON p.id = e.id": "Forbidden table: employees",
    "SELECT name FROM products WHERE id IN (SELECT id FROM employees)": "Forbidden table: employees", "SELECT customers.email FROM customers": "Restricted column: customers.email", "SELECT c.email FROM customers c": "Restricted column: customers.email",
    "SELECT salary FROM products": "Restricted column: salary", "SELECT id FROM products WHERE EXISTS (SELECT phone FROM customers)": "Restricted column: phone", "SELECT name FROM products WHERE note = ' DROP '": "Forbidden keyword in query",
    "SELECT id FROM products LIMIT 5+5": "Invalid SQL: non-literal LIMIT", "SELECT id FROM products LIMIT ?": "Invalid SQL: non-literal LIMIT",
}
INVALID = ["NOT VALID SQL !!!!", "SELECT id FROM products; SELECT id FROM orders", "SELECT FROM products", "SELECT id FROM", "SELECT (id FROM products", "SELECT a b c d FROM products", "hello there", "SELECT 'open FROM products", "SELECT id FROM products WHERE", "SELECT id FROM products LIMIT"]
REWRITTEN = {
    "SELECT product_name FROM products": "SELECT product_name FROM products LIMIT 50", "SELECT product_name FROM products LIMIT 9999": "SELECT product_name FROM products LIMIT 50", "SELECT id FROM products;": "SELECT id FROM products LIMIT 50",
    "SELECT id FROM (SELECT id FROM products LIMIT 5) t": "SELECT id FROM (SELECT id FROM products LIMIT 5) t LIMIT 50", "WITH w AS (SELECT id FROM orders) SELECT id FROM w": "WITH w AS (SELECT id FROM orders) SELECT id FROM w LIMIT 50",
    "SELECT 2 * price AS double_price FROM products -- note": "SELECT 2 * price AS double_price FROM products LIMIT 50", "SELECT id FROM products LIMIT 10, 200": "SELECT id FROM products LIMIT 10, 50",
}
PASSED = ["SELECT id FROM products LIMIT 10", "select ID from PRODUCTS limit 50", "SELECT id FROM products UNION ALL SELECT id FROM orders LIMIT 3", "SELECT max(x) OVER (PARTITION BY y ORDER BY z DESC) m FROM orders o, products p WHERE o.id = p.id AND o.d BETWEEN 1 AND 2 GROUP BY a, b HAVING count(id) > 2 ORDER BY 1 LIMIT 10 OFFSET 5", "SELECT CASE WHEN a > 1 THEN 'x' ELSE 'y' END l, CAST(a AS decimal(10, 2)) FROM orders LIMIT 1", "SELECT \"id\" FROM `products` LIMIT 1"]


def test_verdicts():
    engine = PolicyEngine(policy())
    for sql, why in BLOCKED.items():
        v = engine.validate(sql)
        assert (v.verdict, v.violations, v.safe_sql) == (Verdict.BLOCKED, [why], None), sql
    for sql in INVALID:
        v = engine.validate(sql)
        assert v.verdict == Verdict.BLOCKED and v.violations[0].startswith("Invalid SQL: "), sql
    for sql, safe in REWRITTEN.items():
        v = engine.validate(sql)
        assert (v.verdict, v.safe_sql, v.violations, v.original_sql) == (Verdict.REWRITTEN, safe, [], sql)
    for sql in PASSED:
        v = engine.validate(sql)
        assert (v.verdict, v.safe_sql) == (Verdict.PASSED, sql), (sql, v)


def test_scope():
    engine = PolicyEngine(policy(require_user_scope=True), 42)
    assert engine.validate("SELECT o.id FROM orders o JOIN products p ON o.pid = p.id").safe_sql == "SELECT o.id FROM (SELECT * FROM orders WHERE user_id = 42) AS o JOIN products p ON o.pid = p.id LIMIT 50"
    assert engine.validate("SELECT id FROM orders LIMIT 3").safe_sql == "SELECT id FROM (SELECT * FROM orders WHERE user_id = 42) AS orders LIMIT 3"
    assert PolicyEngine(policy(require_user_scope=True)).validate("SELECT id FROM orders LIMIT 3").verdict == Verdict.PASSED


def test_compat():
    engine = PolicyEngine(policy(), compat=True)
    assert engine.validate("SELECT c.email FROM customers c LIMIT 1").verdict == Verdict.PASSED
    assert engine.validate("WITH w AS (SELECT id FROM orders) SELECT id FROM w").violations == ["Forbidden table: w"]
    assert engine.validate("SELECT id FROM (SELECT id FROM products LIMIT 5) t").verdict == Verdict.PASSED
    assert PolicyEngine(policy()).validate("WITH w AS (SELECT id FROM orders) DELETE FROM orders").verdict == Verdict.BLOCKED
    assert PolicyEngine(policy(permitted_tables=[])).validate("SELECT id FROM anything LIMIT 1").verdict == Verdict.PASSED


def test_policy_from_dict():
    p = SQLPolicy.from_dict({"permitted_operations": ["SELECT"], "permitted_tables": ["t"]})
    assert (p.max_rows, p.require_user_scope, p.scoped_tables, p.restricted_columns) == (1000, False, [], {})
    for bad in ({"permitted_tables": ["t"]}, {"permitted_operations": ["SELECT"]}, {"permitted_operations": "SELECT", "permitted_tables": ["t"]}, {"permitted_operations": [1], "permitted_tables": ["t"]}):
        with pytest.raises(ValueError):
            SQLPolicy.from_dict(bad)


def test_columns(spark):
    every = [*BLOCKED, *INVALID, *REWRITTEN, *PASSED]
    df = spark.createDataFrame([(i, s, "mine") for i, s in enumerate(every)], "i int, sql string, row string")
    engine = PolicyEngine(policy())
    for r in with_verdicts(df, "sql", policy()).collect():
        v = engine.validate(every[r.i])
        assert (r.verdict, r.safe_sql, r.violations, r.row) == (v.verdict.value, v.safe_sql, v.violations, "mine")
    for r in df.select("i", operation_scan("sql", policy()).alias("w")).collect():
        assert r.w == engine.operation((every[r.i] or "").strip())


def test_guarded(spark):
    spark.createDataFrame([(i, i % 3, "fine" if i % 2 else "DROP TABLE users") for i in range(200)], "id int, user_id int, note string").createOrReplaceTempView("orders")
    p = policy(permitted_tables=["orders"], require_user_scope=True)
    got = guarded_sql(spark, "SELECT o.id, o.note FROM orders o ORDER BY o.id", p, 1)
    rows = got.rows.collect()
    assert len(rows) == 50 and all(r.id % 3 == 1 for r in rows) and {r.note for r in rows if r.id % 2 == 0} != {"DROP TABLE users"}
    refused = guarded_sql(spark, "DROP TABLE orders", p, 1)
    assert refused.rows is None and refused.message == "[BLOCKED] Forbidden operation: DROP"
    assert guarded_sql(spark, "SELECT id FROM orders WHERE id == = 3", p, 1).rows is None


def test_bypasses_are_blocked(spark):
    """Each on its verdict, and none runs; what Spark alone would read otherwise is caught when it is run."""
    from palisade.queries import BYPASSES, POLICY, USER

    spark.createDataFrame([(1, 7, "a"), (2, 8, "b")], "event_id int, user_id int, value string").createOrReplaceTempView("events")
    spark.createDataFrame([("p",)], "p_name string").createOrReplaceTempView("part")
    spark.createDataFrame([("c", 1.0)], "c_name string, c_acctbal double").createOrReplaceTempView("customer")
    for sql, why in BYPASSES:
        got = guarded_sql(spark, sql, POLICY, USER)
        assert got.rows is None and got.verdict.violations == [why], sql
    for sql in ("WITH events AS (SELECT event_id, user_id FROM events) SELECT event_id, user_id FROM events", "SELECT e.event_id, e.user_id FROM events e WHERE e.event_id IN (SELECT event_id FROM events)"):
        assert [tuple(r) for r in guarded_sql(spark, sql, POLICY, USER).rows.collect()] == [(1, 7)]


def test_names_of_common_tables_are_seen_where_they_hold():
    from palisade.plans.sqllex import analyse

    cte = lambda sql: [(t.name, t.is_cte) for t in analyse(sql).tables]
    assert cte("WITH a AS (SELECT x FROM a) SELECT x FROM a") == [("a", False), ("a", True)]
    assert cte("WITH RECURSIVE a AS (SELECT x FROM a) SELECT x FROM a") == [("a", True), ("a", True)]
    assert cte("WITH a AS (SELECT x FROM t), b AS (SELECT x FROM a) SELECT x FROM b") == [("t", False), ("a", True), ("b", True)]
    assert cte("SELECT x FROM (WITH a AS (SELECT x FROM t) SELECT x FROM a) s, a") == [("t", False), ("a", True), ("a", False)]


def test_tables_of_the_parsed_plan(spark):
    from palisade.plans.execute import planned_tables

    parse = lambda sql: dict(planned_tables(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()))
    assert parse("WITH a AS (SELECT x FROM t) SELECT x, (SELECT max(y) FROM u) FROM a WHERE x IN (SELECT z FROM d.v) LIMIT 3") == {"a": 1, "t": 1, "u": 1, "v": 1}
    assert "" in parse("SELECT x FROM IDENTIFIER('t' || 'u')")
