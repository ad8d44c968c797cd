import pytest

from lodestone.plans import sql
from lodestone.sources import tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    tables.register(spark, FOLDER, ["orders", "customer", "part", "nation", "lineitem"])
    spark.sql("CREATE OR REPLACE TEMP VIEW big_orders AS SELECT * FROM orders WHERE o_totalprice > 1000")
    return spark


@pytest.mark.parametrize("statement", [
    "DELETE FROM orders", "UPDATE orders SET o_orderkey = 1", "DROP TABLE orders", "INSERT INTO orders SELECT * FROM orders", "EXPLAIN SELECT 1", "SET a = 1", "SHOW TABLES", "SELECT 1; DELETE FROM orders", "SELECT 1; SELECT 2",
    "WITH x AS (SELECT 1) INSERT INTO orders SELECT * FROM x", "WITH x AS (DELETE FROM orders) SELECT 1", "SELECT reflect('java.lang.System', 'getProperty', 'x')", "SELECT java_method('a', 'b')", "SELECT * FROM parquet.`/tmp`", "SELECT `reflect`('java.lang.System', 'getProperty', 'user.name')", "SELECT 1 WHERE EXISTS (SELECT `try_reflect`('a', 'b'))", "WITH x AS (SELECT `java_method`('a', 'b') AS a) SELECT a FROM x",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'x')", "SELECT * FROM IDENTIFIER('parquet.`/tmp`')", "SELECT spark_catalog.default.f(1)", "SELECT input_file_name() FROM orders", "SELECT * FROM orders WHERE version() = 'x'",
    "FROM orders SELECT *", "TABLE orders", "VALUES (1)", "", "SELECT (", "-- only a comment",
])
def test_rejected(views, statement):
    assert sql.verdict(views, statement)


@pytest.mark.parametrize("statement", [
    "SELECT COUNT(*) FROM orders", "SELECT 1;", "-- note\nSELECT 1", "/* a */ WITH x AS (SELECT * FROM orders) SELECT COUNT(*) FROM x", "SELECT 'DROP TABLE x; DELETE' AS a", "SELECT REPLACE('a', 'a', 'b') AS a", "SELECT 1 -- DROP TABLE x", "SELECT c_name AS `drop` FROM customer",
    "SELECT 'parquet.`x`, reflect(1)' AS a", "SELECT row_number() OVER (ORDER BY c_name) AS r FROM customer", "SELECT CASE WHEN c_name LIKE 'a%' THEN 1 END AS a FROM customer WHERE c_custkey IN (1, 2) AND c_name IS NOT NULL", "SELECT x FROM customer LATERAL VIEW explode(array(1, 2)) t AS x",
    "WITH RECURSIVE y(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM y WHERE n < 3) SELECT n FROM y", "SELECT a FROM VALUES (1), (2) AS t(a) UNION SELECT 2 EXCEPT SELECT 3 ORDER BY 1 LIMIT 1 OFFSET 1", "SELECT EXTRACT(YEAR FROM o_orderdate) AS y, CAST(1 AS DOUBLE) FROM orders GROUP BY 1 HAVING COUNT(*) > 1",
])
def test_accepted(views, statement):
    assert sql.verdict(views, statement) is None


@pytest.mark.parametrize(("statement", "reads"), [
    ("SELECT * FROM orders", ["orders"]), ("SELECT * FROM orders JOIN customer ON o_custkey = c_custkey", ["customer", "orders"]), ("SELECT * FROM orders, part WHERE 1 = 1", ["orders", "part"]),
    ("SELECT * FROM big_orders", ["orders"]), ("WITH orders AS (SELECT * FROM part) SELECT * FROM orders", ["part"]), ("WITH x AS (SELECT 1 AS a) SELECT * FROM x", []), ("SELECT 'FROM nation' AS a FROM part", ["part"]),
    ("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", ["customer", "orders"]), ("SELECT (SELECT MAX(p_size) FROM part) AS m, c_name FROM customer", ["customer", "part"]), ("SELECT * FROM part /* nation */ -- orders", ["part"]),
    ("SELECT * FROM (SELECT * FROM nation) n LEFT JOIN customer ON n_nationkey = c_nationkey", ["customer", "nation"]),
])
def test_footprint(views, statement, reads):
    assert sql.footprint(views, statement) == reads


def test_execution(views):
    guard = sql.Guarded(views, row_limit=5)
    result = guard.execute("SELECT o_orderkey FROM orders")
    assert len(result.rows) == 5 and result.truncated and result.columns == ["o_orderkey"]
    assert not guard.execute("SELECT 1 AS a").truncated
    assert guard.execute("SELECT nothing FROM orders").error == "UNRESOLVED_COLUMN.WITH_SUGGESTION"
    assert guard.execute("SELECT * FROM nowhere").error == "TABLE_OR_VIEW_NOT_FOUND"
    assert guard.execute("DROP VIEW orders").error == "not a query"
    slow = sql.Guarded(views, timeout_s=1).execute("SELECT COUNT(*) AS n FROM range(3000000000) a JOIN range(1000) b ON a.id % 1000 < b.id")
    assert slow.error == "timeout" and slow.elapsed_s < 20


def test_static_errors(views):
    assert sql.static_error(views, "SELECT n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey") == "AMBIGUOUS_REFERENCE"
    assert sql.static_error(views, "SELECT x.n_name FROM nation a") == "UNRESOLVED_COLUMN.WITH_SUGGESTION"
    assert sql.static_error(views, "SELECT n_name FROM nation") is None


def test_grain(views):
    changed, notes = sql.grain_safe(views, "SELECT c_name, c_mktsegment AS m, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
    assert notes == ["any_value(c_name)", "any_value(c_mktsegment)"] and sql.static_error(views, changed) is None
    assert views.sql(changed).columns == ["c_name", "m", "n"]
    assert sql.grain_safe(views, "SELECT c_custkey, COUNT(*) AS n FROM customer GROUP BY c_custkey")[1] == []
    # Only the query that lacks the aggregate changes, and only the place of the column.
    changed, notes = sql.grain_safe(views, "WITH x AS (SELECT c_name AS a, c_custkey FROM customer) SELECT upper(a) AS u, EXTRACT(YEAR FROM max(o_orderdate)) AS y FROM x JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
    assert notes == ["any_value(a)"] and "c_name AS a" in changed and "upper(any_value(a)) AS u" in changed and sql.static_error(views, changed) is None
    changed, _ = sql.grain_safe(views, "SELECT * FROM (SELECT c_custkey, c_name, COUNT(*) AS n FROM customer GROUP BY c_custkey) WHERE n > 0")
    assert views.sql(changed).columns == ["c_custkey", "c_name", "n"]


def test_labels_become_keys(views):
    labels = {"c_name": "c_custkey"}
    changed, notes = sql.by_key(views, "SELECT c.c_name, 'GROUP BY c_name' AS t, COUNT(*) AS n FROM customer c JOIN orders ON c_custkey = o_custkey GROUP BY c.c_name ORDER BY n DESC", labels)
    assert notes == ["c_name -> c_custkey"] and "GROUP BY `c`.c_custkey ORDER" in changed and "'GROUP BY c_name'" in changed
    changed, _ = sql.grain_safe(views, changed)
    assert views.sql(changed).columns == ["c_name", "t", "n"]
    for fine in ("SELECT c_name, COUNT(*) FROM customer GROUP BY c_name, c_custkey", "SELECT p_brand, COUNT(*) FROM part GROUP BY p_brand", "SELECT c_name FROM customer ORDER BY c_name"):
        assert sql.by_key(views, fine, labels) == (fine, [])
    inner = "SELECT MAX(n) AS m FROM (SELECT COUNT(*) AS n FROM customer GROUP BY c_name)"
    assert sql.by_key(views, inner, labels)[0].endswith("GROUP BY c_custkey)")


LABELLED = "customer JOIN orders ON c_custkey = o_custkey"


@pytest.mark.parametrize(("statement", "grouping"), [
    (f"SELECT c_name AS who, COUNT(*) AS n FROM {LABELLED} GROUP BY who", "GROUP BY c_custkey"), (f"SELECT c_name AS who, COUNT(*) AS n FROM {LABELLED} GROUP BY 1 ORDER BY n", "GROUP BY c_custkey ORDER BY n"),
    (f"SELECT c.c_name, o_orderstatus, COUNT(*) AS n FROM customer c JOIN orders ON c_custkey = o_custkey GROUP BY c.c_name, o_orderstatus", "GROUP BY `c`.c_custkey, o_orderstatus"),
    (f"WITH x AS (SELECT c_name AS who FROM {LABELLED}) SELECT who, COUNT(*) AS n FROM x GROUP BY who", "GROUP BY lodestone_c_custkey"), (f"WITH x AS (SELECT c_custkey AS k, c_name AS who FROM {LABELLED}) SELECT who, COUNT(*) AS n FROM x y GROUP BY y.who", "GROUP BY `y`.k"),
    (f"SELECT who, COUNT(*) AS n FROM (SELECT who FROM (SELECT c_name AS who, c_acctbal FROM {LABELLED}) WHERE c_acctbal > 0) GROUP BY who", "GROUP BY lodestone_c_custkey"),
    ("SELECT a.c_name, COUNT(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey GROUP BY a.c_name", "GROUP BY `a`.c_custkey"), ("SELECT c_name, COUNT(*) AS n FROM customer GROUP BY c_name UNION ALL SELECT p_name, 1 FROM part", "GROUP BY c_custkey UNION ALL"),
    ("SELECT COUNT(*) AS n FROM nation WHERE n_nationkey IN (SELECT MAX(c_nationkey) FROM customer GROUP BY c_name)", "GROUP BY c_custkey)"),
])
def test_labels_are_followed_to_their_tables(views, statement, grouping):
    changed, notes = sql.by_key(views, statement, {"c_name": "c_custkey"})
    assert notes == ["c_name -> c_custkey"] and grouping in changed
    safe, _ = sql.grain_safe(views, changed)
    assert sql.static_error(views, safe) is None and views.sql(safe).columns == views.sql(statement).columns
    assert sql.by_key(views, safe, {"c_name": "c_custkey"}) == (safe, [])


@pytest.mark.parametrize("statement", [
    "SELECT who, COUNT(*) AS n FROM (SELECT DISTINCT c_name AS who FROM customer) GROUP BY who", "SELECT who, COUNT(*) AS n FROM (SELECT c_name AS who FROM customer UNION ALL SELECT p_name FROM part) GROUP BY who", "SELECT upper(c_name) AS u, COUNT(*) AS n FROM customer GROUP BY upper(c_name)",
    "SELECT c_name, COUNT(*) AS n FROM customer GROUP BY ROLLUP (c_name)", "SELECT who, COUNT(*) AS n FROM (SELECT c_name AS who, COUNT(*) AS k FROM customer GROUP BY c_name, c_custkey) GROUP BY who", "SELECT p_name AS c_name, COUNT(*) AS n FROM part GROUP BY c_name", "SELECT c_name AS who, COUNT(*) AS n FROM customer GROUP BY who, c_custkey",
    "SELECT * FROM (SELECT *, 1 AS one FROM (SELECT c_name AS who FROM customer)) GROUP BY who, one",
])
def test_labels_stay_where_a_key_would_change_the_meaning(views, statement):
    assert sql.by_key(views, statement, {"c_name": "c_custkey"}) == (statement, [])


def test_days_are_followed_to_their_tables(views):
    views.sql("CREATE OR REPLACE TEMP VIEW noon AS SELECT o_orderkey, o_orderdate + INTERVAL 12 HOUR AS o_orderdate, concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 12:00:00') AS orderdate FROM orders")
    until = views.sql("SELECT COUNT(*) FROM orders WHERE o_orderdate < '1997-07-01'").first()[0]
    for column in ("o_orderdate", "orderdate"):
        for statement in (
            f"WITH x AS (SELECT {column} AS placed FROM noon) SELECT COUNT(*) FROM x WHERE placed <= '1997-06-30'", f"SELECT COUNT(*) FROM (SELECT y.{column} AS placed FROM noon y) z WHERE '1997-06-30' >= z.placed",
            f"SELECT COUNT(*) FROM (SELECT {column} AS placed FROM noon) WHERE placed BETWEEN DATE'1900-01-01' AND DATE'1997-06-30'", f"SELECT COUNT(CASE WHEN b.{column} <= '1997-06-30' THEN 1 END) FROM noon a JOIN noon b USING (o_orderkey)",
        ):
            changed, notes = sql.whole_days(views, statement)
            assert len(notes) == 1 and views.sql(changed).first()[0] == until, statement
            assert sql.whole_days(views, changed) == (changed, [])
    for fine in ("WITH x AS (SELECT CAST(o_orderdate AS DATE) AS placed FROM noon) SELECT COUNT(*) FROM x WHERE placed <= '1997-06-30'", "WITH x AS (SELECT substr(orderdate, 1, 10) AS placed FROM noon) SELECT COUNT(*) FROM x WHERE placed <= '1997-06-30'", "SELECT nothing FROM noon WHERE o_orderdate <= '1997-06-30'"):
        assert sql.whole_days(views, fine) == (fine, [])


def test_what_is_read_comes_from_typed_plans(views):
    assert sql.footprint(views, "SELECT 'View (`part`' AS x FROM nation") == ["nation"]
    assert sql.footprint(views, "SELECT c_name FROM customer WHERE EXISTS (SELECT 1 FROM big_orders WHERE o_custkey = c_custkey) ORDER BY (SELECT MAX(p_size) FROM part)") == ["customer", "orders", "part"]
    assert sql.columns_read(views, "SELECT 'ReadSchema: struct<x:int>' AS a, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > (SELECT AVG(p_retailprice) FROM part))") == {"c_name", "c_custkey", "o_custkey", "o_totalprice", "p_retailprice"}


PROBE = "reflect('java.lang.System', 'setProperty', 'lodestone.probe', 'hit')"


@pytest.mark.parametrize("statement", [
    f"SELECT sum(o_orderkey) OVER w AS x FROM orders WINDOW w AS (PARTITION BY {PROBE}) LIMIT 1", f"SELECT sum(o_orderkey) OVER w AS x FROM orders WINDOW w AS (ORDER BY {PROBE}), v AS (PARTITION BY 1)", f"WITH x AS (SELECT 1 AS a) SELECT sum(a) OVER w FROM x WINDOW w AS (PARTITION BY {PROBE})",
    f"SELECT * FROM (SELECT o_orderstatus s, o_totalprice p FROM orders) PIVOT (sum(p) FOR s IN ({PROBE}))", f"SELECT * FROM (SELECT o_orderstatus s, o_totalprice p FROM orders) PIVOT (max({PROBE}) FOR s IN ('F'))", f"SELECT * FROM orders, LATERAL (SELECT {PROBE})", f"SELECT * FROM orders LEFT JOIN LATERAL (SELECT {PROBE}) ON true",
    f"SELECT * FROM VALUES ({PROBE}) AS t(x)", f"SELECT * FROM orders LATERAL VIEW explode(array({PROBE})) t", f"SELECT count(*) FROM orders GROUP BY CUBE ({PROBE})", f"SELECT (SELECT max({PROBE})) FROM orders", f"SELECT * FROM orders ORDER BY {PROBE} LIMIT length({PROBE})", f"SELECT * FROM range({PROBE})",
    f"SELECT x FROM orders UNPIVOT (v FOR x IN (o_orderkey)) WHERE {PROBE} = ''", f"SELECT aggregate(array(1), 0, (a, b) -> {PROBE})", f"SELECT * FROM orders JOIN customer ON {PROBE} = c_name", f"SELECT * FROM orders TABLESAMPLE (10 ROWS) WHERE {PROBE} IS NULL", f"SELECT CASE {PROBE} WHEN 1 THEN 2 END",
    f"SELECT first_value({PROBE}) IGNORE NULLS FROM orders", f"SELECT * FROM IDENTIFIER({PROBE})", f"SELECT named_struct('a', {PROBE}).a", f"SELECT DATE'2020-01-01' + make_interval(length({PROBE}))",
])
def test_no_call_into_java_passes(views, statement):
    jvm = views._jvm.java.lang.System
    jvm.clearProperty("lodestone.probe")
    assert sql.Guarded(views).execute(statement).error in ("reaches outside of the tables", "has a part that can't be read")
    assert jvm.getProperty("lodestone.probe") is None


def test_functions_of_others_under_known_names_are_refused(views):
    other = views.newSession()
    other.udf.register("soundex", lambda x: "mine")
    assert sql.verdict(other, "SELECT soundex('a') AS a") and sql.verdict(views, "SELECT soundex('a') AS a") is None


def test_whole_days(views):
    views.sql("CREATE OR REPLACE TEMP VIEW loose AS SELECT o_orderkey, concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 12:00:00') AS orderdate FROM orders")
    statement = "SELECT COUNT(*) AS n FROM loose WHERE orderdate BETWEEN '1997-06-01' AND '1997-06-30' AND 'orderdate <= x' <> ''"
    changed, notes = sql.whole_days(views, statement)
    assert notes == ["day of orderdate"] and "try_cast(orderdate AS DATE) BETWEEN" in changed and "'orderdate <= x'" in changed
    day = views.sql("SELECT COUNT(*) FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE'1997-06-01' AND DATE'1997-06-30'").first()[0]
    assert views.sql(changed).first()[0] == day
    for fine in ("SELECT 1 FROM loose WHERE orderdate >= '1997-06-01' AND orderdate < '1997-07-01'", "SELECT 1 FROM loose WHERE date(orderdate) <= '1997-06-30'", "SELECT 1 FROM orders WHERE o_orderkey = 5"):
        assert sql.whole_days(views, fine) == (fine, [])
    assert sql.whole_days(views, "SELECT 1 FROM orders WHERE o_orderdate <= DATE'1997-06-30'")[1] == ["day of o_orderdate"]
    assert [n.names for n in sql.loose_dates(views, "SELECT 1 FROM loose WHERE '1997-06-01' > orderdate")] == [["orderdate"]]


def test_order_at_the_top(views):
    assert sql.ordered(views, "SELECT 1 AS a ORDER BY a LIMIT 3") and sql.ordered(views, "WITH x AS (SELECT 1 AS a) SELECT a FROM x ORDER BY a;")
    assert not sql.ordered(views, "SELECT * FROM (SELECT 1 AS a ORDER BY a)") and not sql.ordered(views, "SELECT 'ORDER BY a' AS a")


def test_dialect(views):
    sql.install_dialect(views)
    run = lambda s: views.sql(sql.compatible(s, ["c_name", "customer", "nation"])).collect()
    assert run("SELECT COUNT(*) FROM \"customer\" WHERE \"c_name\" LIKE \"CUSTOMER#%\"")[0][0] > 0
    assert run("SELECT strftime('%Y', date(d)), strftime('%H:%M', d), datetime(d), unixepoch(d), julianday(d) FROM (SELECT '2017-06-30 12:00:00' AS d)")[0][:] == ("2017", "12:00", "2017-06-30 12:00:00", 1498824000, 2457935.0)
    assert run("SELECT date('now') = current_date(), strftime('%Y', 'bad'), datetime('now') IS NOT NULL")[0][:] == (True, None, True)
    assert run("SELECT total(o_totalprice * (1 - 0.5)), 'total(x)' FROM orders WHERE o_orderkey < 0")[0][:] == (0.0, "total(x)")
    assert run("SELECT a FROM (SELECT 'a.c' AS a) WHERE a GLOB 'a.[b-d]' AND NOT a GLOB '?[^.]c' AND NOT 'abc' GLOB 'a.c'") != []
    assert run("SELECT COUNT(*) FROM main.customer WHERE [c_name] LIKE 'CUSTOMER#%'")[0][0] > 0
    assert run("SELECT total(o_totalprice) FROM orders WHERE o_orderkey < 0")[0][0] == 0.0
    assert run("SELECT strftime('%Y-%m', d), date(d), julianday(d) FROM (SELECT '2017-06-30 12:00:00' AS d)")[0][0] == "2017-06"
    assert run("SELECT date(d) FROM (SELECT 'unknown' AS d)")[0][0] is None
    assert run("SELECT 'x LIKE [y] main.z' AS a")[0][0] == "x LIKE [y] main.z"
    assert run("SELECT 1 FROM (SELECT 'abc' AS a) WHERE a GLOB 'a*'") != []


def test_replies():
    assert sql.clean_sql("Sure:\n```sql\nSELECT  'a;  b'\nFROM t;\n```\nDone.") == "SELECT 'a;  b' FROM t"
    assert sql.clean_sql("sql: WITH x AS (SELECT 1) SELECT * FROM x; DROP TABLE y") == "WITH x AS (SELECT 1) SELECT * FROM x"


def test_repairs_only_what_spark_refuses(views):
    views.sql("CREATE OR REPLACE TEMP VIEW `Order Details` AS SELECT 1 AS a, 2 AS d")
    assert sql.repaired(views, "SELECT a FROM OrderDetails WHERE d BETWEEM 1 AND 2 AND 'x' <> 'BETWEEM'") == ("SELECT a FROM `order details` WHERE d BETWEEN 1 AND 2 AND 'x' <> 'BETWEEM'", ["BETWEEM -> BETWEEN", "OrderDetails -> `order details`"])
    assert sql.repaired(views, "SELCT c_name FROM customer GRUOP BY c_name")[0] == "SELECT c_name FROM customer GROUP BY c_name"
    for fine in ("SELECT o_orderdate - INTERVAL 1 DAY AS groups FROM orders", "SELECT a AS distinctive FROM `Order Details`", "SELECT nothing FROM orders"):
        assert sql.repaired(views, fine) == (fine, [])
    assert sql.repaired(views, "DROP everything now")[1] == []


def test_open_choices(views):
    joined = "SELECT year(l_shipdate) AS y, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"
    assert sql.open_choices(views, joined, "Orders by year") == [("l_shipdate", "o_orderdate")]
    assert sql.open_choices(views, joined, "Orders by year", "use l_shipdate") == []
    assert sql.open_choices(views, "SELECT year(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY 1", "Orders by year") == []


def test_equivalence(views):
    guard = sql.Guarded(views, timeout_s=60)
    gold = "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"
    assert sql.equivalent(guard, "SELECT o_orderstatus AS s, SUM(1) AS k FROM orders GROUP BY 1 ORDER BY 2", gold)
    assert not sql.equivalent(guard, "SELECT o_orderstatus, COUNT(*) + 1 AS n FROM orders GROUP BY 1", gold)
    assert not sql.equivalent(guard, "SELECT COUNT(*) FROM orders", gold)
    assert not sql.equivalent(guard, "SELECT nothing", gold)
    assert not sql.equivalent(sql.Guarded(views, row_limit=2), "SELECT o_orderkey FROM orders", "SELECT o_orderkey FROM orders")
    by = "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus ORDER BY n"
    assert sql.equivalent(guard, by, by) and not sql.equivalent(guard, by + " DESC", by) and sql.equivalent(guard, by + " DESC", gold)
    assert sql.equivalent(guard, "SELECT 1.004 AS x UNION ALL SELECT 2.0", "SELECT 2.009 AS x UNION ALL SELECT 1.0") and not sql.equivalent(guard, "SELECT 1.004 AS x", "SELECT 1.02 AS x")
    with pytest.raises(ValueError):
        sql.equivalent(guard, gold, "SELECT nothing")


def test_glob_only_behind_the_operator(views):
    run = lambda s: views.sql(sql.compatible(s)).collect()
    assert run("SELECT 'a GLOB ''b''' AS x, 'c' GLOB  'C*' AS y, 'it''s' GLOB 'it''?' AS z, 'GLOB' AS g")[0][:] == ("a GLOB 'b'", False, True, "GLOB")


def test_date_modifiers(views):
    sql.install_dialect(views)
    row = views.sql(sql.compatible("SELECT date('2017-03-31', '-1 month'), date('2017-03-31', 'start of month'), datetime('2017-03-31 10:00:00', '+36 hours'), strftime('%Y', '2017-12-31', '+1 day'), unixepoch('1970-01-01', '+2 days'), date('2017-03-31', 'nonsense'), date('x', '-1 day'), date('now', '-1 day') = date_sub(current_date(), 1), date('2016-02-29', '+1 year')")).first()
    assert [str(x) for x in row] == ["2017-02-28", "2017-03-01", "2017-04-01 22:00:00", "2018", "172800", "None", "None", "True", "2017-02-28"]
