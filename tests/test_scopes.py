import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.columns import question_words
from lodestone.operators import constraints, evaluation
from lodestone.plans import sql
from lodestone.plans.scopes import schema_problems
from lodestone.sources import tables


@pytest.fixture(scope="module")
def views(spark):
    tables.register(spark, "/root/testdata/sf0.001", ["orders", "customer", "part", "nation", "lineitem"])
    return spark


@pytest.mark.parametrize(("statement", "found"), [
    ("SELECT o.nothing, x.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkee", [("column", "o.nothing"), ("qualifier", "x.c_name"), ("column", "c.c_custkee")]),
    ("SELECT p.p_nam, q.c FROM partt p", [("qualifier", "q.c"), ("table", "partt")]), ("SELECT customer.c_name, c_name FROM orders", [("qualifier", "customer.c_name"), ("column", "c_name")]),
    ("WITH x AS (SELECT c_name AS who FROM customer) SELECT x.who, x.c_name FROM x JOIN (SELECT COUNT(*) AS n FROM orders) y ON y.m = 1", [("column", "x.c_name"), ("column", "y.m")]),
    ("SELECT c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_oops = c_acctbal)", [("column", "o_oops")]), ("SELECT c_custkey, COUNT(*) AS n FROM customer GROUP BY c_custke HAVING m > 1 ORDER BY k", [("column", "k"), ("column", "m"), ("column", "c_custke")]),
])
def test_all_problems_of_a_statement(views, statement, found):
    assert sorted((p.kind, p.name) for p in schema_problems(views, statement)) == sorted(found)
    assert sql.static_error(views, statement)


@pytest.mark.parametrize("statement", [
    "SELECT c_name AS a, upper(a) AS b FROM customer ORDER BY b, c_acctbal", "SELECT x FROM customer LATERAL VIEW explode(array(1)) e AS x", "WITH RECURSIVE y(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM y WHERE n < 3) SELECT n FROM y", "SELECT t.a FROM VALUES (1) AS t(a)",
    "SELECT s.a FROM (SELECT named_struct('a', 1) AS s)", "SELECT transform(array(1), v -> v + 1) AS x", "SELECT * FROM (SELECT o_orderstatus AS s, o_totalprice AS p FROM orders) PIVOT (SUM(p) FOR s IN ('F' AS f)) WHERE f > 0", "SELECT y.* FROM (SELECT * FROM customer) y WHERE y.c_name <> ''",
    "SELECT (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c.c_custkey) AS m FROM customer c", "SELECT id FROM range(3)", "SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY ALL", "SELECT k, v FROM (SELECT p_size AS a, p_partkey AS b FROM part) UNPIVOT (v FOR k IN (a, b))",
])
def test_nothing_right_is_reported(views, statement):
    assert sql.static_error(views, statement) is None and schema_problems(views, statement) == []


def test_advice(views):
    said = [str(p) for p in schema_problems(views, "SELECT c.c_nam, p_size, n.n_name FROM custmer x JOIN customer c ON 1 = 1")]
    assert "column c.c_nam: c has no such column; nearest: c_name" in said and any(x.startswith("table custmer: does not exist; nearest: customer") for x in said)
    assert [p.advice for p in schema_problems(views, "SELECT p_size FROM customer")] == ["belongs to part, which is in no FROM or JOIN of this query"]


@pytest.mark.parametrize(("statement", "mended"), [
    ("SELCT COUNT(*) FORM orders", "SELECT COUNT(*) FROM orders"), ("SELECT c_name FROM customer WHERE c_custkey BETWEWEN 1 AND 2", "SELECT c_name FROM customer WHERE c_custkey BETWEEN 1 AND 2"),
    ("SELECT CASE WEN 1 = 1 THEN 2 EDN AS x FROM orders", "SELECT CASE WHEN 1 = 1 THEN 2 END AS x FROM orders"), ("SELECT 'FORM' AS a FORM orders -- FORM", "SELECT 'FORM' AS a FROM orders -- FORM"),
    ("SELCT c_name FORM customer WEHRE c_custkey > 3 ODER BY c_name LIMT 3", "SELECT c_name FROM customer WHERE c_custkey > 3 ORDER BY c_name LIMIT 3"),
])
def test_misspelt_keywords(views, statement, mended):
    assert sql.repaired(views, statement)[0] == mended


def test_names_are_never_respelt(views):
    for statement in ("SELECT o_orderkey FROM orders WHRE", "SELECT orders FROM FROM part", "SELECT nation( FROM nation", "SELECT total price FROM orders, WHERE"):
        changed, notes = sql.repaired(views, statement)
        assert not any(n.split(" ->")[0].lower() in ("orders", "part", "nation", "o_orderkey", "c_name") for n in notes), (changed, notes)


def test_edits():
    assert [sql.distance(a, b) for a, b in (("FORM", "FROM"), ("SELCT", "SELECT"), ("GRUOP", "GROUP"), ("A", "A"), ("ABCD", "WXYZ"), ("BETWEWEN", "BETWEEN"))] == [1, 1, 1, 0, 3, 1]


def test_operands_of_formulas(spark):
    rows = [("q", "m", "SUM(price * (1 - rebate))"), ("q", "n", "COUNT(DISTINCT o.okey) / NULLIF(SUM(Price), 0)"), ("q", "t", "SUM(price) WHERE 'rebate' CostOfGoods"), ("q", "c", "CASE WHEN kind = 'x' THEN price END"), ("q", "z", None)]
    got = constraints.missing_fields(spark.createDataFrame(rows, "qid string, name string, expression string"), ["price"]).collect()
    assert sorted((r["name"], r["field"]) for r in got) == [("c", "kind"), ("m", "rebate"), ("n", "okey"), ("t", "CostOfGoods")]
    asked = [("a", "Approximate CostOfGoods as 0.7 * price. Thanks"), ("b", "Suppose that cost_of_goods is 70% of price, please"), ("c", "What is it?")]
    got = constraints.supplied_approximations(spark.createDataFrame(asked, "qid string, question string")).collect()
    assert sorted(map(tuple, got)) == [("a", "CostOfGoods", "0.7 * price"), ("b", "cost_of_goods", "70% of price")]


def test_nearest_question_without_a_threshold(spark):
    rng, words = random.Random(7), [f"w{i}" for i in range(40)]
    draw = lambda p, n: [(f"{p}{i}", " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(40)], k=rng.randrange(0, 9)))) for i in range(n)]
    train, test = [*draw("t", 60), ("t60", None), ("t61", "only here"), ("t62", "w1 w2 w3")], [*draw("e", 50), ("e50", ""), ("e51", "w3 w2 w1")]
    f = lambda rows: spark.createDataFrame(rows, "qid string, question string")
    sets = lambda rows: {r["qid"]: set(r["w"]) for r in f(rows).select("qid", question_words(F.col("question")).alias("w")).collect()}
    a, b = sets(train), sets(test)
    want = {}
    for i, x in a.items():
        best = min((-round(len(x & y) / max(len(x | y), 1), 6), j) for j, y in b.items())
        want[i] = (best[1], -best[0] or 0.0)
    assert {r["train_id"]: (r["test_id"], r["overlap"]) for r in evaluation.closest(f(train), f(test)).collect()} == want
    assert evaluation.closest(f(train), f(test).limit(0)).count() == 0 and evaluation.closest(f(train).limit(0), f(test)).count() == 0


def test_nearest_question_in_parts(spark, monkeypatch):
    """Parts of few words, more words than bits, ties and copies; no pair of texts is joined or shuffled."""
    rng, words = random.Random(9), [f"w{i}" for i in range(150)]
    draw = lambda p, n: [(f"{p}{i}", " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(150)], k=rng.randrange(1, 30)))) for i in range(n)]
    train, test = draw("t", 80), draw("e", 90)
    train, test = [*train, *[("u" + i, t) for i, t in train[:9]], ("v", "nobody else")], [*test, *[("d" + i, t) for i, t in test[:9]]]
    for name, value in (("WORDS", 200), ("PARTS", 3), ("MASKS", 1)):
        monkeypatch.setattr(evaluation, name, value)
    f = lambda rows: spark.createDataFrame(rows, "qid string, question string")
    want = {}
    for i, x in train:
        x = set(x.split())
        best = min((-round(len(x & set(y.split())) / len(x | set(y.split())), 6), j) for j, y in test)
        want[i] = (best[1], -best[0] or 0.0)
    df = evaluation.closest(f(train), f(test))
    assert {r["train_id"]: (r["test_id"], r["overlap"]) for r in df.collect()} == want
    plan = df._jdf.queryExecution().analyzed().toString()
    assert all("sequence" in line for line in plan.split("\n") if "Generate" in line)  # texts are copied by part, not by word
