"""The registered queries and, where SQL can say the same, the SQL that they are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.operators import answers, constraints, evaluation, relational, retrieval
from lodestone.plans import pipeline
from lodestone.plans import sql as sqls
from lodestone.plans.scopes import schema_problems
from lodestone.sources import corpus, tables
from lodestone.sources.tables import table

REVENUE = "SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))"
WINDOW = "CAST(o_orderdate AS DATE) BETWEEN DATE '1997-06-01' AND DATE '1997-06-30'"
MIXED = "(SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 101 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 12:00:00' END AS dated FROM orders)"
AS_DATE = "TRY_CAST(dated AS DATE)"

RELATIONAL = {
    "count_all": "SELECT COUNT(*) AS n FROM orders",
    "count_eq": "SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'",
    "count_gt_window": f"SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > 100000 AND {WINDOW}",
    "revenue_total": f"SELECT CAST({REVENUE} AS DOUBLE) AS revenue FROM lineitem",
    "revenue_type_window": f"SELECT p_type, CAST({REVENUE} AS DOUBLE) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE {WINDOW} GROUP BY p_type",
    "qty_group_topk": f"SELECT p_type, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE {WINDOW} GROUP BY p_type ORDER BY quantity DESC, p_type LIMIT 3",
    "lowest_group": f"SELECT p_type, CAST({REVENUE} AS DOUBLE) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type ORDER BY revenue, p_type LIMIT 1",
    "revenue_topk_supplier": f"SELECT s_suppkey, MIN(s_name) AS supplier, MIN(r_name) AS region, CAST({REVENUE} AS DOUBLE) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY s_suppkey ORDER BY revenue DESC, s_suppkey LIMIT 5",
    "topk_customer_grain": f"SELECT c_custkey, MIN(c_name) AS customer, CAST({REVENUE} AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY revenue DESC, c_custkey LIMIT 3",
    "aov_current": f"SELECT revenue, orders, CAST(ROUND(CAST(revenue / NULLIF(orders, 0) AS DECIMAL(18,6)), 2) AS DOUBLE) AS aov FROM (SELECT CAST({REVENUE} AS DOUBLE) AS revenue, COUNT(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {WINDOW})",
    "aov_legacy": f"SELECT gross, orders, CAST(ROUND(CAST(gross / NULLIF(orders, 0) AS DECIMAL(18,6)), 2) AS DOUBLE) AS aov FROM (SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS gross, COUNT(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {WINDOW})",
    "margin_topk": f"SELECT c_custkey, MIN(c_name) AS customer, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) - CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.7 AS DECIMAL(3,2))) AS DOUBLE) AS margin FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE {WINDOW} GROUP BY c_custkey ORDER BY margin DESC, c_custkey LIMIT 1",
    "pct_discounted": "SELECT hits, n, CAST(hits AS DOUBLE) * 100.0 / n AS pct FROM (SELECT SUM(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS hits, COUNT(*) AS n FROM lineitem)",
    "lines_vs_orders": "SELECT COUNT(*) AS lines, COUNT(DISTINCT l_orderkey) AS orders FROM lineitem",
    "having_alias": "SELECT p_brand, COUNT(*) AS parts FROM part GROUP BY p_brand HAVING COUNT(*) >= 5",
    "reporting_group_count": "SELECT COUNT(DISTINCT CASE WHEN p_type IN ('LARGE', 'STANDARD') THEN p_partkey END) AS parts, COUNT(DISTINCT CASE WHEN p_type IN ('LARGE', 'STANDARD') THEN p_brand END) AS brands FROM part",
    "reporting_group_rollup": f"SELECT CASE WHEN p_type IN ('LARGE', 'STANDARD') THEN 'Heavy' ELSE p_type END AS reporting_group, CAST({REVENUE} AS DOUBLE) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "null_predicate": "SELECT COUNT(*) FILTER (WHERE n IS NULL) AS without_lines, COUNT(*) FILTER (WHERE n IS NOT NULL) AS with_lines FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
    "in_list": "SELECT p_size, COUNT(*) AS n FROM part WHERE p_size IN (1, 5, 10) GROUP BY p_size",
    "like_ci": "SELECT COUNT(*) AS n FROM part WHERE p_name ILIKE '%RED%' OR p_type ILIKE '%anodized%' OR p_name ILIKE 'part 1%'",
    "case_expr": "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band, COUNT(*) AS n, MIN(p_size) AS low, MAX(p_size) AS high FROM part GROUP BY 1",
    "distinct_rows": "SELECT DISTINCT p_brand, p_type FROM part",
    "semi_in": "SELECT COUNT(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "semi_exists": "SELECT p_type, COUNT(*) AS n FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49) GROUP BY p_type",
    "anti_orders": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "left_join_count": "SELECT COALESCE(k, 0) AS orders, COUNT(*) AS customers FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS k FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1",
    "right_join_count": "SELECT n_name, COALESCE(k, 0) AS customers FROM (SELECT c_nationkey, COUNT(*) AS k FROM customer GROUP BY 1) RIGHT JOIN nation ON c_nationkey = n_nationkey",
    "full_join_count": "SELECT COALESCE(s_nationkey, c_nationkey) AS nationkey, COALESCE(suppliers, 0) AS suppliers, COALESCE(customers, 0) AS customers FROM (SELECT s_nationkey, COUNT(*) AS suppliers FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey, COUNT(*) AS customers FROM customer GROUP BY 1) ON s_nationkey = c_nationkey",
    "cross_const": "SELECT COUNT(*) AS n FROM region CROSS JOIN nation",
    "using_join": "SELECT lang, COUNT(*) AS n, SUM(toxic) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "natural_join": "SELECT lang, quality, COUNT(*) AS n FROM (SELECT doc_id, lang FROM documents) NATURAL JOIN (SELECT doc_id, quality FROM labels) GROUP BY lang, quality",
    "self_join_nation": "SELECT a.n_regionkey, COUNT(*) AS pairs FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY 1",
    "comma_join": "SELECT r_name, COUNT(*) AS n FROM nation, region WHERE n_regionkey = r_regionkey GROUP BY r_name",
    "derived_join": "SELECT c_mktsegment, MAX(largest) AS largest FROM customer JOIN (SELECT o_custkey, MAX(o_totalprice) AS largest FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1",
    "scalar_subquery": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders)",
    "cte_multi": "WITH big AS (SELECT o_custkey FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM per GROUP BY n",
    "cte_shadow": "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F'",
    "cte_recursive": "WITH RECURSIVE years(y) AS (SELECT 1995 UNION ALL SELECT y + 1 FROM years WHERE y < 2001) SELECT y, COUNT(o_orderkey) AS n FROM years LEFT JOIN orders ON year(o_orderdate) = y GROUP BY y",
    "union_all": "SELECT y, COUNT(*) AS n FROM (SELECT year(o_orderdate) AS y FROM orders UNION ALL SELECT year(l_shipdate) FROM lineitem) GROUP BY y",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_keys": "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)",
    "except_keys": "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
    "window_rank": "SELECT * FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2",
    "window_running_sum": "SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM orders",
    "order_offset": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer ORDER BY balance NULLS FIRST, c_custkey LIMIT 20 OFFSET 5",
    "date_half_open": "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderdate < TIMESTAMP '1997-07-01'",
    "date_mixed_text": f"SELECT COUNT(*) FILTER (WHERE {AS_DATE} BETWEEN DATE '1997-06-01' AND DATE '1997-06-30') AS by_day, COUNT(*) FILTER (WHERE dated BETWEEN '1997-06-01' AND '1997-06-30') AS as_text, COUNT(*) FILTER (WHERE {AS_DATE} IS NULL) AS unparsable FROM {MIXED}",
    "strftime_year": f"SELECT strftime({AS_DATE}, '%Y-%m') AS month, COUNT(*) AS n FROM {MIXED} GROUP BY 1",
    "julian": "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + CAST(2440587.5 AS DOUBLE) AS day FROM orders",
    "aggregates": "SELECT o_orderstatus, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS over FROM orders GROUP BY o_orderstatus",
    "total_of_none": "SELECT COALESCE(SUM(o_totalprice), CAST(0 AS DOUBLE)) AS total, COUNT(*) AS n FROM orders WHERE o_totalprice < 0",
    "scalar_functions": "SELECT c_custkey, UPPER(SUBSTR(c_name, 1, 4)) AS head, LENGTH(c_name) AS n, CAST(ABS(ROUND(CAST(c_acctbal AS DECIMAL(12,2)), 0)) AS DOUBLE) AS size, IFNULL(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS segment, REPLACE(c_name, 'Customer', 'C') AS short, TRIM(LOWER(c_mktsegment)) AS lower, printf('%05d', c_custkey) AS padded, c_mktsegment || '|' || c_name AS joined FROM customer",
    "glob_match": "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '^Customer#0*[1-4][0-9]?$')",
    "json_props": "SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type",
    "multiset_diff": "SELECT y, o_orderstatus, COUNT(*) AS n FROM (SELECT year(o_orderdate) AS y, o_orderstatus FROM orders EXCEPT ALL SELECT year(o_orderdate), o_orderstatus FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1, 2",
}


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float, bool)) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({names})"


_SINGULAR = "CASE WHEN regexp_matches(t, '^.{3,}ies$') THEN regexp_replace(t, 'ies$', 'y') WHEN regexp_matches(t, '^.{3,}es$') THEN regexp_replace(t, 'es$', '') WHEN regexp_matches(t, '^.{3,}s$') THEN regexp_replace(t, 's$', '') ELSE t END"


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def _counts(source: str, key: str, text: str) -> str:
    """(key, token, tf) of a table in SQL."""
    return f"(SELECT k AS {key}, token, COUNT(*) AS tf FROM (SELECT k, t AS token FROM (SELECT {key} AS k, unnest({_tokens(text)}) AS t FROM {source}) UNION ALL SELECT k, {_SINGULAR} FROM (SELECT {key} AS k, unnest({_tokens(text)}) AS t FROM {source}) WHERE {_SINGULAR} <> t) GROUP BY 1, 2)"


def _bm25_sql(docs: str, doc: str, text: str, queries: str, query: str, question: str, k: int) -> str:
    return f"""
WITH counts AS {_counts(docs, doc, text)}, wanted AS {_counts(queries, query, question)},
dl AS (SELECT {doc}, SUM(tf) AS dl FROM counts GROUP BY 1), n AS (SELECT COUNT(*) AS n, (SELECT SUM(dl) FROM dl) / COUNT(*) AS avgdl FROM {docs}),
idf AS (SELECT token, ln(n - COUNT(*) + 0.5) - ln(COUNT(*) + 0.5) AS idf FROM counts, n GROUP BY token, n), f AS (SELECT AVG(idf) * 0.25 AS floor FROM idf),
scored AS (SELECT w.{query}, c.{doc}, ROUND(SUM(w.tf * (CASE WHEN idf < 0 THEN floor ELSE idf END) * c.tf * 2.5 / (c.tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM counts c JOIN wanted w USING (token) JOIN idf USING (token) JOIN dl USING ({doc}), n, f GROUP BY 1, 2)
SELECT * FROM (SELECT {query}, {doc}, score, ROW_NUMBER() OVER (PARTITION BY {query} ORDER BY score DESC, {doc}) AS rank FROM scored WHERE score > 0) WHERE rank <= {k}"""


_DOCS, _QUESTIONS = _values(corpus.DOCUMENTS, "source, text"), _values(corpus.QUESTIONS, "qid, question")
_LINES = f"(SELECT source, i, line, SUM(CASE WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY i) AS c FROM (SELECT source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {_DOCS}))"
_CHUNKS = f"(SELECT source || '::chunk' || (c - 1) AS chunk_id, source, trim(string_agg(line, chr(10) ORDER BY i), chr(10) || ' ') AS content FROM {_LINES} GROUP BY source, c)"
_RULES = " || ".join(f"CASE WHEN regexp_matches(lower(line), '{r}') THEN '{n},' ELSE '' END" for n, r in retrieval.RULES.items())


def _chunks(spark):
    return corpus.chunks(corpus.documents(spark))


def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark)


def corpus_manifest(spark, d):
    return corpus.manifest(corpus.documents(spark))


def token_df(spark, d):
    return retrieval.token_counts(table(spark, d, "documents"), "doc_id", "text").groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def stem_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(C.stems(F.col("text")), " ").alias("stems"))


def bm25_topk(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), 10, "doc_id", "text", "item_id", "text")


def bm25_corpus(spark, d):
    return retrieval.bm25(_chunks(spark), corpus.questions(spark), 4)


def entity_expand(spark, d):
    return retrieval.expand_entities(_chunks(spark), corpus.questions(spark))


def definition_expand(spark, d):
    return retrieval.expand_definitions(_chunks(spark), corpus.questions(spark))


def retrieve_chunks(spark, d):
    return retrieval.retrieve(_chunks(spark), corpus.questions(spark)).orderBy("qid", F.desc("score"), "chunk_id")


def quarantine_lines(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    return retrieval.quarantine(texts.unionByName(_chunks(spark).select("chunk_id", "content"))).drop("line_no")


def date_windows(spark, d):
    return constraints.date_windows(_chunks(spark))


def kpi_formulas(spark, d):
    return constraints.kpi_formulas(_chunks(spark))


def reporting_groups(spark, d):
    return constraints.reporting_groups(_chunks(spark))


def policy_facts(spark, d):
    return constraints.policy_facts(_chunks(spark))


def route_labels(spark, d):
    columns = {t: table(spark, d, t).columns for t in pipeline.TABLES}
    return constraints.routes(corpus.questions(spark), _chunks(spark), corpus.documents(spark), list(columns), [c for cs in columns.values() for c in cs])


def resolved_windows(spark, d):
    return constraints.resolved_windows(_chunks(spark), corpus.questions(spark), corpus.documents(spark)).drop("used")


def planned_constraints(spark, d):
    columns = {t: table(spark, d, t).columns for t in pipeline.TABLES}
    return constraints.plans(_chunks(spark), corpus.questions(spark), corpus.documents(spark), columns).select("qid", "route", "blocker", "constraints", F.array_join("used_chunks", ",").alias("used_chunks"))


#: Questions in several wordings, put beside the opening turns, which are all unlike each other in generated tables.
ASKED = [("a1", "How many orders are there in total?"), ("a2", "how many orders are there, in TOTAL"), ("a3", "How many open orders are there in total?"), ("a4", "Revenue of heavy parts in Harvest Sale 1997"), ("a5", "Revenue of all heavy parts in Harvest Sale 1997. Return a float.")]


def jaccard_pairs(spark, d):
    """Opening turns of conversations, and questions, whose words overlap with another's by 0.8 or more: pairs of different
    word sets, each named by its smallest key and with the number of texts that have it."""
    turns = table(spark, d, "conversations").filter("turn = 0 AND conv_id IS NOT NULL").select(F.col("conv_id").cast("string").alias("qid"), F.col("text").alias("question"))
    pairs, members = retrieval.similar_sets(turns.unionByName(spark.createDataFrame(ASKED, "qid string, question string")), 0.8)
    sizes = members.groupBy("set").agg(F.count("*").alias("n"))
    of = lambda x: sizes.select(F.col("set").alias(x), F.col("n").alias("n_" + x))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "overlap", "n_a", "n_b")


def typed_answer_json(spark, d):
    return answers.built(relational.revenue_topk_supplier(spark, d).select("supplier", F.col("revenue").cast("double").alias("revenue"), "s_suppkey"), "list[{supplier:str,revenue:float}]", [-F.col("revenue"), F.col("s_suppkey")])


_CHECKS = [("a", True, "orders", "orders", "c1", "c1,c2", True, 3), ("b", False, "orders,part", "orders", "c3", "c1", True, 0), ("c", True, "", "orders", "c1", "c1", False, 0)]


def validator_failures(spark, d):
    rows = [(q, ok, c.split(",") if c else [], e.split(","), k.split(","), s.split(","), num, n) for q, ok, c, e, k, s, num, n in _CHECKS]
    return answers.failures(spark.createDataFrame(rows, "qid string, format_ok boolean, cited array<string>, expected array<string>, chunks array<string>, seen array<string>, numeric boolean, n_rows int"))


_CASES = [("plain", {}, 0), ("repaired", {"repairs": 2, "rewrites": 1}, 0), ("empty", {"no_rows": 1, "repairs": 2, "disagrees": 1, "rag": 1, "baseline": 1}, 0), ("open", {"open_choices": 1}, 0), ("invented", {"approximated": 0}, 1)]


def confidence_rubric(spark, d):
    rows = [(q, *(f.get(c, 0) for c in answers.CONFIDENCE), i) for q, f, i in _CASES]
    return answers.confidence(spark.createDataFrame(rows, "qid string, " + ", ".join(f"{c} int" for c in answers.CONFIDENCE) + ", invented int"))


_CELLS = [("1.004", "1.0"), ("1.02", "1.0"), (None, None), (None, "x"), ("a  b", "a b"), ("A", "a"), ("12", "12.00"), ("x", "x ")]


def cell_tolerance(spark, d):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_CELLS)], "i int, a string, b string")
    return df.select("i", C.cells_equal(F.col("a"), F.col("b")).alias("same"))


def recall_grid(spark, d):
    """How often BM25 over documents finds those that contain a benchmark item, by depth."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    hits = retrieval.bm25(docs, items, 5, "doc_id", "text", "item_id", "text").select(F.col("item_id").alias("qid"), F.col("doc_id").alias("chunk_id"), "rank")
    # Gold comes from all documents, not from hits.
    gold = retrieval.containing(docs, items, "doc_id", "text", "item_id", "text").select(F.col("item_id").alias("qid"), F.col("doc_id").alias("chunk_id"))
    return evaluation.recall_grid(gold, hits, [1, 2, 3, 5])


def confusion(spark, d):
    return evaluation.confusion(evaluation.outcomes(spark))


def calibration(spark, d):
    return evaluation.calibration(evaluation.outcomes(spark))


def config_ranking(spark, d):
    return evaluation.ranking(spark.createDataFrame(evaluation.RUNS, "config string, seed int, score double, calls int, disqualified boolean"))


def label_profile(spark, d):
    return tables.label_profile(spark, d, [("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"), ("nation", "n_name")])


def row_counts(spark, d):
    return tables.row_counts(spark, d, tables.TABLES)


def column_owners(spark, d):
    return tables.column_owners(spark, d, tables.TABLES)


#: A call into Java, where a statement may hide one.
_PROBE = "reflect('java.lang.System', 'setProperty', 'lodestone.probe', 'hit')"
_STATEMENTS = [
    ("plain", "SELECT COUNT(*) FROM orders"), ("semicolon", "SELECT 1;"), ("cte", "WITH x AS (SELECT * FROM orders) SELECT COUNT(*) FROM x JOIN part ON 1 = 1"), ("subquery", "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"),
    ("literal", "SELECT 'DELETE FROM x; DROP' AS a"), ("replace", "SELECT REPLACE('a', 'a', 'b') AS a"), ("delete", "DELETE FROM orders"), ("drop", "DROP TABLE orders"), ("two", "SELECT 1; DELETE FROM orders"), ("explain", "EXPLAIN SELECT 1"),
    ("cte_insert", "WITH x AS (SELECT 1) INSERT INTO orders SELECT * FROM x"), ("reflect", "SELECT reflect('java.lang.System', 'getProperty', 'user.name')"), ("quoted_reflect", "SELECT `reflect`('java.lang.System', 'getProperty', 'user.name')"), ("file", "SELECT * FROM parquet.`/tmp/x`"), ("unknown_table", "SELECT * FROM nowhere"), ("unknown_column", "SELECT nothing FROM orders"),
    ("ambiguous", "SELECT n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey"), ("bare", "SELECT c_name, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    ("window", f"SELECT SUM(o_orderkey) OVER w AS x FROM orders WINDOW w AS (PARTITION BY {_PROBE})"), ("window_fine", "SELECT SUM(o_orderkey) OVER w AS x FROM orders WINDOW w AS (PARTITION BY o_custkey)"),
    ("pivot", f"SELECT * FROM (SELECT o_orderstatus AS s, o_totalprice AS p FROM orders) PIVOT (SUM(p) FOR s IN ({_PROBE} AS a))"), ("pivot_aggregate", f"SELECT * FROM (SELECT o_orderstatus AS s, o_totalprice AS p FROM orders) PIVOT (MAX({_PROBE}) FOR s IN ('F' AS f))"),
    ("pivot_fine", "SELECT * FROM (SELECT o_orderstatus AS s, o_totalprice AS p FROM orders) PIVOT (SUM(p) FOR s IN ('F' AS f))"), ("lateral", f"SELECT o_orderkey, x FROM orders, LATERAL (SELECT {_PROBE} AS x)"),
    ("lateral_view", f"SELECT x FROM orders LATERAL VIEW explode(array({_PROBE})) t AS x"), ("values", f"SELECT x FROM VALUES (1), (length({_PROBE})) AS t(x)"), ("hint", f"SELECT /*+ REPARTITION({_PROBE}) */ o_orderkey FROM orders"),
    ("hint_fine", "SELECT /*+ REPARTITION(3, o_custkey) */ o_orderkey FROM orders"), ("grouping_sets", f"SELECT COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_custkey), ({_PROBE}))"), ("lambda", f"SELECT transform(array(1), x -> {_PROBE}) AS a FROM orders"),
    ("filter_clause", f"SELECT COUNT(*) FILTER (WHERE {_PROBE} = 'x') AS n FROM orders"), ("range_argument", f"SELECT id FROM range(length({_PROBE}))"), ("unpivot_fine", "SELECT k, v FROM (SELECT p_size AS a, p_partkey AS b FROM part) UNPIVOT (v FOR k IN (a, b))"),
]


def guard_verdicts(spark, d):
    tables.register(spark, d, pipeline.TABLES)
    rows = []
    for name, statement in _STATEMENTS:
        why = sqls.verdict(spark, statement)
        error = None if why else sqls.static_error(spark, statement)
        rows.append((name, why, error, None if why or error else ",".join(sqls.footprint(spark, statement)), ",".join(sqls.grain_safe(spark, statement)[1]) if not why else ""))
    return spark.createDataFrame(rows, "name string, rejected string, error string, tables string, rewrites string")


_CHOICES = [("open", "Orders over time", "SELECT year(l_shipdate) AS y, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"), ("named", "Lines by l_shipdate", "SELECT year(l_shipdate) AS y, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"), ("single", "Orders by date", "SELECT year(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY 1")]


def interpretive_choices(spark, d):
    tables.register(spark, d, pipeline.TABLES)
    return spark.createDataFrame([(n, ";".join(f"{c} or {o}" for c, o in sqls.open_choices(spark, s, q))) for n, q, s in _CHOICES], "name string, choices string")


def schema_text(spark, d):
    return spark.createDataFrame([(x,) for x in tables.rendered(spark, d, pipeline.TABLES).split("\n")], "line string")


def answered_questions(spark, d):
    return pipeline.run(spark, d).withColumns({"tables": F.array_join("tables", ","), "chunks": F.array_join("chunks", ",")}).drop("packet")


_TEXT = {
    f.__name__: f for f in (
        chunk_markdown, corpus_manifest, token_df, stem_tokens, bm25_topk, bm25_corpus, entity_expand, definition_expand, retrieve_chunks, quarantine_lines, date_windows, kpi_formulas, reporting_groups, policy_facts, route_labels,
        resolved_windows, planned_constraints, jaccard_pairs, typed_answer_json, validator_failures, confidence_rubric, cell_tolerance, recall_grid, confusion, calibration, config_ranking, label_profile, row_counts, column_owners, guard_verdicts, interpretive_choices, schema_text, answered_questions,
    )
}


_ENTITY = "((?:[A-Z][a-z]+ ){1,4}(?:19|20)[0-9]{2})"
_NAMED = f"(SELECT DISTINCT qid, chunk_id FROM (SELECT qid, unnest(regexp_extract_all(question, '{_ENTITY}')) AS e FROM {_QUESTIONS}) JOIN (SELECT chunk_id, unnest(regexp_extract_all(content, '{_ENTITY}')) AS f FROM {_CHUNKS}) ON lower(e) = lower(f))"


def _stems_sql(text: str) -> str:
    """The distinct words of a text in the singular."""
    return f"list_sort(list_distinct(list_transform({_tokens(text)}, lambda t: {_SINGULAR})))"


_HEADINGS = f"(SELECT chunk_id, unnest(list_concat([trim(regexp_replace(regexp_replace(h, '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g'))], list_transform(regexp_extract_all(h, '\\(([^)]*)\\)', 1), lambda x: trim(x)))) AS v FROM (SELECT chunk_id, trim(regexp_extract(content, '^#{{1,6}}\\s+([^\\n]*)', 1)) AS h FROM {_CHUNKS}))"
_DEFINED = f"(SELECT DISTINCT qid, chunk_id FROM (SELECT chunk_id, {_stems_sql('v')} AS need FROM {_HEADINGS} WHERE length(v) >= 3 AND NOT regexp_matches(v, '^[0-9]+$')) JOIN (SELECT qid, {_stems_sql('question')} AS have FROM {_QUESTIONS}) ON len(need) > 0 AND len(list_intersect(need, have)) = len(need))"
_DOC_LINES = f"(SELECT chunk_id, unnest(string_split(content, chr(10))) AS line FROM {_CHUNKS})"
#: What the fixture corpus, its questions and _STATEMENTS say, read by hand.
_EXPECTED = {
    "policy_facts": ("chunk_id, subject, members, low, high", [("policy::chunk1", "Perishables", "Fruit, Dairy", 3, 7), ("policy::chunk1", "Unopened parts", "", 14, 14), ("policy::chunk1", "Opened parts", "", 0, 0), ("policy::chunk1", "Engines", "", 30, 30)]),
    "route_labels": ("qid, route", [("q1", "hybrid"), ("q2", "hybrid"), ("q3", "hybrid"), ("q4", "rag"), ("q5", "sql"), ("q6", "hybrid")]),
    "interpretive_choices": ("name, choices", [("open", "l_shipdate or o_orderdate"), ("named", ""), ("single", "")]),
    "guard_verdicts": ("name, rejected, error, tables, rewrites", [
        ("plain", None, None, "orders", ""), ("semicolon", None, None, "", ""), ("cte", None, None, "orders,part", ""), ("subquery", None, None, "customer,orders", ""), ("literal", None, None, "", ""), ("replace", None, None, "", ""),
        ("delete", "not a query", None, None, ""), ("drop", "not a query", None, None, ""), ("two", "more than one statement", None, None, ""), ("explain", "not a query", None, None, ""), ("cte_insert", "not read-only", None, None, ""),
        ("reflect", "reaches outside of the tables", None, None, ""), ("quoted_reflect", "reaches outside of the tables", None, None, ""), ("file", "reaches outside of the tables", None, None, ""), ("unknown_table", None, "TABLE_OR_VIEW_NOT_FOUND", None, ""),
        ("unknown_column", None, "UNRESOLVED_COLUMN.WITH_SUGGESTION", None, ""), ("ambiguous", None, "AMBIGUOUS_REFERENCE", None, ""), ("bare", None, "MISSING_AGGREGATION", None, "any_value(c_name)"),
        ("window", "reaches outside of the tables", None, None, ""), ("pivot", "reaches outside of the tables", None, None, ""), ("pivot_aggregate", "reaches outside of the tables", None, None, ""), ("lateral", "reaches outside of the tables", None, None, ""), ("lateral_view", "reaches outside of the tables", None, None, ""), ("values", "reaches outside of the tables", None, None, ""), ("grouping_sets", "reaches outside of the tables", None, None, ""), ("lambda", "reaches outside of the tables", None, None, ""), ("filter_clause", "reaches outside of the tables", None, None, ""), ("range_argument", "reaches outside of the tables", None, None, ""),
        ("window_fine", None, None, "orders", ""), ("pivot_fine", None, None, "orders", ""), ("hint_fine", None, None, "orders", ""), ("unpivot_fine", None, None, "part", ""), ("hint", "reaches outside of the tables", None, None, ""),
    ]),
    "sql_rewrites": ("name, notes", [("label", "c_name -> c_custkey,any_value(c_name)"), ("keyed", ""), ("last_day", "day of o_orderdate"), ("half_open", ""), ("garbled", "GRUOP -> GROUP"), ("sound", ""), ("swapped", "SELCT -> SELECT,FORM -> FROM"), ("longer", "BETWEWEN -> BETWEEN"), ("three", "FORM -> FROM,WEHRE -> WHERE,ODER -> ORDER")]),
}
_GRAIN = "ENTITY GRAIN: one row a key; names are shown, not grouped by"
_DATES = "DATES: both ends are included; a date with a time of day counts as its day"
_COLUMNS = "COLUMN: l_extendedprice of lineitem\nCOLUMN: l_discount of lineitem"
_PLANNED = [
    ("q1", "hybrid", None, f"ROUTE: hybrid\nDATE WINDOW: harvest sale 1997 1997-06-01 to 1997-06-30\n{_DATES}\nFORMULA: Revenue = SUM(l_extendedprice * (1 - l_discount))\n{_COLUMNS}\nREPORTING GROUP: Heavy = Large, Standard\n{_GRAIN}", "campaigns::chunk1,catalog::chunk1,memo::chunk0,metrics::chunk3"),
    ("q2", "hybrid", None, f"ROUTE: hybrid\nDATE WINDOW: frost sale 1998 1998-12-01 to 1998-12-31\n{_DATES}\nFORMULA: AOV = SUM(l_extendedprice * (1 - l_discount)) / COUNT(DISTINCT o_orderkey)\n{_COLUMNS}\nCOLUMN: o_orderkey of orders\n{_GRAIN}", "campaigns::chunk2,metrics::chunk1"),
    ("q3", "hybrid", "no column for CostOfGoods", f"ROUTE: hybrid\nFORMULA: GM = SUM(l_extendedprice * (1 - l_discount) - CostOfGoods)\n{_COLUMNS}\nMISSING: CostOfGoods\n{_GRAIN}", "metrics::chunk2"),
    ("q4", "rag", None, "ROUTE: rag", ""), ("q5", "sql", None, f"ROUTE: sql\n{_GRAIN}", ""), ("q6", "hybrid", None, f"ROUTE: hybrid\nFORMULA: Revenue = SUM(l_extendedprice * (1 - l_discount))\n{_COLUMNS}\n{_GRAIN}", "metrics::chunk3"),
]
#: Statements with what they need before they run.
_REWRITTEN = [
    ("label", "SELECT c_name, COUNT(*) AS n FROM customer GROUP BY c_name"), ("keyed", "SELECT c_name, COUNT(*) AS n FROM customer GROUP BY c_custkey, c_name"), ("last_day", "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate <= '1997-06-30'"),
    ("half_open", "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate < '1997-07-01'"), ("garbled", "SELECT c_name FROM customer GRUOP BY c_name"), ("sound", "SELECT o_orderdate - INTERVAL 1 DAY AS groups FROM orders"),
    ("swapped", "SELCT COUNT(*) FORM orders"), ("longer", "SELECT c_name FROM customer WHERE c_custkey BETWEWEN 1 AND 2"), ("three", "SELECT c_name FORM customer WEHRE c_custkey > 3 ODER BY c_name"),
]


def sql_rewrites(spark, d):
    """Which rewrites statements get: repair where Spark refuses, labels to keys, any_value, whole days."""
    tables.register(spark, d, pipeline.TABLES)
    rows = []
    for name, statement in _REWRITTEN:
        statement, notes = sqls.repaired(spark, statement)
        for rewrite in () if notes else (lambda s: sqls.by_key(spark, s, {"c_name": "c_custkey"}), lambda s: sqls.grain_safe(spark, s), lambda s: sqls.whole_days(spark, s)):
            statement, more = rewrite(statement)
            notes += more
        rows.append((name, ",".join(notes)))
    return spark.createDataFrame(rows, "name string, notes string")


#: Lines by part, the part named in several ways; names of parts are not unique.
_BY_NAME = {
    "direct": "SELECT p_name AS part, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name",
    "alias": "SELECT p_name AS part, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY part",
    "ordinal": "SELECT p_name AS part, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "cte": "WITH sold AS (SELECT p_name AS part, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT part, COUNT(*) AS n FROM sold GROUP BY part",
    "cte_with_key": "WITH sold AS (SELECT p_partkey, p_name AS part FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT x.part, COUNT(*) AS n FROM sold x GROUP BY x.part",
    "derived": "SELECT part, COUNT(*) AS n FROM (SELECT item AS part FROM (SELECT p_name AS item, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE l_quantity > 0) GROUP BY part",
    "derived_ordinal": "SELECT part, COUNT(*) AS n FROM (SELECT p.p_name AS part FROM lineitem JOIN part p ON l_partkey = p.p_partkey) y GROUP BY 1",
}
#: Orders until a day, with a time of day under several names.
_NOON = "(SELECT o_orderkey, o_orderstatus, o_orderdate + INTERVAL 12 HOUR AS at FROM orders)"
_UNTIL = {
    "direct": f"SELECT o_orderstatus AS status, COUNT(*) AS n FROM {_NOON} WHERE at <= '1997-06-30' GROUP BY o_orderstatus",
    "cte": f"WITH x AS (SELECT at AS placed, o_orderstatus FROM {_NOON}) SELECT o_orderstatus AS status, COUNT(*) AS n FROM x WHERE placed <= '1997-06-30' GROUP BY o_orderstatus",
    "derived": f"SELECT status, COUNT(*) AS n FROM (SELECT y.at AS placed, o_orderstatus AS status FROM {_NOON} y) z WHERE '1997-06-30' >= z.placed GROUP BY status",
    "between": f"SELECT status, COUNT(*) AS n FROM (SELECT at AS placed, o_orderstatus AS status FROM {_NOON}) WHERE placed BETWEEN '1900-01-01' AND '1997-06-30' GROUP BY status",
    "case": f"WITH x AS (SELECT at AS placed, o_orderstatus FROM {_NOON}) SELECT o_orderstatus AS status, SUM(CASE WHEN placed <= '1997-06-30' THEN 1 ELSE 0 END) AS n FROM x GROUP BY o_orderstatus",
}


def keyed_groups(spark, d):
    """The rows of _BY_NAME, grouped by the key instead of the name, wherever the name comes from."""
    tables.register(spark, d, ["lineitem", "part"])
    found = []
    for form, statement in _BY_NAME.items():
        statement = sqls.grain_safe(spark, sqls.by_key(spark, statement, {"p_name": "p_partkey"})[0])[0]
        found.append(spark.sql(statement).select(F.lit(form).alias("form"), "part", "n"))
    return reduce(DataFrame.unionAll, found)


def whole_day_counts(spark, d):
    """The rows of _UNTIL, the last day included whole."""
    tables.register(spark, d, ["orders"])
    return reduce(DataFrame.unionAll, (spark.sql(sqls.whole_days(spark, s)[0]).select(F.lit(form).alias("form"), "status", "n") for form, s in _UNTIL.items()))


def closest_turns(spark, d):
    """For every opening turn of a conversation the later turn of a user whose words overlap most with its own."""
    turns = table(spark, d, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    opening = turns.filter("turn = 0").select(F.col("conv_id").cast("string").alias("qid"), F.col("text").alias("question"))
    later = turns.filter("turn > 0 AND role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("qid"), F.col("text").alias("question"))
    return evaluation.closest(opening, later)


def formula_operands(spark, d):
    """Operands that no table has, of one formula for every type of part."""
    types = table(spark, d, "part").select("p_type").distinct()
    rate = F.concat(F.lower("p_type"), F.lit("_rate"))
    text = F.concat(F.lit("SUM(l_extendedprice * (1 - l_discount) * "), rate, F.lit(") / NULLIF(COUNT(DISTINCT l_orderkey), 0) + CASE WHEN p_type = 'LARGE' THEN "), F.initcap("p_type"), F.lit("Bonus ELSE 0 END"))
    formulas = types.select(F.col("p_type").alias("qid"), F.lit("rated revenue").alias("name"), text.alias("expression"))
    return constraints.missing_fields(formulas, [c for t in pipeline.TABLES for c in table(spark, d, t).columns])


def schema_findings(spark, d):
    """What is wrong with a statement that misspells every column of a table, and asks for it under a name that isn't there."""
    tables.register(spark, d, pipeline.TABLES)
    rows = []
    for t in pipeline.TABLES:
        statement = f"SELECT {', '.join(f'x.{c}_x, y.{c}, x.{c}' for c in spark.table(t).columns)} FROM {t} x WHERE {t}_z > 0 AND EXISTS (SELECT 1 FROM {t}_y WHERE x.{t}_w = 1)"
        rows += [(t, p.kind, p.name) for p in schema_problems(spark, statement)]
    return spark.createDataFrame(rows, "table_name string, kind string, name string")


_TEXT |= {f.__name__: f for f in (closest_turns, formula_operands, schema_findings, sql_rewrites, keyed_groups, whole_day_counts)}


def queries() -> dict:
    return {name: getattr(relational, name) for name in RELATIONAL} | _TEXT


def _answers_sql() -> str:
    """The registered questions' records, with answers computed from the tables."""
    window = "CAST(o_orderdate AS DATE) BETWEEN DATE '{}' AND DATE '{}'"
    heavy = f"SELECT CAST(ROUND(CAST({REVENUE} AS DECIMAL(28,8)), 2) AS DOUBLE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE {window.format('1997-06-01', '1997-06-30')} AND p_type IN ('LARGE', 'STANDARD')"
    value = f"SELECT ROUND(CAST({REVENUE} AS DOUBLE) / COUNT(DISTINCT o_orderkey), 2) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {window.format('1998-12-01', '1998-12-31')}"
    best = f"SELECT '[' || string_agg('{{\"revenue\": ' || CAST(r AS VARCHAR) || ', \"supplier\": \"' || s || '\"}}', ', ' ORDER BY r DESC, k) || ']' FROM (SELECT s_suppkey AS k, MIN(s_name) AS s, CAST(ROUND(CAST({REVENUE} AS DECIMAL(28,8)), 2) AS DOUBLE) AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY {REVENUE} DESC, 1 LIMIT 3)"
    rows = [
        ("q1", "hybrid", "answered", f"CAST(({heavy}) AS VARCHAR)", "lineitem,orders,part", _PLANNED[0][4], 0.55, "o_orderdate and not l_shipdate", None), ("q2", "hybrid", "answered", f"CAST(({value}) AS VARCHAR)", "lineitem,orders", _PLANNED[1][4], 0.65, "o_orderdate and not l_shipdate", None),
        ("q3", "hybrid", "needs_review", "NULL", "", "", None, "", "no column for CostOfGoods"), ("q4", "rag", "answered", "'7'", "", "policy::chunk1", 0.65, "", None), ("q5", "sql", "answered", "CAST((SELECT COUNT(*) FROM orders) AS VARCHAR)", "orders", "", 0.75, "", None),
        ("q6", "hybrid", "answered", f"({best})", "lineitem,supplier", "metrics::chunk3", 0.7, "", None),
    ]
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, float) else f"'{v}'"
    return " UNION ALL ".join(f"SELECT {lit(q)} AS qid, {lit(r)} AS route, {lit(s)} AS status, {a} AS answer, {lit(t)} AS tables, {lit(c)} AS chunks, CAST({lit(n)} AS DOUBLE) AS confidence, 0 AS repairs, {lit(x)} AS assumptions, {lit(v)} AS review" for q, r, s, a, t, c, n, x, v in rows)


def _schema_sql(names: list[str]) -> str:
    """The rendering of tables that are not empty."""
    keys = ", ".join(f"'{t}.{c}'" for t in names for c in tables.PRIMARY_KEYS[t])
    kind = "CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'int' WHEN data_type = 'DOUBLE' THEN 'num' WHEN data_type = 'VARCHAR' THEN 'txt' ELSE 'date' END"
    column = f"column_name || ':' || {kind} || CASE WHEN table_name || '.' || column_name IN ({keys}) THEN '*' ELSE '' END"
    joins = _values([(f"JOIN {a}.{b} = {c}.{d}",) for a, b, c, d in tables.FOREIGN_KEYS if a in names and c in names], "line")
    return f"SELECT table_name || '(' || string_agg({column}, ', ' ORDER BY ordinal_position) || ')' AS line FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in names)}) GROUP BY table_name UNION ALL SELECT * FROM {joins}"


def oracle_sql() -> dict[str, str]:
    label = lambda t, c: f"SELECT '{t}.{c}' AS label, COUNT(*) AS n, COUNT(DISTINCT {c}) AS n_distinct, COUNT(DISTINCT {c}) < COUNT(*) AND COUNT(DISTINCT {c}) >= 0.9 * COUNT(*) AS collides FROM {t}"
    cells = _values([(i, a, b) for i, (a, b) in enumerate(_CELLS)], "i, a, b")
    outcomes = _values(evaluation.OUTCOMES, "id, label, predicted, confidence, correct, answered")
    runs = _values(evaluation.RUNS, "config, seed, score, calls, disqualified")
    cents = " - ".join(["75", *(f"{c} * {round(v * 100)}" for c, v in answers.CONFIDENCE.items())])
    cases = _values([(q, *(f.get(c, 0) for c in answers.CONFIDENCE), i) for q, f, i in _CASES], "qid, " + ", ".join(answers.CONFIDENCE) + ", invented")
    words = "list_sort(list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(text), '\\breturn\\b.*$', ''), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')))"
    turns = f"(SELECT key, {words} AS w FROM (SELECT CAST(conv_id AS VARCHAR) AS key, text FROM conversations WHERE turn = 0 AND conv_id IS NOT NULL UNION ALL SELECT * FROM {_values(ASKED, 'key, text')}))"
    later = f"(SELECT conv_id || ':' || turn AS key, {words} AS w FROM conversations WHERE conv_id IS NOT NULL AND turn > 0 AND role = 'user')"
    opening = f"(SELECT CAST(conv_id AS VARCHAR) AS key, {words} AS w FROM conversations WHERE conv_id IS NOT NULL AND turn = 0)"
    shared = "len(list_intersect(a.w, b.w)) / greatest(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 1)"
    named = f"SELECT table_name, column_name AS c FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in pipeline.TABLES)})"
    overlap = "len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))"
    text = {
        "chunk_markdown": f"SELECT * FROM {_CHUNKS}",
        "corpus_manifest": f"SELECT source, sha256(text) AS sha256, chunk_ids FROM {_DOCS} JOIN (SELECT source, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_ids FROM {_CHUNKS} GROUP BY 1) USING (source)",
        "token_df": f"SELECT token, COUNT(*) AS df, CAST(SUM(tf) AS BIGINT) AS n FROM {_counts('documents', 'doc_id', 'text')} GROUP BY token",
        "stem_tokens": f"SELECT item_id, string_agg(DISTINCT s, ' ' ORDER BY s) AS stems FROM (SELECT item_id, {_SINGULAR} AS s FROM (SELECT item_id, unnest({_tokens('text')}) AS t FROM benchmark)) GROUP BY item_id",
        "bm25_topk": _bm25_sql("documents", "doc_id", "text", "benchmark", "item_id", "text", 10),
        "bm25_corpus": _bm25_sql(f"(SELECT * FROM {_CHUNKS})", "chunk_id", "content", f"(SELECT * FROM {_QUESTIONS})", "qid", "question", 4),
        "quarantine_lines": f"SELECT chunk_id, line, rtrim(rules, ',') AS rules FROM (SELECT chunk_id, line, {_RULES} AS rules FROM (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT chunk_id, unnest(string_split(content, chr(10))) FROM {_CHUNKS}) WHERE NOT regexp_matches(line, '^\\s*$|^\\s*#{{1,6}}\\s')) WHERE rules <> ''",
        "date_windows": f"SELECT chunk_id, source, name, kind, TRY_CAST(nullif(s, '') AS DATE) AS start_date, TRY_CAST(e AS DATE) AS end_date FROM (SELECT chunk_id, source, name, 'declared' AS kind, regexp_extract(content, '(?i)Dates:\\s*([0-9-]{{10}})\\s*(?:to|through|until|-|–|—)\\s*([0-9-]{{10}})', 1) AS s, regexp_extract(content, '(?i)Dates:\\s*([0-9-]{{10}})\\s*(?:to|through|until|-|–|—)\\s*([0-9-]{{10}})', 2) AS e FROM (SELECT *, lower(regexp_extract(content, '((?:[A-Z][a-z]+ ){{1,4}}(?:19|20)[0-9]{{2}})', 1)) AS name FROM {_CHUNKS}) UNION ALL SELECT chunk_id, source, name, 'revised', '', regexp_extract(content, '(?i)Revised end date:\\s*([0-9-]{{10}})', 1) FROM (SELECT *, lower(regexp_extract(content, '((?:[A-Z][a-z]+ ){{1,4}}(?:19|20)[0-9]{{2}})', 1)) AS name FROM {_CHUNKS})) WHERE e <> ''",
        "jaccard_pairs": f"WITH s AS (SELECT w, MIN(key) AS k, COUNT(*) AS n FROM {turns} WHERE len(w) > 0 GROUP BY w) SELECT a.k AS a, b.k AS b, ROUND({overlap}, 6) AS overlap, a.n AS n_a, b.n AS n_b FROM s a JOIN s b ON a.k < b.k WHERE ROUND({overlap}, 6) >= 0.8",
        "validator_failures": "SELECT * FROM (VALUES ('a', ''), ('b', 'format,tables,chunks,rows'), ('c', 'tables')) t(qid, failed)",
        "confidence_rubric": f"SELECT qid, CAST(LEAST(GREATEST(CASE WHEN invented > 0 THEN LEAST(c, 60) WHEN open_choices > 0 THEN LEAST(c, 75) ELSE c END, 5), 99) AS DOUBLE) / 100 AS confidence FROM (SELECT *, {cents} AS c FROM {cases})",
        "cell_tolerance": f"SELECT i, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL WHEN TRY_CAST(a AS DOUBLE) IS NOT NULL AND TRY_CAST(b AS DOUBLE) IS NOT NULL THEN abs(TRY_CAST(a AS DOUBLE) - TRY_CAST(b AS DOUBLE)) <= 0.01 ELSE trim(regexp_replace(a, '\\s+', ' ', 'g')) = trim(regexp_replace(b, '\\s+', ' ', 'g')) END AS same FROM {cells}",
        "recall_grid": f"WITH hits AS (SELECT * FROM ({_bm25_sql('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text', 5)})), gold AS (SELECT DISTINCT item_id, doc_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)) SELECT k, ROUND(COUNT(g.item_id) / (SELECT COUNT(*) FROM gold), 6) AS recall, ROUND(COUNT(*) / (SELECT COUNT(DISTINCT item_id) FROM gold), 6) AS mean_chunks FROM hits h JOIN (VALUES (1), (2), (3), (5)) t(k) ON h.rank <= k LEFT JOIN gold g ON g.item_id = h.item_id AND g.doc_id = h.doc_id GROUP BY k",
        "confusion": f"SELECT label, predicted, COUNT(*) AS n FROM {outcomes} GROUP BY 1, 2",
        "calibration": f"SELECT n, ROUND(a, 6) AS accuracy, ROUND(c, 6) AS confidence, ROUND(c - a, 6) AS gap FROM (SELECT COUNT(*) AS n, AVG(CASE WHEN correct THEN CAST(1 AS DOUBLE) ELSE 0 END) AS a, AVG(CAST(confidence AS DOUBLE)) AS c FROM {outcomes} WHERE answered)",
        "config_ranking": f"SELECT config, ROUND(AVG(CAST(score AS DOUBLE)), 6) AS mean, ROUND(CAST(MAX(score) - MIN(score) AS DOUBLE), 6) AS spread, AVG(CAST(calls AS DOUBLE)) AS calls FROM {runs} GROUP BY config HAVING NOT bool_or(disqualified)",
        "closest_turns": f"SELECT a.key AS train_id, b.key AS test_id, ROUND({shared}, 6) AS overlap FROM {opening} a, {later} b QUALIFY row_number() OVER (PARTITION BY a.key ORDER BY ROUND({shared}, 6) DESC, b.key) = 1",
        "formula_operands": "SELECT p_type AS qid, 'rated revenue' AS name, unnest([lower(p_type) || '_rate', upper(p_type[1]) || lower(p_type[2:]) || 'Bonus']) AS field FROM (SELECT DISTINCT p_type FROM part)",
        "schema_findings": f"SELECT table_name, kind, name FROM ({named}), LATERAL (SELECT 'column' AS kind, 'x.' || c || '_x' AS name UNION ALL SELECT 'qualifier', 'y.' || c) UNION ALL SELECT table_name, unnest(['column', 'table', 'column']), unnest([table_name || '_z', table_name || '_y', 'x.' || table_name || '_w']) FROM (SELECT DISTINCT table_name FROM ({named}))",
        "keyed_groups": f"SELECT form, part, n FROM (SELECT p_partkey, MIN(p_name) AS part, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey), {_values([(x,) for x in _BY_NAME], 'form')}",
        "whole_day_counts": f"SELECT form, status, n FROM (SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders WHERE CAST(o_orderdate + INTERVAL 12 HOUR AS DATE) <= DATE '1997-06-30' GROUP BY 1), {_values([(x,) for x in _UNTIL], 'form')}",
        "label_profile": " UNION ALL ".join(label(t, c) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"), ("nation", "n_name"))),
        "row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n FROM {t}" for t in tables.TABLES),
        "typed_answer_json": f"SELECT '[' || string_agg('{{\"supplier\":\"' || supplier || '\",\"revenue\":' || CAST(ROUND(CAST(revenue AS DECIMAL(28,8)), 2) AS DECIMAL(28,2)) || '}}', ',' ORDER BY revenue DESC, s_suppkey) || ']' AS answer FROM ({RELATIONAL['revenue_topk_supplier']})",
    }
    read = lambda rows, names: f"SELECT * FROM {_values(rows, names)}"
    text |= {name: read(rows, names) for name, (names, rows) in _EXPECTED.items()}
    owners = f"(SELECT column_name, list_sort(list(table_name)) AS o FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in tables.TABLES)}) GROUP BY 1)"
    text |= {
        "entity_expand": f"SELECT * FROM {_NAMED}",
        "definition_expand": f"SELECT * FROM {_DEFINED}",
        "retrieve_chunks": f"WITH hits AS (SELECT qid, chunk_id, score FROM ({text['bm25_corpus']})), named AS (SELECT * FROM {_NAMED}), defined AS (SELECT * FROM {_DEFINED}) SELECT qid, chunk_id, score, 'bm25' AS via FROM hits UNION ALL SELECT qid, chunk_id, 0, 'conflict-expansion' FROM named ANTI JOIN hits USING (qid, chunk_id) UNION ALL SELECT qid, chunk_id, 0, 'definition-expansion' FROM defined ANTI JOIN hits USING (qid, chunk_id) ANTI JOIN named USING (qid, chunk_id)",
        "kpi_formulas": f"SELECT chunk_id, trim(regexp_replace(f, '\\([^)]*\\)', '', 'g')) AS name, CASE WHEN regexp_matches(f, '(?i)legacy|retired') THEN 'legacy' WHEN regexp_matches(f, '(?i)current|effective') THEN 'current' ELSE 'unspecified' END AS label, expression FROM (SELECT chunk_id, regexp_extract(line, '^([A-Za-z][^=]{{1,80}}?)\\s*=\\s*(.+)$', 1) AS f, regexp_extract(line, '^([A-Za-z][^=]{{1,80}}?)\\s*=\\s*(.+)$', 2) AS expression FROM {_DOC_LINES}) WHERE f <> '' AND contains(expression, '(')",
        "reporting_groups": f"SELECT chunk_id, regexp_extract(line, 'group named ([A-Z][a-z]+)', 1) AS name, unnest(string_split(regexp_extract(line, '^(.*) are combined into a single', 1), ' and ')) AS member FROM {_DOC_LINES} WHERE contains(line, 'combined into a single reporting group')",
        "resolved_windows": "SELECT qid, name, CAST(a AS DATE) AS start_date, CAST(b AS DATE) AS end_date, conflict, status FROM " + _values([("q1", "harvest sale 1997", "1997-06-01", "1997-06-30", True, "revision claims precedence"), ("q2", "frost sale 1998", "1998-12-01", "1998-12-31", False, "no conflict")], "qid, name, a, b, conflict, status"),
        "planned_constraints": read(_PLANNED, "qid, route, blocker, constraints, used_chunks"),
        "column_owners": f"SELECT column_name, array_to_string(o, ',') AS owners, CASE WHEN len(o) = 1 THEN 'column of ' || o[1] || ' only' ELSE 'exists on ' || array_to_string(o, ', ') || ' - qualify' END AS advice FROM {owners}",
        "schema_text": _schema_sql(pipeline.TABLES),
        "answered_questions": _answers_sql(),
    }
    return RELATIONAL | text
