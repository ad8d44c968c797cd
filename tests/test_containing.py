import random
import re

import duckdb

from lodestone import queries
from lodestone.operators import answers, evaluation, retrieval


def test_phrases_are_found_letter_by_letter(spark):
    rng, words = random.Random(3), ["Alpha", "beta", "gamma,", "delta-x", "é", "12", "of", "of", "of"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(120)] + [(200, None), (201, ""), (202, "xAlphas beta gammas")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))) for i in range(60)] + [(90, ""), (91, None), (92, "pha beta gam"), (93, "nowhere to be found"), (94, "of"), (95, "of of o"), (95, "é é é"), (96, "lphas beta gamm")]
    want = {(i, d) for i, p in items if p for d, t in docs if t and p in t}
    got = retrieval.containing(spark.createDataFrame(docs, "d long, text string"), spark.createDataFrame(items, "i long, p string"), "d", "text", "i", "p").collect()
    assert {(r["i"], r["d"]) for r in got} == want and len(got) == len(want) > 30


def test_answers_agree_at_any_depth():
    same = [("14", "14.01"), ("{'a': 'x  y', 'b': 1.005}", '{"b": 1.0, "a": "x y"}'), ("[{'a': 1}, {'a': 2.01}]", '[{"a": 1.0}, {"a": 2.0}]'), ('{"a": {"b": [1, 2]}}', "{'a': {'b': (1, 2)}}"), ("'x'", '"x"'), ("None", "null"), ("True", "true")]
    other = [("14", "14.02"), ("[1, 2]", "[2, 1]"), ("[1]", "[1, 1]"), ('{"a": 1}', '{"b": 1}'), ("true", "1"), ('"1"', "1"), ("null", "0")]
    assert all(answers.agree(a, b) is True for a, b in same) and all(answers.agree(a, b) is False for a, b in other)
    assert answers.agree("about 14", "14") is None and answers.agree(None, "14") is None and answers.agree("14", "[" * 200_000) is None


def test_best_documents_with_repeated_and_missing_keys(spark):
    """Against SQL; neither scores nor pairs of document and query are shuffled."""
    rng, words = random.Random(5), ["ties", "tie", "boxes", "a", "b2", "c", "ss", "uses", "rare"]
    text = lambda n: " ".join(rng.choices(words, weights=range(9, 0, -1), k=rng.randrange(0, n)))
    docs = [(i, text(30)) for i in range(60)] + [(3, "rare rare"), (3, None), (4, "c uses"), (None, "a ties"), (None, "rare boxes"), (90, None)]
    items = [(f"q{i}", text(6)) for i in range(12)] + [("q12", None), ("q1", "rare")]
    d, q = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "q string, w string")
    con = duckdb.connect()
    con.execute("CREATE TABLE ds (d BIGINT, t VARCHAR)")
    con.execute("CREATE TABLE qs (q VARCHAR, w VARCHAR)")
    con.executemany("INSERT INTO ds VALUES (?, ?)", docs)
    con.executemany("INSERT INTO qs VALUES (?, ?)", items)
    want = con.execute(queries._bm25_sql("ds", "d", "t", "qs", "q", "w", 4)).fetchall()
    got = retrieval.bm25(d, q, 4, "d", "t", "q", "w")
    assert sorted((r["q"], r["d"], r["score"], r["rank"]) for r in got.collect()) == sorted(want) and len(want) > 10
    shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString())
    assert shuffles and not any(re.search(r"\bq#", x) and re.search(r"\b(d|_doc)#", x) for x in shuffles)


def test_recall_counts_repeated_gold(spark):
    gold = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1)], "qid string, chunk_id long")
    hits = spark.createDataFrame([("a", 1, 2), ("a", 5, 1), ("b", 1, 3), ("c", 1, 1)], "qid string, chunk_id long, rank int")
    got = evaluation.recall_grid(gold, hits, [1, 2, 3])
    assert sorted(map(tuple, got.collect())) == [(1, 0.0, 1.0), (2, 0.5, 1.5), (3, 0.75, 2.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # either side is read once
    assert evaluation.recall_grid(gold, hits.limit(0), [1]).count() == 0
