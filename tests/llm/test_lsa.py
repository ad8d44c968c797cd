import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lsa
from tests.llm.helpers import edges, empty, table


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 12))] for _ in range(2))
        tail = rng.randint(1, len(a))
        assert lsa.common_length(a, b, tail) == (lcs(a, b), lcs(a[-tail:], b))


def brute(docs, items):
    """Items whose words lie in a document one after another."""
    found = set()
    for d, t in docs:
        text = " " + " ".join(lsa.tokens(t)) + " "
        found |= {(d, i) for i, x in items if " " + " ".join(lsa.tokens(x)) + " " in text}
    return found


def test_planted_items_are_found(spark):
    docs, bench = table(spark, sf="sf0.01"), table(spark, "benchmark", "sf0.01")
    rows = lsa.leaks(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    want = brute(docs.select("doc_id", "text").collect(), bench.collect())
    assert want and want <= got
    texts, items = dict(docs.select("doc_id", "text").collect()), dict(bench.collect())
    for d, i in got - want:  # anything more must cover the item
        assert lcs(lsa.tokens(items[i]), lsa.tokens(texts[d])) >= 0.7 * len(lsa.tokens(items[i]))
    kept = {r["doc_id"] for r in lsa.without_leaks(docs, bench).collect()}
    assert kept == set(texts) - {d for d, _ in got}


def test_paraphrases(spark):
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark", "sf0.01").collect()]
    docs = table(spark, sf="sf0.001").filter("doc_id < 60").select("doc_id", "text").collect()
    rng, rows = random.Random(3), []
    for (d, t), (i, x) in zip(docs, items, strict=False):
        w = x.split()
        for k in rng.sample(range(len(w)), len(w) // 6):
            w[k] = rng.choice(["otherword", w[k] + " added", ""])
        rows.append((d, t + "\n" + " ".join(w) + "\n" + t[:300], i))
    df = spark.createDataFrame(rows, "doc_id long, text string, planted long")
    got = {(r["doc_id"], r["item_id"]) for r in lsa.leaks(df, table(spark, "benchmark", "sf0.01")).collect()}
    assert len({(d, i) for d, _, i in rows} & got) >= 0.95 * len(rows)


def planted(spark, lengths, changed, each=8):
    """(documents, items): item i of n words lies in document i, with every changed-th word replaced by another."""
    rng, docs, items = random.Random(6), [], []
    texts = [lsa.tokens(r["text"]) for r in table(spark, sf="sf0.01").orderBy("doc_id").limit(120).collect()]
    pool = sorted({w for t in texts for w in t})
    for n in lengths:
        for _ in range(each):
            words = rng.sample(pool, min(n, len(pool))) + rng.choices(pool, k=max(0, n - len(pool)))
            around, at = rng.choices(pool, k=1500), rng.randrange(1500)
            items.append((len(items), " ".join(words)))
            inside = [f"other{k}" if changed and k % changed == 1 else w for k, w in enumerate(words)]
            docs.append((len(docs), " ".join(around[:at] + inside + around[at:])))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_items_of_every_length(spark):
    for changed in (0, 6):
        docs, items = planted(spark, (3, 4, 10, 40, 220, 300, 600, 2000), changed)
        got = {(r["doc_id"], r["item_id"]) for r in lsa.leaks(docs, items, rank=32).collect()}
        missed = [n for i, n in enumerate(k for k in (3, 4, 10, 40, 220, 300, 600, 2000) for _ in range(8)) if (i, i) not in got]
        print("words changed", changed, "missed lengths", missed)
        # A third of three words changed leaves less than COVERED.
        assert set(missed) <= ({3} if changed else set())


def test_recall_by_rank(spark):
    """A lower rank proposes more, and loses none: equal words have equal places at any rank."""
    docs, items = planted(spark, (12, 30, 60), 7, each=50)
    for rank in (16, 64, 128):
        found = lsa.leaks(docs, items, rank=rank).filter("doc_id = item_id").count()
        print(f"rank {rank}: {found} of 150")
        assert found >= 140


def test_an_index_beyond_the_limit_is_refused(spark):
    with pytest.raises(ValueError, match="bytes"):
        lsa.leaks(table(spark), table(spark, "benchmark"), max_bytes=100_000)


def test_basis_spans_the_rows(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 80))
    rows = spark.createDataFrame([(list(range(80)), x.tolist()) for x in a], "terms array<int>, values array<float>").repartition(3)
    v = lsa.randomised_basis(rows, 80, 30)
    assert np.allclose(a @ v @ v.T, a, atol=1e-3)
    low = lsa.randomised_basis(rows, 80, 5, rounds=6)
    s = np.linalg.svd(a)[1]
    assert np.linalg.norm(a @ low) ** 2 > 0.97 * (s[:5] ** 2).sum()


def test_edges(spark):
    bench = spark.createDataFrame([(1, "same text here now"), (2, ""), (3, None), (None, "Same, text here now!")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = sorted(((r["doc_id"], r["item_id"]) for r in lsa.leaks(edges(spark), bench).collect()), key=repr)
    assert got == sorted([(4, 1), (4, 1), (5, 1), (4, None), (4, None), (5, None)], key=repr)
    assert lsa.leaks(empty(spark), bench).count() == 0
    assert lsa.leaks(edges(spark), bench.limit(0)).count() == 0
    assert lsa.without_leaks(edges(spark), bench).columns == edges(spark).columns
