import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from lodestone.llm import lsa, mixing, quality
from lodestone.llm.queries import vocabulary
from tests.llm.helpers import edges, empty, table, words
from tests.llm.test_overlap import shingles


def smallest_of_groups(docs):
    """The smallest id of each group of texts linked by a Jaccard similarity of their five-word shingles of 0.8 or more; all pairs are compared."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 0.8 * len(a) <= len(b) and 0.8 * len(b) <= len(a) and find(i) != find(j) and len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def test_stages_follow_each_other(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark)
    kept = {r["doc_id"] for r in quality.quality(docs).filter("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = [(d, texts[d]) for d in sorted(kept)]
    distinct = smallest_of_groups(first)
    bench = table(spark, "benchmark").collect()
    leaked = {d for d in distinct for b in bench if f" {' '.join(lsa.tokens(b['text']))} " in f" {' '.join(lsa.tokens(texts[d]))} "}
    third = docs.filter(docs.doc_id.isin([d for d in distinct - leaked]))
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mixed(third).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    want = Counter()
    for d, n in taken.items():
        ids = t.encode(texts[d], add_special_tokens=False).ids + [2]
        want[(d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += n
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == +want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_stages_keep_columns_and_survive_edges(spark):
    for docs in (edges(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, "").count()


def test_clean_documents_stay(spark):
    docs = table(spark, sf="sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "labels", "sf0.01").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.good_quality(spark, docs, "").collect()}
    good = [r["doc_id"] for r in docs.collect() if labels.get(r["doc_id"]) == 1 and len(words(r["text"])) >= 10]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    assert {r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, "").collect()} == smallest_of_groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_run_leaves_other_results_alone(spark):
    unread = mixing.mixed(table(spark))
    first = corpus_pipeline.good_quality(spark, table(spark), "")
    docs = spark.createDataFrame(first.collect(), first.schema)
    corpus_pipeline.distinct(spark, docs, "").count()  # deletes what the first stage wrote, nothing else
    assert unread.count() == table(spark).count()


def test_texts_travel_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for before, after in ((10000, 1000), (0, 1000), (7, 7)):
            spark.conf.set(name, before)
            for _, stage in corpus_pipeline.STAGES[3:]:
                stage(spark, empty(spark), "")
                assert int(spark.conf.get(name)) == after
    finally:
        spark.conf.unset(name)
