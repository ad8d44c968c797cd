from lodestone.llm import mixing
from tests.llm.helpers import edges, empty, rows, table, words


def test_sizes_targets_and_taken(spark):
    docs = table(spark, sf="sf0.01")
    got = {r["doc_id"]: r for r in mixing.mixed(docs).collect()}
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert got.keys() == texts.keys()
    sizes, taken, largest = {}, {}, {}
    for d, r in got.items():
        s = texts[d]["source"]
        assert r["size"] == len(words(texts[d]["text"]))
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"])
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    target = {texts[d]["source"]: r["target"] for d, r in got.items()}
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1
    assert all(target[s] <= 2 * sizes[s] + 1e-6 for s in sizes)
    each = {round(target[s] / weights[s], 3) for s in sizes if target[s] < 2 * sizes[s] - 1e-6}
    assert len(each) == 1
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in sizes)
    assert rows(mixing.mixed(docs)) == rows(mixing.mixed(docs.repartition(7)))


def test_targets_by_hand():
    assert mixing.targets({"a": 10, "b": 10, "c": 10}, {"a": 3, "b": 1, "c": 2}) == {"a": 20, "b": 25 / 3, "c": 50 / 3}
    assert mixing.in_order(["b", None, "a", "Ü", "Z"]) == ["Z", "a", "b", "Ü", None]


def test_heavier_documents_come_more_often(spark):
    docs = spark.createDataFrame([(i, ("plain words only here" if i % 2 else "odd### wo$$$ on&&& he***"), "en", "s%d" % (i % 3), 1) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long")
    taken = {0: 0, 1: 0}
    for r in mixing.mixed(docs).collect():
        taken[r["doc_id"] % 2] += r["taken"]
    assert taken[1] > 1.1 * taken[0]


def test_edges(spark):
    got = mixing.mixed(edges(spark)).collect()
    assert len(got) == 10 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mixed(empty(spark)).count() == 0
    mix = mixing.mix(edges(spark))
    assert mix.columns == edges(spark).columns
    assert sum(len(words(r["text"])) for r in mix.collect()) == sum(r["taken"] for r in got)


def test_repeated_rows_come_near_the_target(spark):
    data = [(7, "the very same words", "en", s, 4) for s in "abc" for _ in range(1000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    # Each source has 4,000 words; 18,000 are dealt 3 : 1 : 2, a's target stops at 8,000.
    want = {8000.0, 10000 / 3, 20000 / 3}
    per = {}
    for r in mixing.mixed(docs).collect():
        per[round(r["target"], 6)] = per.get(round(r["target"], 6), 0) + r["taken"]
    assert per.keys() == {round(t, 6) for t in want} and all(abs(n - t) <= 4 for t, n in per.items())
    per = dict(mixing.mix(docs).groupBy("source").count().collect())
    assert {s: abs(4 * n - t) <= 4 for (s, n), t in zip(sorted(per.items()), (8000, 10000 / 3, 20000 / 3), strict=True)} == dict.fromkeys("abc", True)


def test_selection_matches_brute_force(spark):
    """Sorted by key, a source's documents go in while more than half of the next one fits."""
    docs = table(spark)
    keys = {r[0]: (r[1], r[2]) for r in mixing._keyed(docs, 7, "doc_id", "text", "source").select("doc_id", mixing._OWN + "key", mixing._OWN + "tie").collect()}
    rows_of, got = {}, {}
    for r in docs.collect():
        rows_of.setdefault(r["source"], []).append((*keys[r["doc_id"]], r["doc_id"], len(words(r["text"]))))
    target = {}
    for r in mixing.mixed(docs).collect():
        got[r["doc_id"]] = r["taken"]
        target[r["doc_id"]] = r["target"]
    for mine in rows_of.values():
        size = sum(x[3] for x in mine)
        epochs = int(target[mine[0][2]] // size)
        rest, run = target[mine[0][2]] - epochs * size, 0
        for _, _, d, n in sorted(mine):
            extra = run + n / 2 < rest
            run += n
            assert got[d] == n * (epochs + extra)
