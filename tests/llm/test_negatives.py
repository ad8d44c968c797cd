import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import negatives
from tests.llm.helpers import rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(data, every=10, k=5, least=80):
    """From the definition, in Python's whole numbers; equal rows once."""
    kept = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v), y) for i, v, y in data if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for anchor, a, label in kept:
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=False)), i, y) for i, v, y in kept if i != anchor)
        for p, positive, _ in [s for s in scored if s[2] == label][:k]:
            fit = [s for s in scored if s[2] != label and least * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(anchor, positive, n + 1, s[1], -p, -s[0]) for n, s in enumerate(fit)]
    return sorted(out, key=repr)


def clusters(seed, n=600, dims=8, centres=6, spread=0.1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    at = rng.integers(0, centres, n)
    return [(i, (middle[c] + spread * rng.normal(size=dims)).astype(np.float32).tolist(), int((c + rng.integers(0, 2)) % 4)) for i, c in enumerate(at)]


def run(spark, data, every=10, **options):
    df = spark.createDataFrame(data, SCHEMA)
    return rows(negatives.hard_negatives(df, F.col("vec_id") % every == 0, **options))


@pytest.mark.parametrize("spread", [0.02, 2.0])
def test_against_all_products(spark, spread):
    data = clusters(1, spread=spread)
    got = run(spark, data)
    assert got == by_hand(data) and len(got) > 100


def test_many_cells_units_and_waves_change_nothing(spark, monkeypatch):
    for name, value in {"CELL_ROWS": 20, "UNIT_ROWS": 15, "WAVE": 10, "SAMPLE": 100}.items():
        monkeypatch.setattr(negatives, name, value)
    data = clusters(2, n=500, spread=0.5)
    assert run(spark, data) == by_hand(data)


def test_one_label_or_cell_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "UNIT_ROWS", 40)
    data = [(i, [0.5, 0.25, 0.125], 1) for i in range(300)] + [(i, [0.4, 0.25 + (i % 7) / 100, 0.1], 2) for i in range(300, 340)]
    got = run(spark, data)
    assert got == by_hand(data)
    assert {r[2] for r in got} == {1, 2, 3, 4, 5}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (None, [1.0, 1.0], 1), (0, None, 1), (10, [1.0, None], 1), (20, [nan, 1.0], 1), (30, [1.0, inf], 2), (40, [1.0, -inf], None), (50, [1.0, 0.5], None),
        (60, [1.0, 0.5], 1), (60, [1.0, 0.5], 1), (60, [1.0, 0.5], 3), (60, [0.5, 0.5], 1), (61, [1.0, 0.5], 1), (61, [1.0, 0.5], 1), (62, [1.0, 0.4], 2), (63, [0.9], 2), (64, [0.9, 0.1, 7.0], 2),
        (70, [], 1), (71, [-1.0, -1.0], 1), (80, [-1.0, 1.0], -5), (81, [-1.0, 0.9], -5), (82, [-1.0, 0.95], 7), (90, [0.0, 0.0], 9), (91, [0.0], 9), (92, [0.0, 0.0], 8), (100, [3.0], 11),
    ]
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "q", "x", "anchor", "cell", "key", "rank", "score", "floor")})
    got = rows(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0))
    assert got == by_hand(data) and got
    none = negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0)
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.hard_negatives(df, F.col("vec_id") < -99).count() == 0
    assert negatives.hard_negatives(df.filter("label is null"), F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(ValueError, match="too long"):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e9], 1)], SCHEMA), F.lit(True))


def test_long_vectors_are_multiplied_in_64_bits(spark):
    rng = random.Random(3)
    data = [(i, [rng.randrange(-(1 << 14), 1 << 14) + rng.random() for _ in range(12)], i % 3) for i in range(200)]
    assert run(spark, data) == by_hand(data)


def test_intervals_hold_every_product():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(500, 16)) * 60 + rng.integers(-2, 3, (500, 1)) * 40).astype("f4")
    tree = negatives.Tree(x, np.arange(500) % 3, 16)
    assert sorted(tree.order) == list(range(500))
    for edges, nodes in zip(tree.edges, tree.levels, strict=True):
        for i, j in [(a, b) for a in range(len(edges) - 1) for b in range(0, len(edges) - 1, 3)]:
            low, high = negatives.interval(nodes, nodes, np.array([i]), np.array([j]))
            products = tree.x[edges[i] : edges[i + 1]].astype(float) @ tree.x[edges[j] : edges[j + 1]].astype(float).T
            assert low[0] <= products.min() and products.max() <= high[0]


def test_groups_of_anchors_are_pruned(monkeypatch):
    data = clusters(5, n=4000, dims=16, centres=20, spread=0.05)
    x, label, ids = np.floor(256 * np.array([d[1] for d in data])).astype("f4"), np.array([d[2] for d in data]), np.arange(4000)
    candidates, anchors = negatives.Tree(x, label, 32), negatives.Tree(x[::4], label[::4], 8)
    multiplied, product = Counter(), negatives._multiply

    def watched(a, a_ids, first, last, c, c_ids, picked, best, same):
        multiplied["n"] += (last - first) * len(picked)
        product(a, a_ids, first, last, c, c_ids, picked, best, same)

    monkeypatch.setattr(negatives, "_multiply", watched)
    best = negatives.Best(np.full((1000, 1), -1e15), np.full((1000, 1), 1e15), 5)
    negatives.search(anchors, ids[::4][anchors.order], candidates, ids[candidates.order], best, same=True)
    assert multiplied["n"] < 0.3 * 1000 * 4000
    scores = x[::4][anchors.order].astype(float) @ x.T
    for row in range(0, 1000, 7):
        own = [(-int(scores[row, c]), c) for c in range(4000) if label[c] == anchors.label[row] and c != ids[::4][anchors.order][row]]
        assert [(-s, i) for _, _, s, i in best.hits[best.hits[:, 0] == row].tolist()] == sorted(own)[:5]
