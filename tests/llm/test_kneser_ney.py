import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from lodestone.llm import kneser_ney as kn
from lodestone.llm import tokens
from tests.llm.helpers import crc_mod, edges, empty, lower, table, words


def brute(rows):
    """(scores by row, P(. | u) as a function) of a dictionary-based model."""
    texts = [(d, [*words(lower(t)), "</s>"]) for d, t in rows]
    train = [w for d, w in texts if crc_mod(d, 7) != 2]
    c1, c2 = Counter(), Counter()
    for w in train:
        c1.update(w)
        c2.update(zip(["<s>", *w], w))
    n, v = sum(c1.values()), len(c1)
    before, after, ctx = Counter(), defaultdict(Counter), Counter()
    for (a, b), k in c2.items():
        before[b] += 1
        after[a][min(k, 3)] += 1
        ctx[a] += k
    high = kn.discounts([sum(k == i for k in c2.values()) for i in (1, 2, 3, 4)])
    low = kn.discounts([sum(k == i for k in before.values()) for i in (1, 2, 3, 4)])
    t = sum(before.values())
    rest = sum(low[min(k, 3)] for k in before.values()) / t / (v + 1) if t else 1 / (v + 1)

    def p1(w):
        return (max(before[w] - low[min(before[w], 3)], 0) / t if t else 0) + rest

    def p2(a, w):
        if not ctx[a]:
            return p1(w)
        k = c2[a, w]
        return max(k - high[min(k, 3)], 0) / ctx[a] + sum(high[i] * m for i, m in after[a].items()) / ctx[a] * p1(w)

    out = []
    for d, w in texts:
        out.append((d, crc_mod(d, 7) == 2, len(w), sum(c1[x] > 0 for x in w), n, sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p2(a, x)) for a, x in zip(["<s>", *w], w))))
    return out, p2, c1


def compare(df):
    want, _, _ = brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    got = kn.lm_scores(df).drop("perplexity").collect()
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=repr), sorted(want, key=repr), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-5)


def test_matches_brute_force(spark):
    compare(table(spark))


def test_edges(spark):
    compare(edges(spark))
    compare(edges(spark).filter("doc_id = 1"))
    assert kn.lm_scores(empty(spark)).count() == 0


def test_probabilities_sum_to_one():
    rows = [(i, t) for i, t in enumerate(["a b c a b", "a b d", "c a b", "d d d a", "b c", "a", "e f g a b", "c c c"])]
    _, p2, c1 = brute(rows)
    for a in ["<s>", "a", "b", "zzz"]:
        assert sum(p2(a, w) for w in c1) + p2(a, "unknown") == pytest.approx(1)


def test_better_than_base_on_held_out_texts(spark):
    got = kn.lm_scores(table(spark, sf="sf0.01")).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got["s"] > got["b"]


def test_hashed_keys_where_ids_need_more_bits(spark, monkeypatch):
    monkeypatch.setattr(kn, "PACKED", 0)
    compare(edges(spark))
    compare(table(spark).limit(80))


def test_counts_have_64_bits(tmp_path):
    folder, big = f"file://{tmp_path}", (1 << 33) + 5
    batches = [pd.DataFrame({"bucket": [0, 0, 2], "key": [-7, 3, 3], "n": [1, big, big]}), pd.DataFrame({"bucket": [2, 2], "key": [3, 9], "n": [big, 2]})]
    ends = [end for _, end in kn._write_sorted(iter(batches), folder) if end]
    store = kn.Sorted({b: (kn._file(folder, f), start, n) for b, f, start, n in ends})
    ids, counts = store.find(np.array([2, 0, 0, 2, 1], "i4"), np.array([3, -7, 3, 4, 3]))
    assert ids.tolist() == [2, 0, 1, -1, -1] and counts.tolist() == [2 * big, 1, big, 0, 0]
    assert store.counts_of(np.array([0, 1, 2, 3])).tolist() == [1, big, 2 * big, 2]


def test_stores_that_are_not_mounted_are_read_in_parts(tmp_path, monkeypatch):
    from pyarrow import fs

    np.arange(1000, dtype="<i8").tofile(tmp_path / "x")
    monkeypatch.setattr(tokens, "_store", lambda uri: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), uri.removeprefix("file://")))
    read = tokens.Reader(most=3000)
    for start in (0, 300, 600, 0, 300):
        assert read(f"file://{tmp_path}/x", "<i8", start, 150).tolist() == list(range(start, start + 150))
        assert read.size <= 3000 and len(read.kept) <= 2
