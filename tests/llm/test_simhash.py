import numpy as np
import xxhash

from lodestone.llm import simhash
from lodestone.llm.components import connected_components
from tests.llm.helpers import edges, empty, lower, table, words


def brute_print(text, k=4):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute(docs, shingle=4, distance=4):
    prints = [brute_print(t, shingle) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i] = root[root[i]]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return sorted(((d, f"{prints[i]:016x}", names.get(find(i))) for i, (d, _) in enumerate(docs)), key=repr)


def compare(df, **kw):
    got = sorted((tuple(r) for r in simhash.near_duplicates(df, **kw).collect()), key=repr)
    assert got == brute([tuple(r) for r in df.select("doc_id", "text").collect()], **kw)


def test_matches_brute_force(spark):
    compare(table(spark, sf="sf0.01"))
    compare(table(spark, sf="sf0.01"), shingle=5, distance=6)


def test_edges(spark):
    compare(edges(spark))
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.one_of_each(edges(spark))
    assert kept.columns == edges(spark).columns
    assert [r["doc_id"] for r in kept.filter("text like 'same%'").collect()] == [4]
    assert simhash.one_of_each(empty(spark)).count() == 0


def test_hot_keys_are_split_without_loss(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base:  # chains and balls around each
        x = int(b)
        for _ in range(150):
            x ^= 1 << int(rng.integers(64))
            prints.add(x)
            prints.add(int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    prints = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    label = {}
    for node, root in simhash.linked_components(df, chunk=50).collect():
        label[node] = root
    got = [label.get(int(x), int(x)) for x in prints.view(np.int64)]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 4):
            root[find(i)] = find(int(j))
    assert {frozenset(np.flatnonzero(np.array(got) == g)) for g in set(got)} == {frozenset(i for i in range(len(prints)) if find(i) == r) for r in {find(i) for i in range(len(prints))}}


def test_masks_cover_every_pair_within_distance():
    rng = np.random.default_rng(1)
    for n in (6, 7, 8):
        masks = simhash.block_masks(n, 4)
        for _ in range(200):
            flips = sum({1 << int(b) for b in rng.integers(0, 64, 4)})
            assert any(flips & (m % 2**64) == 0 for m in masks)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 200: 0}
