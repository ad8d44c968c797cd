import random

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import overlap, simhash
from tests.llm.helpers import edges, empty, lower, table, words


def shingles(text, k=5):
    w = words(lower(text))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def near_copies(spark, least=0.8):
    """(text, changed text, Jaccard) of documents with random words replaced."""
    rng, pairs = random.Random(4), []
    for r in table(spark, sf="sf0.01").orderBy("doc_id").collect():
        w = words(r["text"])
        if not 60 <= len(w) <= 2000 or len(set(w)) < 0.5 * len(w) or len(pairs) >= 400:
            continue
        changed = list(w)
        for k in rng.sample(range(len(w)), max(1, round(len(w) * rng.uniform(0.001, 0.025)))):
            changed[k] = f"other{rng.randrange(10**9)}"
        s = jaccard(" ".join(w), " ".join(changed))
        if s >= least:
            pairs.append((" ".join(w), " ".join(changed), s))
    return pairs


def test_pipeline_finds_near_copies_of_every_band(spark):
    pairs = near_copies(spark)
    docs = [(2 * i + k, t) for i, (a, b, _) in enumerate(pairs) for k, t in enumerate((a, b))]
    kept = {r["doc_id"] for r in corpus_pipeline.distinct(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()}
    for low in (0.8, 0.85, 0.9, 0.95):
        band = [i for i, p in enumerate(pairs) if low <= p[2] < low + 0.05 + (low == 0.95)]
        found = sum(2 * i + 1 not in kept for i in band)
        print(f"recall {low:.2f}: {found} of {len(band)}")
        assert len(band) >= 20 and found >= 0.97 * len(band)


def test_matches_brute_force(spark):
    docs = table(spark).select("doc_id", "text").collect()
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    assert {r["doc_id"] for r in overlap.one_of_each(table(spark)).collect()} == set(least.values())


def test_large_components_are_split_without_loss(spark):
    w = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join([*w[:k], f"x{i}", *w[k + 1 :]])) for i in range(60) for k in [i * 5]] + [(100 + i, f"alone {i} a b c d e f") for i in range(5)]
    df = spark.createDataFrame(docs, "row long, text string").select("row", overlap.sketches(F.col("text"), 5).alias("s")).select("row", "s.*")
    got = overlap.linked_sets(overlap.saved(df, "test"), 0.8, chunk=7).collect()
    assert len(got) == 59 and len({r["root"] for r in got}) == 1


def components(texts, least=0.8):
    """{position: least position of its component} of texts, from all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_large_components_against_all_pairs(spark, monkeypatch):
    """Chains in which only neighbours are similar, groups of near copies, and groups whose members share keys without being similar."""
    rng, base, texts = random.Random(8), [f"w{i}" for i in range(200)], []
    for i in range(40):  # a chain
        texts.append(" ".join(base[i * 4 : i * 4 + 120] + [f"c{k}" for k in range(max(0, i * 4 + 120 - 200))]))
    for i in range(40):  # near copies
        k = rng.randrange(200)
        texts.append(" ".join([f"n{x}" for x in [*base[:k], f"x{i}", *base[k + 1 :]]]))
    for i in range(30):  # alike by three quarters or so
        own = [f"m{x}" for x in base]
        for k in rng.sample(range(200), rng.randrange(2, 9)):
            own[k] = f"y{i}-{k}"
        texts.append(" ".join(own))
    texts += [texts[0], "", "", "short one"]
    monkeypatch.setattr(overlap, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(overlap, "NUMBERS", 500)
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").select("row", overlap.sketches(F.col("text"), 5).alias("s")).select("row", "s.*")
    table_ = overlap.saved(df, "test")
    names = {r["row"]: r["fp"] for r in table_.select("row", "fp").collect()}
    root = {r["node"]: r["root"] for r in overlap.linked_sets(table_, 0.8, chunk=6).collect()}
    got = [root.get(names[i], names[i]) for i in range(len(texts))]
    want = components(texts)
    assert len(set(want)) > 3
    assert [got.index(x) for x in got] == want


def test_edges(spark):
    kept = overlap.one_of_each(edges(spark))
    assert kept.columns == edges(spark).columns
    assert [r["doc_id"] for r in kept.filter("text like 'same%'").collect()] == [4]
    assert overlap.one_of_each(empty(spark)).count() == 0


def test_simhash_finds_near_copies_by_itself(spark, monkeypatch):
    """Without MinHash keys, pairs within four bits are found if their Jaccard similarity holds, and only those."""
    pairs, real = near_copies(spark), overlap.sketches
    pairs = [(a, b) for a, b, _ in pairs if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 4]
    same, other = ("a b c " * 100 + " ".join(f"{p}{i}" for i in range(60)) for p in "xy")
    assert (simhash.fingerprint(same) ^ simhash.fingerprint(other)).bit_count() <= 4 and jaccard(same, other) < 0.8
    pairs.append((same, other))
    docs = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    monkeypatch.setattr(overlap, "sketches", lambda text, shingle: real(text, shingle).withField("keys", F.array().cast("array<long>")))
    kept = {r["doc_id"] for r in overlap.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(pairs) > 20 and not kept & {2 * i + 1 for i in range(len(pairs) - 1)} and kept >= {2 * len(pairs) - 2, 2 * len(pairs) - 1}
