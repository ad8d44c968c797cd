import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import quality
from tests.llm.helpers import edges, empty, table, words


def figures(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    base_failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), base_failed


def compare(docs):
    got = quality.quality(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *figures(r["text"])) for r in texts), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=repr) == want
    assert all(not (r["kept"] and r["base_failed"]) for r in got)


def test_figures_match_brute_force(spark):
    compare(table(spark))
    compare(table(spark, sf="sf0.01"))


def test_edges(spark):
    compare(edges(spark))
    assert quality.quality(empty(spark)).count() == 0
    assert quality.keep_good(edges(spark)).columns == edges(spark).columns
    assert quality.keep_good(empty(spark)).count() == 0


def test_verdicts_agree_with_labels(spark):
    got = quality.quality(table(spark, sf="sf0.01")).join(table(spark, "labels", "sf0.01"), "doc_id")
    counts = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    good, bad = counts.get((1, True), 0), counts.get((0, False), 0)
    assert bad >= 0.95 * (bad + counts.get((0, True), 0))
    assert good >= 0.95 * (good + counts.get((1, False), 0))


def voted(rules, n=10_000, noisy=None, lone=0.0):
    """Counts of patterns: 10 % of bad documents that several rules reject; noisy rejects 15 % of all at random, lone is the
    share of documents that only the first rule rejects."""
    rng, counts = random.Random(2), Counter()
    for _ in range(n):
        bad = rng.random() < 0.1
        v = [-1 if bad and i < 5 and rng.random() < 0.8 else 1 for i in range(rules)]
        if lone and rng.random() < lone:
            v[0] = -1
        if noisy is not None and rng.random() < 0.15:
            v[noisy] = -1
        counts[tuple(v)] += 1
    return sorted(counts.items())


def test_noisy_rule_loses_weight():
    names = [f"r{i}" for i in range(9)]
    clean = (1,) * 9
    for noisy in (0, 7):
        model = quality.fit(voted(9, noisy=noisy), names)
        alone = clean[:noisy] + (-1,) + clean[noisy + 1 :]
        assert model["rejects"][f"r{noisy}"] > 0.05 and model["p_good"][alone] >= 0.5 and model["p_good"][clean] >= 0.9
        assert model["p_good"][(-1, -1, -1, -1, -1, 1, 1, 1, 1)] < 0.5  # more than the noisy rule speaks against it
    model = quality.fit(voted(9, lone=0.03), names)  # a rule that finds a rare kind alone keeps its weight
    assert model["p_good"][(-1,) + clean[1:]] < 0.5


def test_verdicts_differ_from_all_must_pass(spark):
    rng = random.Random(1)
    known = [f"palabra{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    docs = table(spark, sf="sf0.001").select("doc_id", "text").collect()
    # Another language: no rule knows its words.
    other = [(10_000 + i, "\n".join(" ".join(rng.choice(known) + rng.choice("xyz") + str(rng.randrange(99)) for _ in range(60)) for _ in range(3))) for i in range(40)]
    got = quality.quality(spark.createDataFrame([*map(tuple, docs), *other], "doc_id long, text string"))
    assert got.filter("doc_id >= 10000 and kept").count() == 40


def brute_posteriors(rows, names, rounds):
    """Expectation-maximisation document by document, with loops and plain numbers."""
    k, total = len(names), len(rows)
    prior = [[quality.NOISE] * k] + [[0.9 if i == j else 0.1 for j in range(k)] for i in range(k)]
    weight = [quality.RATE_WEIGHT * total] + [1e-4 * total] * k
    rates, shares = [[10 * x for x in prior[0]], *[x[:] for x in prior[1:]]], [quality.GOOD] + [(1 - quality.GOOD) / k] * k
    for last in [False] * rounds + [True]:
        posteriors = []
        for v in rows:
            like = [s * math.prod(r if x < 0 else 1 - r if x > 0 else 1 for x, r in zip(v, rs, strict=True)) for s, rs in zip(shares, rates, strict=True)]
            posteriors.append([x / sum(like) for x in like])
        if last:
            return [p[0] for p in posteriors]
        mass = [sum(p[c] for p in posteriors) for c in range(k + 1)]
        good = (mass[0] + quality.SHARE_WEIGHT * total * quality.GOOD) / (total * (1 + quality.SHARE_WEIGHT))
        bad = [m + 1e-9 * total for m in mass[1:]]
        shares = [good] + [(1 - good) * b / sum(bad) for b in bad]
        for c in range(k + 1):
            for j in range(k):
                r = sum(p[c] for p, v in zip(posteriors, rows, strict=True) if v[j] < 0)
                a = sum(p[c] for p, v in zip(posteriors, rows, strict=True) if v[j] > 0)
                rates[c][j] = (r + weight[c] * prior[c][j]) / (r + a + weight[c])


def test_posteriors_and_verdicts_match_brute_force(spark):
    docs = table(spark, sf="sf0.01").unionByName(edges(spark, extra=False))
    votes = {x: F.when(no, -1).when(yes, 1).otherwise(0) for x, (no, yes) in quality.rules().items()}
    rows = [tuple(r) for r in quality.with_figures(docs).select(*(v.alias(x) for x, v in votes.items())).collect()]
    model = quality.fit(sorted(Counter(rows).items()), list(votes))
    assert len(model["trace"]) > 5 and all(b >= a - 1e-12 for a, b in zip(model["trace"], model["trace"][1:]))
    want = brute_posteriors(rows, list(votes), len(model["trace"]) - 1)
    got = [model["p_good"][v] for v in rows]
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-6
    verdicts = Counter(p >= 0.5 and not figures(t)[5] for p, (t,) in zip(want, docs.select("text").collect(), strict=True))
    assert Counter(r["kept"] for r in quality.quality(docs).collect()) == verdicts


def test_a_reject_alone_and_joint_evidence():
    """One reject of a rule that also strikes good documents is forgiven; two of such rules together are not."""
    names = [f"r{i}" for i in range(8)]
    rng, counts = random.Random(5), Counter()
    for _ in range(20_000):
        bad = rng.random() < 0.15
        counts[tuple(-1 if rng.random() < (0.85 if bad else 0.1) and i < 3 else 1 for i in range(8))] += 1
    model = quality.fit(sorted(counts.items()), names)
    one, two = (-1,) + (1,) * 7, (-1, -1) + (1,) * 6
    assert model["p_good"][one] > 0.5 > model["p_good"][two]


def test_plan_is_native(spark, capsys):
    quality.with_figures(table(spark)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
