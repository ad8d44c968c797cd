import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import divergence
from tests.llm.helpers import EDGES, SCHEMA, edges, empty, lower, rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def by_hand(docs):
    """(lang, source, part, item, value, rank) from the definition, in Python's whole numbers; docs has (lang, source, text)."""
    count, found = defaultdict(Counter), defaultdict(Counter)
    sources = defaultdict(set)
    for lang, source, text in docs:
        lang, source, terms = lang or "", source or "", TERM.findall(lower(text))
        sources[lang].add(source)
        found[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang in sources:
        kept = [t for t, n in found[lang].items() if n >= 10]
        total = Counter()
        for s in sources[lang]:
            total.update(count[lang, s])

        def values(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q, p = values(total), {s: values(count[lang, s]) for s in sources[lang]}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources[lang]:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources[lang] if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(items)]
    return sorted(out, key=repr)


def some(seed, n=400, words=60, sources=7):
    rng = random.Random(seed)
    vocabulary = [w + x for w in ("Word", "ähm", "term", "Zed", "😀b") for x in ("", "a", "Éé", "q", "xyz", "ll", "o", "pp", "rr", "ss", "t", "u")][:words]
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "en", "de", None, ""]), rng.choice([*(f"s{i}" for i in range(sources)), None])
        favourite = vocabulary[len(source or '') % 5 :: 5]
        yield lang, source, rng.choice([None, "", " 12 [] "]) if rng.random() < 0.1 else " ".join(rng.choice(favourite if rng.random() < 0.3 else vocabulary) for _ in range(rng.randrange(1, 12)))


def run(spark, data):
    return rows(divergence.divergence(spark.createDataFrame(list(data), "lang string, source string, text string")).select("lang", "source", "part", "item", "value", "rank"))


def test_against_the_definition(spark):
    data = list(some(1))
    assert run(spark, data) == by_hand(data)


def test_shards_and_laps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_TERMS", 7)
    monkeypatch.setattr(divergence, "LAP_BYTES", 1)
    data = list(some(2, sources=3))
    assert run(spark, data) == by_hand(data)


def test_one_hot_source_and_rare_languages(spark):
    data = [("en", "hot", "common words here again")] * 300 + [("en", f"s{i}", "common here other") for i in range(12)]
    data += [("xx", "lone", "seldom")] * 3 + [("yy", "a", "rare"), ("yy", "b", None)] + [("zz", "only", "many times")] * 12
    assert run(spark, data) == by_hand(data)


def test_edges(spark):
    got = divergence.divergence(edges(spark)).select("lang", "source", "part", "item", "value", "rank")
    assert rows(got) == by_hand([(r[2], r[3], r[1]) for r in EDGES])
    many = spark.createDataFrame(EDGES * 12, SCHEMA).withColumns({c: F.lit("clash") for c in ("term", "n", "total", "seat", "shard", "piece", "value", "rank", "item")})
    assert rows(divergence.divergence(many).select("lang", "source", "part", "item", "value", "rank")) == by_hand([(r[2], r[3], r[1]) for r in EDGES * 12])
    assert divergence.divergence(empty(spark)).count() == 0


def test_every_two_seats_meet_once(spark):
    for seats in range(1, 12):
        turns = spark.range(20).select(F.col("id").alias("turn"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seats - 1).cast("long"))).alias("seat"))
        met = turns.withColumn("other", divergence.partner(F.col("seat"), F.col("turn"), F.lit(seats).cast("long"))).filter("other is not null").collect()
        assert sorted((r["seat"], r["other"]) for r in met) == sorted([p for a, b in combinations(range(seats), 2) for p in ((a, b), (b, a))])
        by_turn = {(r["turn"], r["seat"]): r["other"] for r in met}
        assert all(by_turn[turn, other] == seat for (turn, seat), other in by_turn.items())


def test_probability_is_exact():
    rng = random.Random(5)
    for _ in range(300):
        kept = rng.randrange(1, 10 ** rng.randrange(1, 9))
        total = rng.randrange(10 ** rng.randrange(1, 15))
        counts = [rng.randrange(total + 1) for _ in range(5)] + [0, total]
        got = divergence.probability(np.array(counts), total, kept)
        assert got.tolist() == [1 + 10**9 * (c + 2) // (total + 2 * kept) for c in counts]


def test_hosts_stay_where_they_are(spark, monkeypatch):
    """The plan of a lap shuffles travelling pieces only."""
    plans = []
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    met = PandasCogroupedOps.applyInPandas

    def watched(self, *args):
        df = met(self, *args)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", watched)
    run(spark, some(3, n=80))
    assert plans
    for plan in plans:
        home, guests = plan.split("FlatMapCoGroupsInPandas")[1].split("InMemoryRelation")[0], plan.split("Exchange")[-1]
        assert "Exchange" not in home, plan
        assert "Generate explode" in guests, plan


def test_pieces_round_trip():
    at, n = np.array([0, 5, 6, 4095]), np.array([1, 2**40, 3, 7])
    a, b = divergence.unpacked(divergence.packed(at, n))
    assert a.tolist() == at.tolist() and b.tolist() == n.tolist()
    assert [len(x) for x in divergence.unpacked(None)] == [0, 0]
