"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents that labels confirm as toxic; everything else is unlabelled text, toxic or not. A logistic
classifier in numpy minimises the class-prior-corrected risk: pi * R(positives as 1) + max(0, R(unlabelled as 0) -
pi * R(positives as 0)), pi the share of toxic documents. Where the second term turns negative, a step is made
against it, as the non-negative estimator asks. Inputs are counts of words and word beginnings; those kept are the
ones whose document frequencies among positives and among unlabelled text differ most, of those that four positives or
more have and that are more than twice as frequent among positives: with fewer than four positives in the sample no input is
left and every score is the class prior.

Scale: fitting sees a bounded sample, `positives` and `unlabelled` documents in order of a hash of their ids; features
are counted in Spark, at most `features` of them are kept. Every whole text is scored in one pass without a shuffle.

Edge cases: a null or empty text scores by the intercept; null labels and labels of documents that aren't there teach
nothing; repeated label rows count once, a document with both labels is a positive; of documents with one id, the first text in
order teaches, all are scored; without positives every score is
the class prior, or 0; an empty table gives an empty result; lang, source, ids and labels are never inputs of a score;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bucket_of_id, saved

_LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 9)
FOLDS, HELD_OUT = 5, 0
#: Words without a feature that a worker remembers.
REMEMBERED = 500_000


def features_of(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if n <= len(word))]


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen = (Counter(), Counter())
        for text, positive in zip(pdf["text"], pdf["positive"], strict=True):
            seen[int(positive)].update({f for w in set(_LETTERS.findall(text.lower())) for f in features_of(w)})
        for k in (k for k in (0, 1) if seen[k]):
            yield pd.DataFrame({"feature": list(seen[k]), "u": [n * (1 - k) for n in seen[k].values()], "p": [n * k for n in seen[k].values()]})


class Model:
    """Weights by feature; picklable and bounded by the number of features."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.idle = weights, bias, set()

    def counts(self, text: str) -> Counter:
        words = _LETTERS.findall(text.lower())
        found = Counter()
        if len(self.idle) > REMEMBERED:
            self.idle = set()
        busy = {}
        for w in set(words) - self.idle:
            kept = [f for f in features_of(w) if f in self.weights]
            if kept:
                busy[w] = kept
            else:
                self.idle.add(w)
        if busy:
            for w in words:
                for f in busy.get(w, ()):
                    found[f] += 1
        return found

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[f] * math.log1p(n) for f, n in self.counts(text).items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_weights(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk over rows x, by gradient steps with momentum."""
    xp, xu = x[positive], x[~positive]
    w, b = np.zeros(x.shape[1]), math.log(prior / (1 - prior))
    vw, vb = np.zeros_like(w), 0.0
    soft = lambda z: np.logaddexp(0, z)
    sig = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(steps):
        zp, zu = xp @ w + b, xu @ w + b
        negative = soft(zu).mean() - prior * soft(zp).mean()
        gp, gu = sig(zp), sig(zu)
        gn_w, gn_b = xu.T @ gu / len(zu) - prior * (xp.T @ gp) / len(zp), gu.mean() - prior * gp.mean()
        if negative >= 0:
            gw, gb = gn_w - prior * (xp.T @ (1 - gp)) / len(zp), gn_b - prior * (1 - gp).mean()
        else:
            gw, gb = -gn_w, -gn_b
        vw, vb = 0.9 * vw - rate * (gw + decay * w), 0.9 * vb - rate * gb
        w, b = w + vw, b + vb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 6000, features: int = 1500) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic); only rows outside the held-out fold teach."""
    teaches = bucket_of_id(F.col("doc_id"), FOLDS) != HELD_OUT
    known = saved(labels.select("doc_id", "toxic").filter(teaches & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    rank = F.xxhash64("doc_id", F.lit(11))
    some = lambda df, n: df.select("doc_id").distinct().orderBy(rank, "doc_id").limit(n)
    held = docs.filter(teaches & F.col("doc_id").isNotNull())
    chosen = some(known.filter("toxic = 1").join(held.select("doc_id"), "doc_id", "left_semi"), positives).withColumn("positive", F.lit(True))
    chosen = chosen.unionByName(some(held, unlabelled).withColumn("positive", F.lit(False)))
    # At most positives + unlabelled ids, and one row of each: the first text of a repeated id.
    drawn = held.join(F.broadcast(saved(chosen, "chosen")), "doc_id").groupBy("doc_id", "positive").agg(F.min(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    sample = saved(drawn.select("text", "positive"), "sample")
    n = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    if not n.get(True) or not n.get(False) or not 0 < prior < 1:
        return Model({}, math.log(prior / (1 - prior)) if 0 < prior < 1 else -30.0)
    share = lambda c, k: (F.col(c) + 0.5) / (n[k] + 1)
    evidence = (share("p", True) - share("u", False)) ** 2 / (share("u", False) + share("p", True))
    counted = sample.repartition(16).mapInPandas(_count_features, "feature string, u long, p long").groupBy("feature").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
    best = counted.filter((F.col("p") >= 4) & (share("p", True) > 2 * share("u", False))).orderBy(evidence.desc(), "feature").limit(features)
    names = sorted(r["feature"] for r in best.select("feature").collect())
    if not names:
        return Model({}, math.log(prior / (1 - prior)))
    at = {f: i for i, f in enumerate(names)}
    sparse = sample.repartition(16).mapInPandas(partial(_vectors, at=at), "positive boolean, k array<int>, v array<int>").collect()
    x = np.zeros((len(sparse), len(names)), np.float32)
    for row, s in zip(x, sparse, strict=True):
        row[s["k"]] = np.log1p(s["v"])
    w, b = fit_weights(x, np.array([s["positive"] for s in sparse]), prior)
    return Model(dict(zip(names, map(float, w), strict=True)), float(b))


def _vectors(batches: Iterator[pd.DataFrame], at: dict[str, int]) -> Iterator[pd.DataFrame]:
    model = Model(dict.fromkeys(at, 0.0), 0.0)
    for pdf in batches:
        counts = [model.counts(t) for t in pdf["text"]]
        yield pd.DataFrame({"positive": pdf["positive"], "k": [[at[f] for f in c] for c in counts], "v": [list(c.values()) for c in counts]})


def _score(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [model.score(t) for t in pdf["text"]]})


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    model = fit(own, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), **options)
    scored = own.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(partial(_score, model=model), "doc_id string, score double")
    ids = F.col("doc_id").cast("long")
    return scored.select(ids.alias("doc_id"), (bucket_of_id(ids, FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
