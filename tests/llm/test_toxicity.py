import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import toxicity
from tests.llm.helpers import crc_mod, edges, empty, table


def test_held_out_accuracy(spark):
    docs, labels = table(spark, sf="sf0.1"), table(spark, "labels", "sf0.1")
    got = toxicity.toxicity(docs, labels, positives=400, unlabelled=1500).join(labels, "doc_id").filter("held_out").collect()
    score, y = np.array([r["score"] for r in got]), np.array([r["toxic"] for r in got])
    rank = score.argsort().argsort()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.85
    predicted = np.array([r["predicted"] for r in got])
    assert predicted[y == 0].mean() < 0.03 and predicted[y == 1].mean() > 0.6


def test_edges(spark):
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.toxicity(edges(spark), labels).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (crc_mod(r["doc_id"], 5) == 0) for r in got)
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    assert toxicity.toxicity(edges(spark), labels.limit(0)).count() == 10


def test_risk_is_kept_from_going_negative():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = x[:, 0] > 0.8
    known = x[y & (rng.random(400) < 0.5)]
    rows, positive = np.concatenate([known, x]), np.arange(len(known) + 400) < len(known)
    w, b = toxicity.fit_weights(rows, positive, float(y.mean()))
    assert ((x @ w + b > 0) == y).mean() > 0.9 and np.abs(w).max() < 100


def test_repeated_ids_do_not_widen_the_sample(spark):
    data = [(i % 40, f"{'vile awful slur' if i % 40 < 12 else 'kind plain words'} {i % 3}") for i in range(4000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(40)], "doc_id long, toxic int")
    seen = []
    fitted = toxicity.fit_weights

    def watched(x, positive, prior, **kw):
        seen.append(len(x))
        return fitted(x, positive, prior, **kw)

    toxicity.fit_weights = watched
    try:
        got = toxicity.toxicity(docs, labels, positives=30, unlabelled=30).collect()
    finally:
        toxicity.fit_weights = fitted
    assert seen and seen[0] <= 60 and len(got) == 4000
