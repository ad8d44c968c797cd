import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import discriminant
from tests.llm.helpers import crc_mod, edges, empty, table


def by_hand(x, y):
    """Log odds of rows by the definition: inverse covariances, determinants, no factors."""
    d = x.shape[1]
    centre = [x[y == k].mean(0) for k in (0, 1)]
    scale = np.sqrt(np.maximum(sum(((x[y == k] - centre[k]) ** 2).sum(0) for k in (0, 1)) / len(x), 1e-6))
    density = []
    for k in (0, 1):
        z = (x[y == k] - centre[k]) / scale
        s = np.mean([np.outer(v, v) for v in z], axis=0)
        m = np.trace(s) / d
        spread = np.sum((s - m * np.eye(d)) ** 2)
        doubt = min(np.mean([np.sum((np.outer(v, v) - s) ** 2) for v in z]) / len(z), spread)
        w = max(doubt / spread, discriminant.LEAST)
        s = (1 - w) * s + w * m * np.eye(d)
        every = (x - centre[k]) / scale
        density.append(math.log((y == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", every, np.linalg.inv(s), every))
    return density[1] - density[0]


def test_against_the_definition(spark):
    docs, labels = table(spark, sf="sf0.01"), table(spark, "labels", "sf0.01")
    got = {r["doc_id"]: r for r in discriminant.classified(docs, labels).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    x = np.array([discriminant.statistics(r["text"] or "") for r in rows])
    taught = np.array([r["doc_id"] in known and crc_mod(r["doc_id"], 3) != 1 for r in rows])
    y = np.array([known.get(r["doc_id"], -1) for r in rows])
    full, part = x, x[taught]
    odds = by_hand(np.concatenate([part]), y[taught])
    for r, z in zip([r for r, t in zip(rows, taught, strict=True) if t], odds, strict=True):
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), rel=1e-4, abs=1e-9)
    assert len(full) > len(part)
    assert all(r["held_out"] == (crc_mod(i, 3) == 1) and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())


def test_held_out_accuracy(spark):
    labels = table(spark, "labels", "sf0.1")
    got = discriminant.classified(table(spark, sf="sf0.1"), labels).join(labels, "doc_id").filter("held_out").collect()
    score, y = np.array([r["score"] for r in got]), np.array([r["quality"] for r in got])
    rank = score.argsort().argsort()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.99 and (score[y == 1] >= 0.5).mean() > 0.98 and (score[y == 0] < 0.5).mean() > 0.95


def test_labels_and_sources_are_no_inputs(spark):
    docs, labels = table(spark), table(spark, "labels")
    plain = {r["doc_id"]: r["score"] for r in discriminant.classified(docs, labels).collect()}
    turned = docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string"), "x": F.lit("clash"), "good": F.lit("clash"), "score": F.lit("clash")})
    held = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in discriminant.classified(turned, held).collect()} == pytest.approx(plain)


def test_edges(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, 0), (7, None), (None, 1), (99, 1), (1, 1)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    got = discriminant.classified(edges(spark), labels).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (crc_mod(r["doc_id"], 3) == 1) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert discriminant.classified(empty(spark), labels).count() == 0
    assert {r["score"] for r in discriminant.classified(edges(spark), labels.limit(0)).collect()} == {0.5}
    one = discriminant.classified(edges(spark), labels.filter("quality = 1"))
    assert all(r["predicted"] == 1 for r in one.collect())


def test_statistics_of_odd_texts():
    for text in ("", " \n\t", "x", "a" * 300_000, "word " * 200_000, "\n" * 100_000, "😀\ud800", "|" * 1000, "a b"):
        assert all(map(math.isfinite, discriminant.statistics(text))) and len(discriminant.statistics(text)) == len(discriminant.NAMES)


def test_covariance_is_shrunk_more_the_fewer_rows_it_has():
    rng = np.random.default_rng(1)
    wide = rng.normal(size=(5000, 6)) @ np.diag([3, 2, 1, 1, 0.5, 0.1])

    def distance(n):
        z = wide[:n] - wide[:n].mean(0)
        s = z.T @ z / n
        return np.abs(discriminant.shrunk(s, n, ((z**2).sum(1) ** 2).sum()) - s).max() / np.abs(s).max()

    assert distance(10) > distance(200) > distance(5000) > 0
    np.linalg.cholesky(discriminant.shrunk(np.zeros((6, 6)), 1, 0.0))
