"""Calibration against a plain fit, and the whole path from reviews to an evaluation on unseen listings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import calibration as C


def rows(n=600, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        x = rng.gauss(0, 2)
        out.append((f"l{i // 3}", i, 1 / (1 + math.exp(-x)), int(rng.random() < 1 / (1 + math.exp(-(1.7 * x - 0.6))))))
    return out


KIND = "listing_id string, pair int, score double, label int"


def plain_platt(data):
    pos, neg = sum(r[3] for r in data), sum(1 - r[3] for r in data)
    x = np.array([math.log(r[2] / (1 - r[2])) for r in data])
    t = np.array([(pos + 1) / (pos + 2) if r[3] else 1 / (neg + 2) for r in data])
    w = np.zeros(2)
    m = np.stack([x, np.ones(len(x))], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-m @ w))
        w -= np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]), m.T @ (p - t))
    return w


def test_platt(spark):
    data = rows()
    got, want = C.fit_platt(spark.createDataFrame(data, KIND).repartition(5)), plain_platt(data)
    assert (got.slope, got.offset) == (pytest.approx(want[0], rel=1e-4), pytest.approx(want[1], rel=1e-4))
    apart = [(f"l{i}", i, 0.9 if i % 2 else 0.1, i % 2) for i in range(20)]
    fit = C.fit_platt(spark.createDataFrame([*apart, ("x", 1, None, 1), ("x", 2, 1.0, None)], KIND))
    assert math.isfinite(fit.slope) and fit.slope > 0
    ends = spark.createDataFrame([(0.0,), (1.0,)], "s double").select(fit.probability(F.col("s")).alias("p")).collect()
    assert 0 < ends[0].p < 0.1 and 0.9 < ends[1].p < 1
    with pytest.raises(ValueError):
        C.fit_platt(spark.createDataFrame([r for r in data if r[3]], KIND))


def test_from_reviews_to_an_evaluation(spark):
    data = rows(1500, 2)
    df = C.split_reviews(spark.createDataFrame(data, KIND)).checkpoint()
    assert df.groupBy("listing_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    part = lambda name: df.where(F.col("split") == name)
    point = C.calibrate_and_select(part("calibration"), part("threshold"), least_precision=0.8, least_rows=10)
    held = [(r.listing_id, r.label, 1 / (1 + math.exp(-(point.platt.slope * math.log(r.score / (1 - r.score)) + point.platt.offset)))) for r in part("threshold").collect()]
    chosen = [y for _, y, p in held if p >= point.threshold - 1e-12]
    assert sum(chosen) / len(chosen) == pytest.approx(point.precision) and point.precision >= 0.8 and sum(chosen) / sum(y for _, y, _ in held) == pytest.approx(point.recall)
    assert all(sum(y for _, y, p in held if p >= t) / max(1, sum(p >= t for *_, p in held)) < 0.8 for t in {p for *_, p in held} if t < point.threshold - 1e-9 and sum(y for _, y, p in held if p >= t) > sum(chosen))
    test = part("test").withColumn("score", point.platt.probability(F.col("score")))
    out = {r.metric: r for r in C.evaluate_reviews(test, point.threshold, resamples=100).collect()}
    got = test.toPandas()
    hit = got["score"] >= point.threshold
    assert out["precision"].value == pytest.approx(got.loc[hit, "label"].mean()) and out["recall"].value == pytest.approx(hit[got["label"] == 1].mean())
    assert out["precision"].low <= out["precision"].value <= out["precision"].high and out["recall"].groups == got["listing_id"].nunique()
    with pytest.raises(ValueError, match="share"):
        C.calibrate_and_select(part("test"), part("test"))
    assert C.calibrate_and_select(part("calibration"), part("threshold"), least_precision=0.99, least_rows=10_000).threshold is None
