"""Calibrated match probabilities, a threshold chosen on other listings, and an evaluation on yet others."""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import intervals as V
from tessera.operators.metrics import precision_first_threshold
from tessera.operators.sampling import group_split

#: Shares of the listings (fixed values), scores are kept so far from 0 and 1, Newton steps at most.
SPLITS = {"train": 0.60, "calibration": 0.15, "threshold": 0.10, "test": 0.15}
EDGE, STEPS = 1e-6, 50


class Platt(NamedTuple):
    """Probability = logistic(slope * log-odds of the score + offset)."""

    slope: float
    offset: float

    def probability(self, score: Column) -> Column:
        return 1 / (1 + F.exp(-(self.slope * log_odds(score) + self.offset)))


def log_odds(score: Column) -> Column:
    p = F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), score))
    return F.log(p / (1 - p))


def fit_platt(rows: DataFrame, score: str = "score", label: str = "label") -> Platt:
    """Slope and offset of least log loss against smoothed targets, by Newton's method.

    A step is one aggregation of five sums over the distinct pairs of score and label.  The targets are (n + 1) / (n + 2) and
    1 / (n + 2) of each class, so that separable labels have a finite fit; ValueError without both labels.
    """
    own = rows.where(f"{score} is not null and {label} is not null").select(log_odds(F.col(score)).alias("x"), F.col(label).cast("int").alias("y"))
    own = own.groupBy("x", "y").agg(F.count("*").alias("n")).checkpoint()
    pos, neg = (int(n or 0) for n in own.agg(F.sum(F.when(F.col("y") == 1, F.col("n"))), F.sum(F.when(F.col("y") == 0, F.col("n")))).first())
    if not pos or not neg:
        raise ValueError("both labels are needed")
    own = own.withColumn("t", F.when(F.col("y") == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2)))
    a, b, before = 0.0, math.log((pos + 1) / (neg + 1)), math.inf
    step, n = (0.0, 0.0), F.col("n")
    for _ in range(STEPS):
        z = a * F.col("x") + b
        p = 1 / (1 + F.exp(-z))
        w = n * p * (1 - p)
        loss = F.sum(n * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("t") * z))
        x, d = F.col("x"), n * (p - F.col("t"))
        now, ga, gb, haa, hab, hbb = own.agg(loss, F.sum(d * x), F.sum(d), F.sum(w * x * x), F.sum(w * x), F.sum(w)).first()
        if now > before + 1e-12 * abs(before):
            step = (step[0] / 2, step[1] / 2)
            a, b = a - step[0], b - step[1]
            continue
        if before - now < 1e-10 * max(1.0, abs(now)):
            break
        haa, hbb, before = haa + 1e-12, hbb + 1e-12, now
        det = haa * hbb - hab * hab
        step = ((gb * hab - ga * hbb) / det, (ga * hab - gb * haa) / det)
        a, b = a + step[0], b + step[1]
    return Platt(a, b)


class Operating(NamedTuple):
    """A calibration, the threshold chosen under it (None if no score keeps the precision), and what it gave where it was chosen."""

    platt: Platt
    threshold: float | None
    precision: float | None
    recall: float | None


def split_reviews(rows: DataFrame, listing: str = "listing_id", seed: int = V.SEED, weights: Mapping[str, float] = SPLITS) -> DataFrame:
    """``rows`` with ``split``; all candidates of a listing fall together."""
    return rows.join(group_split(rows, listing, seed, dict(weights)), listing)


def calibrate_and_select(calibration: DataFrame, selection: DataFrame, listing: str = "listing_id", least_precision: float = 0.99, least_rows: int = 25, lower_bound: bool = False) -> Operating:
    """Fits the calibration on one part's (score, label) rows and the precision-first threshold on the other's.

    ValueError if the two share a listing.
    """
    shared = calibration.select(listing).distinct().join(selection.select(listing), listing, "left_semi").count()
    if shared:
        raise ValueError(f"calibration and selection share {shared} listings")
    platt = fit_platt(calibration)
    best = precision_first_threshold(selection.withColumn("score", platt.probability(F.col("score"))), least_precision, least_rows, lower_bound).first()
    return Operating(platt, *((None, None, None) if best is None else (best.threshold, best.precision, best.recall)))


def evaluate_reviews(rows: DataFrame, threshold: float, listing: str = "listing_id", score: str = "score", resamples: int = V.RESAMPLES, seed: int = V.SEED) -> DataFrame:
    """``(metric, value, low, high, groups)`` of precision and recall at ``threshold``, whole listings drawn for the intervals."""
    hit, yes = F.col(score) >= threshold, F.col("label") == 1
    counted = rows.withColumns({"tp": (hit & yes).cast("int"), "chosen": hit.cast("int"), "yes": yes.cast("int")})
    parts = [V.interval(counted, V.pooled_ratio("tp", whole), listing, resamples=resamples, seed=seed).withColumn("metric", F.lit(name)) for name, whole in (("precision", "chosen"), ("recall", "yes"))]
    return parts[0].unionByName(parts[1]).select("metric", "value", "low", "high", "groups")
