"""Ranking, normalisation, margins, running precision and funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: Sequence[str], score: str, tie: str) -> DataFrame:
    """``rank`` from 1 by score, highest first, ties by id."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))


def top_k(rows: DataFrame, by: Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    return ranked(rows, by, score, tie).where(F.col("rank") <= k)


def average_rank(value: str, by: Sequence[str] = ()) -> Column:
    """Rank with the average of tied places."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def price_percentile(rows: DataFrame, by: Sequence[str], price: str) -> Column:
    """Share of the known prices of the group that are at most this one; null for an unknown price."""
    w = Window.partitionBy(*by, F.col(price).isNull()).orderBy(price)
    return F.when(F.col(price).isNotNull(), F.cume_dist().over(w))


def min_max(value: str, by: Sequence[str]) -> Column:
    """Scaled to 0..1 within the group, 0 where the group is constant."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.0)


def winner_margin(rows: DataFrame, by: Sequence[str], score: str, tie: str) -> DataFrame:
    """The best row of each group with the runner-up's score and the margin (all of it, without a runner-up)."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    best = rows.withColumn("rank", F.row_number().over(w)).withColumn("runner_up", F.lead(score).over(w)).where("rank = 1").drop("rank")
    return best.withColumn("margin", F.col(score) - F.coalesce("runner_up", F.lit(0.0)))


def average_precision(rows: DataFrame, by: Sequence[str], score: str, label: str, tie: str) -> DataFrame:
    """Mean, over the positives, of the precision down to each; null without positives."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    run = rows.withColumn("hits", F.sum(label).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.row_number().over(w))
    hit = F.when(F.col(label) == 1, F.col("hits") / F.col("at"))
    return run.groupBy(*by).agg(F.avg(hit).alias("average_precision"), F.sum(label).cast("long").alias("positives"))


def gain(grade: Column, place: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(place + 1)


def carry_forward(rows: DataFrame, by: Sequence[str], order: str, value: Column) -> Column:
    """The last known value so far in the group's order."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def funnel(stages: DataFrame, by: Sequence[str], order: str, kept: str) -> DataFrame:
    """Before, after and initial size of each stage, and the share pruned since the stage before and the start."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = stages.withColumn("initial", F.first(kept).over(w)).withColumn("before", F.coalesce(F.lag(kept).over(w), F.col(kept)))
    return rows.withColumns({"pruned": 1 - F.col(kept) / F.col("before"), "pruned_total": 1 - F.col(kept) / F.col("initial")})
