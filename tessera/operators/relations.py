"""Joins and set operations between tables that describe the same things."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tasks_of(df: DataFrame) -> int:
    """Tasks for work that is large beside its bytes."""
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def best_per(df: DataFrame, key: Sequence[str], order: Column, values: Sequence[str]) -> DataFrame:
    """The values of the row that comes first in ``order`` (a struct) within each key."""
    return df.groupBy(*key).agg(*[F.min_by(v, order).alias(v) for v in values])


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; the others stay or are added."""
    return new.unionByName(old.join(new.select(*key), list(key), "left_anti"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``(key, change)``: novel, removed, and duplicate for ids that occur twice in one snapshot."""
    novel = new.join(old.select(key), key, "left_anti").select(key).distinct().withColumn("change", F.lit("novel"))
    removed = old.join(new.select(key), key, "left_anti").select(key).distinct().withColumn("change", F.lit("removed"))
    both = old.select(key, F.lit(0).alias("s")).union(new.select(key, F.lit(1).alias("s")))
    twice = both.groupBy(key, "s").count().where("count > 1").select(key).distinct().withColumn("change", F.lit("duplicate"))
    return novel.union(removed).union(twice)


def consistent_lookup(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value, conflicting)``: the single value of each key, null where there are several."""
    agg = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return agg.select(key, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias(value), (F.col("lo") != F.col("hi")).alias("conflicting"))


def reviewed(auto: DataFrame, review: DataFrame, key: str, value: str) -> DataFrame:
    """A reviewer's decision goes before the automatic one."""
    r = review.select(key, F.col(value).alias("decided"))
    return auto.join(r, key, "left").select(key, F.coalesce("decided", value).alias(value), F.col("decided").isNotNull().alias("overridden"))


def pair_constraints(left: DataFrame, right: DataFrame, on: Column, status: Column) -> DataFrame:
    """Pairs of two categories that don't pass; ``on`` keeps the pairs to one request or pool."""
    return left.join(right, on).withColumn("status", status).where("status <> 'pass'")


def arc_consistent(sides: dict[str, DataFrame], rules: Sequence[tuple[str, str, Column]], key: str = "id") -> dict[str, DataFrame]:
    """Drops options without any partner, again and again, until nothing changes.

    Each rule is a condition between two sides (their columns prefixed by the side's name).  Between rounds the
    sides are checkpointed.
    """
    sides = {n: d.select(*[F.col(c).alias(f"{n}_{c}") for c in d.columns]).checkpoint() for n, d in sides.items()}
    while True:
        before = {n: d.count() for n, d in sides.items()}
        for a, b, rule in rules:
            sides[a] = sides[a].join(sides[b], rule, "left_semi")
            sides[b] = sides[b].join(sides[a], rule, "left_semi")
        sides = {n: d.checkpoint() for n, d in sides.items()}
        if before == {n: d.count() for n, d in sides.items()}:
            return sides


def connected(edges: DataFrame) -> DataFrame:
    """``(node, component)`` with the least node of each component, over ``edges(a, b)``."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        new = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        up = new.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = new.join(up, "component").select("node", "old", F.col("up").alias("component")).checkpoint()
        if new.where("old <> component").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def reference_faults(events: DataFrame, parents: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Events with ``faults``: the names of the references that point nowhere.

    Each parent is (name, table, its key, the event's column that refers to it).
    """
    out, flags = events, []
    for name, parent, key, ref in parents:
        known = parent.select(F.col(key).alias(f"__{name}")).distinct()
        out = out.join(known, F.col(ref) == F.col(f"__{name}"), "left")
        flags.append(F.when(F.col(f"__{name}").isNull(), F.lit(f"unknown_{name}")))
    faults = F.filter(F.array(*flags), lambda f: f.isNotNull())
    return out.withColumn("faults", faults).drop(*[f"__{name}" for name, *_ in parents])


def same_universe(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that only one of the two has; empty if the universes are equal."""
    k = list(key)
    left = a.select(*k).distinct().join(b.select(*k), k, "left_anti").withColumn("only_in", F.lit("left"))
    return left.union(b.select(*k).distinct().join(a.select(*k), k, "left_anti").withColumn("only_in", F.lit("right")))


def quarantine(rows: DataFrame, identity: Sequence[str], price: str, order: Sequence[str]) -> DataFrame:
    """``outcome`` per row: all rows of an identity with several prices are rejected, else the first is kept."""
    w = Window.partitionBy(*identity)
    prices = F.size(F.collect_set(price).over(w))
    first = F.row_number().over(w.orderBy(*order)) == 1
    return rows.withColumn("outcome", F.when(prices > 1, "price_conflict").when(first, "kept").otherwise("duplicate"))
