"""Aggregations used by cohort, catalogue, facet and operations reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper ends of the latency histogram, in seconds.
LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def cohort_counts(rows: DataFrame, key: Sequence[str], family: str, entity: str) -> DataFrame:
    """Rows, distinct families and distinct entities of each cohort, largest first."""
    agg = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(family).alias("families"), F.count_distinct(entity).alias("entities"))
    return agg.orderBy(F.desc("families"), F.desc("entities"), F.desc("n"), *key)


def median_and_mad(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Exact median and median absolute deviation, two passes over one partitioning."""
    centre = rows.groupBy(*key).agg(F.median(value).alias("median"), F.count("*").alias("n"))
    off = rows.join(centre, list(key)).withColumn("off", F.abs(F.col(value) - F.col("median")))
    return off.groupBy(*key).agg(F.first("median").alias("median"), F.first("n").alias("n"), F.median("off").alias("mad"))


def scaled_scores(rows: DataFrame, group: Sequence[str], by: Sequence[str], value: str, lower_is_better: str) -> DataFrame:
    """Min-max scale to 0..100 within a comparable group (50 where constant), turned where lower is better, then averaged."""
    span = rows.groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    part = (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    score = F.when(F.col("hi") - F.col("lo") <= 1e-12, 50.0).otherwise(100 * F.when(F.col(lower_is_better), 1 - part).otherwise(part))
    return rows.join(span, list(group)).withColumn("score", score).groupBy(*by).agg(F.round(F.avg("score"), 6).alias("score"))


def mid_rank_percentile(value: Column, at: Column) -> Column:
    """100 * (less + half of equal) / n as an aggregate."""
    return 100 * F.sum(F.when(value < at, 1.0).when(value == at, 0.5).otherwise(0.0)) / F.count("*")


def robust_cv(value: str) -> Column:
    """Population deviation in percent of the median, to two places; null below two values or for a median of 0."""
    return F.when(F.count(value) > 1, F.bround(F.try_divide(100 * F.stddev_pop(value), F.median(value)), 2))


def conditional_counts(rows: DataFrame, key: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in flags.items()])


def facets(rows: DataFrame, category: str, brand: str, wanted_category: str) -> DataFrame:
    """``(facet, value, n)``: categories over all rows, brands over the wanted category only."""
    a = rows.groupBy(F.col(category).alias("value")).count().select(F.lit("category").alias("facet"), "value", F.col("count").alias("n"))
    b = rows.where(F.col(category) == wanted_category).groupBy(F.col(brand).alias("value")).count()
    return a.union(b.select(F.lit("brand").alias("facet"), "value", F.col("count").alias("n")))


def readiness(rows: DataFrame, key: Sequence[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows, rows that have some field of each group, and the share of rows that have all groups."""
    has = {g: F.coalesce(*fields).isNotNull() for g, fields in groups.items()}
    ready = F.lit(True)
    for c in has.values():
        ready = ready & c
    return rows.groupBy(*key).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"has_{g}") for g, c in has.items()], F.round(F.count_if(ready) / F.count("*"), 6).alias("ready_rate"))


def duplicate_groups(rows: DataFrame, identity: Sequence[str], member: str) -> DataFrame:
    """Identities with several members, and the members in order, comma-joined."""
    members = F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda m: m.cast("string")), ",")
    return rows.groupBy(*identity).agg(F.count("*").alias("n"), members.alias("members")).where("n > 1")


def coverage_histogram(rows: DataFrame, item: str) -> DataFrame:
    """How many items have how many judgments."""
    return rows.groupBy(item).count().groupBy(F.col("count").alias("judgments")).agg(F.count("*").alias("items"))


def adjudicated(rows: DataFrame, decisions: DataFrame, item: str, grade: str, judge: str) -> DataFrame:
    """Per item the final grade: the judges' if they agree, else the decision of someone who wasn't one of them.

    ``decisions`` has (item, adjudicator, decided).  ``source`` says unanimous, adjudicated, invalid_adjudicator or open.
    """
    agg = rows.groupBy(item).agg(F.count("*").alias("judgments"), F.min(grade).alias("lo"), F.max(grade).alias("hi"), F.collect_set(judge).alias("judges"))
    both = agg.join(decisions.select(item, "adjudicator", "decided"), item, "left")
    agree, own = F.col("lo") == F.col("hi"), F.array_contains("judges", F.col("adjudicator"))
    source = F.when(agree, "unanimous").when(F.col("adjudicator").isNull(), "open").when(own, "invalid_adjudicator").otherwise("adjudicated")
    return both.select(item, "judgments", F.when(agree, F.col("lo")).when(source == "adjudicated", F.col("decided")).alias("grade"), source.alias("source"))


def agreement(rows: DataFrame, item: str, grade: str) -> DataFrame:
    """Per item: judgments, unanimous, and the agreed grade (null where judges differ)."""
    agg = rows.groupBy(item).agg(F.count("*").alias("judgments"), F.min(grade).alias("lo"), F.max(grade).alias("hi"))
    return agg.select(item, "judgments", (F.col("lo") == F.col("hi")).alias("unanimous"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("grade"))


def receipts(rows: DataFrame, ts: str, status: str, failed: Sequence[str], newest: int) -> DataFrame:
    """One row over the newest receipts: counts, latest, and whether older ones were left out."""
    top = rows.orderBy(F.desc(ts), F.desc("event_id")).limit(newest + 1)
    kept = top.orderBy(F.desc(ts), F.desc("event_id")).limit(newest)
    more = top.agg((F.count("*") > newest).alias("truncated"))
    bad = F.col(status).isin(list(failed))
    return kept.agg(F.count("*").alias("n"), F.count_if(bad).alias("failures"), F.count_if(~bad).alias("successes"), F.max(ts).alias("latest")).crossJoin(more)


def freshness(rows: DataFrame, key: str, ts: str, now: Column) -> DataFrame:
    """Watermark: the least of the keys' newest times; with null and future times counted."""
    newest = rows.groupBy(key).agg(F.max(ts).alias("newest"), F.count_if(F.col(ts).isNull()).alias("nulls"), F.count_if(F.col(ts) > now).alias("future"))
    return newest.agg(F.min("newest").alias("watermark"), F.count("*").alias("keys"), F.sum("nulls").alias("null_times"), F.sum("future").alias("future_times"))


def latency_histogram(rows: DataFrame, key: str, seconds: str) -> DataFrame:
    """Cumulative counts by upper bucket end; the last bucket holds all."""
    ends = F.array(*[F.lit(b) for b in LATENCY_BUCKETS], F.lit(float("inf")))
    hit = rows.select(key, F.explode(F.filter(ends, lambda e: e >= F.col(seconds))).alias("le"))
    return hit.groupBy(key, F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.format_string("%.3f", "le")).alias("le")).agg(F.count("*").alias("n"))


def known_sum(values: Column) -> Column:
    """Sum of the non-negative entries of a map."""
    return F.aggregate(F.filter(F.map_values(values), lambda v: v.isNotNull() & (v >= 0)), F.lit(0.0), lambda a, v: a + v)


def distinct_list(value: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_set(value)), lambda v: v.cast("string")), ",")
