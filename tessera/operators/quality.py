"""Batch quality, regressions against a baseline, readiness, freshness, retention and event ingestion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REJECTION_MAX = 0.20
LEAST_ACCEPTED, LEAST_LISTINGS, LEAST_CATEGORY, MORE_REJECTED, LEAST_BASELINE = 0.70, 0.70, 0.60, 0.15, 10


def checks(rows: DataFrame, rules: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """``(name, observed, status)``: rules give an aggregate that should be 0 and the status (fail or warning) if not."""
    one = rows.agg(*[F.coalesce(c, F.lit(0)).cast("double").alias(n) for n, (c, _) in rules.items()])
    each = [F.struct(F.lit(n).alias("name"), F.col(n).alias("observed"), F.when(F.col(n) > 0, level).otherwise("pass").alias("status")) for n, (_, level) in rules.items()]
    return one.select(F.inline(F.array(*each)))


def overall(results: DataFrame) -> DataFrame:
    return results.agg(F.when(F.count_if(F.col("status") == "fail") > 0, "fail").when(F.count_if(F.col("status") == "warning") > 0, "warning").otherwise("pass").alias("status"))


def batch_rules(key: str, schema: str, versions: Sequence[str], rejected: Column) -> dict[str, tuple[Column, str]]:
    """Empty batch, null and repeated ids, unknown schema versions, and too large a share of rejected rows."""
    return {
        "empty_batch": ((F.count("*") == 0).cast("int"), "fail"),
        "null_ids": (F.count_if(F.col(key).isNull()), "fail"),
        "duplicate_ids": (F.count(key) - F.count_distinct(key), "fail"),
        "unknown_schema": (F.count_if(~F.coalesce(F.col(schema).isin(list(versions)), F.lit(False))), "fail"),
        "rejection_rate": ((F.avg(rejected.cast("int")) > REJECTION_MAX).cast("int"), "warning"),
    }


def regressions(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Kinds (by ``key``, with column n) that shrank below the share of a baseline of ten or more, or vanished."""
    both = before.select(key, F.col("n").alias("was")).join(now.select(key, "n"), key, "left")
    least = F.ceil(F.col("was") * LEAST_CATEGORY)
    fault = F.when(F.col("n").isNull(), "vanished").when((F.col("was") >= LEAST_BASELINE) & (F.col("n") < least), "shrunk").otherwise("pass")
    return both.select(key, "was", F.coalesce("n", F.lit(0)).alias("n"), fault.alias("status"))


#: Sources whose records may be used for nothing but the catalogue (fixed names).
CONTROLLED = ("bizgram_controlled_pdf", "dynacore_controlled_pdf")


def batch_report(records: DataFrame, rejected: int) -> DataFrame:
    """``(name, count, status)`` of the nine invariants of a batch of normalised records.

    Columns: source_name, source_record_id, schema_version, record_type, has_data, training_eligible,
    published_claims_eligible, and for the record's kind: product_id, category, brand, model, canonical_name;
    benchmark_id, unit, score; source_listing_id, base_price, currency.
    """
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    some = lambda *cs: reduce(lambda a, b: a | b, [blank(c) for c in cs])
    kind, yes = F.col("record_type"), lambda c: F.coalesce(F.col(c), F.lit(False))
    counts = {
        "accepted_records_present": (F.count("*") == 0).cast("long"),
        "source_record_ids_present": F.count_if(blank("source_record_id")),
        "source_record_ids_unique": F.count("*") - F.count_distinct(F.coalesce("source_record_id", F.lit(""))),
        "normalised_envelope_complete": F.count_if(some("schema_version", "record_type") | ~yes("has_data")),
        "rejection_rate_within_threshold": (F.lit(rejected) > REJECTION_MAX * (F.count("*") + rejected)).cast("long"),
        "canonical_products_valid": F.count_if((kind == "canonical_product") & some("product_id", "category", "brand", "model", "canonical_name")),
        "benchmark_values_valid": F.count_if((kind == "benchmark_observation") & (some("benchmark_id", "product_id", "unit") | ~F.coalesce((F.col("score") > 0) & (F.col("score") < float("inf")), F.lit(False)))),
        "retailer_prices_valid": F.count_if((kind == "retailer_listing") & (blank("source_listing_id") | ~F.coalesce((F.col("base_price") > 0) & F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False)))),
        "controlled_import_use_restricted": F.count_if(F.col("source_name").isin(*CONTROLLED) & (yes("training_eligible") | yes("published_claims_eligible"))),
    }
    one = records.agg(*[c.cast("long").alias(n) for n, c in counts.items()])
    each = [F.struct(F.lit(n).alias("name"), F.col(n).alias("count"), F.when(F.col(n) > 0, "fail").otherwise("pass").alias("status")) for n in counts]
    return one.select(F.inline(F.array(*each)))


def regression_report(now: DataFrame, before: DataFrame) -> DataFrame:
    """``(name, count, status)`` of the five comparisons with the last passing batch; none for a baseline under ten rows.

    Both tables have (kind, key, n) with the kinds accepted, rejected, record_type and category: accepted rows and
    listings must keep 70 %, categories 60 %, record types must not vanish, and rejections not rise by over 15 points.
    """
    both = before.select("kind", "key", F.col("n").alias("was")).join(now.select("kind", "key", F.col("n").alias("now")), ["kind", "key"], "full_outer").na.fill(0, ["was", "now"])
    of, large = (lambda k: F.col("kind") == k), F.col("was") >= LEAST_BASELINE
    short = lambda share: F.greatest(F.lit(0), F.ceil(F.col("was") * share) - F.col("now"))
    total = lambda k, c: F.sum(F.when(of(k), F.col(c)).otherwise(0))
    rate = lambda c: F.try_divide(total("rejected", c), total("rejected", c) + total("accepted", c))
    counts = {
        "accepted_count_regression": F.sum(F.when(of("accepted"), short(LEAST_ACCEPTED)).otherwise(0)),
        "retailer_listing_count_regression": F.sum(F.when(of("record_type") & (F.col("key") == "retailer_listing") & large, short(LEAST_LISTINGS)).otherwise(0)),
        "record_type_regression": F.count_if(of("record_type") & large & (F.col("now") == 0)),
        "category_count_regression": F.sum(F.when(of("category") & large, short(LEAST_CATEGORY)).otherwise(0)),
        "rejection_rate_regression": (F.coalesce(rate("now"), F.lit(0.0)) - F.coalesce(rate("was"), F.lit(0.0)) > MORE_REJECTED).cast("long"),
    }
    one = both.agg(total("accepted", "was").alias("baseline"), *[c.cast("long").alias(n) for n, c in counts.items()]).where(F.col("baseline") >= LEAST_BASELINE)
    each = [F.struct(F.lit(n).alias("name"), F.col(n).alias("count"), F.when(F.col(n) > 0, "fail").otherwise("pass").alias("status")) for n in counts]
    return one.select(F.inline(F.array(*each)))


def operations(offers: DataFrame, snapshots: DataFrame, now: Column, hours: int) -> DataFrame:
    """One row for an operator: offers by mapping outcome, and how many listings' newest price is stale."""
    agg = offers.agg(F.count("*").alias("offers"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("matched", "unmatched", "manual_review", "rejected_conflict")])
    newest = snapshots.groupBy("listing").agg(F.max("ts").alias("ts"))
    stale = newest.agg(F.count("*").alias("listings"), F.count_if(F.col("ts") < now - F.expr(f"INTERVAL {hours} HOURS")).alias("stale"))
    return agg.crossJoin(stale)


def readiness_blockers(totals: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """One row: the names of the measures below their limits; an unknown measure blocks."""
    why = F.filter(F.array(*[F.when(~F.coalesce(F.col(c) >= v, F.lit(False)), F.lit(c)) for c, v in limits.items()]), lambda x: x.isNotNull())
    return totals.select(*limits, F.array_join(why, ",").alias("blockers"))


def freshness_status(rows: DataFrame, now: Column, hours: int) -> DataFrame:
    """degraded on null or future times, stale behind the limit, else fresh; on the result of ``aggregates.freshness``."""
    bad = (F.col("null_times") > 0) | (F.col("future_times") > 0) | F.col("watermark").isNull()
    return rows.withColumn("status", F.when(bad, "degraded").when(F.col("watermark") < now - F.expr(f"INTERVAL {hours} HOURS"), "stale").otherwise("fresh"))


def retention_plan(rows: DataFrame, deadlines: Sequence[str], on: Column, grace_days: int) -> DataFrame:
    """``expires`` (the earliest deadline; for an orphan, after the grace) and ``action``: delete, keep, or hold."""
    orphan = F.date_add("created", grace_days)
    expires = F.coalesce(F.least(*deadlines) if len(deadlines) > 1 else F.col(deadlines[0]), orphan)
    return rows.withColumn("expires", expires).withColumn("action", F.when(F.coalesce(F.col("hold"), F.lit(False)), "hold").when(F.col("expires") < on, "delete").otherwise("keep"))


def idempotent(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """``outcome`` of each event: accepted, replay (same session, key and payload), conflict, or duplicate.

    Events repeat by id, then by (session, key), then by (impression, kind); the first in ``order`` is accepted.
    A repeat with the same session, key and payload is a replay; any other repeat of an id or key conflicts, and a
    repeated impression is a duplicate if the payload is the same.
    """
    def first(*by: str) -> Column:
        return F.first(F.struct("session", "key", "payload", "event_id")).over(Window.partitionBy(*by).orderBy(*order))

    def place(*by: str) -> Column:
        return F.row_number().over(Window.partitionBy(*by).orderBy(*order))

    rows = events.withColumns({"a": first("event_id"), "b": first("session", "key"), "c": first("impression", "kind"), "na": place("event_id"), "nb": place("session", "key"), "nc": place("impression", "kind")})
    same = lambda r: (F.col(f"{r}.session") == F.col("session")) & (F.col(f"{r}.key") == F.col("key")) & (F.col(f"{r}.payload") == F.col("payload"))
    has_key, has_impression = F.col("key").isNotNull(), F.col("impression").isNotNull()
    out = (
        F.when(F.col("na") > 1, F.when(same("a"), "replay").otherwise("conflict"))
        .when(has_key & (F.col("nb") > 1), F.when(same("b"), "replay").otherwise("conflict"))
        .when(has_impression & (F.col("nc") > 1), F.when(F.col("c.payload") == F.col("payload"), "duplicate").otherwise("conflict"))
        .otherwise("accepted")
    )
    return rows.withColumn("outcome", F.coalesce(out, F.lit("conflict"))).drop("a", "b", "c", "na", "nb", "nc")


def expired_leases(tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks whose lease has run out go back to open."""
    gone = (F.col("state") == "leased") & (F.col("lease_until") <= now)
    return tasks.withColumns({"state": F.when(gone, "open").otherwise(F.col("state")), "lease_until": F.when(~gone, F.col("lease_until"))})
