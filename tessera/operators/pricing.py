"""Price intelligence over observations ``(product, listing, ts, price, in_stock, seller, tie)``.

``tie`` orders observations of one listing at one instant; the first counts as the latest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.aggregates import robust_cv

MAD_SCALE = 0.6745


def delivered(base: Column, shipping: Column) -> Column:
    """What a buyer pays: the price and the shipping, free if unknown."""
    return base + F.coalesce(shipping, F.lit(0))


def single_currency(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations of products with one currency, ``(product, currencies)`` of those with several): those can't be averaged."""
    seen = obs.groupBy("product").agg(F.array_sort(F.collect_set("currency")).alias("currencies"))
    mixed = seen.where(F.size("currencies") > 1)
    return obs.join(mixed.select("product"), "product", "left_anti"), mixed


def latest_per_listing(obs: DataFrame, by: list[str]) -> DataFrame:
    """The newest observation of each ``by`` group, the first of equal times."""
    w = Window.partitionBy(*by).orderBy(F.col("ts").desc(), "tie")
    return obs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def daily_lowest_in_stock(obs: DataFrame) -> DataFrame:
    """Per product and day the cheapest in-stock observation, ties by listing and then by input order."""
    rows = obs.where("in_stock").withColumn("day", F.to_date("ts"))
    best = F.min(F.struct("price", "listing", "tie", "ts")).alias("b")
    return rows.groupBy("product", "day").agg(best).select("product", "day", "b.ts", "b.listing", "b.price")


def within_days(ts: Column, as_of: Column, days: int) -> Column:
    """``as_of - days <= ts <= as_of``, both ends in."""
    return ts.between(as_of - F.expr(f"INTERVAL {days} DAYS"), as_of)


def daily_market_state(obs: DataFrame) -> DataFrame:
    """Per product and day: distinct in-stock sellers, and the share of listings whose last state was in stock."""
    last = latest_per_listing(obs.withColumn("day", F.to_date("ts")), ["product", "day", "listing"])
    return last.groupBy("product", "day").agg(
        F.count_distinct(F.when(F.col("in_stock"), F.col("seller"))).alias("sellers"),
        F.avg(F.col("in_stock").cast("int")).alias("stock_ratio"),
    )


def direction(n_before: Column, before: Column, n_recent: Column, recent: Column, absolute: float, relative: float = 0.1) -> Column:
    """increasing, decreasing or stable; under two days on either side: insufficient_history."""
    bound = F.greatest(F.lit(absolute), F.abs(before) * relative)
    return (
        F.when((n_before < 2) | (n_recent < 2), "insufficient_history")
        .when(recent - before > bound, "increasing")
        .when(recent - before < -bound, "decreasing")
        .otherwise("stable")
    )


def market_trends(obs: DataFrame, as_of: DataFrame) -> DataFrame:
    """Seller and stock trend: the last seven days against the seven before, by date."""
    recent = obs.join(as_of, "product").where(within_days(F.col("ts"), F.col("as_of"), 14)).drop("as_of")
    state = daily_market_state(recent).join(as_of, "product")
    cut = F.to_date(F.col("as_of") - F.expr("INTERVAL 7 DAYS"))
    new, old = F.col("day") >= cut, F.col("day") < cut
    agg = state.groupBy("product").agg(
        *[F.count(F.when(side, 1)).alias(f"n_{name}") for name, side in (("new", new), ("old", old))],
        *[F.avg(F.when(side, F.col(c))).alias(f"{c}_{name}") for c in ("sellers", "stock_ratio") for name, side in (("new", new), ("old", old))],
    )
    trend = lambda c, limit: direction(F.col("n_old"), F.col(f"{c}_old"), F.col("n_new"), F.col(f"{c}_new"), limit)
    return agg.select("product", trend("sellers", 0.5).alias("seller_trend"), trend("stock_ratio", 0.1).alias("stock_trend"))


def mad_anomalies(daily: DataFrame, threshold: float = 3.5) -> DataFrame:
    """Daily prices with a modified z-score beyond the threshold.

    Where the median deviation is 0 any other price is an anomaly without a score; under three days there is none.
    """
    centre = daily.groupBy("product").agg(F.median("price").alias("centre"), F.count("*").alias("n"))
    off = daily.join(centre.where("n >= 3"), "product").withColumn("off", F.col("price") - F.col("centre"))
    mad = off.groupBy("product").agg(F.median(F.abs("off")).alias("mad"))
    score = F.when(F.col("mad") != 0, F.bround(F.lit(MAD_SCALE) * F.col("off") / F.col("mad"), 4))
    rows = off.join(mad, "product").withColumn("score", score)
    odd = F.when(F.col("mad") == 0, F.col("off") != 0).otherwise(F.abs("score") > threshold)
    return rows.where(odd).select("product", "ts", "listing", "price", F.when(F.col("off") > 0, "high").otherwise("low").alias("direction"), "score")


def current_offers(obs: DataFrame, as_of: DataFrame, hours: int = 48) -> DataFrame:
    """The latest observation of each listing, if in stock and not older than ``hours`` at ``as_of``."""
    last = latest_per_listing(obs, ["product", "listing"]).join(as_of, "product")
    return last.where(F.col("in_stock") & (F.col("ts") >= F.col("as_of") - F.expr(f"INTERVAL {hours} HOURS")))


def price_labels(current: Column, median_30: Column, low: Column, percentile: Column, volatility: Column, sufficient: Column, volatile: float = 10.0) -> Column:
    """Comma-joined labels."""
    value = [
        F.when(current <= low * 1.03, F.lit("near_recent_low")),
        F.when(percentile <= 25, F.lit("good_current_value")),
        F.when(current > median_30 * 1.10, F.lit("above_recent_average")),
    ]
    some = reduce(lambda a, b: a | b, [v.isNotNull() for v in value])
    parts = [*value, F.when(~some, F.lit("typical_price")), F.when(volatility >= volatile, F.lit("high_volatility"))]
    return F.when(current.isNull(), "no_current_offer").when(~sufficient, "insufficient_history").otherwise(F.concat_ws(",", *parts))


def price_intelligence(obs: DataFrame, min_days: int = 7) -> DataFrame:
    """One row per product: current offer, 30- and 90-day history, trends, labels and anomalies.

    The time of analysis is the product's newest observation.  Where observations have a currency, products with
    several are left out (``single_currency`` names them).
    """
    if "currency" in obs.columns:
        obs = single_currency(obs)[0]
    as_of = obs.groupBy("product").agg(F.max("ts").alias("as_of"))
    offers = current_offers(obs, as_of)
    current = offers.groupBy("product").agg(F.min("price").alias("current_price"), F.count_distinct("seller").alias("seller_count"))
    daily = daily_lowest_in_stock(obs).join(as_of, "product")
    days_90 = daily.where(within_days(F.col("ts"), F.col("as_of"), 90))
    in_30 = within_days(F.col("ts"), F.col("as_of"), 30)
    history = days_90.join(current.select("product", "current_price"), "product", "left").groupBy("product").agg(
        F.count(F.when(in_30, 1)).alias("history_days_30d"),
        F.count("*").alias("history_days_90d"),
        F.median(F.when(in_30, F.col("price"))).alias("median_30d"),
        F.median("price").alias("median_90d"),
        F.min("price").alias("recent_low_90d"),
        (F.sum(F.when(F.col("price") < F.col("current_price"), 1.0).when(F.col("price") == F.col("current_price"), 0.5).otherwise(0.0)) * 100 / F.count("*")).alias("pct"),
        robust_cv("price").alias("vol"),
    )
    odd = mad_anomalies(days_90).groupBy("product").agg(F.count("*").alias("anomaly_count"))
    rows = as_of.join(current, "product", "left").join(history, "product", "left").join(market_trends(obs, as_of), "product", "left").join(odd, "product", "left")
    enough = F.coalesce(F.col("history_days_90d") >= min_days, F.lit(False))
    rows = rows.withColumn("history_sufficient", enough)
    rows = rows.withColumn("percentile_90d", F.when(enough & (F.col("current_price") != 0), F.bround("pct", 2)))
    rows = rows.withColumn("volatility_90d", F.when(enough, F.col("vol")))
    labels = price_labels(*[F.col(c) for c in ("current_price", "median_30d", "recent_low_90d", "percentile_90d", "volatility_90d", "history_sufficient")])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        "product", "as_of", "current_price", "median_30d", "median_90d", "recent_low_90d", "percentile_90d", "volatility_90d", zero("seller_count"),
        F.coalesce("seller_trend", F.lit("insufficient_history")).alias("seller_trend"), F.coalesce("stock_trend", F.lit("insufficient_history")).alias("stock_trend"),
        zero("history_days_30d"), zero("history_days_90d"), "history_sufficient", labels.alias("labels"), zero("anomaly_count"),
    )


def price_history(obs: DataFrame, newest: int) -> DataFrame:
    """The newest observations of each product, and whether older ones were left out."""
    w = Window.partitionBy("product").orderBy(F.col("ts").desc(), "listing", "tie")
    ranked = obs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= newest + 1)
    more = F.max("rn").over(Window.partitionBy("product")) > newest
    return ranked.withColumn("truncated", more).where(F.col("rn") <= newest)
