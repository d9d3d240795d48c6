"""Price queries: product is a brand, a listing and a seller are a supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import pricing as P
from tessera.plans.registry import query, table

OBS = """obs AS (SELECT p_brand AS product, l_suppkey AS listing, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_returnflag <> 'R' AS in_stock,
  l_suppkey AS seller, l_orderkey * 10 + l_linenumber AS tie FROM lineitem JOIN part ON l_partkey = p_partkey),
asof_t AS (SELECT product, max(ts) AS as_of FROM obs GROUP BY product),
daily AS (SELECT product, ts::DATE AS day, ts, listing, price FROM obs WHERE in_stock
  QUALIFY row_number() OVER (PARTITION BY product, ts::DATE ORDER BY price, listing, tie) = 1)"""
OFFERS = """offers AS (SELECT o.* FROM (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY product, listing ORDER BY ts DESC, tie) = 1) o
  JOIN asof_t a ON o.product = a.product WHERE in_stock AND ts >= as_of - INTERVAL 48 HOUR)"""
MAD = """d90 AS (SELECT d.*, as_of FROM daily d JOIN asof_t USING (product) WHERE ts BETWEEN as_of - INTERVAL 90 DAY AND as_of),
c AS (SELECT product, median(price) AS centre FROM d90 GROUP BY product HAVING count(*) >= 3),
o AS (SELECT d90.*, price - centre AS off FROM d90 JOIN c USING (product)),
m AS (SELECT product, median(abs(off)) AS mad FROM o GROUP BY product),
odd AS (SELECT o.*, mad, CASE WHEN mad <> 0 THEN round_even(0.6745::DOUBLE * off / mad, 4) END AS score FROM o JOIN m USING (product)),
anomalies AS (SELECT product, ts, listing, price, CASE WHEN off > 0 THEN 'high' ELSE 'low' END AS direction, score FROM odd
  WHERE CASE WHEN mad = 0 THEN off <> 0 ELSE abs(score) > 3.5 END)"""
TREND = """st AS (SELECT product, ts::DATE AS day, in_stock, seller, as_of FROM obs JOIN asof_t USING (product) WHERE ts BETWEEN as_of - INTERVAL 14 DAY AND as_of
  QUALIFY row_number() OVER (PARTITION BY product, ts::DATE, listing ORDER BY ts DESC, tie) = 1),
sd AS (SELECT product, day, any_value(as_of) AS as_of, count(DISTINCT CASE WHEN in_stock THEN seller END) AS sellers, avg(in_stock::INT) AS ratio FROM st GROUP BY product, day),
tr AS (SELECT product, count(*) FILTER (day >= (as_of - INTERVAL 7 DAY)::DATE) AS nn, count(*) FILTER (day < (as_of - INTERVAL 7 DAY)::DATE) AS np,
  avg(sellers) FILTER (day >= (as_of - INTERVAL 7 DAY)::DATE) AS sn, avg(sellers) FILTER (day < (as_of - INTERVAL 7 DAY)::DATE) AS sp,
  avg(ratio) FILTER (day >= (as_of - INTERVAL 7 DAY)::DATE) AS rn, avg(ratio) FILTER (day < (as_of - INTERVAL 7 DAY)::DATE) AS rp FROM sd GROUP BY product),
trends AS (SELECT product,
  CASE WHEN nn < 2 OR np < 2 THEN 'insufficient_history' WHEN sn - sp > greatest(0.5, abs(sp) * 0.1) THEN 'increasing' WHEN sn - sp < -greatest(0.5, abs(sp) * 0.1) THEN 'decreasing' ELSE 'stable' END AS seller_trend,
  CASE WHEN nn < 2 OR np < 2 THEN 'insufficient_history' WHEN rn - rp > greatest(0.1, abs(rp) * 0.1) THEN 'increasing' WHEN rn - rp < -greatest(0.1, abs(rp) * 0.1) THEN 'decreasing' ELSE 'stable' END AS stock_trend FROM tr)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("product"), F.col("l_suppkey").alias("listing"), F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_returnflag") != "R").alias("in_stock"), F.col("l_suppkey").alias("seller"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"),
    )


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


@query(f"""WITH {OBS}, {OFFERS}, {MAD}, {TREND},
cur AS (SELECT product, min(price) AS current_price, count(DISTINCT seller) AS seller_count FROM offers GROUP BY product),
h AS (SELECT product, count(*) FILTER (ts >= as_of - INTERVAL 30 DAY) AS history_days_30d, count(*) AS history_days_90d,
  median(price) FILTER (ts >= as_of - INTERVAL 30 DAY) AS median_30d, median(price) AS median_90d, min(price) AS recent_low_90d,
  100.0::DOUBLE * sum(CASE WHEN price < current_price THEN 1.0::DOUBLE WHEN price = current_price THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*) AS pct, CASE WHEN count(price) > 1 THEN round_even(100 * stddev_pop(price) / nullif(median(price), 0), 2) END AS vol
  FROM d90 LEFT JOIN cur USING (product) GROUP BY product),
n AS (SELECT product, count(*) AS anomaly_count FROM anomalies GROUP BY product),
r AS (SELECT *, coalesce(history_days_90d >= 7, false) AS history_sufficient FROM asof_t LEFT JOIN cur USING (product) LEFT JOIN h USING (product) LEFT JOIN trends USING (product) LEFT JOIN n USING (product)),
q AS (SELECT *, CASE WHEN history_sufficient AND current_price <> 0 THEN round_even(pct, 2) END AS percentile_90d, CASE WHEN history_sufficient THEN vol END AS v FROM r)
SELECT product, strftime(as_of, '%Y-%m-%d') AS as_of, round(current_price, 6) AS current_price, round(median_30d, 6) AS median_30d, round(median_90d, 6) AS median_90d, round(recent_low_90d, 6) AS recent_low_90d,
  percentile_90d, round(v, 6) AS volatility_90d, coalesce(seller_count, 0) AS seller_count, coalesce(seller_trend, 'insufficient_history') AS seller_trend, coalesce(stock_trend, 'insufficient_history') AS stock_trend,
  coalesce(history_days_30d, 0) AS history_days_30d, coalesce(history_days_90d, 0) AS history_days_90d, history_sufficient, coalesce(anomaly_count, 0) AS anomaly_count,
  CASE WHEN current_price IS NULL THEN 'no_current_offer' WHEN NOT history_sufficient THEN 'insufficient_history' ELSE
    concat_ws(',', CASE WHEN current_price <= recent_low_90d * 1.03::DOUBLE THEN 'near_recent_low' END, CASE WHEN percentile_90d <= 25 THEN 'good_current_value' END,
      CASE WHEN current_price > median_30d * 1.1::DOUBLE THEN 'above_recent_average' END,
      CASE WHEN NOT (coalesce(current_price <= recent_low_90d * 1.03::DOUBLE, false) OR coalesce(percentile_90d <= 25, false) OR coalesce(current_price > median_30d * 1.1::DOUBLE, false)) THEN 'typical_price' END,
      CASE WHEN v >= 10 THEN 'high_volatility' END) END AS labels FROM q""")
def price_intelligence_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.price_intelligence(observations(spark, sf_dir))
    six = {c: F.round(c, 6) for c in ("current_price", "median_30d", "median_90d", "recent_low_90d", "volatility_90d")}
    return rows.withColumns(six).withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))


@query(f"WITH {OBS} SELECT product, strftime(day, '%Y-%m-%d') AS day, listing, round(price, 6) AS price FROM daily")
def price_daily_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_lowest_in_stock(observations(spark, sf_dir)).select("product", _day("day"), "listing", F.round("price", 6).alias("price"))


@query(f"WITH {OBS}, {MAD} SELECT product, strftime(ts, '%Y-%m-%d') AS ts, listing, round(price, 6) AS price, direction, score FROM anomalies")
def price_mad_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    as_of = obs.groupBy("product").agg(F.max("ts").alias("as_of"))
    daily = P.daily_lowest_in_stock(obs).join(as_of, "product").where(P.within_days(F.col("ts"), F.col("as_of"), 90)).drop("as_of")
    return P.mad_anomalies(daily).select("product", _day("ts"), "listing", F.round("price", 6).alias("price"), "direction", "score")


@query(f"WITH {OBS}, {TREND} SELECT * FROM trends")
def price_market_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return P.market_trends(obs, obs.groupBy("product").agg(F.max("ts").alias("as_of")))


@query(f"WITH {OBS}, {OFFERS} SELECT product, listing, strftime(ts, '%Y-%m-%d') AS ts, round(price, 6) AS price, row_number() OVER (PARTITION BY product ORDER BY price, listing) = 1 AS cheapest FROM offers")
def price_current_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    obs = observations(spark, sf_dir)
    offers = P.current_offers(obs, obs.groupBy("product").agg(F.max("ts").alias("as_of")))
    first = F.row_number().over(Window.partitionBy("product").orderBy("price", "listing")) == 1
    return offers.select("product", "listing", _day("ts"), F.round("price", 6).alias("price"), first.alias("cheapest"))


@query(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ts DESC, listing, tie) AS rn, count(*) OVER (PARTITION BY product) > 20 AS truncated FROM obs)
SELECT product, rn::INTEGER AS rn, listing, round(price, 6) AS price, in_stock, truncated FROM r WHERE rn <= 20""")
def price_history_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.price_history(observations(spark, sf_dir), 20).select("product", "rn", "listing", F.round("price", 6).alias("price"), "in_stock", "truncated")


@query(f"""WITH {OBS}, g AS (SELECT product, ts::DATE AS day, listing, in_stock, seller FROM obs QUALIFY row_number() OVER (PARTITION BY product, ts::DATE, listing ORDER BY ts DESC, tie) = 1)
SELECT product, strftime(day, '%Y-%m-%d') AS day, count(DISTINCT CASE WHEN in_stock THEN seller END) AS sellers, round(avg(in_stock::INT), 6) AS stock_ratio FROM g GROUP BY product, day""")
def price_daily_market_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_market_state(observations(spark, sf_dir)).select("product", _day("day"), "sellers", F.round("stock_ratio", 6).alias("stock_ratio"))


@query("""WITH o AS (SELECT p_brand AS product, l_extendedprice / l_quantity + CASE WHEN l_tax > 0.02 THEN l_tax * 100 ELSE 0 END AS price, CASE WHEN p_brand IN ('Brand#7', 'Brand#11') AND l_suppkey % 2 = 0 THEN 'USD' ELSE 'SGD' END AS currency FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT product, string_agg(DISTINCT currency, ',' ORDER BY currency) AS currencies, count(DISTINCT currency) > 1 AS refused FROM o GROUP BY 1)
SELECT product, currencies, refused, CASE WHEN NOT refused THEN round(min(price), 6) END AS least, CASE WHEN NOT refused THEN round(median(price), 6) END AS middle FROM o JOIN c USING (product) GROUP BY product, currencies, refused""")
def price_single_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    currency = F.when(F.col("p_brand").isin("Brand#7", "Brand#11") & (F.col("l_suppkey") % 2 == 0), "USD").otherwise("SGD")
    price = P.delivered(F.col("l_extendedprice") / F.col("l_quantity"), F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 100))
    obs = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("product"), price.alias("price"), currency.alias("currency"))
    usable, mixed = P.single_currency(obs)
    good = usable.groupBy("product").agg(F.min("currency").alias("currencies"), F.round(F.min("price"), 6).alias("least"), F.round(F.median("price"), 6).alias("middle"))
    bad = mixed.select("product", F.array_join("currencies", ",").alias("currencies"), F.lit(True).alias("refused"))
    return good.withColumn("refused", F.lit(False)).unionByName(bad, allowMissingColumns=True)


@query(f"""WITH {OBS}, w AS (SELECT product, max(ts) AS newest, count(*) AS n FROM obs GROUP BY 1), e AS (SELECT product FROM obs GROUP BY 1 HAVING count(DISTINCT listing) >= 5),
r AS (SELECT o.*, row_number() OVER (PARTITION BY o.product ORDER BY ts DESC, listing, tie) AS rn FROM obs o JOIN e USING (product))
SELECT product, rn::INTEGER AS rn, listing, strftime(ts, '%Y-%m-%d') AS ts, round(price, 6) AS price, ts >= newest - INTERVAL 48 HOUR AS current, ts >= newest - INTERVAL 90 DAY AS in_history FROM r JOIN w USING (product) WHERE rn <= 10""")
def price_history_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest prices of products with five listings or more, and what each may be used for."""
    obs = observations(spark, sf_dir)
    eligible = obs.groupBy("product").agg(F.count_distinct("listing").alias("n")).where("n >= 5")
    rows = P.price_history(obs.join(eligible, "product", "left_semi"), 10)
    rows = rows.join(obs.groupBy("product").agg(F.max("ts").alias("newest")), "product")
    within = lambda span: F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {span}")
    return rows.select("product", "rn", "listing", _day("ts"), F.round("price", 6).alias("price"), within("48 HOURS").alias("current"), within("90 DAYS").alias("in_history"))
