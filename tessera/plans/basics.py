"""Filters, joins, aggregations, windows and samples over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import filters as P
from tessera.operators import relations as J
from tessera.operators import sampling as S
from tessera.operators import windows as W
from tessera.plans.registry import checkpoints, query, table

STOCK = "CASE WHEN p_size % 5 = 0 THEN 'out_of_stock' WHEN p_size % 5 = 1 THEN 'limited_stock' WHEN p_size % 7 = 0 THEN NULL ELSE 'in_stock' END"
VRAM = "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END"
TYPES = "(SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 2)"


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.withColumn("stock", F.expr(STOCK)).withColumn("vram", F.expr(VRAM))


def _two_types(part: DataFrame) -> list[str]:
    return [r.p_type for r in part.select("p_type").distinct().orderBy("p_type").limit(2).collect()]


@query(f"""SELECT p_partkey, p_name FROM (SELECT *, {STOCK} AS stock, {VRAM} AS vram FROM part)
WHERE p_brand <> (SELECT min(p_brand) FROM part) AND p_retailprice <= 1500 AND coalesce(stock IN ('in_stock', 'limited_stock'), false)
AND (p_type NOT IN {TYPES} OR coalesce(vram >= 16, false))""")
def filter_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = products(spark, sf_dir)
    low = part.agg(F.min("p_brand")).first()[0]
    f = P.ProductFilter(excluded_brands=[low.replace("-", "_").replace(" ", "_")], max_price=1500, minimum={"vram": (_two_types(part), 16)})
    cols = {"id": F.col("p_partkey"), "category": F.col("p_type"), "brand": F.col("p_brand"), "price": F.col("p_retailprice"), "stock": F.col("stock"), "vram": F.col("vram")}
    return part.where(P.product_matches(f, cols)).select("p_partkey", "p_name")


@query("""SELECT event_id, CASE WHEN regexp_matches(v, '^-?[0-9]+(\\.[0-9]+)?$') THEN v::DOUBLE END AS number, coalesce(CASE WHEN regexp_matches(v, '^-?[0-9]+(\\.[0-9]+)?$') THEN v::DOUBLE END >= 50, false) AS large
FROM (SELECT event_id, props ->> '$.k' AS v FROM events)""")
def filter_json_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = P.safe_number(F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", number.alias("number"), P.holds(number >= 50).alias("large"))


@query("SELECT p_partkey FROM part WHERE (p_name ILIKE '%a%' OR p_brand ILIKE '%a%') AND (p_name ILIKE '%1%' OR p_brand ILIKE '%1%')")
def filter_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(P.matches_terms(["a", "1"], [F.col("p_name"), F.col("p_brand")])).select("p_partkey")


@query(f"""SELECT p_partkey, concat_ws(',', CASE WHEN NOT coalesce(stock = 'in_stock', false) THEN 'not_in_stock' END, CASE WHEN NOT coalesce(p_retailprice <= 1400, false) THEN 'over_budget' END,
CASE WHEN NOT coalesce(vram >= 10, false) THEN 'vram_too_small' END) AS reasons FROM (SELECT *, {STOCK} AS stock, {VRAM} AS vram FROM part)""")
def filter_eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = P.reasons([(F.col("stock") == "in_stock", "not_in_stock"), (F.col("p_retailprice") <= 1400, "over_budget"), (P.feature_matches(F.col("vram"), "at_least", 10), "vram_too_small")])
    return products(spark, sf_dir).select("p_partkey", F.array_join(why, ",").alias("reasons"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN NOT coalesce(o_orderstatus = 'F', false) THEN 'o_orderstatus_mismatch' END,
CASE WHEN NOT coalesce(o_orderpriority = '1-URGENT', false) THEN 'o_orderpriority_mismatch' END) AS reasons FROM orders""")
def filter_contract_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = P.mismatch_reasons({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(why, ",").alias("reasons"))


@query("""WITH t AS (SELECT p_partkey, p_size, p_type, string_split(p_name, ' ') AS words FROM part)
SELECT p_partkey, CASE WHEN p_size >= 40 AND len(words) >= 1 THEN 4 WHEN p_size >= 20 THEN 3 ELSE 0 END::INTEGER AS grade FROM t""")
def filter_silver_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    must, top = P.constraint(F.col("p_size"), "ge", 20), P.constraint(F.col("p_size"), "ge", 40) & P.constraint(words, "not_null")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(must & top, 4).when(must, 3).otherwise(0).alias("grade"))


@query("SELECT event_id FROM events WHERE ts BETWEEN (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND (SELECT max(ts) FROM events)")
def filter_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.pricing import within_days

    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("as_of"))
    return events.join(newest).where(within_days(F.col("ts"), F.col("as_of"), 7)).select("event_id")


@query("""SELECT o_orderkey, arg_min(l_partkey, (l_extendedprice, l_linenumber)) AS l_partkey, min(l_extendedprice) AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R' GROUP BY o_orderkey""")
def join_cheapest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").withColumnRenamed("l_extendedprice", "price")
    best = J.best_per(lines, ["l_orderkey"], F.struct("price", "l_linenumber"), ["l_partkey", "price"])
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(best, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_partkey", "price")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def join_without_open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return table(spark, sf_dir, "customer").join(opened, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def join_with_large_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_suppkey")
    return table(spark, sf_dir, "supplier").join(large, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("""SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 8""")
def join_left_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")).where("n < 8")


@query("SELECT DISTINCT p_partkey, p_brand FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_discount > 0.05")
def join_distinct_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select("l_partkey")
    part = table(spark, sf_dir, "part")
    return part.join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_brand").distinct()


@query("""SELECT vec_id, label, doc_id FROM embeddings JOIN documents ON vec_id = doc_id AND sha256(text) = sha256(CASE WHEN vec_id % 3 = 0 THEN text || ' old' ELSE text END) WHERE lang = 'en'""")
def join_vectors_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("content"), "text")
    stored = F.sha2(F.when(F.col("vec_id") % 3 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text")), 256)
    indexed = table(spark, sf_dir, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").select("vec_id", "label", stored.alias("indexed"))
    live = docs.where("lang = 'en'").select("doc_id", "content")
    return indexed.join(live, (F.col("vec_id") == F.col("doc_id")) & (F.col("indexed") == F.col("content"))).select("vec_id", "label", "doc_id")


@query("""SELECT doc_id, 'novel' AS change FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'removed' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'duplicate' FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1 UNION SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)""")
def join_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.snapshot_diff(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id")


@query("""SELECT l_orderkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS l_linestatus, min(l_linestatus) <> max(l_linestatus) AS conflicting FROM lineitem GROUP BY l_orderkey""")
def join_consistent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.consistent_lookup(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus")


@query("""SELECT d.doc_id, coalesce(l.quality, (n_chars > 1500)::INTEGER) AS quality, l.quality IS NOT NULL AS overridden FROM documents d LEFT JOIN labels l USING (doc_id)""")
def join_reviewed_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    auto = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("quality"))
    return J.reviewed(auto, table(spark, sf_dir, "labels"), "doc_id", "quality")


@query("""SELECT event_id, concat_ws(',', CASE WHEN c_custkey IS NULL THEN 'unknown_customer' END, CASE WHEN p_partkey IS NULL THEN 'unknown_part' END) AS faults FROM events
LEFT JOIN (SELECT DISTINCT c_custkey FROM customer) ON user_id = c_custkey LEFT JOIN (SELECT DISTINCT p_partkey FROM part) ON event_id = p_partkey""")
def join_reference_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = [("customer", table(spark, sf_dir, "customer"), "c_custkey", "user_id"), ("part", table(spark, sf_dir, "part"), "p_partkey", "event_id")]
    return J.reference_faults(table(spark, sf_dir, "events"), parents).select("event_id", F.array_join("faults", ",").alias("faults"))


@query("""WITH RECURSIVE e AS (SELECT doc_id AS a, 1000000000 + n_chars AS b FROM documents), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS x, a AS y FROM w UNION SELECT r.x, w.b FROM r JOIN w ON r.y = w.a) SELECT x AS node, min(y) AS component FROM r GROUP BY x""")
def join_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints(spark)
    return J.connected(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"), (F.lit(1000000000) + F.col("n_chars")).alias("b")))


@query("""WITH old AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1), new AS (SELECT user_id AS id, -count(*) AS n FROM events GROUP BY 1)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)""")
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    new = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg((-F.count("*")).alias("n"))
    return J.upsert(old, new, ["id"])


@query("""WITH x AS (SELECT *, count(DISTINCT source) OVER (PARTITION BY lang, text) AS p, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, CASE WHEN p > 1 THEN 'price_conflict' WHEN rn = 1 THEN 'kept' ELSE 'duplicate' END AS outcome FROM x""")
def join_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("title"))
    return J.quarantine(rows, ["lang", "title"], "source", ["doc_id"]).select("doc_id", "outcome")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS families, count(DISTINCT l_partkey) AS entities FROM lineitem GROUP BY ALL")
def agg_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cohort_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_suppkey", "l_partkey")


@query("""WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS median, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(any_value(median), 6) AS median, any_value(n) AS n, round(median(abs(l_extendedprice - median)), 6) AS mad FROM lineitem JOIN m USING (l_suppkey) GROUP BY l_suppkey""")
def agg_median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.median_and_mad(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice").withColumns({c: F.round(c, 6) for c in ("median", "mad")})


@query("""WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT user_id, event_type, round(avg(CASE WHEN hi - lo <= 1e-12 THEN 50 ELSE 100 * CASE WHEN event_type < 'm' THEN 1 - (value - lo) / (hi - lo) ELSE (value - lo) / (hi - lo) END END), 6) AS score FROM events JOIN s USING (event_type) GROUP BY ALL""")
def agg_workload_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("lower", F.col("event_type") < "m")
    return A.scaled_scores(rows, ["event_type"], ["user_id", "event_type"], "value", "lower")


@query("""SELECT event_type, count(*) AS n, count_if(value > 50) AS high, count_if(user_id % 2 = 0) AS even FROM events GROUP BY 1""")
def agg_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.conditional_counts(table(spark, sf_dir, "events"), ["event_type"], {"high": F.col("value") > 50, "even": F.col("user_id") % 2 == 0})


@query("""SELECT 'category' AS facet, p_type AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'brand', p_brand, count(*) FROM part WHERE p_type = (SELECT min(p_type) FROM part) GROUP BY ALL""")
def agg_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return A.facets(part, "p_type", "p_brand", part.agg(F.min("p_type")).first()[0])


@query(f"""SELECT p_type, count(*) AS n, count_if(vram IS NOT NULL) AS has_memory, count_if(stock IS NOT NULL OR p_size > 25) AS has_offer, round(count_if(vram IS NOT NULL AND (stock IS NOT NULL OR p_size > 25)) / count(*), 6) AS ready_rate
FROM (SELECT *, {STOCK} AS stock, {VRAM} AS vram FROM part) GROUP BY p_type""")
def agg_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = products(spark, sf_dir).withColumn("big", F.when(F.col("p_size") > 25, "y"))
    return A.readiness(part, ["p_type"], {"memory": [F.col("vram")], "offer": [F.col("stock"), F.col("big")]})


@query("SELECT sha256(text) AS content, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def agg_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicate_groups(table(spark, sf_dir, "documents").withColumn("content", F.sha2("text", 256)), ["content"], "doc_id")


@query("SELECT judgments, count(*) AS items FROM (SELECT user_id, count(*) AS judgments FROM events GROUP BY 1) GROUP BY 1")
def agg_coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.coverage_histogram(table(spark, sf_dir, "events"), "user_id")


@query("""SELECT o_custkey, count(*) AS judgments, min(o_orderstatus) = max(o_orderstatus) AS unanimous, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS grade FROM orders GROUP BY 1""")
def agg_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.agreement(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("""WITH t AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) SELECT count(*) AS n, count_if(event_type = 'click') AS failures, count_if(event_type <> 'click') AS successes, max(event_id) FILTER (ts = (SELECT max(ts) FROM t)) AS latest, (SELECT count(*) > 1000 FROM events) AS truncated FROM t""")
def agg_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    rows = A.receipts(e.select("event_id", "event_type", "at", "ts"), "ts", "event_type", ["click"], 1000)
    newest = e.agg(F.max("at").alias("m")).select(F.col("m.event_id").alias("id"))
    return rows.drop("latest").crossJoin(newest.withColumnRenamed("id", "latest"))


@query("""WITH n AS (SELECT user_id, max(ts) AS newest, count_if(ts IS NULL) AS nulls, count_if(ts > TIMESTAMP '2024-01-20') AS future FROM events GROUP BY 1)
SELECT epoch_us(min(newest)) AS watermark, count(*) AS keys, sum(nulls)::BIGINT AS null_times, sum(future)::BIGINT AS future_times FROM n""")
def agg_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.freshness(table(spark, sf_dir, "events"), "user_id", "ts", F.lit("2024-01-20").cast("timestamp_ntz"))
    return rows.withColumn("watermark", F.unix_micros(F.col("watermark").cast("timestamp")))


@query("""WITH b AS (SELECT unnest([0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 'inf'::DOUBLE]) AS le), e AS (SELECT event_type, value / 10 AS s FROM events)
SELECT event_type, CASE WHEN le = 'inf'::DOUBLE THEN '+Inf' ELSE printf('%.3f', le) END AS le, count(*) AS n FROM e JOIN b ON le >= s GROUP BY ALL""")
def agg_latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latency_histogram(table(spark, sf_dir, "events").withColumn("s", F.col("value") / 10), "event_type", "s")


@query("SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, round_even(100 * stddev_pop(l_quantity) / median(l_quantity), 2) AS cv, CASE WHEN count(l_tax) FILTER (l_tax > 0.07) > 1 THEN round_even(100 * stddev_pop(CASE WHEN l_tax > 0.07 THEN 0 END) / nullif(median(CASE WHEN l_tax > 0.07 THEN 0 END), 0), 2) END AS cv_of_zeros FROM lineitem GROUP BY 1")
def agg_distinct_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("zero", F.when(F.col("l_tax") > 0.07, 0)).groupBy("l_suppkey").agg(A.distinct_list("l_returnflag").alias("flags"), A.robust_cv("l_quantity").alias("cv"), A.robust_cv("zero").alias("cv_of_zeros"))


@query("SELECT c_mktsegment, round(100.0 * sum(CASE WHEN c_acctbal < 1000 THEN 1.0 WHEN c_acctbal = 1000 THEN 0.5 ELSE 0 END) / count(*), 2) AS pct FROM customer GROUP BY 1")
def agg_mid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(A.mid_rank_percentile(F.col("c_acctbal"), F.lit(1000.0)), 2).alias("pct"))


@query("SELECT p_type, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rank FROM part) WHERE rank <= 5")
def window_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.top_k(table(spark, sf_dir, "part"), ["p_type"], "p_retailprice", "p_partkey", 5).select("p_type", "p_partkey", "rank")


@query("""SELECT p_partkey, rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2 AS avg_rank,
round(CASE WHEN max(p_size) OVER w > min(p_size) OVER w THEN (p_size - min(p_size) OVER w) / (max(p_size) OVER w - min(p_size) OVER w) ELSE 0 END, 6) AS scaled, round(cume_dist() OVER (PARTITION BY p_type ORDER BY p_retailprice), 6) AS pct FROM part WINDOW w AS (PARTITION BY p_type)""")
def window_ranks_and_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", W.average_rank("p_size", ["p_type"]).alias("avg_rank"), F.round(W.min_max("p_size", ["p_type"]), 6).alias("scaled"), F.round(W.price_percentile(part, ["p_type"], "p_retailprice"), 6).alias("pct"))


@query("""WITH r AS (SELECT *, row_number() OVER w AS rn, lead(l_extendedprice) OVER w AS runner_up FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber))
SELECT l_suppkey, l_orderkey, round(l_extendedprice - coalesce(runner_up, 0), 4) AS margin FROM r WHERE rn = 1""")
def window_winner_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("tie", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return W.winner_margin(rows, ["l_suppkey"], "l_extendedprice", "tie").select("l_suppkey", "l_orderkey", F.round("margin", 4).alias("margin"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question FROM conversations""")
def window_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", W.carry_forward(rows, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("text"))).alias("question"))


@query("""WITH s AS (SELECT l_suppkey, l_linenumber AS stage, count(*) AS kept FROM lineitem GROUP BY ALL), f AS (SELECT *, first_value(kept) OVER w AS initial, coalesce(lag(kept) OVER w, kept) AS before FROM s WINDOW w AS (PARTITION BY l_suppkey ORDER BY stage))
SELECT l_suppkey, stage, kept, before, initial, round(1 - kept / before, 6) AS pruned, round(1 - kept / initial, 6) AS pruned_total FROM f""")
def window_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("stage")).agg(F.count("*").alias("kept"))
    return W.funnel(s, ["l_suppkey"], "stage", "kept").withColumns({c: F.round(c, 6) for c in ("pruned", "pruned_total")})


@query("SELECT doc_id, left(sha256(concat('seed', chr(0), doc_id::VARCHAR)), 16) AS priority FROM documents ORDER BY priority, doc_id LIMIT 100")
def sample_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "seed", "doc_id", 100)


@query("""WITH s AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS place, count(*) OVER () AS k FROM (SELECT DISTINCT p_type FROM part)),
q AS (SELECT p_type, (100 // k) + (place <= 100 % k)::INT AS quota FROM s), r AS (SELECT p_partkey, p_type, p_size = 50 AS anchor, left(sha256(concat('s', chr(0), p_partkey::VARCHAR)), 16) AS priority FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY anchor DESC, priority, p_partkey) AS rn FROM r)
SELECT p_partkey, anchor, rn <= quota AS within FROM n JOIN q USING (p_type) ORDER BY anchor DESC, within DESC, priority, p_partkey LIMIT 100""")
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_sample(table(spark, sf_dir, "part"), "s", "p_partkey", "p_type", 100, F.col("p_size") == 50).select("p_partkey", "anchor", "within")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50")
def page_of_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.paged(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], 3, 25)[0].select("p_partkey", "p_retailprice")


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents), s AS (SELECT doc_id, list(w) AS ws FROM t GROUP BY 1), b AS (SELECT list(DISTINCT w) AS bs FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark))
SELECT doc_id, round(len(list_intersect(ws, bs)) / (len(ws) + len(bs) - len(list_intersect(ws, bs))), 6) AS jaccard FROM s, b""")
def set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda d, *c: d.select(*c, F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    known = words(table(spark, sf_dir, "benchmark")).distinct().withColumn("known", F.lit(1))
    size = known.agg(F.count("*").alias("size"))
    shared = words(table(spark, sf_dir, "documents"), "doc_id").join(known, "w", "left").groupBy("doc_id").agg(F.count("*").alias("own"), F.count("known").alias("both"))
    return shared.join(size).select("doc_id", F.round(F.col("both") / (F.col("own") + F.col("size") - F.col("both")), 6).alias("jaccard"))


@query("""SELECT doc_id, 'left' AS only_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def set_universe_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.same_universe(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""WITH j AS (SELECT user_id AS item, event_type AS grade, event_id % 7 AS judge FROM events WHERE event_type IN ('click', 'view')), d AS (SELECT c_custkey AS item, c_custkey % 40 AS adjudicator, 'view' AS decided FROM customer WHERE c_custkey % 3 <> 0),
a AS (SELECT item, count(*) AS judgments, min(grade) AS lo, max(grade) AS hi, list(DISTINCT judge) AS judges FROM j GROUP BY 1), s AS (SELECT a.*, decided, CASE WHEN lo = hi THEN 'unanimous' WHEN adjudicator IS NULL THEN 'open' WHEN list_contains(judges, adjudicator) THEN 'invalid_adjudicator' ELSE 'adjudicated' END AS source FROM a LEFT JOIN d USING (item))
SELECT item, judgments, CASE WHEN lo = hi THEN lo WHEN source = 'adjudicated' THEN decided END AS grade, source FROM s""")
def agg_adjudicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'view')").select(F.col("user_id").alias("item"), F.col("event_type").alias("grade"), (F.col("event_id") % 7).alias("judge"))
    made = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("item"), (F.col("c_custkey") % 40).alias("adjudicator"), F.lit("view").alias("decided"))
    return A.adjudicated(rows, made, "item", "grade", "judge")


@query("""WITH RECURSIVE p0 AS (SELECT p_partkey AS id, p_size AS s, p_partkey % 9 AS t FROM part WHERE p_type = 'SMALL' AND p_size > 30), q0 AS (SELECT p_partkey AS id, p_size AS s, p_partkey % 9 AS t FROM part WHERE p_type = 'LARGE' AND p_size > 12), r0 AS (SELECT p_partkey AS id, p_size AS s, p_partkey % 9 AS t FROM part WHERE p_type = 'PROMO' AND p_size < 25),
""" + ", ".join(f"p{i + 1} AS (SELECT * FROM p{i} a WHERE EXISTS (SELECT 1 FROM q{i} b WHERE b.s = a.s)), q{i}h AS (SELECT * FROM q{i} b WHERE EXISTS (SELECT 1 FROM p{i + 1} a WHERE b.s = a.s)), "
    f"q{i + 1} AS (SELECT * FROM q{i}h b WHERE EXISTS (SELECT 1 FROM r{i} c WHERE c.t = b.t AND c.s < b.s)), r{i + 1} AS (SELECT * FROM r{i} c WHERE EXISTS (SELECT 1 FROM q{i + 1} b WHERE c.t = b.t AND c.s < b.s))" for i in range(6))
    + " SELECT 'p' AS side, id FROM p6 UNION ALL SELECT 'q', id FROM q6 UNION ALL SELECT 'r', id FROM r6")
def join_arc_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints(spark)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("s"), (F.col("p_partkey") % 9).alias("t"), "p_type")
    sides = {"p": part.where("p_type = 'SMALL' and s > 30"), "q": part.where("p_type = 'LARGE' and s > 12"), "r": part.where("p_type = 'PROMO' and s < 25")}
    out = J.arc_consistent(sides, [("p", "q", F.col("p_s") == F.col("q_s")), ("q", "r", (F.col("q_t") == F.col("r_t")) & (F.col("r_s") < F.col("q_s")))])
    return out["p"].select(F.lit("p").alias("side"), F.col("p_id").alias("id")).union(out["q"].select(F.lit("q"), "q_id")).union(out["r"].select(F.lit("r"), "r_id"))


@query("""SELECT a.p_partkey AS left_id, b.p_partkey AS right_id, CASE WHEN a.p_size = 50 OR b.p_size = 50 THEN 'unknown' WHEN abs(a.p_size - b.p_size) > 20 THEN 'fail' ELSE 'warning' END AS status
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = 'SMALL' AND b.p_type = 'LARGE' WHERE a.p_size = 50 OR b.p_size = 50 OR abs(a.p_size - b.p_size) > 10""")
def join_pair_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    side = lambda kind, p: part.where(F.col("p_type") == kind).select(F.col("p_partkey").alias(f"{p}_id"), F.col("p_size").alias(f"{p}_size"), F.col("p_brand").alias(f"{p}_brand"))
    apart = F.abs(F.col("left_size") - F.col("right_size"))
    status = F.when((F.col("left_size") == 50) | (F.col("right_size") == 50), "unknown").when(apart > 20, "fail").when(apart > 10, "warning").otherwise("pass")
    return J.pair_constraints(side("SMALL", "left"), side("LARGE", "right"), F.col("left_brand") == F.col("right_brand"), status).select("left_id", "right_id", "status")


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN 'rush' END, CASE WHEN o_orderstatus = 'F' THEN 'done' END, 'none') AS alias, o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P' AND o_totalprice > 1000 AS rights_valid,
o_orderkey % 5 IN (0, 3) AS leaks, round(CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 ELSE 0 END + greatest(0, o_custkey % 4 - 1) + CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE 0 END, 6)::DOUBLE AS known FROM orders""")
def filter_rights_and_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First known alias, rights on a date, payloads that would tell a reviewer the answer, and sums of known entries."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    payload = F.concat(F.lit('{"a": {"'), F.when(k % 5 == 0, "bm25_Score").when(k % 5 == 3, "rank").otherwise("title"), F.lit('": 1, "text": "a score of 3"}}'))
    entries = F.create_map(F.lit("a"), F.when(c % 3 > 0, (c % 3).cast("double")), F.lit("b"), (c % 4 - 1).cast("double"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", P.first_of(F.when(F.col("o_orderpriority") == "1-URGENT", "rush"), F.when(F.col("o_orderstatus") == "F", "done"), F.lit("none")).alias("alias"),
        P.rights_valid(F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp"), [F.col("o_orderstatus") != "P", F.col("o_totalprice") > 1000]).alias("rights_valid"), P.leaks_hint(payload).alias("leaks"), A.known_sum(entries).alias("known"),
    )


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 2 = 1 THEN 'equals' END, CASE WHEN p_size >= 25 THEN 'at_least' END, CASE WHEN len(list_filter(string_split(p_name, ' '), lambda x: x = 'widget')) > 0 THEN 'contains' END, CASE WHEN p_partkey % 3 = 1 THEN 'truthy' END) AS met,
len(list_filter(string_split(p_name, ' '), lambda x: replace(lower(x), '-', '_') = 'red')) > 0 AS any_red FROM part""")
def filter_feature_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, k = F.split("p_name", " "), F.col("p_partkey")
    kinds = [("equals", F.when(F.col("p_size") % 2 == 1, "on").otherwise("off"), "on"), ("at_least", F.col("p_size"), 25), ("contains", words, "widget"), ("truthy", F.when(k % 3 == 1, True).when(k % 3 == 2, False), None)]
    met = F.filter(F.array(*[F.when(P.feature_matches(c, op, want), F.lit(op)) for op, c, want in kinds]), lambda x: x.isNotNull())
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(met, ",").alias("met"), P.any_equal(words, "RED ").alias("any_red"))
