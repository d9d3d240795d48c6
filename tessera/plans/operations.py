"""Quality, performance, records, sources and streams over events, orders and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import performance as G
from tessera.operators import quality as Q
from tessera.operators import records as N
from tessera.plans.registry import query, shared_root, table
from tessera.sources import files
from tessera.streaming import ingest


@query("""WITH a AS (SELECT count(*) AS n, count_if(event_id IS NULL) AS nulls, count(event_id) - count(DISTINCT event_id) AS dup, count_if(NOT coalesce(event_type IN ('click', 'view'), false)) AS bad, avg((value > 50)::INT) AS rate FROM events)
SELECT * FROM (SELECT unnest(['empty_batch', 'null_ids', 'duplicate_ids', 'unknown_schema', 'rejection_rate']) AS name, unnest([(n = 0)::DOUBLE, nulls::DOUBLE, dup::DOUBLE, bad::DOUBLE, (rate > 0.2)::INT::DOUBLE]) AS observed,
unnest([CASE WHEN n = 0 THEN 'fail' ELSE 'pass' END, CASE WHEN nulls > 0 THEN 'fail' ELSE 'pass' END, CASE WHEN dup > 0 THEN 'fail' ELSE 'pass' END, CASE WHEN bad > 0 THEN 'fail' ELSE 'pass' END, CASE WHEN rate > 0.2 THEN 'warning' ELSE 'pass' END]) AS status FROM a)""")
def quality_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.checks(table(spark, sf_dir, "events"), Q.batch_rules("event_id", "event_type", ["click", "view"], F.col("value") > 50))


@query("""WITH b AS (SELECT event_type, count(*) AS was FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), n AS (SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND value > 30 GROUP BY 1)
SELECT event_type, was, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'vanished' WHEN was >= 10 AND n < ceil(was * 0.6) THEN 'shrunk' ELSE 'pass' END AS status FROM b LEFT JOIN n USING (event_type)""")
def quality_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, cut = table(spark, sf_dir, "events"), F.lit("2024-01-16").cast("timestamp_ntz")
    count = lambda d: d.groupBy("event_type").agg(F.count("*").alias("n"))
    return Q.regressions(count(e.where((F.col("ts") >= cut) & (F.col("value") > 30))), count(e.where(F.col("ts") < cut)), "event_type")


@query("""SELECT CASE WHEN count_if(ts IS NULL) > 0 OR count_if(ts > TIMESTAMP '2024-01-29') > 0 THEN 'degraded' ELSE 'fresh' END AS status, count(DISTINCT user_id) AS keys FROM events""")
def quality_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-29").cast("timestamp_ntz")
    return Q.freshness_status(A.freshness(table(spark, sf_dir, "events"), "user_id", "ts", now), now, 24).select("status", "keys")


@query("""SELECT count(*) AS products, round(avg((n_chars > 500)::INT), 6) AS mapped, round(count(DISTINCT text) / count(*), 6) AS distinct_share, concat_ws(',', CASE WHEN count(*) < 750 THEN 'products' END, CASE WHEN avg((n_chars > 500)::INT) < 0.8 THEN 'mapped' END,
CASE WHEN count(DISTINCT text) / count(*) < 0.9 THEN 'distinct_share' END) AS blockers FROM documents""")
def quality_readiness_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "documents").agg(F.count("*").alias("products"), F.avg((F.col("n_chars") > 500).cast("int")).alias("mapped"), (F.count_distinct("text") / F.count("*")).alias("distinct_share"))
    return Q.readiness_blockers(totals, {"products": 750, "mapped": 0.8, "distinct_share": 0.9}).withColumns({c: F.round(c, 6) for c in ("mapped", "distinct_share")})


@query("""WITH r AS (SELECT o_orderkey, o_orderdate::DATE AS created, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + 90 END AS a, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate::DATE + 60 END AS b, o_orderstatus = 'P' AS hold FROM orders),
e AS (SELECT *, coalesce(least(a, b), created + 30) AS expires FROM r) SELECT o_orderkey, strftime(expires, '%Y-%m-%d') AS expires, CASE WHEN hold THEN 'hold' WHEN expires < DATE '2000-01-01' THEN 'delete' ELSE 'keep' END AS action FROM e""")
def quality_retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("created"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 90)).alias("a"), F.when(F.col("o_orderpriority") != "1-URGENT", F.date_add(day, 60)).alias("b"), (F.col("o_orderstatus") == "P").alias("hold"))
    return Q.retention_plan(rows, ["a", "b"], F.lit("2000-01-01").cast("date"), 30).select("o_orderkey", F.date_format("expires", "yyyy-MM-dd").alias("expires"), "action")


@query("""WITH e AS (SELECT event_id, user_id AS session, event_id % 500 AS key, event_type AS kind, event_id // 3 AS impression, round(value)::VARCHAR AS payload, 0 AS pass FROM events),
r AS (SELECT * FROM e UNION ALL SELECT * REPLACE (1 AS pass) FROM e), w AS (SELECT *, first_value(struct_pack(s := session, k := key, p := payload)) OVER a AS fa, first_value(struct_pack(s := session, k := key, p := payload)) OVER b AS fb, first_value(payload) OVER c AS fc,
row_number() OVER a AS na, row_number() OVER b AS nb, row_number() OVER c AS nc FROM r WINDOW a AS (PARTITION BY event_id ORDER BY pass, event_id), b AS (PARTITION BY session, key ORDER BY pass, event_id), c AS (PARTITION BY impression, kind ORDER BY pass, event_id))
SELECT event_id, pass, CASE WHEN na > 1 THEN CASE WHEN fa.s = session AND fa.k = key AND fa.p = payload THEN 'replay' ELSE 'conflict' END WHEN nb > 1 THEN CASE WHEN fb.s = session AND fb.k = key AND fb.p = payload THEN 'replay' ELSE 'conflict' END
WHEN nc > 1 THEN CASE WHEN fc = payload THEN 'duplicate' ELSE 'conflict' END ELSE 'accepted' END AS outcome FROM w""")
def stream_idempotent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), (F.col("event_id") % 500).alias("key"), F.col("event_type").alias("kind"), F.floor(F.col("event_id") / 3).alias("impression"),
                                              F.format_string("%.1f", F.round("value")).alias("payload"), F.lit(0).alias("pass"))
    return Q.idempotent(e.union(e.withColumn("pass", F.lit(1))), ["pass", "event_id"]).select("event_id", "pass", "outcome")


@query("""WITH m AS (SELECT l_suppkey, l_returnflag, median(l_extendedprice) AS med, count(*) AS n, count(DISTINCT l_partkey) AS entities FROM lineitem GROUP BY ALL HAVING count(*) >= 5)
SELECT l_suppkey, l_returnflag, round(any_value(med), 4) AS median, any_value(m.n) AS n, any_value(m.entities) AS entities, round(median(abs(l_extendedprice - med)), 4) AS mad, round(CASE WHEN l_returnflag = 'R' THEN 1000 / any_value(med) ELSE any_value(med) END, 6) AS target
FROM lineitem JOIN m USING (l_suppkey, l_returnflag) GROUP BY l_suppkey, l_returnflag""")
def performance_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("entity", F.col("l_partkey"))
    out = G.training_rows(rows, "l_suppkey", ["l_returnflag"], "l_extendedprice", F.col("l_returnflag") == "R", 5)
    return out.withColumns({"median": F.round("median", 4), "mad": F.round("mad", 4), "target": F.round("target", 6)})


@query("""SELECT 'several_generations' AS fault, 'l_suppkey' AS detail, count(*) AS n FROM (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)
UNION ALL SELECT 'duplicate_id', 'l_orderkey', count(l_orderkey) - count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'too_uniform', 'l_tax', 1 FROM lineitem HAVING count(DISTINCT l_tax) < 20""")
def performance_frame_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.frame_faults(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_returnflag", ["l_quantity", "l_tax"], 0.5, 20)


@query("""WITH o AS (SELECT l_partkey AS p_partkey, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'N' AND l_discount > 0.08 GROUP BY 1), m AS (SELECT p_type, avg(p_size) AS v FROM part GROUP BY 1)
SELECT p_partkey, round(coalesce(o.v, m.v), 6) AS value, CASE WHEN o.v IS NOT NULL THEN 'observed' WHEN m.v IS NOT NULL THEN 'predicted' ELSE 'unavailable' END AS basis FROM part LEFT JOIN o USING (p_partkey) LEFT JOIN m USING (p_type)""")
def performance_observed_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N' and l_discount > 0.08").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("value"))
    model = part.join(part.groupBy("p_type").agg(F.avg("p_size").alias("value")), "p_type").select("p_partkey", "value")
    return G.observed_first(part.select("p_partkey"), seen, model, ["p_partkey"]).withColumn("value", F.round("value", 6))


@query("SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS o_orderpriority, max(n) AS n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def performance_modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.modal(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query()
def performance_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return G.train_regressor(rows, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").transform(rows).select("l_orderkey", "l_linenumber", "prediction")


@query("""SELECT o_orderkey, CASE WHEN a IS NULL AND b IS NULL THEN 'unknown' WHEN a IS NULL OR b IS NULL OR a = b THEN coalesce(a, b) ELSE 'conflict' END AS stock
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'in_stock' WHEN o_orderstatus = 'F' THEN 'out_of_stock' END AS a, CASE WHEN o_totalprice > 50000 THEN 'in_stock' END AS b FROM orders)""")
def records_reconciled_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("o_orderstatus") == "O", "in_stock").when(F.col("o_orderstatus") == "F", "out_of_stock").otherwise("unknown")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.reconciled(a, F.when(F.col("o_totalprice") > 50000, "in_stock")).alias("stock"))


@query("""WITH k AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '(?i)tion') THEN 'tion' END, CASE WHEN regexp_matches(text, '(?i)keit') THEN 'keit' END, CASE WHEN regexp_matches(text, '(?i)eux') THEN 'eux' END], lambda x: x IS NOT NULL) AS ks, text FROM documents)
SELECT doc_id, left(text, 60) AS title, CASE WHEN len(ks) = 1 THEN ks[1] END AS category, CASE WHEN len(ks) = 0 THEN 'no_category' WHEN len(ks) > 1 THEN 'ambiguous_category' END AS reason FROM k""")
def records_single_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.keyed_single(table(spark, sf_dir, "documents"), "text", {"tion": "tion", "keit": "keit", "eux": "eux"}, 60).select("doc_id", "title", "category", "reason")


@query("""WITH b AS (SELECT l_partkey, arg_min(l_suppkey, (l_extendedprice, l_suppkey)) AS listing, min(l_extendedprice) AS price, count(*) AS offers FROM lineitem GROUP BY 1), s AS (SELECT l_partkey, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY 1)
SELECT p_partkey, price, listing, coalesce(offers, 0) AS offers, score FROM part LEFT JOIN b ON b.l_partkey = p_partkey LEFT JOIN s ON s.l_partkey = p_partkey""")
def records_assembled_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("listing"), F.col("l_extendedprice").alias("price"), "l_discount")
    return N.assembled(table(spark, sf_dir, "part").select("p_partkey"), lines, lines.groupBy("p_partkey").agg(F.round(F.avg("l_discount"), 6).alias("score")), "p_partkey")


@query("SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'authoritative' ELSE 'unknown' END AS authority FROM lineitem GROUP BY 1")
def records_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("kind", F.when(F.col("l_linestatus") == "F", "manufacturer").otherwise("retailer"))
    return N.authority(rows, "l_orderkey", "kind")


@query("SELECT page_id, url AS name, page_id::DECIMAL(12, 2)::DOUBLE AS price FROM pages")
def source_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit('<script type="application/ld+json">{"@graph": ['), F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("url").alias("name"), F.struct(F.col("page_id").alias("price")).alias("offers"))), F.lit("]}</script>"))
    rows = N.json_ld(table(spark, sf_dir, "pages").withColumn("html", F.concat("html", block)), "html").where("type = 'Product'")
    return rows.select("page_id", "name", F.col("price").cast("double").alias("price"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3")
def source_head_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.head_per_category(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber"], 3).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE n_chars > 1000")
def source_new_or_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.where("n_chars <= 1000").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return files.new_or_changed(docs, known, "doc_id", "text").select("doc_id", "content_hash")


def _folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer")
def source_json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    files.write_json_lines(rows, path, ["c_custkey"])
    return files.read_json_lines(spark, path, "c_acctbal double, c_custkey long, c_mktsegment string, c_name string")[0]


@query("SELECT event_id, user_id, event_type FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, events = _folder(spark), table(spark, sf_dir, "events")
    events.union(events).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    ingest.available_now(spark, f"{base}/in", schema, lambda s: ingest.deduplicated(s, ["event_id"], "ts", "40 days"), f"{base}/out", f"{base}/state")
    return spark.read.schema(schema).parquet(f"{base}/out").select("event_id", "user_id", "event_type")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, events = _folder(spark), table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{base}/in")
    published = f"{base}/out"
    agg = lambda d: d.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    ingest.staged(spark, f"{base}/in", events.schema, f"{base}/state", lambda batch, i: agg(batch).write.mode("overwrite").parquet(f"{published}/batch={i}"))
    parts = spark.read.parquet(published)
    return parts.groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


KINDS = "CASE o_orderstatus WHEN 'F' THEN 'canonical_product' WHEN 'O' THEN 'benchmark_observation' ELSE 'retailer_listing' END"
RECORDS = {
    "source_name": "CASE WHEN o_orderkey % 40 = 0 THEN 'bizgram_controlled_pdf' ELSE 'open' END", "source_record_id": "CASE WHEN o_orderkey % 50 = 1 THEN '' ELSE CAST(o_orderkey % 9000 AS STRING) END", "schema_version": "CASE WHEN o_orderkey % 60 > 0 THEN 'v1' END", "record_type": KINDS,
    "has_data": "o_orderkey % 70 > 0", "training_eligible": "o_orderkey % 80 = 0", "published_claims_eligible": "false", "product_id": "CASE WHEN o_orderkey % 11 > 0 THEN 'p' END", "category": "o_orderpriority", "brand": "CASE WHEN o_orderkey % 13 > 0 THEN 'b' ELSE '' END", "model": "'m'", "canonical_name": "'n'",
    "benchmark_id": "'x'", "unit": "CASE WHEN o_orderkey % 17 > 0 THEN 's' END", "score": "o_totalprice - 20000", "source_listing_id": "'l'", "base_price": "o_totalprice - 10000", "currency": "CASE WHEN o_orderkey % 19 > 0 THEN 'SGD' ELSE 'sgd' END",
}


@query("WITH r AS (SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in RECORDS.items()) + """ FROM orders WHERE o_orderkey % 100 < 75), x AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 100 >= 75),
a AS (SELECT (count(*) = 0)::BIGINT AS a1, count_if(source_record_id = '') AS a2, count(*) - count(DISTINCT source_record_id) AS a3, count_if(schema_version IS NULL OR NOT has_data) AS a4, ((SELECT n FROM x) > 0.2 * (count(*) + (SELECT n FROM x)))::BIGINT AS a5,
count_if(record_type = 'canonical_product' AND (product_id IS NULL OR brand = '')) AS a6, count_if(record_type = 'benchmark_observation' AND (product_id IS NULL OR unit IS NULL OR score <= 0)) AS a7, count_if(record_type = 'retailer_listing' AND (base_price <= 0 OR currency = 'sgd')) AS a8, count_if(source_name <> 'open' AND training_eligible) AS a9 FROM r),
u AS (SELECT unnest(['accepted_records_present', 'source_record_ids_present', 'source_record_ids_unique', 'normalised_envelope_complete', 'rejection_rate_within_threshold', 'canonical_products_valid', 'benchmark_values_valid', 'retailer_prices_valid', 'controlled_import_use_restricted']) AS name, unnest([a1, a2, a3, a4, a5, a6, a7, a8, a9]) AS count FROM a),
s AS (SELECT name, count, CASE WHEN count > 0 THEN 'fail' ELSE 'pass' END AS status FROM u) SELECT * FROM s UNION ALL SELECT 'overall', NULL::BIGINT + 0, CASE WHEN count_if(status = 'fail') > 0 THEN 'fail' ELSE 'pass' END FROM s""".replace("NULL::BIGINT + 0", "0::BIGINT"))
def quality_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    records = orders.where("o_orderkey % 100 < 75").select(*[F.expr(e).alias(c) for c, e in RECORDS.items()])
    out = Q.batch_report(records, orders.where("o_orderkey % 100 >= 75").count())
    return out.union(Q.overall(out).select(F.lit("overall").alias("name"), F.lit(0).cast("long").alias("count"), "status"))


def _counts_sql(name: str, where: str) -> str:
    return f"""{name}s AS (SELECT {KINDS} AS record_type, o_orderpriority AS category, o_orderkey % 5 = 0 AS rejected FROM orders WHERE {where}),
{name} AS (SELECT 'accepted' AS kind, '' AS key, count_if(NOT rejected) AS n FROM {name}s UNION ALL SELECT 'rejected', '', count_if(rejected) FROM {name}s UNION ALL SELECT 'record_type', record_type, count(*) FROM {name}s GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM {name}s GROUP BY 2)"""


@query(f"""WITH {_counts_sql('w', 'o_orderkey % 2 = 0')}, {_counts_sql('n', "o_orderkey % 2 = 1 AND o_orderstatus <> 'O' AND (o_orderpriority <> '5-LOW' OR o_custkey % 2 = 0) AND (o_orderkey % 5 = 0 OR o_custkey % 4 > 0)")},
b AS (SELECT coalesce(w.kind, n.kind) AS kind, coalesce(w.key, n.key) AS key, coalesce(w.n, 0) AS was, coalesce(n.n, 0) AS now FROM w FULL JOIN n ON w.kind = n.kind AND w.key = n.key),
a AS (SELECT sum(CASE WHEN kind = 'accepted' THEN greatest(0, ceil(was * 0.7) - now) ELSE 0 END)::BIGINT AS a1, sum(CASE WHEN kind = 'record_type' AND key = 'retailer_listing' AND was >= 10 THEN greatest(0, ceil(was * 0.7) - now) ELSE 0 END)::BIGINT AS a2, count_if(kind = 'record_type' AND was >= 10 AND now = 0) AS a3,
sum(CASE WHEN kind = 'category' AND was >= 10 THEN greatest(0, ceil(was * 0.6) - now) ELSE 0 END)::BIGINT AS a4, (sum(now) FILTER (kind = 'rejected') / sum(now) FILTER (kind IN ('accepted', 'rejected')) - sum(was) FILTER (kind = 'rejected') / sum(was) FILTER (kind IN ('accepted', 'rejected')) > 0.15)::BIGINT AS a5 FROM b),
u AS (SELECT unnest(['accepted_count_regression', 'retailer_listing_count_regression', 'record_type_regression', 'category_count_regression', 'rejection_rate_regression']) AS name, unnest([a1, a2, a3, a4, a5]) AS count FROM a) SELECT name, count, CASE WHEN count > 0 THEN 'fail' ELSE 'pass' END AS status FROM u""")
def quality_regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counts(where: str) -> DataFrame:
        rows = table(spark, sf_dir, "orders").where(where).select(F.expr(KINDS).alias("record_type"), F.col("o_orderpriority").alias("category"), (F.col("o_orderkey") % 5 == 0).alias("rejected"))
        per = lambda kind: rows.groupBy(F.col(kind).alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
        both = rows.agg(F.count_if(~F.col("rejected")).alias("a"), F.count_if("rejected").alias("r")).select(F.inline(F.array(F.struct(F.lit("accepted").alias("kind"), F.lit("").alias("key"), F.col("a").alias("n")), F.struct(F.lit("rejected").alias("kind"), F.lit("").alias("key"), F.col("r").alias("n")))))
        return both.union(per("record_type")).union(per("category"))

    now = "o_orderkey % 2 = 1 AND o_orderstatus <> 'O' AND (o_orderpriority <> '5-LOW' OR o_custkey % 2 = 0) AND (o_orderkey % 5 = 0 OR o_custkey % 4 > 0)"
    return Q.regression_report(counts(now), counts("o_orderkey % 2 = 0"))


@query("""WITH o AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'matched' WHEN 1 THEN 'unmatched' WHEN 2 THEN 'manual_review' ELSE 'rejected_conflict' END AS outcome FROM lineitem), n AS (SELECT l_suppkey, l_partkey, max(l_shipdate) AS ts FROM lineitem GROUP BY ALL)
SELECT count(*) AS offers, count_if(outcome = 'matched') AS matched, count_if(outcome = 'unmatched') AS unmatched, count_if(outcome = 'manual_review') AS manual_review, count_if(outcome = 'rejected_conflict') AS rejected_conflict, (SELECT count(*) FROM n) AS listings, (SELECT count_if(ts < TIMESTAMP '2000-01-01' - INTERVAL 48 HOUR) FROM n) AS stale FROM o""")
def quality_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    lines = table(spark, sf_dir, "lineitem")
    offers = lines.select(F.when(n == 0, "matched").when(n == 1, "unmatched").when(n == 2, "manual_review").otherwise("rejected_conflict").alias("outcome"))
    return Q.operations(offers, lines.select(F.struct("l_suppkey", "l_partkey").alias("listing"), F.col("l_shipdate").alias("ts")), F.lit("2000-01-01").cast("timestamp_ntz"), 48)


@query("""WITH t AS (SELECT l_suppkey, l_extendedprice AS actual, l_quantity * 1000 AS predicted, l_tax, l_returnflag FROM lineitem), g AS (SELECT l_suppkey, count(*) AS n, min(actual) AS low, avg(abs(predicted - actual) / actual) AS mape, count_if(l_tax > 0.07 OR predicted < 2000) AS outside FROM t WHERE l_returnflag = 'N' GROUP BY 1)
SELECT count(*) AS groups, count_if(l_suppkey % 3 = 0) AS overlap, count_if(n >= 2 AND low > 0) AS evaluable, round(100 * max(mape) FILTER (n >= 2 AND low > 0), 6) AS worst_mape, sum(n)::BIGINT AS rows, sum(outside)::BIGINT AS outside_rows FROM g""")
def performance_group_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1000).alias("predicted"), "l_tax", "l_returnflag")
    out = G.group_diagnostics(lines.where("l_returnflag = 'N'"), "l_suppkey", lines.where("l_suppkey % 3 = 0"), {"l_tax": (0.0, 0.07), "predicted": (2000.0, 1e12)})
    return out.withColumn("worst_mape", F.round("worst_mape", 6))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, events = _folder(spark), table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{base}/in")
    ingest.staged(spark, f"{base}/in", events.schema, f"{base}/state", lambda batch, i: batch.write.mode("overwrite").parquet(f"{base}/out"), lambda s: ingest.running_totals(s, ["event_type"], "value"), "complete")
    return spark.read.parquet(f"{base}/out").withColumn("total", F.round("total", 4))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""")
def stream_final_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the watermark has passed: later events can't change them any more."""
    base, events = _folder(spark), table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{base}/in")
    ingest.available_now(spark, f"{base}/in", events.schema, lambda s: ingest.daily_buckets(s, "ts", ["event_type"], "value"), f"{base}/out", f"{base}/state")
    schema = "day timestamp, event_type string, n long, total double"
    return spark.read.schema(schema).parquet(f"{base}/out").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
