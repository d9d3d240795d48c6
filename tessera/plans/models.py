"""Frozen evaluations, splits, performance models and candidate pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numbers as X
from tessera.operators import candidates as R
from tessera.operators import intervals as V
from tessera.operators import metrics as M
from tessera.operators import performance as G
from tessera.operators import quality as Q
from tessera.operators import ranking as K
from tessera.operators import retrieval
from tessera.operators import sampling as S
from tessera.plans.evaluation import _six
from tessera.plans.registry import SQL, checkpoints, query, spread, table


def _frozen_sql(name: str, order: str) -> str:
    return f"""{name}r AS (SELECT lang AS query_id, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY {order}) AS rank FROM documents WHERE NOT (lang = 'es' AND doc_id % 50 = 0)),
{name}b AS (SELECT c.*, rank, row_number() OVER (PARTITION BY c.query_id ORDER BY grade DESC, c.id) AS ideal FROM c LEFT JOIN {name}r r ON r.query_id = c.query_id AND r.id = c.id),
{name} AS (SELECT query_id, count_if(grade > 0 AND rank <= 20) / count_if(grade > 0) AS recall, coalesce(1 / min(rank) FILTER (grade > 0), 0) AS mrr, count(*) = count(rank) AS complete,
  CASE WHEN count(*) = count(rank) THEN sum(CASE WHEN rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN (2 ** grade - 1) / log2(ideal + 1) ELSE 0 END) END AS ndcg FROM {name}b GROUP BY query_id HAVING count_if(grade > 0) > 0)"""


FROZEN = "g AS (SELECT doc_id, max(quality) + 2 * max(toxic) AS grade FROM labels GROUP BY 1), c AS (SELECT lang AS query_id, doc_id AS id, coalesce(grade, 0) AS grade FROM documents LEFT JOIN g USING (doc_id))"


def _frozen(spark: SparkSession, sf_dir: str, score: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    grades = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") + 2 * F.max("toxic")).alias("grade"))
    from tessera.operators.windows import ranked

    given = ranked(docs.where("not (query_id = 'es' and id % 50 = 0)").withColumn("s", F.expr(score)), ["query_id"], "s", "id")
    return M.frozen_metrics(docs.select("query_id", "id"), docs.join(grades, "id").select("query_id", "id", "grade"), given)


@query(f"WITH {FROZEN}, {_frozen_sql('a', 'n_chars DESC, doc_id')} SELECT query_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, complete FROM a")
def metric_frozen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(_frozen(spark, sf_dir, "n_chars"), "recall", "mrr", "ndcg")


@query(f"""WITH {FROZEN}, {_frozen_sql('a', 'n_chars DESC, doc_id')}, {_frozen_sql('b', '-(n_chars % 97) DESC, doc_id')},
p AS (SELECT 'recall' AS metric, a.recall AS x, b.recall AS y FROM a JOIN b USING (query_id) UNION ALL SELECT 'mrr', a.mrr, b.mrr FROM a JOIN b USING (query_id)) SELECT metric, 0 AS unpaired, count(*) AS queries, round(avg(x), 6) AS baseline, round(avg(y), 6) AS challenger, round(avg(y) - avg(x), 6) AS delta,
round(CASE WHEN avg(x) > 0 THEN 100 * (avg(y) - avg(x)) / avg(x) END, 4) AS relative_pct FROM p GROUP BY 1""")
def metric_paired_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.paired(_frozen(spark, sf_dir, "n_chars"), _frozen(spark, sf_dir, "-(n_chars % 97)"), "query_id", ["recall", "mrr"])
    return _six(out, "baseline", "challenger", "delta").withColumn("relative_pct", F.round("relative_pct", 4))


@query()
def metric_grouped_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the error per segment, whole customers drawn."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = both.select("c_mktsegment", "o_custkey", F.col("o_totalprice").alias("actual"), (F.col("c_acctbal") + 150_000).alias("predicted"))
    return M.grouped_bootstrap(rows, "o_custkey", lambda d: float((d["actual"] - d["predicted"]).abs().mean()), ["actual", "predicted"], resamples=80, by=["c_mktsegment"])


@query()
def metric_published_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six statistics of a forecast of the totals per segment and priority, whole customers drawn, with what blocks a claim."""
    checkpoints(spark)
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = both.select("c_mktsegment", "o_custkey", "o_orderkey", F.col("o_totalprice").alias("actual"), (F.col("c_acctbal") + 150_000).alias("predicted"))
    pair = ("actual", "predicted")
    kinds = {"mean": V.mean("actual"), "mae": V.absolute_error(*pair), "mape": V.percentage_error(*pair), "r2": V.determination(*pair), "pooled": V.pooled_ratio(*pair[::-1]), "macro": V.macro_ratio(*pair[::-1])}
    found = [V.interval(rows, s, "o_custkey", "o_orderkey", ["c_mktsegment"]).withColumn("statistic", F.lit(name)) for name, s in kinds.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return V.claim_gate(out, least_groups=20, floor=0.0, least_low=0.0).withColumn("blockers", F.array_join("blockers", ","))


@query("SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.9), 6) AS value, count(l_extendedprice) AS n FROM lineitem GROUP BY 1")
def metric_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(M.percentile(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.9), "value")


@query("""WITH RECURSIVE p AS (SELECT l_partkey, l_orderkey, l_linenumber, 'left:' || l_partkey AS l, 'right:' || l_orderkey AS r, (l_linenumber = 1 AND l_returnflag = 'R')::INT AS label FROM lineitem),
e AS (SELECT l AS a, r AS b FROM p WHERE label = 1 UNION SELECT r, l FROM p WHERE label = 1), w AS (SELECT a AS x, a AS y FROM e UNION SELECT w.x, e.b FROM w JOIN e ON w.y = e.a), c AS (SELECT x, min(y) AS root FROM w GROUP BY x),
s AS (SELECT p.*, coalesce(cl.root, l) AS lr, coalesce(cr.root, r) AS rr FROM p LEFT JOIN c cl ON cl.x = l LEFT JOIN c cr ON cr.x = r),
f AS (SELECT *, ('0x' || left(sha256('17:' || lr), 13))::BIGINT / 4503599627370496 AS fl, ('0x' || left(sha256('17:' || rr), 13))::BIGINT / 4503599627370496 AS fr FROM s),
g AS (SELECT *, CASE WHEN fl < 0.6 THEN 'train' WHEN fl < 0.8 THEN 'validation' ELSE 'test' END AS sl, CASE WHEN fr < 0.6 THEN 'train' WHEN fr < 0.8 THEN 'validation' ELSE 'test' END AS sr FROM f)
SELECT l_partkey AS left_id, l_orderkey AS right_id, label, CASE WHEN sl = sr THEN sl END AS split FROM g""")
def split_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints(spark)
    label = ((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R")).cast("int")
    return S.component_split(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("left_id"), F.col("l_orderkey").alias("right_id"), label.alias("label")), 17)


@query("""WITH g AS (SELECT DISTINCT c_custkey, c_mktsegment AS s FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sha256('[5,["str","' || c_custkey || '"]]'), c_custkey) AS place, count(*) OVER (PARTITION BY s) AS n FROM g),
q AS (SELECT *, n // 5 AS size, n % 5 AS more FROM r) SELECT c_custkey, 'fold_' || CASE WHEN place <= more * (size + 1) THEN (place - 1) // (size + 1) ELSE more + (place - more * (size + 1) - 1) // size END AS split FROM q""")
def split_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.folds(table(spark, sf_dir, "customer"), "c_custkey", 5, 5, "c_mktsegment")


@query("""WITH old AS (SELECT * FROM documents WHERE doc_id % 3 = 0 AND source < 'src5'), f AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM old) AND source NOT IN (SELECT source FROM old))
SELECT count(*) AS rows, count(DISTINCT source) AS families, 0 AS removed, concat_ws(',', CASE WHEN count(*) < 20 THEN 'too_few_rows' END, CASE WHEN count(DISTINCT source) < 10 THEN 'too_few_families' END) AS blockers FROM f""")
def split_external_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return S.external_gate(docs.where("doc_id % 3 = 0 and source < 'src5'"), docs, "doc_id", "source").withColumn("blockers", F.array_join("blockers", ","))


@query(f"SELECT count(*) AS items, count(DISTINCT split) AS splits, sha256(string_agg(line, ',' ORDER BY line)) AS checksum FROM (SELECT split, c_custkey || '=' || split AS line FROM ({SQL['split_groups']}))")
def split_frozen_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = S.group_split(table(spark, sf_dir, "customer"), "c_custkey", 17, {"train": 0.6, "validation": 0.2, "test": 0.2}, "c_mktsegment")
    return S.split_checksum(split, "c_custkey")


@query("""WITH r AS (SELECT doc_id, source, count(*) OVER (PARTITION BY lang, source) AS n, lang FROM documents), f AS (SELECT doc_id AS id, lang AS q, 'fused' AS source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 10),
o AS (SELECT doc_id AS id, lang AS q, CASE doc_id % 2 WHEN 0 THEN 'bm25' ELSE 'vector' END AS source, row_number() OVER (PARTITION BY lang, doc_id % 2 ORDER BY doc_id) AS rank FROM documents), b AS (SELECT * FROM f UNION ALL SELECT * FROM o),
s AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY q, id ORDER BY (source <> 'fused')::INT, rank, source) = 1), t AS (SELECT *, CASE WHEN source = 'fused' THEN 0 ELSE row_number() OVER (PARTITION BY q, source ORDER BY rank, id) END AS turn FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY turn, CASE WHEN turn = 0 THEN rank END NULLS FIRST, source, id)::INTEGER AS place FROM t) SELECT q, id, source, place FROM p WHERE place <= 30""")
def sample_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("q"), F.col("doc_id").alias("id"), "n_chars")
    fused = docs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("n_chars"), "id"))).where("rank <= 10").select("q", "id", F.lit("fused").alias("source"), "rank")
    own = docs.withColumn("source", F.when(F.col("id") % 2 == 0, "bm25").otherwise("vector")).withColumn("rank", F.row_number().over(Window.partitionBy("q", "source").orderBy("id"))).select("q", "id", "source", "rank")
    return S.round_robin_pool(fused.union(own), ["q"], 30).select("q", "id", "source", "place")


@query("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE l_suppkey::VARCHAR END AS family, l_returnflag AS generation, CASE WHEN l_discount > 0.09 THEN NULL ELSE l_discount - 0.01 END AS target, l_tax AS tax, CASE WHEN l_orderkey % 3 > 0 THEN l_quantity END AS quantity, l_linestatus AS status FROM lineitem)
SELECT * FROM (SELECT unnest(['duplicate_id', 'null_or_empty', 'unexpected_value', 'null_target', 'target_not_positive', 'too_often_missing', 'too_uniform']) AS fault, unnest(['id', 'family', 'status', 'target', 'target', 'quantity', 'tax']) AS detail,
unnest([count(id) - count(DISTINCT id), count_if(family = ''), count_if(status <> 'F'), count_if(target IS NULL), count_if(target <= 0), (avg((quantity IS NULL)::INT) > 0.25)::BIGINT, (count(DISTINCT tax) < 20)::BIGINT]) AS n FROM f) WHERE n > 0
UNION ALL SELECT 'several_generations', 'family', count(*) FROM (SELECT family FROM f GROUP BY 1 HAVING count(DISTINCT generation) > 1)""")
def performance_frame_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_suppkey") % 9 == 0, "").otherwise(F.col("l_suppkey").cast("string")).alias("family"), F.col("l_returnflag").alias("generation"),
        F.when(F.col("l_discount") <= 0.09, F.col("l_discount") - 0.01).alias("target"), F.col("l_tax").alias("tax"), F.when(F.col("l_orderkey") % 3 > 0, F.col("l_quantity")).alias("quantity"), F.col("l_linestatus").alias("status"),
    )
    return G.frame_checks(frame, "id", "family", "generation", "target", ["tax", "quantity"], {"status": "F"}, 0.25, 20)


@query("""WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_size END AS size, CASE WHEN p_partkey % 6 > 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 5 = 0 THEN p_size * 3.0 END AS observed, p_size * 2.0 - 20 AS predicted FROM part),
t AS (SELECT min(size) AS s0, max(size) AS s1, min(price) AS r0, max(price) AS r1 FROM f WHERE p_partkey % 3 = 0 AND size BETWEEN 5 AND 40), i AS (SELECT f.*, (((size IS NULL)::INT + (price IS NULL)::INT) / 2 > 0.5 OR coalesce(size NOT BETWEEN s0 AND s1, false) OR coalesce(price NOT BETWEEN r0 AND r1, false)) AS odd FROM f, t)
SELECT p_partkey, CASE WHEN observed IS NOT NULL THEN 'observed' WHEN odd THEN 'relative_only' ELSE 'predicted' END AS basis, CASE WHEN observed IS NOT NULL THEN 'observed_benchmark' WHEN odd THEN 'input_outside_training_contract' ELSE 'precise_model_prediction' END AS decision,
(CASE WHEN observed IS NOT NULL THEN observed WHEN NOT odd THEN greatest(0, predicted) END)::DOUBLE AS score, coalesce(observed, greatest(0, predicted))::DOUBLE AS relative_score, (CASE WHEN observed IS NULL AND NOT odd THEN greatest(0, greatest(0, predicted) - 5) END)::DOUBLE AS lower FROM i""")
def performance_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 > 0, size).alias("size"), F.when(k % 6 > 0, F.col("p_retailprice")).alias("price"), F.when(k % 5 == 0, size * 3).alias("observed"), (size * 2 - 20).alias("predicted"))
    profiles = G.feature_profiles(rows.where("p_partkey % 3 = 0 and size between 5 and 40"), ["size", "price"])
    return G.estimates(rows, G.confidence_issues(profiles, 0.5), 5.0, precise=True, promotable=True).select("p_partkey", "basis", "decision", "score", "relative_score", "lower")


@query("""SELECT p_partkey, round(c * 2.5, 6) AS core_base_clock_capacity, round(t / c, 6) AS thread_core_ratio, round(w / c, 6) AS tdp_watts_per_core, round(c * 4.5 / w, 6) AS boost_capacity_per_watt, (p_brand = 'Brand#1')::INT::DOUBLE AS generation_0, (p_brand = 'Brand#2')::INT::DOUBLE AS generation_1, (p_brand NOT IN ('Brand#1', 'Brand#2'))::INT::DOUBLE AS generation_unknown
FROM (SELECT *, (p_size % 16 + 1)::DOUBLE AS c, (p_size % 32 + 2)::DOUBLE AS t, (p_size + 35)::DOUBLE AS w FROM part)""")
def performance_engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("generation"), (size % 16 + 1).alias("core_count"), (size % 32 + 2).alias("thread_count"), F.lit(2.5).alias("base_clock_ghz"), F.lit(4.5).alias("boost_clock_ghz"), (size + 35).alias("tdp_watts"))
    out = G.engineered(rows, "generation", ["Brand#2", "Brand#1"])
    names = ("core_base_clock_capacity", "thread_core_ratio", "tdp_watts_per_core", "boost_capacity_per_watt")
    return out.select("p_partkey", *[F.round(c, 6).alias(c) for c in names], "generation_0", "generation_1", "generation_unknown")


@query()
def performance_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge penalties judged on folds of whole suppliers."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_extendedprice")
    fold = S.folds(rows, "l_suppkey", 3, 4).select("l_suppkey", F.substring("split", 6, 9).cast("int").alias("fold"))
    return G.cross_validated(rows.join(fold, "l_suppkey"), ["l_quantity", "l_discount"], "l_extendedprice", "fold", [0.0, 10.0, 1000.0])


@query("""WITH m AS (SELECT p_type AS category, p_brand AS workload, min('m' || p_partkey) AS model, count(*) AS n FROM part WHERE p_size > 45 GROUP BY ALL)
SELECT p_partkey, CASE WHEN n = 1 THEN model END AS model, CASE WHEN n IS NULL THEN 'no_model' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS state FROM part LEFT JOIN m ON category = p_type AND workload = p_brand""")
def performance_resolved_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    asked = part.select("p_partkey", F.col("p_type").alias("category"), F.col("p_brand").alias("workload"))
    registry = part.where("p_size > 45").select(F.col("p_type").alias("category"), F.col("p_brand").alias("workload"), F.concat(F.lit("m"), "p_partkey").alias("model"))
    return G.resolved_models(asked, registry).select("p_partkey", "model", "state")


@query("""WITH f AS (SELECT 'gpu:nvidia_geforce_rtx_' || (2000 + p_size * 10) AS family, CASE WHEN p_size % 2 = 0 THEN p_type END AS arch FROM part), n AS (SELECT family, arch, count(*) AS n FROM f WHERE arch IS NOT NULL GROUP BY ALL),
k AS (SELECT family, arg_min(arch, (-n, arch)) AS known FROM n GROUP BY 1) SELECT family, coalesce(known, 'nvidia_rtx_' || substr(family, 24, 2) || '_series') AS generation FROM (SELECT DISTINCT family FROM f) LEFT JOIN k USING (family)""")
def performance_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("gpu:nvidia_geforce_rtx_"), 2000 + size * 10).alias("family"), F.when(size % 2 == 0, F.col("p_type")).alias("arch"))
    return G.generations(rows, "family", "arch")


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 OR o_orderkey % 3 = 1 AND o_orderkey % 2 = 1 AND o_orderkey % 5 > 0 AS contracted, 'render_4_1_' || replace(lower(trim(o_orderstatus)), ' ', '_') || '_cpu_' || (o_orderkey % 7) AS slug FROM orders""")
def performance_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(k % 3 == 0, "samples/minute ").when(k % 3 == 1, "seconds").otherwise("ms").alias("unit"), (k % 2 == 0).alias("higher"), F.when(k % 3 == 0, "samples_per_minute").when(k % 5 > 0, "total_render_time").otherwise("other").alias("field"))
    return rows.select("o_orderkey", G.contracted(rows, "unit", "higher", "field").alias("contracted"), G.workload_slug(F.lit("Render--4.1"), "o_orderstatus", F.lit("CPU_"), k % 7).alias("slug"))


@query("""WITH m AS (SELECT l_suppkey, count(*) AS n, round(1 - avg(l_discount) * 4, 6) AS r2, round(avg(l_tax) * 300, 6) AS mape, l_suppkey % 2 = 0 AS reportable, CASE WHEN l_suppkey % 7 > 0 THEN count(DISTINCT l_returnflag) END AS groups FROM lineitem GROUP BY l_suppkey),
b AS (SELECT *, concat_ws(',', CASE WHEN NOT coalesce(n >= 600, false) THEN 'n' END, CASE WHEN NOT r2 >= 0.8 THEN 'r2' END, CASE WHEN NOT mape <= 12.1 THEN 'mape' END, CASE WHEN NOT coalesce(groups >= 3, false) THEN 'groups' END) AS blockers FROM m)
SELECT l_suppkey, blockers, CASE WHEN blockers = '' THEN 'high' WHEN n >= 600 AND (r2 >= 0.7 OR mape <= 20) AND reportable THEN 'medium' ELSE 'low' END AS confidence FROM b""")
def performance_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(1 - F.avg("l_discount") * 4, 6).alias("r2"), F.round(F.avg("l_tax") * 300, 6).alias("mape"), F.count_distinct("l_returnflag").alias("flags"))
    rows = agg.select("l_suppkey", "n", "r2", "mape", (F.col("l_suppkey") % 2 == 0).alias("reportable"), F.when(F.col("l_suppkey") % 7 > 0, F.col("flags")).alias("groups"))
    out = G.promotion(rows, [("n", "least", 600), ("r2", "least", 0.8), ("mape", "most", 12.1), ("groups", "least", 3)], "r2", "mape", "n", 600, 0.8, 12.1)
    return out.select("l_suppkey", F.array_join("blockers", ",").alias("blockers"), "confidence")


@query("SELECT event_id, round(ln(1 + value), 6) AS fitted, round(greatest(0, exp(ln(1 + value)) - 1), 4) AS back, round(greatest(0, value - 50), 4) AS plain FROM events")
def number_target_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(X.to_target(v, "log1p"), 6).alias("fitted"), F.round(X.from_target(X.to_target(v, "log1p"), "log1p"), 4).alias("back"), F.round(X.from_target(X.to_target(v - 50, "identity"), "identity"), 4).alias("plain"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' AND ts <= TIMESTAMP '2024-01-15' THEN 'open' WHEN event_type = 'click' THEN 'leased' ELSE 'done' END AS state, NOT (event_type = 'click' AND ts <= TIMESTAMP '2024-01-15') AS has_lease FROM events""")
def quality_expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "leased").otherwise("done").alias("state"), F.col("ts").alias("lease_until"))
    out = Q.expired_leases(tasks, F.lit("2024-01-15").cast("timestamp_ntz"))
    return out.select("event_id", "state", F.col("lease_until").isNotNull().alias("has_lease"))


@query("""SELECT s.c_mktsegment AS query_id, p_partkey AS id FROM (SELECT c_mktsegment, round(avg(c_acctbal) / 4, 2) AS budget FROM customer GROUP BY 1) s, (SELECT *, CASE p_type WHEN 'SMALL' THEN 'gpu' WHEN 'LARGE' THEN 'memory' ELSE 'case' END AS kind, CASE WHEN p_partkey % 7 > 0 THEN p_size END AS cap FROM part)
WHERE (p_retailprice <= budget OR c_mktsegment = 'BUILDING' AND p_type = 'MEDIUM') AND p_brand NOT IN ('Brand#3') AND (c_mktsegment <> 'MACHINERY' OR p_size % 5 > 0 OR c_mktsegment = 'BUILDING' AND p_type = 'MEDIUM') AND (kind <> 'gpu' OR coalesce(cap >= 12, false)) AND (kind <> 'memory' OR c_mktsegment = 'HOUSEHOLD' OR coalesce(cap >= 8, false))
AND (NOT (c_mktsegment = 'BUILDING' AND kind = 'case') OR p_partkey = (SELECT min(p_partkey) FROM part WHERE p_type = 'MEDIUM' AND p_brand <> 'Brand#3'))""")
def filter_allowed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each market segment as a request with filters, one of them with a part it already owns."""
    requests, products = _requests(spark, sf_dir), _products(spark, sf_dir)
    owned = table(spark, sf_dir, "part").where("p_type = 'MEDIUM' and p_brand <> 'Brand#3'").agg(F.min("p_partkey").alias("product_id"))
    return R.allowed(requests, products, owned.select(F.lit("BUILDING").alias("query_id"), F.lit("case").alias("category"), "product_id"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("query_id")).agg(F.round(F.avg("c_acctbal") / 4, 2).alias("budget"))
    q = F.col("query_id")
    return agg.select("query_id", "budget", F.array(F.lit("BRAND#3")).alias("excluded_brands"), (q == "MACHINERY").alias("in_stock_only"), F.lit(12).alias("minimum_gpu_vram_gb"), F.when(q != "HOUSEHOLD", 8).alias("minimum_memory_gb"), F.lower(F.concat_ws(" ", F.lit("red widget"), q)).alias("text"))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size, kind = F.col("p_partkey"), F.col("p_size"), F.when(F.col("p_type") == "SMALL", "gpu").when(F.col("p_type") == "LARGE", "memory").otherwise("case")
    cap = F.when(k % 7 > 0, size).cast("string")
    return table(spark, sf_dir, "part").select(k.alias("id"), kind.alias("category"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), F.when(size % 5 > 0, "in_stock").otherwise("out_of_stock").alias("stock"), F.create_map(F.lit("vram_gb"), cap, F.lit("capacity_gb"), cap).alias("attributes"), F.concat_ws(" ", "p_name", "p_brand").alias("text"), size.alias("size"))


@query()
def retrieve_candidate_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, hybrid retrieval, arc consistency between graphics and memory and case, then ranking, per segment."""
    checkpoints(spark)
    requests, products = _requests(spark, sf_dir).withColumn("budget", F.lit(2000.0)), spread(_products(spark, sf_dir))
    vectors = retrieval.hash_embedding(products.select("id", "category", "text"), keep=["category"]).drop("norm")
    ids = requests.select(F.xxhash64("query_id").alias("id"), "query_id", "text")
    asked = retrieval.hash_embedding(ids.select("id", "text")).drop("norm").join(ids.select("id", "query_id"), "id").select("query_id", "vector")
    rules = [("gpu", "memory", F.abs(F.col("gpu_size") - F.col("memory_size")) <= 5), ("memory", "case", F.col("memory_brand") == F.col("case_brand"))]
    return R.pools(requests, products, vectors, asked, rules, {"gpu": 10, "memory": 12, "case": 8})


@query("SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN p_size ELSE 0.6 * p_size + 0.4 * 2 END, 6)::DOUBLE AS share FROM part")
def rank_workload_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workload scores under weights: none, one without weights, and two of three weighted ones."""
    size = F.col("p_size").cast("double")
    none = F.create_map().cast("map<string,double>")
    scores = F.when(size % 3 == 0, none).when(size % 3 == 1, F.create_map(F.lit("a"), size)).otherwise(F.create_map(F.lit("a"), size, F.lit("b"), F.lit(2.0)))
    weights = F.when(size % 3 == 1, none).otherwise(F.create_map(F.lit("a"), F.lit(0.6), F.lit("b"), F.lit(0.4)))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(K.weighted_mean(scores, weights), 6).alias("share"))
