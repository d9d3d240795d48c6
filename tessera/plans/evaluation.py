"""Metrics and splits: labels against a deterministic score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import wilson
from tessera.operators import metrics as M
from tessera.operators import sampling as S
from tessera.plans.registry import checkpoints, query, table

ROWS = "x AS (SELECT d.doc_id, lang, max(quality) AS label, (any_value(n_chars) % 101) / 100 AS score, max(quality) * 2 + max(toxic) AS grade FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("doc_id", "lang")
    return both.agg(F.max("quality").alias("label"), (F.first("n_chars") % 101 / 100).alias("score"), (F.max("quality") * 2 + F.max("toxic")).alias("grade"))


def _six(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"""WITH {ROWS}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS r,
sum(label) OVER w AS hits, row_number() OVER w AS pos FROM x WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT lang, count(*) AS n, count_if(score >= 0.5 AND label = 1) AS tp, count_if(score >= 0.5 AND label = 0) AS fp, count_if(score < 0.5 AND label = 1) AS fn, avg(((score >= 0.5)::INT = label)::INT) AS accuracy,
avg((score - label) ** 2) AS brier, sum(label) AS p, sum(r) FILTER (label = 1) AS ranks, avg(hits / pos) FILTER (label = 1) AS ap FROM r GROUP BY lang)
SELECT lang, n, tp, fp, fn, round(accuracy, 6) AS accuracy, round(brier, 6) AS brier, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((ranks - p * (p + 1) / 2) / nullif(p * (n - p), 0), 6) AS auc,
round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(ap, 6) AS average_precision, p::BIGINT AS positives FROM a""")
def metric_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.binary_metrics(rows(spark, sf_dir), ["lang"], 0.5, "doc_id")
    return _six(out, "accuracy", "brier", "precision", "recall", "auc", "f1", "average_precision")


@query(f"""WITH {ROWS}, g AS (SELECT score, sum(label) AS p, count(*) AS n FROM x GROUP BY 1), c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS m, (SELECT sum(label) FROM x) AS pos FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT score AS threshold, round(tp / m, 6) AS precision, round(tp / pos, 6) AS recall, m::BIGINT AS selected FROM c WHERE tp / m >= 0.5 AND m >= 25 ORDER BY tp / pos DESC, tp / m DESC, score DESC LIMIT 1""")
def metric_precision_first_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints(spark)
    return _six(M.precision_first_threshold(rows(spark, sf_dir), 0.5, 25), "precision", "recall").drop("lower")


@query("""WITH x AS (SELECT l_suppkey, l_extendedprice AS actual, l_quantity * 1000 AS predicted FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY actual) + (count(*) OVER (PARTITION BY l_suppkey, actual) - 1) / 2 AS ra,
rank() OVER (PARTITION BY l_suppkey ORDER BY predicted) + (count(*) OVER (PARTITION BY l_suppkey, predicted) - 1) / 2 AS rp, avg(actual) OVER (PARTITION BY l_suppkey) AS mean FROM x)
SELECT l_suppkey, count(*) AS n, round(avg(abs(predicted - actual)), 2) AS mae, round(sqrt(avg((predicted - actual) ** 2)), 2) AS rmse, round(1 - sum((predicted - actual) ** 2) / sum((actual - mean) ** 2), 6) AS r2, round(corr(ra, rp), 6) AS spearman,
round(avg(abs(predicted - actual) / actual), 6) AS mape FROM r GROUP BY 1""")
def metric_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1000).alias("predicted"))
    return _six(M.regression_metrics(x, ["l_suppkey"]), "r2", "spearman", "mape").withColumns({c: F.round(c, 2) for c in ("mae", "rmse")})


RETRIEVAL = f"""{ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rn, row_number() OVER (PARTITION BY lang ORDER BY grade DESC, doc_id) AS ideal FROM x),
m AS (SELECT lang, count_if(grade > 0 AND rn <= 20) / count_if(grade > 0) AS recall, sum(CASE WHEN rn <= 10 THEN (2 ** grade - 1) / log2(rn + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN (2 ** grade - 1) / log2(ideal + 1) ELSE 0 END) AS ndcg,
coalesce(1 / min(rn) FILTER (grade > 0 AND rn <= 50), 0) AS mrr FROM r GROUP BY lang HAVING count_if(grade > 0) > 0)"""


@query(f"WITH {RETRIEVAL} SELECT lang, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM m")
def metric_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(M.retrieval_metrics(rows(spark, sf_dir), "lang", "doc_id"), "recall", "ndcg", "mrr")


@query(f"""WITH {RETRIEVAL.replace("r AS (", "r0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS rn FROM x), r AS (")},
m2 AS (SELECT lang, sum(CASE WHEN r0.rn <= 10 THEN (2 ** r0.grade - 1) / log2(r0.rn + 1) ELSE 0 END) / any_value(best) AS ndcg FROM r0 JOIN (SELECT lang, sum(CASE WHEN ideal <= 10 THEN (2 ** grade - 1) / log2(ideal + 1) ELSE 0 END) AS best FROM r GROUP BY lang) USING (lang) GROUP BY lang)
SELECT count(*) AS queries, round(avg(m.ndcg), 6) AS baseline, round(avg(m2.ndcg), 6) AS candidate, round(avg((round(m2.ndcg, 9) > round(m.ndcg, 9))::INT), 6) AS win_rate, round(avg(m2.ndcg) - avg(m.ndcg), 6) AS lift, round(100 * (avg(m2.ndcg) - avg(m.ndcg)) / avg(m.ndcg), 4) AS relative_pct FROM m JOIN m2 USING (lang)""")
def metric_ranker_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rows(spark, sf_dir)
    base, new = (M.retrieval_metrics(d, "lang", "doc_id").withColumn("ndcg", F.round("ndcg", 9)) for d in (x, x.withColumn("score", F.col("doc_id"))))
    return _six(M.lift(base, new, "lang", "ndcg"), "baseline", "candidate", "win_rate", "lift").withColumn("relative_pct", F.round("relative_pct", 4))


@query("""WITH s AS (SELECT l_suppkey, l_linenumber AS stage, count(*) AS kept, count_if(l_returnflag = 'R') AS rel FROM lineitem GROUP BY ALL), f AS (SELECT *, first_value(kept) OVER w AS k0, first_value(rel) OVER w AS r0 FROM s WINDOW w AS (PARTITION BY l_suppkey ORDER BY stage))
SELECT stage, round(1 - sum(kept) / sum(k0), 6) AS pooled_pruned, round(avg(1 - kept / k0), 6) AS macro_pruned, round(sum(rel) / sum(r0), 6) AS pooled_recall, round(avg(rel / nullif(r0, 0)), 6) AS macro_recall FROM f GROUP BY stage""")
def metric_pruning_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("stage")).agg(F.count("*").alias("kept"), F.count_if(F.col("l_returnflag") == "R").alias("rel"))
    return _six(M.pruning_funnel(s, "l_suppkey", "stage", "kept", "rel"), "pooled_pruned", "macro_pruned", "pooled_recall", "macro_recall")


@query("""WITH r AS (SELECT l_suppkey, abs(l_extendedprice - l_quantity * 1000) AS e, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(l_extendedprice - l_quantity * 1000)) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, n, round(e, 6) AS radius FROM r WHERE rn = ceil(round(least(1, ceil(round((n + 1) * 0.9, 9)) / n) * (n - 1), 9)) + 1""")
def metric_conformal_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1000).alias("e"))
    return _six(M.conformal(x, ["l_suppkey"], "e", 0.1), "radius")


@query("""WITH a AS (SELECT event_type, count_if(value > 50) AS k, count(*) AS n FROM events GROUP BY 1), z AS (SELECT *, 1.959963984540054::DOUBLE AS z, k / n AS p FROM a)
SELECT event_type, round(greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS low, round(least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS high FROM z""")
def metric_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return a.select("event_type", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query()
def metric_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bootstrap(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", "value"), ["event_type"], "value", resamples=200)


@query("""WITH g AS (SELECT DISTINCT c_custkey, c_mktsegment AS s FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sha256('[17,["str","' || c_custkey || '"]]'), c_custkey) AS place, count(*) OVER (PARTITION BY s) AS n FROM g),
e AS (SELECT *, n * 0.6 AS a, n * 0.2 AS b, n * 0.2 AS c FROM r), f AS (SELECT *, floor(a)::INT AS fa, floor(b)::INT AS fb, floor(c)::INT AS fc, n - floor(a)::INT - floor(b)::INT - floor(c)::INT AS rest FROM e),
k AS (SELECT *, (SELECT list(x.name ORDER BY x.r DESC, x.name) FROM (SELECT unnest(['test', 'train', 'validation']) AS name, unnest([round(c - fc, 6), round(a - fa, 6), round(b - fb, 6)]) AS r) x)[1:rest] AS extra FROM f),
q AS (SELECT *, fa + list_contains(extra, 'train')::INT AS qa, fb + list_contains(extra, 'validation')::INT AS qb FROM k)
SELECT c_custkey, CASE WHEN place <= qa THEN 'train' WHEN place <= qa + qb THEN 'validation' ELSE 'test' END AS split FROM q""")
def split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.group_split(table(spark, sf_dir, "customer"), "c_custkey", 17, {"train": 0.6, "validation": 0.2, "test": 0.2}, "c_mktsegment")


@query("""WITH f AS (SELECT doc_id, ('0x' || left(sha256(concat('split', chr(0), sha256(text))), 13))::BIGINT / 4503599627370496 AS x FROM documents)
SELECT doc_id, CASE WHEN x < 0.6 THEN 'train' WHEN x < 0.8 THEN 'validation' ELSE 'test' END AS split FROM f""")
def split_by_hash_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = S.fraction_split(F.sha2("text", 256), "split", [("train", 0.6), ("validation", 0.8), ("test", 1.0)])
    return table(spark, sf_dir, "documents").select("doc_id", split.alias("split"))


@query("""WITH f AS (SELECT sha256(text) AS g, CASE WHEN ('0x' || left(sha256(concat('row', chr(0), doc_id::VARCHAR)), 13))::BIGINT / 4503599627370496 < 0.5 THEN 'a' ELSE 'b' END AS split FROM documents)
SELECT g, count(DISTINCT split) AS splits FROM f GROUP BY g HAVING count(DISTINCT split) > 1""")
def split_leaking_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = S.fraction_split("doc_id", "row", [("a", 0.5), ("b", 1.0)])
    return S.leaking_groups(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("g"), split.alias("split")), "g", "split")
