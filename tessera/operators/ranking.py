"""Ranking features and the heuristic ranker.

Candidates have query_id, product_id, price, budget, the retrieval scores, and any signal named below; an absent
signal counts as null.  What a signal doesn't give is computed where the columns for it are there: model (text) and
query_terms (tokens), attributes and requirements (maps of text), brand and preferred_brands (an array), and
workload_scores and workload_weights (maps of numbers).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import search_tokens
from tessera.operators.windows import min_max, price_percentile, ranked

#: Weights of the heuristic ranker (fixed values).
WEIGHTS: dict[str, float] = {
    "bm25_score": 0.05,
    "vector_similarity": 0.05,
    "rrf_score": 0.08,
    "exact_model_match": 0.02,
    "specification_match": 0.05,
    "weighted_workload_score": 0.20,
    "observed_benchmark_score": 0.08,
    "predicted_workload_score": 0.04,
    "gpu_memory_fit": 0.04,
    "memory_capacity_fit": 0.03,
    "budget_fit": 0.07,
    "price_to_performance": 0.12,
    "discount_vs_30d_median": 0.03,
    "availability_score": 0.03,
    "reliability_score": 0.04,
    "warranty_score": 0.01,
    "review_score": 0.02,
    "freshness_score": 0.01,
    "upgradeability_score": 0.02,
    "power_efficiency_score": 0.02,
    "preference_match_score": 0.04,
    "budget_share": -0.02,
    "price_percentile": -0.01,
}
#: Features that aren't weighted.
MORE = ("has_observed_benchmark", "price_log1p")


def weighted_mean(scores: Column, weights: Column) -> Column:
    """Mean of a score map under a weight map; without weights the plain mean.

    The divisor is the whole weight, also of workloads without a score.
    """
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, w: a + w)
    hit = F.aggregate(F.map_entries(weights), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at(scores, e["key"]), F.lit(0.0)))
    plain = F.try_divide(F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, s: a + s), F.size(scores))
    return F.coalesce(F.when(total > 0, hit / total).otherwise(plain), F.lit(0.0))


def model_match(model: Column, query: Column) -> Column:
    """1 if the model has tokens and all stand in the query."""
    return F.coalesce(((F.size(model) > 0) & (F.size(F.array_except(model, query)) == 0)).cast("double"), F.lit(0.0))


def requirement_fit(actual: Column, required: Column) -> Column:
    """Ratio to the requirement, within 0..2; 0 without a requirement or for an unknown value."""
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(2.0), actual / required))
    return F.when((required > 0) & actual.isNotNull(), ratio).otherwise(0.0)


def unit(value: Column) -> Column:
    """A share within 0..1; values above 1 are taken for percentages."""
    v = F.coalesce(value, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / 100).otherwise(v)))


def specification_match(requirements: Column, attributes: Column) -> Column:
    """Share of the requirements other than minimums that known attributes meet; 0 without any."""
    said = F.filter(F.map_entries(requirements), lambda e: ~e["key"].startswith("minimum_") & F.try_element_at(attributes, e["key"]).isNotNull())
    met = F.size(F.filter(said, lambda e: F.lower(F.try_element_at(attributes, e["key"])) == F.lower(e["value"])))
    return F.coalesce(F.try_divide(met.cast("double"), F.size(said)), F.lit(0.0))


def preference_match(brand: Column, preferred: Column) -> Column:
    return F.coalesce(F.array_contains(F.transform(preferred, F.lower), F.lower(brand)).cast("double"), F.lit(0.0))


def features(rows: DataFrame) -> DataFrame:
    """All 25 features, none null.  Of unknown price: log 0, percentile 1, and a budget share of 1.5 under a budget."""
    have = set(rows.columns)
    get = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    zero = lambda c: F.coalesce(get(c), F.lit(0.0))
    given = lambda c, need, compute: F.coalesce(F.when(get(c).isNotNull(), unit(get(c))), compute() if have.issuperset(need) else F.lit(0.0))
    price, budget = get("price"), F.coalesce(get("budget"), F.lit(0.0))
    work = zero("weighted_workload_score")
    if "workload_scores" in have:
        weights = F.col("workload_weights") if "workload_weights" in have else F.create_map().cast("map<string,double>")
        work = F.when(F.coalesce(F.size("workload_scores"), F.lit(0)) > 0, weighted_mean(F.col("workload_scores"), weights)).otherwise(work)
    share = F.when(price.isNull(), F.when(budget > 0, 1.5).otherwise(0.0)).when(budget > 0, price / budget).otherwise(0.0)
    fit = F.when(price.isNull(), 0.0).when(budget > 0, F.greatest(F.lit(0.0), 1 - price / budget)).otherwise(0.5)
    median = get("median_price_30d")
    out = {
        **{c: zero(c) for c in ("bm25_score", "vector_similarity", "rrf_score", "observed_benchmark_score", "predicted_workload_score")},
        **{c: unit(get(c)) for c in ("availability_score", "reliability_score", "review_score", "freshness_score", "upgradeability_score", "power_efficiency_score")},
        "exact_model_match": given("exact_model_match", {"model", "query_terms"}, lambda: model_match(search_tokens(F.col("model")), F.col("query_terms"))),
        "specification_match": given("specification_match", {"requirements", "attributes"}, lambda: specification_match(F.col("requirements"), F.col("attributes"))),
        "preference_match_score": given("preference_match_score", {"brand", "preferred_brands"}, lambda: preference_match(F.col("brand"), F.col("preferred_brands"))),
        "weighted_workload_score": work,
        "has_observed_benchmark": get("observed_benchmark_score").isNotNull().cast("double"),
        "gpu_memory_fit": requirement_fit(get("vram_gb"), get("minimum_vram_gb")),
        "memory_capacity_fit": requirement_fit(get("memory_gb"), get("minimum_memory_gb")),
        "price_log1p": F.coalesce(F.log1p(price), F.lit(0.0)),
        "budget_share": share,
        "budget_fit": fit,
        "price_to_performance": F.coalesce(work * 1000 / F.greatest(price, F.lit(1.0)) * F.when(price.isNotNull(), 1.0), F.lit(0.0)),
        "price_percentile": F.coalesce(price_percentile(rows, ["query_id"], "price"), F.lit(1.0)),
        "discount_vs_30d_median": F.coalesce(F.when(median > 0, (median - price) / median), F.lit(0.0)),
        "warranty_score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), zero("warranty_years") / 10)),
    }
    return rows.select("query_id", "product_id", *[out[c].alias(c) for c in (*WEIGHTS, *MORE)])


def heuristic(rows: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Features scaled to 0..1 within the query, weighted and summed; ranked, ties by product id.

    ``top`` names the feature that contributes most.
    """
    part = {c: F.lit(w) * min_max(c, ["query_id"]) for c, w in weights.items()}
    scored = rows.select("query_id", "product_id", *[e.alias(c) for c, e in part.items()])
    total = F.round(sum((F.col(c) for c in weights), F.lit(0.0)), 9)
    best = F.array_max(F.array(*[F.struct(F.round(c, 9).alias("v"), F.lit(c).alias("name")) for c in weights]))["name"]
    return ranked(scored.select("query_id", "product_id", total.alias("score"), best.alias("top")), ["query_id"], "score", "product_id")


def pool_scaled(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """Scores of a pool on 0..100; a pool of equal scores gets 100."""
    s = F.max(score).over(_w(by)) - F.min(score).over(_w(by))
    return rows.withColumn("scaled", F.when(s > 0, 100 * min_max(score, by)).otherwise(100.0))


def _w(by: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*by)


def train_pointwise(rows: DataFrame, label: str, seed: int = 17):
    """A gradient-boosted stand-in for a grouped ranker: grades are fitted row by row."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    names = [*WEIGHTS, *MORE]
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), GBTRegressor(labelCol=label, maxIter=10, maxDepth=3, seed=seed)]).fit(rows)
