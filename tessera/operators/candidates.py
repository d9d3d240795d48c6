"""Candidate pools for requests: structured filters, hybrid retrieval, arc consistency, ranking and limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import ranking, retrieval
from tessera.operators.filters import holds, normalised
from tessera.operators.relations import arc_consistent

#: Candidates of a category that go on to build choice (fixed values).
LIMITS = {"cpu": 30, "gpu": 30, "cooler": 30, "case": 30, "memory": 40, "storage": 40, "power_supply": 40, "motherboard": 50}
#: Requirements of a request: category, attribute of the product, kind of comparison (fixed names).
REQUIREMENTS = {
    "minimum_gpu_vram_gb": ("gpu", "vram_gb", "least"), "minimum_memory_gb": ("memory", "capacity_gb", "least"), "storage_gb": ("storage", "capacity_gb", "least"), "case_size": ("case", "case_size", "equal"),
    "required_memory_type": ("memory,motherboard", "memory_type", "equal"), "required_motherboard_form_factor": ("motherboard", "form_factor", "equal"), "wifi_required": ("motherboard", "wifi_support", "true"),
}


def allowed(requests: DataFrame, products: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    """``(query_id, id)``: the products that a request's filters let through.

    Requests have query_id, budget, excluded_brands (an array), in_stock_only, and any of REQUIREMENTS; a null asks for
    nothing.  Products have id, category, brand, price, stock and attributes (a map of text).  A requirement binds the
    products of its category only, and a missing value fails it.  In a category with a locked product (query_id,
    category, product_id) only that one is allowed, whatever its price and stock.
    """
    have = set(requests.columns)
    both = requests.join(products, holds(F.lit(True)))
    lock = F.lit(False)
    if locked is not None:
        mine = locked.select("query_id", "category", F.col("product_id").alias("locked_id"))
        both = both.join(mine, ["query_id", "category"], "left")
        lock = F.col("locked_id").isNotNull()
    ok = lock | F.col("budget").isNull() | holds(F.col("price") <= F.col("budget"))
    if "excluded_brands" in have:
        ok = ok & ~holds(F.exists("excluded_brands", lambda b: normalised(b) == normalised(F.col("brand"))))
    if "in_stock_only" in have:
        ok = ok & (lock | ~holds(F.col("in_stock_only")) | holds(F.col("stock").isin("in_stock", "limited_stock")))
    for name, (kinds, attribute, how) in REQUIREMENTS.items():
        if name in have:
            value, want = F.try_element_at("attributes", F.lit(attribute)), F.col(name)
            met = {"least": value.try_cast("double") >= want.cast("double"), "equal": normalised(value) == normalised(want.cast("string")), "true": F.lower(value) == "true"}[how]
            asked = want.isNotNull() & (want.cast("boolean") if how == "true" else F.lit(True))
            ok = ok & (~F.col("category").isin(kinds.split(",")) | ~holds(asked) | holds(met))
    if locked is not None:
        ok = ok & (~lock | (F.col("locked_id") == F.col("id")))
    return both.where(ok).select("query_id", "id")


def pools(requests: DataFrame, products: DataFrame, vectors: DataFrame, query_vectors: DataFrame, rules: Sequence[tuple[str, str, Column]], limits: Mapping[str, int] = LIMITS, locked: DataFrame | None = None) -> DataFrame:
    """``(query_id, category, id, rank, score, scaled)``: the candidates of each request and category.

    1. Filters, then both retrievals fused: three times the limit of each category (``products`` has text).
    2. Candidates that no candidate of another category goes with are dropped, until nothing changes; ``rules`` are
       conditions between two categories over columns prefixed by the category's name, within one request.
    3. The rest is ranked by the heuristic ranker and cut at the limit; scores are scaled to 0..100 in the pool.
    """
    eligible = allowed(requests, products, locked)
    docs = products.select("id", "category", "text")
    asked = requests.select("query_id", "text").join(query_vectors, "query_id")
    most = max(limits.values())
    found = retrieval.hybrid(docs, vectors, asked, 3 * most, eligible)
    size = F.coalesce(*[F.when(F.col("category") == c, F.lit(n)) for c, n in limits.items()], F.lit(most))
    wide = found.where(F.col("rank") <= 3 * size).select("query_id", "category", "id", F.col("bm25_score"), F.col("vector_score").alias("vector_similarity"), F.col("score").alias("rrf_score"))
    wide = wide.join(products.drop("category", "text"), "id").checkpoint()
    names = sorted({c for a, b, _ in rules for c in (a, b)})
    sides = {c: wide.where(F.col("category") == c).select("query_id", "id", *[x for x in products.columns if x not in ("id", "category", "text")]) for c in names}
    within = [(a, b, (F.col(f"{a}_query_id") == F.col(f"{b}_query_id")) & rule) for a, b, rule in rules]
    kept = arc_consistent(sides, within) if rules else {}
    left = wide.where(~F.col("category").isin(names)) if names else wide
    for c in names:
        left = left.unionByName(wide.where(F.col("category") == c).join(kept[c].select(F.col(f"{c}_query_id").alias("query_id"), F.col(f"{c}_id").alias("id")), ["query_id", "id"], "left_semi"))
    left = left.join(requests.select("query_id", *[c for c in ("budget", "query_terms", "requirements", "preferred_brands", "workload_weights") if c in requests.columns]), "query_id")
    rows = left.withColumn("pool", F.struct("query_id", "category"))
    features = ranking.features(rows.drop("query_id").withColumnsRenamed({"pool": "query_id", "id": "product_id"}))
    ranked = ranking.pool_scaled(ranking.heuristic(features), ["query_id"], "score")
    out = ranked.select("query_id.query_id", "query_id.category", F.col("product_id").alias("id"), "rank", "score", "scaled")
    return out.where(F.col("rank") <= F.coalesce(*[F.when(F.col("category") == c, F.lit(n)) for c, n in limits.items()], F.lit(most)))
