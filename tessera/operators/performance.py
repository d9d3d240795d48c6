"""Performance cohorts: training rows, frame checks, baselines and observed-first estimates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def training_rows(rows: DataFrame, family: str, cohort: Sequence[str], score: str, lower_is_better: Column, least: int, scale: float = 1000.0) -> DataFrame:
    """One row per family and cohort of at least ``least`` rows: median score (scale / median where lower is better), MAD, sizes."""
    key = [family, *cohort]
    centre = rows.groupBy(*key).agg(F.median(score).alias("median"), F.count("*").alias("n"), F.count_distinct("entity").alias("entities")).where(F.col("n") >= least)
    off = rows.join(centre, key).withColumn("off", F.abs(F.col(score) - F.col("median")))
    mad = off.groupBy(*key).agg(F.median("off").alias("mad"))
    target = F.when(lower_is_better, F.lit(scale) / F.col("median")).otherwise(F.col("median"))
    return centre.join(mad, key).withColumn("target", target)


def frame_faults(rows: DataFrame, key: str, family: str, generation: str, features: Sequence[str], missing_max: float, least_values: int) -> DataFrame:
    """``(fault, detail, n)``: null or repeated ids, families of several generations, and features too empty or too uniform."""
    ids = rows.agg(F.count_if(F.col(key).isNull()).alias("null_id"), (F.count(key) - F.count_distinct(key)).alias("duplicate_id"))
    a = ids.select(F.inline(F.array(*[F.struct(F.lit(c).alias("fault"), F.lit(key).alias("detail"), F.col(c).alias("n")) for c in ("null_id", "duplicate_id")])))
    split = rows.groupBy(family).agg(F.count_distinct(generation).alias("g")).where("g > 1").agg(F.lit("several_generations").alias("fault"), F.lit(family).alias("detail"), F.count("*").alias("n"))
    stats = rows.agg(*[e for c in features for e in (F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_m"), F.count_distinct(c).alias(f"{c}_v"))])
    each = [F.struct(F.lit(name).alias("fault"), F.lit(c).alias("detail"), bad.cast("long").alias("n")) for c in features for name, bad in (("too_empty", F.col(f"{c}_m") > missing_max), ("too_uniform", F.col(f"{c}_v") < least_values))]
    return a.union(split).union(stats.select(F.inline(F.array(*each)))).where("n > 0")


def frame_checks(rows: DataFrame, key: str, family: str, generation: str, target: str, features: Sequence[str], expected: dict[str, str], missing_max: float, least_values: int) -> DataFrame:
    """``(fault, detail, n)`` of everything that keeps a frame from training; empty for a sound one.

    Ids, families and generations that are missing or repeat, families of several generations, other categories or
    workloads than expected, targets that are missing, infinite or not positive, and features that are infinite, empty,
    too often missing or too uniform.
    """
    inf = lambda c: F.abs(F.col(c).cast("double")) == float("inf")
    counts: list[tuple[str, str, Column]] = [
        ("empty_frame", key, (F.count("*") == 0).cast("long")), ("null_id", key, F.count_if(F.col(key).isNull())), ("duplicate_id", key, F.count(key) - F.count_distinct(key)),
        *[("null_or_empty", c, F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == ""))) for c in (family, generation)],
        *[("unexpected_value", c, F.count_if(~F.coalesce(F.col(c).cast("string") == v, F.lit(False)))) for c, v in expected.items()],
        ("null_target", target, F.count_if(F.col(target).isNull())), ("infinite_target", target, F.count_if(inf(target))), ("target_not_positive", target, F.count_if(F.col(target) <= 0)),
    ]
    for c in features:
        missing = F.avg(F.col(c).isNull().cast("int"))
        counts += [("infinite_feature", c, F.count_if(inf(c))), ("empty_feature", c, (F.count(c) == 0).cast("long")), ("too_often_missing", c, (missing > missing_max).cast("long")), ("too_uniform", c, (F.count_distinct(c) < least_values).cast("long"))]
    one = rows.agg(*[F.coalesce(e.cast("long"), F.lit(0).cast("long")).alias(f"c{i}") for i, (_, _, e) in enumerate(counts)])
    listed = one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("fault"), F.lit(d).alias("detail"), F.col(f"c{i}").alias("n")) for i, (f, d, _) in enumerate(counts)])))
    spread = rows.groupBy(family).agg(F.count_distinct(generation).alias("g")).where("g > 1").agg(F.lit("several_generations").alias("fault"), F.lit(family).alias("detail"), F.count("*").alias("n"))
    return listed.union(spread).where("n > 0")


def feature_profiles(rows: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Least and greatest value of each feature in training."""
    row = rows.agg(*[e for c in features for e in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))]).first()
    return {c: (row[f"{c}_lo"], row[f"{c}_hi"]) for c in features}


def confidence_issues(profiles: dict[str, tuple[float, float]], missing_allowed: float) -> Column:
    """What speaks against a precise estimate: too much missing, or a value outside the training range."""
    missing = sum((F.col(c).isNull().cast("int") for c in profiles), F.lit(0)) / len(profiles)
    out = [F.when(missing > missing_allowed, "missing_fraction")] + [F.when((F.col(c) < lo) | (F.col(c) > hi), f"outside_{c}") for c, (lo, hi) in profiles.items()]
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def estimates(rows: DataFrame, issues: Column, radius: float, precise: bool, promotable: bool) -> DataFrame:
    """Rows (observed, predicted) with ``basis``, ``decision``, ``score``, ``relative_score`` and the interval.

    A measured value wins.  A model whose precise predictions are off, or whose input is outside its contract, gives a
    relative score only.
    """
    odd, seen = F.size(issues) > 0, F.col("observed").isNotNull()
    value = F.greatest(F.lit(0.0), F.col("predicted"))
    off = "precise_predictions_disabled" if promotable else "model_not_promotion_eligible"
    outside = "input_outside_training_contract" if precise else f"{off}_and_input_outside_training_contract"
    sure = ~odd & F.lit(precise)
    return rows.withColumns({
        "basis": F.when(seen, "observed").when(sure, "predicted").otherwise("relative_only"), "decision": F.when(seen, "observed_benchmark").when(odd, outside).when(sure, "precise_model_prediction").otherwise(off),
        "score": F.when(seen, F.col("observed")).when(sure, value), "relative_score": F.when(seen, F.col("observed")).otherwise(value),
        "lower": F.when(~seen & sure, F.greatest(F.lit(0.0), value - radius)), "upper": F.when(~seen & sure, value + radius),
    })


#: Engineered features of a processor (fixed formulas).
ENGINEERED = {
    "core_base_clock_capacity": lambda: F.col("core_count") * F.col("base_clock_ghz"), "core_boost_clock_capacity": lambda: F.col("core_count") * F.col("boost_clock_ghz"), "thread_core_ratio": lambda: F.col("thread_count") / F.col("core_count"),
    "tdp_watts_per_core": lambda: F.col("tdp_watts") / F.col("core_count"), "boost_capacity_per_watt": lambda: F.col("core_count") * F.col("boost_clock_ghz") / F.col("tdp_watts"),
}


def engineered(rows: DataFrame, generation: str, levels: Sequence[str]) -> DataFrame:
    """Adds the engineered features and a 0/1 column for each generation level, and for an unknown one."""
    known = {f"generation_{i}": (F.col(generation) == v).cast("double") for i, v in enumerate(sorted(levels))}
    unknown = {"generation_unknown": (~F.coalesce(F.col(generation).isin(list(levels)), F.lit(False))).cast("double")}
    return rows.withColumns({**{n: f() for n, f in ENGINEERED.items()}, **{n: F.coalesce(c, F.lit(0.0)) for n, c in known.items()}, **unknown})


def cross_validated(rows: DataFrame, features: Sequence[str], label: str, fold: str, penalties: Sequence[float]) -> DataFrame:
    """``(penalty, mae)``: mean error over the folds of a ridge fit for each penalty of the grid; folds are 0 .. k - 1.

    The fits are those of Spark's LinearRegression, from sums by fold: one pass for all sums, one for all errors.
    ValueError for a null among features and label.
    """
    names = [*features, label]
    x = {c: F.col(c).cast("double") for c in names}
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(x[c]) for c in names] + [F.sum(x[names[i]] * x[names[j]]) for i, j in pairs]
    missing = F.count_if(reduce(or_, [v.isNull() for v in x.values()]))
    found = rows.groupBy(fold).agg(F.count("*").alias("n"), missing.alias("missing"), F.array(*sums).alias("sums")).collect()
    if any(r.missing for r in found):
        raise ValueError("null among features and label")
    own = {r[fold]: np.array([r.n, *r.sums]) for r in found}
    whole, folds = sum(own.values()), len(own)
    if folds < 2 or set(own) != set(range(folds)):
        raise ValueError("every fold from 0 on needs rows, and there have to be two")

    def fit(t: np.ndarray, penalty: float) -> np.ndarray:
        """Intercept and coefficients; the penalty bears on standardised columns, a constant one gets 0."""
        m, second, k = t[1 : len(names) + 1] / t[0], np.zeros((len(names), len(names))), len(features)
        for (i, j), v in zip(pairs, t[len(names) + 1 :], strict=True):
            second[i, j] = second[j, i] = v / t[0]
        cov = second - np.outer(m, m)
        sd = np.sqrt(np.maximum(cov.diagonal(), 0.0))
        use = np.flatnonzero(sd[:k] > 0)
        beta = np.zeros(k)
        if sd[k] > 0 and len(use):
            c = cov[np.ix_(use, use)] / np.outer(sd[use], sd[use]) + np.eye(len(use)) * penalty / sd[k]
            beta[use] = np.linalg.lstsq(c, cov[use, k] / (sd[use] * sd[k]), rcond=None)[0] * sd[k] / sd[use]
        return np.array([m[k] - beta @ m[:k], *beta])

    def error(penalty: float) -> Column:
        fits = [[float(v) for v in fit(whole - own.get(i, np.zeros(len(whole))), penalty)] for i in range(folds)]
        at = F.get(F.array(*[F.array(*map(F.lit, f)) for f in fits]), F.col(fold).cast("int"))
        return F.avg(F.abs(x[label] - sum((at[i + 1] * x[c] for i, c in enumerate(features)), at[0])))

    judged = rows.groupBy(fold).agg(*[error(p).alias(f"mae_{i}") for i, p in enumerate(penalties)])
    lines = F.array(*[F.struct(F.lit(float(p)).alias("penalty"), F.avg(f"mae_{i}").alias("mae")) for i, p in enumerate(penalties)])
    return judged.agg(lines.alias("lines")).select(F.inline("lines"))


def resolved_models(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests (category, workload) with the one model registered for exactly them; several are an error, not a choice."""
    per = registry.groupBy("category", "workload").agg(F.min("model").alias("model"), F.count("*").alias("n"))
    rows = requests.join(per, ["category", "workload"], "left")
    state = F.when(F.col("n").isNull(), "no_model").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return rows.select(*requests.columns, F.when(F.col("n") == 1, F.col("model")).alias("model"), state.alias("state"))


def generations(rows: DataFrame, family: str, architecture: str) -> DataFrame:
    """``(family, generation)``: the most frequent architecture, else the series that the family's number gives."""
    from tessera.functions.parts import series

    known = modal(rows.where(F.col(architecture).isNotNull()), [family], architecture).select(family, F.col(architecture).alias("known"))
    return rows.select(family).distinct().join(known, family, "left").select(family, F.coalesce("known", series(F.col(family))).alias("generation"))


#: Scores that can be compared: unit, better when higher, field of the source (fixed values).
CONTRACTS = [("samples/minute", True, "samples_per_minute"), ("seconds", False, "total_render_time"), ("seconds", False, "render_time_no_sync")]


def contracted(rows: DataFrame, unit: str, higher: str, field: str) -> Column:
    """Whether a score's unit, direction and field belong together."""
    out = F.lit(False)
    for u, h, f in CONTRACTS:
        out = out | ((F.trim(unit) == u) & (F.col(higher) == h) & (F.trim(field) == f))
    return F.coalesce(out, F.lit(False))


def workload_slug(*parts: Column) -> Column:
    text = F.regexp_replace(F.lower(F.concat_ws("_", *parts)), "[^a-z0-9]+", "_")
    return F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", "")


def gate(rows: DataFrame, rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Metric rows with ``blockers``: names of the metrics that are unknown or on the wrong side of their limit.

    Each rule is (column, 'least' or 'most', limit).
    """
    ok = lambda c, how, v: F.col(c) >= v if how == "least" else F.col(c) <= v
    why = [F.when(~F.coalesce(ok(c, how, v), F.lit(False)), F.lit(c)) for c, how, v in rules]
    return rows.withColumn("blockers", F.filter(F.array(*why), lambda b: b.isNotNull()))


def promotion(rows: DataFrame, rules: Sequence[tuple[str, str, float]], r2: str, mape: str, n: str, least_rows: int, least_r2: float, most_mape: float) -> DataFrame:
    """``gate`` with ``confidence``: high without a blocker, medium for a reportable model that nearly fits, else low."""
    out = gate(rows, rules)
    near = F.coalesce((F.col(n) >= least_rows) & ((F.col(r2) >= min(0.70, least_r2)) | (F.col(mape) <= max(20.0, most_mape))), F.lit(False))
    return out.withColumn("confidence", F.when(F.size("blockers") == 0, "high").when(near & F.coalesce("reportable", F.lit(False)), "medium").otherwise("low"))


def observed_first(requests: DataFrame, observed: DataFrame, model: DataFrame, key: Sequence[str]) -> DataFrame:
    """The measured value where there is one, else the estimate; ``basis`` says which, or unavailable."""
    o, m = observed.select(*key, F.col("value").alias("measured")), model.select(*key, F.col("value").alias("estimate"))
    both = requests.join(o, list(key), "left").join(m, list(key), "left")
    basis = F.when(F.col("measured").isNotNull(), "observed").when(F.col("estimate").isNotNull(), "predicted").otherwise("unavailable")
    return both.select(*requests.columns, F.coalesce("measured", "estimate").alias("value"), basis.alias("basis"))


def modal(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, ties to the smaller."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*by, value, "n")


def group_diagnostics(test: DataFrame, group: str, development: DataFrame, profiles: dict[str, tuple[float, float]]) -> DataFrame:
    """One row on test rows (actual, predicted): groups, those that development has too, the worst group's MAPE among
    groups of two rows or more with positive values, and rows outside the training range."""
    outside = [F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)) for c, (lo, hi) in profiles.items()]
    out = outside[0]
    for c in outside[1:]:
        out = out | c
    per = test.groupBy(group).agg(F.count("*").alias("n"), F.min("actual").alias("low"), F.avg(F.try_divide(F.abs(F.col("predicted") - F.col("actual")), F.col("actual"))).alias("mape"), F.count_if(out).alias("outside"))
    seen = per.join(development.select(group).distinct().withColumn("seen", F.lit(1)), group, "left")
    usable = (F.col("n") >= 2) & (F.col("low") > 0)
    return seen.agg(F.count("*").alias("groups"), F.count("seen").alias("overlap"), F.count_if(usable).alias("evaluable"), (100 * F.max(F.when(usable, F.col("mape")))).alias("worst_mape"), F.sum("n").alias("rows"), F.sum("outside").alias("outside_rows"))


def train_regressor(rows: DataFrame, features: Sequence[str], label: str, kind: str = "ridge", seed: int = 17):
    """Median imputation and scaling before ridge regression, or gradient-boosted trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    filled = [f"{f}_filled" for f in features]
    first = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    last = LinearRegression(labelCol=label, regParam=1.0, elasticNetParam=0.0) if kind == "ridge" else GBTRegressor(labelCol=label, maxIter=10, maxDepth=3, seed=seed)
    return Pipeline(stages=[*first, last]).fit(rows)
