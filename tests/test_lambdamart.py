"""The grouped ranker against brute force: gradients over all pairs, splits over all cuts, order of held-out queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import lambdamart as L
from tessera.operators import ranking as K


def plain_gradients(score, grade, cutoff):
    n, slope, curve, total = len(score), np.zeros(len(score)), np.zeros(len(score)), 0.0
    order = sorted(range(n), key=lambda i: -score[i])
    best = sum((2.0**g - 1) / np.log2(2 + i) for i, g in enumerate(sorted(grade, reverse=True)[:cutoff]))
    if not best:
        return slope, curve
    for a in range(min(cutoff, n)):
        for b in range(a + 1, n):
            i, j = order[a], order[b]
            if grade[i] == grade[j]:
                continue
            high, low = (i, j) if grade[i] > grade[j] else (j, i)
            change = abs(2.0 ** grade[i] - 2.0 ** grade[j]) * abs(1 / np.log2(2 + a) - 1 / np.log2(2 + b)) / best
            if max(score) != min(score):
                change /= 0.01 + abs(score[i] - score[j])
            p = 1 / (1 + np.exp(score[high] - score[low]))
            slope[high] -= p * change
            slope[low] += p * change
            curve[[high, low]] += p * (1 - p) * change
            total += 2 * p * change
    scale = np.log2(1 + total) / total if total else 1
    return slope * scale, curve * scale


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_gradients_equal_all_pairs(n):
    rng = np.random.default_rng(n)
    for grades in (rng.integers(0, 4, n), np.zeros(n, int), np.full(n, 2)):
        for score in (np.zeros(n), rng.normal(size=n), np.round(rng.normal(size=n))):
            for got, want in zip(L.gradients(score, grades, 5), plain_gradients(score, grades, 5), strict=True):
                assert got == pytest.approx(want, abs=1e-12)


def test_ndcg():
    assert L.ndcg(np.array([3.0, 2, 1]), np.array([0, 1, 2]), 2) == pytest.approx((1 / np.log2(3)) / (3 + 1 / np.log2(3)))
    assert np.isnan(L.ndcg(np.zeros(2), np.zeros(2)))


def graded(spark, queries=60, n=25):
    """Grades are places within the query, whose level differs from query to query."""
    rng, out = np.random.default_rng(3), []
    for q in range(queries):
        x = rng.normal(size=(n, 4))
        worth = x[:, 0] + np.where(x[:, 1] > 0, 1.5, 0) * x[:, 2] + rng.normal(scale=0.2, size=n)
        grade = np.searchsorted(np.sort(worth), worth) * 5 // n - 1
        out += [(q, i, *map(float, x[i]), int(max(0, grade[i]))) for i in range(n)]
    return spark.createDataFrame(out, "query_id int, product_id int, a double, b double, c double, d double, grade int")


def test_first_split_equals_all_cuts(spark):
    rows = graded(spark, 12, 10)
    s = L.Settings(trees=1, leaves=2, levels=1, features=1.0)
    model = L.train(rows, ["a", "b", "c", "d"], settings=s)
    local = rows.toPandas().sort_values(["query_id", "product_id"])
    parts = [L.gradients(np.zeros(len(g)), g["grade"].to_numpy()) for _, g in local.groupby("query_id")]
    g, h = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    worth, best = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.penalty), (-1, None)
    for i, c in enumerate("abcd"):
        for edge in model.edges[i]:
            left = local[c].to_numpy() <= edge
            if min(left.sum(), (~left).sum()) >= s.least_rows:
                best = max(best, (round(worth(left) + worth(~left), 6), (i, edge)), key=lambda x: x[0])
    tree = model.trees[0]
    found = (int(tree.feature[0]), model.edges[tree.feature[0]][tree.bin[0]])
    left = local["abcd"[found[0]]].to_numpy() <= found[1]
    assert worth(left) + worth(~left) == pytest.approx(best[0], rel=1e-5)
    assert sorted(tree.value[1:]) == pytest.approx(sorted(-s.rate * g[m].sum() / (h[m].sum() + s.penalty) for m in (left, ~left)), rel=1e-4)


def test_better_than_pointwise_on_held_out_queries(spark):
    rows = graded(spark).withColumn("valid", F.col("query_id") % 5 == 1)
    learnt, rest = rows.where("query_id % 5 <> 2"), rows.where("query_id % 5 = 2")
    model = L.train(learnt, ["a", "b", "c", "d"], valid="valid", settings=L.Settings(trees=25, rate=0.2, leaves=8, levels=3, patience=8))
    mean = lambda df: df.toPandas().groupby("query_id").apply(lambda g: L.ndcg(g["score"].to_numpy(), g["grade"].to_numpy()), include_groups=False).mean()
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    pointwise = Pipeline(stages=[VectorAssembler(inputCols=list("abcd"), outputCol="features"), GBTRegressor(labelCol="grade", maxIter=10, maxDepth=3, seed=17)]).fit(learnt)
    ours, theirs = mean(L.predict(rest, model)), mean(pointwise.transform(rest).withColumnRenamed("prediction", "score"))
    assert ours > 0.9 and ours > theirs
    again = L.Model.from_json(model.to_json())
    assert L.predict(rest, again).orderBy("query_id", "product_id").collect() == L.predict(rest.repartition(7), model).orderBy("query_id", "product_id").collect()
    with pytest.raises(ValueError):
        L.Model.from_json(model.to_json().replace("0.", "1.", 1))


def test_same_trees_however_rows_are_dealt_out(spark):
    rows, s = graded(spark, 15, 12), L.Settings(trees=3, leaves=4, levels=2)
    a, b = (L.train(r, ["a", "b", "c", "d"], settings=s).to_json() for r in (rows.repartition(1), rows.repartition(9)))
    assert a == b


def test_faults(spark):
    with pytest.raises(ValueError, match="grades"):
        L.train(graded(spark, 3, 5).withColumn("grade", F.lit(1)), ["a"])
    with pytest.raises(Exception, match="candidates"):
        L.train(graded(spark, 2, 6), ["a"], settings=L.Settings(pool=5, trees=1))
    rows = graded(spark, 4, 6).withColumn("a", F.when(F.col("product_id") > 2, F.col("a"))).withColumn("grade", F.when(F.col("product_id") != 1, F.col("grade")))
    odd = rows.union(rows.limit(1).withColumn("query_id", F.lit(None).cast("int"))).withColumn("score", F.lit("x"))
    model = L.train(odd, ["a", "b"], settings=L.Settings(trees=2, leaves=3, levels=2))
    assert L.predict(odd, model).count() == 25 and L.predict(odd.limit(0), model).count() == 0 and len(K.WEIGHTS) == 23
