"""Steps whose memory has to stay bounded while tables grow."""

import hashlib
import random
import time
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import entity as E
from tessera.operators import metrics as X
from tessera.operators import performance as G
from tessera.operators import retrieval as R
from tessera.plans import ingestion as I
from tessera.plans import matching as M

SF = "/root/testdata/sf0.001"


def test_no_side_of_the_pairs_is_broadcast(spark):
    for conflicts in (False, True):
        plan = E.block_pairs(*M.listings(spark, SF), keep_conflicts=conflicts)._jdf.queryExecution().executedPlan().toString()
        # the listings themselves join two tables of their own
        assert "MergeJoin" in plan and not [line for line in plan.split("\n") if "BroadcastHashJoin" in line and "p_partkey" not in line]


def test_similarity_is_that_of_a_new_matcher_for_every_pair():
    draw = random.Random(3)
    texts = [None, "", "a" * 250, *("".join(draw.choices("abc 12", k=draw.randint(1, 230))) for _ in range(40))]
    pairs = [(x, y) for y in texts for x in texts]
    got = T.sequence_ratio.func(pd.Series([x for x, _ in pairs]), pd.Series([y for _, y in pairs]))
    assert got.tolist() == [SequenceMatcher(None, x or "", y or "").ratio() for x, y in pairs]


def test_words_are_counted_where_their_document_is(spark):
    rows = [(1, "x", "b a b c b"), (2, "x", ""), (3, "x", None), (4, "y", "c c")]
    postings, terms = R.bm25_index(spark.createDataFrame(rows, "id long, category string, text string"))
    got = {(r.category, r.term, r.id): (r.tf, r.length, r.avg_length) for r in postings.collect()}
    assert got == {("x", "a", 1): (1, 5, 5 / 3), ("x", "b", 1): (3, 5, 5 / 3), ("x", "c", 1): (1, 5, 5 / 3), ("y", "c", 4): (2, 2, 2.0)}
    assert {(r.category, r.term) for r in terms.collect()} == {("x", "a"), ("x", "b"), ("x", "c"), ("y", "c")}
    counted = postings.select("id", "category", "term", "tf")._jdf.queryExecution().optimizedPlan().toString()
    assert counted.count("Aggregate [") == 1, "only the sizes of the categories are aggregated"


def test_embedding_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "x", "a b"), (2, None, "")], "id long, category string, text string")
    kept, plain = R.hash_embedding(docs, keep=["category"]), R.hash_embedding(docs)
    assert {(r.id, r.category) for r in kept.collect()} == {(1, "x"), (2, None)} and kept.drop("category").collect() == plain.collect()


def test_names_are_read_once_and_by_all_cores(spark, tmp_path):
    spark.range(1, 40_001, 8).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 40_001, 8).selectExpr("id as l_orderkey", "1 as l_linenumber", "id as l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    for q, n in ((I.text_hardware_families, None), (I.join_hardware_families, 8)):
        out = q(spark, str(tmp_path))
        assert "regexp_extract_all" in (plan := out._jdf.queryExecution().optimizedPlan().toString())
        assert not [line for line in plan.split("\n") if "regexp_extract_all" in line and "p_partkey" in line], "no pattern meets a row of the table"
        assert out.count() == 5000 and (n is None or {r.products for r in out.collect()} == {n})


def test_pairs_are_met_and_judged_by_all_tasks(spark):
    plan = E.block_pairs(*M.listings(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 3 and "Scan parquet" not in plan


def test_matched_reads_the_pairs_once(spark):
    plan = E.matched(*(sides := M.listings(spark, SF)), spark.range(0).selectExpr("id as l_id", "id as p_id", "0.5D as score", "false as conflict"))._jdf.queryExecution().optimizedPlan().toString()
    assert sides and plan.count("Range (0, 0") == 1


def test_grouped_draws_gather_rows_once(spark):
    rows = pd.DataFrame({"g": [3, 10, 3, 7, 1, 10, 2, 7], "v": [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0]})
    parts = [g for _, g in sorted(rows.groupby("g"), key=lambda x: str(x[0]))]
    draws = [np.random.default_rng([5, i]).integers(0, len(parts), len(parts)) for i in range(40)]
    want = np.quantile([pd.concat([parts[j] for j in d])["v"].mean() for d in draws], [0.025, 0.975])
    got = X.grouped_bootstrap(spark.createDataFrame(rows), "g", lambda d: float(d["v"].mean()), ["v"], 40, seed=5).collect()[0]
    assert np.allclose([got.low, got.high], want) and got.groups == 5
    many = spark.range(50_000).selectExpr("id as g", "double(id) as v")
    began = time.time()
    assert X.grouped_bootstrap(many, "g", lambda d: float(d["v"].mean()), ["v"], 64).collect()[0].groups == 50_000
    assert time.time() - began < 60


def test_plain_texts_stay_out_of_python(spark):
    docs = spark.createDataFrame([(1, "Ab c-D"), (2, "ＡＢ ﬁx Straße"), (3, None), (4, "")], "id long, text string").select("id", T.search_terms(F.col("text")).alias("t"))
    assert {r.id: r.t for r in docs.collect()} == {1: ["ab", "c-d"], 2: ["ab", "fix", "strasse"], 3: [], 4: []}
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert "search_normalised(CASE WHEN" in plan and "octet_length" in plan


def plain_embedding(words, dim=512):
    out, joined = np.zeros(dim, np.float32), "".join(words)
    for weight, features in ((1.0, [f"w:{w}" for w in words]), (1.35, [f"b:{a}_{b}" for a, b in zip(words, words[1:])]), (0.2, [f"c:{joined[i : i + 4]}" for i in range(len(joined) - 3)])):
        for f in features:
            digest = hashlib.sha256(f.encode()).digest()
            out[int.from_bytes(digest[:8], "big") % dim] += np.float32(weight if digest[8] & 1 else -weight)
    norm = float(np.linalg.norm(out))
    return (out / np.float32(norm) if norm else out).tolist(), norm


def test_embedding_is_that_of_each_feature_in_turn(spark, monkeypatch):
    draw = random.Random(5)
    texts = ["", "a", "ab cd", *(" ".join("".join(draw.choices("abc{}1", k=draw.randint(1, 6))) for _ in range(draw.randint(1, 80))) for _ in range(30))]
    monkeypatch.setattr(R, "REMEMBERED", 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = {r.id: r.w for r in docs.select("id", T.search_terms(F.col("text")).alias("w")).collect()}
    assert {r.id: (r.vector, r.norm) for r in R.hash_embedding(docs).collect()} == {i: plain_embedding(w) for i, w in words.items()}


def test_allowed_pairs_are_compared_in_products_and_not_broadcast(spark):
    draw = random.Random(6)
    vector = lambda: [float(draw.randint(-3, 3)) for _ in range(4)]
    vectors = [(i, "xy"[i % 2], vector() if i % 9 else None) for i in range(60)]
    queries = [(f"q{i}", vector()) for i in range(4)] + [("q4", [0.0] * 4)]
    pairs = [(f"q{draw.randrange(6)}", draw.randrange(70)) for _ in range(150)]
    v, q, p = (spark.createDataFrame(r, s) for r, s in ((vectors, "id long, category string, vector array<float>"), (queries, "query_id string, vector array<float>"), (pairs, "query_id string, id long")))
    found = R.cosine_search(v, q, 3, p)
    unit = lambda x: np.zeros(4) if x is None or not any(x) else np.array(x) / np.linalg.norm(x)
    want = set()
    for name, x in queries:
        for kind in "xy":
            rows = sorted((-round(float(unit(x) @ unit(y)), 9) + 0.0, i) for i, c, y in vectors if c == kind and (name, i) in set(pairs))[:3]
            want |= {(name, kind, i, rank, -s + 0.0) for rank, (s, i) in enumerate(rows, 1)}
    assert {(r.query_id, r.category, r.id, r.rank, r.score + 0.0) for r in found.collect()} == want
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_cross_validation_reads_the_rows_twice(spark):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = spark.range(300).selectExpr("id % 3 as fold", "double(id % 17) as a", "double(id * 7 % 31) / 10 as b", "4.0D as c", "double(id % 17) * 3 - double(id * 7 % 31) + double(id * 13 % 11) as y").checkpoint()
    features = ["a", "b", "c"]
    found = {r.penalty: r.mae for r in G.cross_validated(rows, features, "y", "fold", [0.0, 2.0, 50.0]).collect()}
    data, judge = VectorAssembler(inputCols=features, outputCol="v").transform(rows), RegressionEvaluator(labelCol="y", metricName="mae")
    for penalty, mae in found.items():
        model = LinearRegression(labelCol="y", featuresCol="v", elasticNetParam=0.0, regParam=penalty)
        assert abs(mae - np.mean([judge.evaluate(model.fit(data.where(f"fold <> {i}")).transform(data.where(f"fold = {i}"))) for i in range(3)])) < 1e-6  # Spark iterates where a column is constant
    for bad in (rows.withColumn("b", F.when(F.col("b") > 1, F.col("b"))), rows.where("fold <> 1")):
        with pytest.raises(ValueError):
            G.cross_validated(bad, features, "y", "fold", [0.0])


def test_texts_to_embed_are_dealt_out(spark):
    docs = spark.range(40).selectExpr("id", "'ab cd' as text").coalesce(1)
    plan = R.hash_embedding(docs)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.index("MapInPandas") < plan.index("REPARTITION_BY_NUM")
