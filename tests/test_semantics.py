"""Literal cases for the rules that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.operators import compat, filters, optimizer, quality, records, relations, sampling, windows
from tessera.operators.retrieval import reciprocal_rank_fusion


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_missing_values_never_satisfy(spark):
    f = filters.ProductFilter(max_price=1200, minimum={"vram": (["gpu"], 16)})
    rows = [("a", "gpu", 899.0, "in_stock", 12), ("b", "gpu", 1099.0, "limited_stock", 20), ("c", "gpu", 999.0, "out_of_stock", 24), ("d", "cpu", 749.0, "in_stock", None), ("e", "gpu", None, "in_stock", 24), ("f", "gpu", 1.0, None, 24), ("g", "gpu", 1.0, "in_stock", None)]
    df = spark.createDataFrame(rows, "id string, category string, price double, stock string, vram int")
    got = df.where(filters.product_matches(f, {c: F.col(c) for c in df.columns} | {"brand": F.lit("x")}))
    assert {r.id for r in got.collect()} == {"b", "d"}


def test_safe_number(spark):
    values = ["1", "-2.5", "1e5", "NaN", "", None, "7 "]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.n for r in df.select(filters.safe_number(F.col("v")).alias("n")).collect()] == [1.0, -2.5, None, None, None, None, None]


def test_rank_fusion(spark):
    rows = [("q", "bm25", "a", 1), ("q", "bm25", "b", 2), ("q", "vector", "b", 1), ("q", "vector", "c", 2), ("q", "vector", "c", 9)]
    got = reciprocal_rank_fusion(spark.createDataFrame(rows, "q string, source string, id string, rank int"), ["q"]).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"] and got[0].score == pytest.approx(1 / 62 + 1 / 61)


def test_text(spark):
    r = one(spark, T.matching_normalised(F.lit("  MÖBIUS—RTX４０７０  ")).alias("a"), T.identifier(F.lit("AB-12 / 34")).alias("b"), T.numeric_facts(F.lit("2x16GB kit, 1 TB SSD, 0.75 kW PSU, 36 cm radiator")).alias("c"),
            T.money(F.lit("S$1,234.565")).cast("string").alias("d"), T.money(F.lit("free")).alias("e"), (T.version_key(F.lit("F10")) > T.version_key(F.lit("F9b"))).alias("f"), T.offset_timestamp(F.lit("2024-01-01T00:00:00")).alias("g"), T.sequence_ratio(F.lit("abcd"), F.lit("bcde")).alias("h"))
    assert (r.a, r.b, r.d, r.e, r.f, r.g) == ("mobius rtx4070", "ab1234", "1234.57", None, True, None) and r.h == 0.75
    assert r.c == "capacity_gb=1024.00,length_mm=360.00,power_w=750.00,total_capacity_gb=32.00"


def test_cosine_and_wilson(spark):
    low, high = N.wilson(F.lit(0), F.lit(0))
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = one(spark, N.cosine(arr(1, 0), arr(1, 0)).alias("a"), N.cosine(arr(1, 0), arr(0, 0)).alias("b"), N.cosine(arr(1), arr(1, 2)).alias("c"), low.alias("low"), high.alias("high"))
    assert (r.a, r.b, r.c, r.low, r.high) == (1.0, 0.0, 0.0, None, None)


def test_compatibility_is_never_guessed(spark):
    df = spark.createDataFrame([(1, 300.0, 350.0), (2, 360.0, 350.0), (3, None, 350.0), (4, -1.0, 350.0)], "build_id long, gpu_length_mm double, case_gpu_mm double")
    got = {r.build_id: r.status for r in compat.check(df, ["gpu_case.length"]).collect()}
    assert got == {1: "pass", 2: "fail", 3: "unknown", 4: "unknown"}
    psu = spark.createDataFrame([(1, 100.0, 300.0, 625.0), (2, 100.0, 300.0, 624.0)], "build_id long, cpu_watts double, gpu_watts double, psu_watts double")
    assert {r.build_id: r.status for r in compat.check(psu, ["psu.capacity"]).collect()} == {1: "pass", 2: "fail"}
    assert {r.rule for r in compat.check(df).collect()} == set(compat.RULES)
    cables = spark.sql("SELECT 1 AS build_id, map('8pin', 2) AS gpu_connectors, map('8pin', 1) AS psu_connectors, true AS authoritative UNION ALL SELECT 2, map('8pin', 1), map('8pin', 1), false")
    assert {r.build_id: r.status for r in compat.check(cables, ["psu.gpu_connectors"]).collect()} == {1: "fail", 2: "unknown"}



def test_allocation_and_split(spark):
    assert sampling.allocate(30, {"train": 0.6, "validation": 0.2, "test": 0.2}) == {"train": 18, "validation": 6, "test": 6}
    assert sampling.allocate(3, {"train": 0.9, "validation": 0.05, "test": 0.05}) == {"train": 1, "validation": 1, "test": 1}
    df = spark.createDataFrame([(f"g{i}",) for i in range(30)], "g string")
    w = {"train": 0.6, "validation": 0.2, "test": 0.2}
    a, b = (sampling.group_split(d, "g", 17, w).collect() for d in (df, df.orderBy(F.desc("g"))))
    assert sorted(a) == sorted(b) and sorted(x.split for x in a).count("train") == 18


def test_cursor_scope():
    scope = sampling.scope_digest({"category": "gpu", "size": 20})
    c = sampling.encode_cursor({"page": 2, "scope": scope}, b"secret")
    assert sampling.decode_cursor(c, b"secret")["scope"] == sampling.scope_digest({"size": 20, "category": "gpu"}) != sampling.scope_digest({"category": "cpu", "size": 20})


def test_cursor_round_trip():
    c = sampling.encode_cursor({"page": 3}, b"secret")
    assert sampling.decode_cursor(c, b"secret") == {"page": 3}
    with pytest.raises(ValueError):
        sampling.decode_cursor(c, b"other")


def test_event_outcomes(spark):
    rows = [(1, "s", "k", "view", "i", "p", 0), (1, "s", "k", "view", "i", "p", 1), (1, "t", "k", "view", "i", "p", 2), (2, "s", "k", "view", "j", "q", 3), (3, "s", "k3", "view", "i", "p", 4), (4, "s", "k4", "view", "i", "z", 5), (5, None, None, "view", None, "p", 6)]
    df = spark.createDataFrame(rows, "event_id long, session string, key string, kind string, impression string, payload string, n int")
    got = {r.n: r.outcome for r in quality.idempotent(df, ["n"]).collect()}
    assert got == {0: "accepted", 1: "replay", 2: "conflict", 3: "conflict", 4: "duplicate", 5: "conflict", 6: "accepted"}


def test_signals_and_pairs(spark):
    r = one(spark, records.reconciled(F.lit("a"), F.lit(None), F.lit("unknown")).alias("a"), records.reconciled(F.lit("a"), F.lit("b")).alias("b"), records.reconciled(F.lit(None).cast("string")).alias("c"))
    assert (r.a, r.b, r.c) == ("a", "conflict", "unknown")


def test_average_rank(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 7)], "id long, v long")
    assert {r.id: r.r for r in df.select("id", windows.average_rank("v").alias("r")).collect()} == {1: 1.5, 2: 1.5, 3: 3.0}


def test_arc_consistency(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, s string")
    b = spark.createDataFrame([(1, "x", 1), (2, "z", 2)], "id long, s string, t int")
    c = spark.createDataFrame([(1, 2)], "id long, t int")
    out = relations.arc_consistent({"a": a, "b": b, "c": c}, [("a", "b", F.col("a_s") == F.col("b_s")), ("b", "c", F.col("b_t") == F.col("c_t"))])
    assert all(d.count() == 0 for d in out.values())


def test_listing_csv(spark, tmp_path):
    from tessera.sources.files import read_device_ids, read_json_lines, read_listing_csv

    (tmp_path / "x.csv").write_text("source_listing_id,title,retailer,currency,base_price,shipping_price,stock_status,condition,listing_url,observed_at\n"
                                    "1,A,R,SGD,\"1,299.90\",,in stock,new,https://a,2024-01-01T00:00:00Z\n2,B,R,USD,5,,in stock,used,http://a,2024-01-01\n")  # fmt: skip
    good, bad = read_listing_csv(spark, str(tmp_path / "x.csv"))
    assert [str(r.base_price) for r in good.collect()] == ["1299.90"] and bad.first().reasons == ["unsupported_currency", "not_new", "invalid_time", "insecure_url"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n[1]\n{"a": \n')
    rows, refused = read_json_lines(spark, str(tmp_path / "x.jsonl"), "a long")
    assert [r.a for r in rows.collect()] == [1] and {r.reason for r in refused.collect()} == {"not_an_object", "malformed"}
    (tmp_path / "ids").mkdir()
    (tmp_path / "ids/p.ids").write_text("# c\n10de  NV\n\t1234  Dev\n\t\t1043 0001  Sub\n8086  IN\n\tabcd  Dev2\n")
    got = [(r.level, r.vendor, r.device, r.code, r["name"]) for r in read_device_ids(spark, str(tmp_path / "ids")).orderBy("line").collect()]
    assert got == [(0, "10de", None, "10de", "NV"), (1, "10de", "1234", "1234", "Dev"), (2, "10de", "1234", "1043 0001", "Sub"), (0, "8086", None, "8086", "IN"), (1, "8086", "abcd", "abcd", "Dev2")]
