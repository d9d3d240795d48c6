"""Operators on literals, against plain versions of the same rules."""

import itertools
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import parts as P
from tessera.operators import candidates, compat, entity, metrics, optimizer, performance, ranking, retrieval, sampling
from tessera.sources import files

SIDE = "id long, category string, brand string, mpn string, gtin string, title string, price double, attributes map<string,string>"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_facts_and_variants(spark):
    said = lambda t: P.written_facts(P.facts(F.lit(t)))
    r = one(spark, said("2x16GB kit, 1 TB SSD, 0.75 kW PSU, 36 cm radiator").alias("a"), said("RTX 4070, 5.2GHz; x8gb 8gbx").alias("b"), said(None).alias("c"))
    assert r.a == "capacity=1024.0000000000,length=360.0000000000,module_count=2.0000000000,power=750.0000000000,total_capacity=32.0000000000" and r.b == "frequency=5200.0000000000" and r.c == ""
    v = P.variants(F.create_map(F.lit("capacity_gb"), F.lit("0"), F.lit("power_w"), F.lit("0.65 kW")), P.facts(F.lit("2x16 GB")))
    assert tuple(one(spark, v.alias("v")).v) == (32.0, 32.0, 2.0, 650.0, None)
    shorts = lambda need, have: P.shortages(P.connectors(F.lit(need))["counts"], P.connectors(F.lit(have))["counts"])
    r = one(spark, shorts("8-pin, 6-pin", "2x 6+2-pin").alias("a"), shorts("8-pin, 6-pin", "8-pin").alias("b"), P.connectors(F.lit("4-pin"), "eps")["counts"].alias("c"))
    assert r.a == {} and r.b == {"pcie_6_pin": 1} and r.c == {"eps_4_pin": 1}


def sides(spark, left, right):
    make = lambda rows: spark.createDataFrame([(i, c, b, m, g, t, 1.0, a) for i, c, b, m, g, t, a in rows], SIDE)
    return make(left), make(right)


def test_blocking_and_conflicts(spark):
    left = [(1, "RAM", "Acme", "M-32", None, "Acme kit 32 GB", None), (2, "Graphics Card", None, None, None, "RTX4070", None), (3, "cpu", "Other", None, None, "chip 9", None)]
    right = [(10, "memory", "Acme", "m32", None, "Acme kit 64GB", None), (11, "gpu", "Acme", None, None, "Geforce RTX 4070 super", None), (12, "cpu", "Acme", None, None, "chip 9", None)]
    pairs = lambda keep: {(r.l_id, r.p_id) for r in entity.block_pairs(*sides(spark, left, right), keep_conflicts=keep).collect()}
    assert pairs(False) == {(2, 11)} and pairs(True) == {(1, 10), (2, 11)}
    rows = entity.review_candidates(entity.block_pairs(*sides(spark, left, right), keep_conflicts=True))
    got = {r.l_id: (round(r.score, 6), list(r.reasons)) for r in rows.collect()}
    assert got[1][1] == ["exact_manufacturer_part_number", "brand", "model_tokens", "character_similarity", "numeric_conflict_review", "numeric_conflict:capacity_gb"] and got[1][0] > 0.75
    hard = entity.hard_negatives(rows).collect()
    assert [r.l_id for r in hard if r.l_id == 1] == [1] and abs(hard[0].hardness - min(1, 0.55 * got[hard[0].l_id][0] + (0.35 if hard[0].l_id == 1 else 0.10))) < 1e-6


def test_anchors(spark):
    left = [(1, "gpu", "Acme", "AB-1234", None, "x", None), (2, "gpu", None, None, None, "Acme thing AB1234 red", None), (3, "gpu", "Acme", "AB1234", "88", "y", None), (4, "gpu", "Zed", "AB1234", None, "z", None), (5, "gpu", None, None, "77", "Acme black", None)]
    right = [(10, "gpu", "Acme", "AB1234", "99", "p", {"colour": "Red"}), (11, "gpu", "Bolt", "QQQQQQ", "88", "q", None), (12, "gpu", "Acme", None, "77", "r", {"colour": "white"})]
    got = {r.l_id: (r.outcome, r.p_id, r.method) for r in entity.anchored(*sides(spark, left, right)).collect()}
    assert got == {1: ("auto_matched", 10, "exact_mpn_brand"), 2: ("auto_matched", 10, "exact_mpn_brand"), 3: ("ambiguous", None, None), 5: ("hard_conflict", None, None)}


def test_review_batch_is_greedy(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(12), "abc"[rng.randrange(3)], round(rng.random(), 3)) for i in range(150)]
    rows = [(i, lst, "abc"[lst % 3], p) for i, lst, _, p in rows]
    df = spark.createDataFrame(rows, "item_id long, listing_id long, category string, priority double")
    import hashlib

    tie = {i: hashlib.sha256(f"20260722:{i}".encode()).hexdigest() for i, *_ in rows}
    left, want, by_listing, by_category = list(rows), [], {}, {}
    while len(want) < 15:
        open_ = [r for r in left if by_listing.get(r[1], 0) < 2]
        if not open_:
            break
        best = min(open_, key=lambda r: (-(r[3] - min(0.25, 0.05 * by_category.get(r[2], 0))), tie[r[0]]))
        want.append(best[0])
        by_listing[best[1]], by_category[best[2]] = by_listing.get(best[1], 0) + 1, by_category.get(best[2], 0) + 1
        left.remove(best)
    assert [r.item_id for r in entity.review_batch(df, 15).orderBy("place").collect()] == want


def test_choice_against_all_builds(spark):
    rng = random.Random(8)
    cats = ["a", "b", "psu", "d"]
    rows = [("r", c, 10 * i + j, rng.randrange(50, 200), 0.0, rng.randrange(10, 60), rng.choice([90, 150, 220]), *[float(rng.randrange(100)) for _ in range(6)]) for i, c in enumerate(cats) for j in range(7)]
    df = spark.createDataFrame(rows, "request_id string, category string, product_id long, price_cents long, warning_penalty double, power_watts int, psu_watts int, " + ", ".join(f"{s} double" for s in optimizer.SCORES))
    pairs = [("r", 0 + i, 10 + j, None if (i + j) % 3 == 0 else 250) for i in range(7) for j in range(7) if (i * j) % 2 == 0]
    links = spark.createDataFrame(pairs, "request_id string, left_id long, right_id long, penalty long")
    limits = optimizer.Limits(480, base_watts=5, headroom_percent=20, supply="psu")
    names = ["best_overall", "lowest_power", "best_value"]
    got = optimizer.choose(df, cats, limits, names, links).orderBy("place").collect()
    by = {r[2]: r for r in rows}
    bad = {frozenset(p[1:3]) for p in pairs if p[3] is None}
    cost = {frozenset(p[1:3]): p[3] for p in pairs if p[3] is not None}

    def coef(r, name):
        p = optimizer.PROFILES[name]
        return round(sum(a * b for a, b in zip(p.weights, r[7:])) * 100) - (r[3] // p.price_divisor if p.price_divisor else 0) - r[5] * p.per_watt

    prior = []
    for name, found in zip(names, got):
        best = None
        for ids in itertools.product(*[[r[2] for r in rows if r[1] == c] for c in cats]):
            two = [frozenset(x) for x in itertools.combinations(ids, 2)]
            price, load = sum(by[i][3] for i in ids), 5 + sum(by[i][5] for i in ids if by[i][1] != "psu")
            if price > 480 or any(t in bad for t in two) or load * 120 > by[ids[2]][6] * 100 or any(sum(x != y for x, y in zip(ids, old)) < 2 for old in prior):
                continue
            key = (-(sum(coef(by[i], name) for i in ids) - sum(cost.get(t, 0) for t in two)), price, ids)
            best = key if best is None or key < best else best
        assert (-found.objective, found.price_cents, tuple(found.ids)) == best
        prior.append(best[2])
    builds = spark.createDataFrame([("r", k, i) for k, ids in enumerate([*prior, (0, 10, 20)]) for i in ids], "request_id string, build_id int, product_id long")
    errors = {r.build_id: r.errors for r in optimizer.build_errors(builds, df, cats, limits, links).collect()}
    assert [errors[i] for i in range(3)] == [[], [], []] and "needs_one_d" in errors[3] and "forbidden_pair" in errors[3]
    none = optimizer.choose(df, cats, limits._replace(budget_cents=10), names, links)
    assert none.count() == 0


def test_compatibility_of_radiators_and_bios(spark):
    rows = [(1, "aio", 240.0, "top", 27.0, {"Top": [240.0]}, {"top": 30.0}), (2, "AIO", 360.0, "top", 27.0, {"Top": [240.0]}, None), (3, "aio", 240.0, None, 40.0, {"top": [240.0], "front": [240.0]}, {"top": 30.0, "front": 45.0}), (4, "aio", 240.0, "side", None, None, None)]
    df = spark.createDataFrame(rows, "build_id long, cooler_kind string, radiator_mm double, radiator_position string, radiator_thickness double, case_radiators_at map<string,array<double>>, case_thickness_at map<string,double>")
    assert {r.build_id: r.status for r in compat.check(df, ["cooler_case.clearance"]).collect()} == {1: "pass", 2: "fail", 3: "pass", 4: "unknown"}
    rows = [(1, "Zen 4", "B650", ["zen4"], "F9", {"zen4": "F10"}, True), (2, "Zen 4", "B650", ["zen4"], "F9", {"zen4": "F10"}, False), (3, "Zen 4", "B650", ["zen3"], None, None, None), (4, "Zen 4", "B650", None, None, None, None), (5, "Zen 4", "B650", ["zen4"], None, {"zen4": "F10"}, True), (6, "Zen 4", "B650", ["zen4"], "F10a", {"zen4": "F10"}, None)]
    df = spark.createDataFrame(rows, "build_id long, cpu_generation string, board_chipset string, board_generations array<string>, board_bios string, board_minimum_bios map<string,string>, board_update_available boolean")
    assert {r.build_id: r.status for r in compat.check(df, ["cpu_board.chipset_bios"]).collect()} == {1: "warning", 2: "fail", 3: "fail", 4: "unknown", 5: "unknown", 6: "pass"}


def test_ranking_features_without_signals(spark):
    rows = [("q", 1, 100.0, 87.0, None, "RTX 4070", ["rtx", "4070", "gpu"], "acme", ["ACME"], 8.0, None), ("q", 2, None, 0.5, 50.0, "RTX 4070 Ti", ["rtx", "4070", "gpu"], "zed", ["ACME"], 8.0, 16.0)]
    df = spark.createDataFrame(rows, "query_id string, product_id long, price double, review_score double, exact_model_match double, model string, query_terms array<string>, brand string, preferred_brands array<string>, vram_gb double, minimum_vram_gb double")
    got = {r.product_id: r for r in ranking.features(df).collect()}
    assert (got[1].review_score, got[1].exact_model_match, got[1].preference_match_score, got[1].gpu_memory_fit) == (0.87, 1.0, 1.0, 0.0)
    assert (got[2].review_score, got[2].exact_model_match, got[2].preference_match_score, got[2].gpu_memory_fit, got[2].price_percentile) == (0.5, 0.5, 0.0, 0.5, 1.0)


def test_bm25_fills_up_and_keeps_order(spark):
    docs = spark.createDataFrame([(i, "c", t) for i, t in enumerate(["alpha beta", "beta", "gamma ＲＴＸ", "", "alpha alpha", None])], "id long, category string, text string")
    asked = spark.createDataFrame([("q", "alpha rtx"), ("none", "zzz")], "query_id string, text string")
    every = {(r.query_id, r.id): (r["rank"], round(r.score, 6)) for r in retrieval.bm25(docs, asked).collect()}
    for k in (1, 3, 5):
        got = {(r.query_id, r.id): (r["rank"], round(r.score, 6)) for r in retrieval.bm25(docs, asked, k).collect()}
        assert got == {x: v for x, v in every.items() if v[0] <= k}
    assert every["q", 2][1] > 0 and every["none", 0] == (1, 0.0) and len(every) == 12
    only = spark.createDataFrame([("q", 4), ("q", 3), ("none", 5)], "query_id string, id long")
    assert {(r.query_id, r.id, r["rank"]) for r in retrieval.bm25(docs, asked, 2, only).collect()} == {("q", 4, 1), ("q", 3, 2), ("none", 5, 1)}


def test_grouped_bootstrap_depends_on_the_data_only(spark):
    rows = [(i // 3, float(i % 7)) for i in range(60)]
    mean = lambda d: float(d["x"].mean())
    a, b = (metrics.grouped_bootstrap(spark.createDataFrame(r, "g long, x double").repartition(n), "g", mean, ["x"], resamples=64).first() for r, n in ((rows, 1), (rows[::-1], 5)))
    assert tuple(a) == tuple(b) and a.low < sum(x for _, x in rows) / 60 < a.high and a.groups == 20


def test_component_split_never_parts_a_positive_pair(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.randrange(40), int(rng.random() < 0.3)) for _ in range(120)]
    got = sampling.component_split(spark.createDataFrame(rows, "left_id long, right_id long, label int"), 3).collect()
    assert all(r.split is not None for r in got if r.label == 1) and any(r.split is None for r in got)
    seen = {}
    for r in got:
        if r.split is not None:
            assert seen.setdefault(("l", r.left_id), r.split) == r.split and seen.setdefault(("r", r.right_id), r.split) == r.split


def test_gates(spark):
    df = spark.createDataFrame([(1, 0.9, 5.0, True), (2, None, 30.0, False)], "id long, r2 double, mape double, reportable boolean")
    out = performance.gate(df, [("r2", "least", 0.8), ("mape", "most", 10.0)])
    assert {r.id: list(r.blockers) for r in out.collect()} == {1: [], 2: ["r2", "mape"]}


def test_filters_of_a_request(spark):
    requests = spark.createDataFrame([("q", 100.0, ["Zed"], True, 8)], "query_id string, budget double, excluded_brands array<string>, in_stock_only boolean, minimum_gpu_vram_gb int")
    rows = [(1, "gpu", "Acme", 90.0, "in_stock", {"vram_gb": "8"}), (2, "gpu", "Acme", 90.0, "in_stock", None), (3, "gpu", "zed", 90.0, "in_stock", {"vram_gb": "16"}), (4, "cpu", "Acme", 101.0, "in_stock", None), (5, "cpu", "Acme", 100.0, None, None), (6, "cpu", "Acme", 9.0, "limited_stock", None)]
    products = spark.createDataFrame(rows, "id long, category string, brand string, price double, stock string, attributes map<string,string>")
    assert {r.id for r in candidates.allowed(requests, products).collect()} == {1, 6}
    locked = spark.createDataFrame([("q", "cpu", 4)], "query_id string, category string, product_id long")
    assert {r.id for r in candidates.allowed(requests, products, locked).collect()} == {1, 4}


def test_archives_arrays_and_publishing(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b/2.json", '{"x": 2}')
        z.writestr("b/1.json", '{"x": 1}')
        z.writestr("c.txt", "no")
    assert [(r.member, r.text) for r in files.zip_members(spark, str(tmp_path / "a.zip")).orderBy("member").collect()] == [("b/1.json", '{"x": 1}'), ("b/2.json", '{"x": 2}')]
    with pytest.raises(Exception, match="too large"):
        files.zip_members(spark, str(tmp_path / "a.zip"), limit=3).collect()
    (tmp_path / "r.json").write_text('[{"ID": "a"},\n {"ID": "b"}]')
    assert [(r.place, r.value) for r in files.read_json_array(spark, str(tmp_path / "r.json")).collect()] == [(0, '{"ID":"a"}'), (1, '{"ID":"b"}')]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    made = files.publish(rows, rows.where("id > 5"), str(tmp_path / "run"), ["id"])
    again = files.publish(rows.repartition(2), rows.where("id > 5"), str(tmp_path / "run2"), ["id"])
    key = lambda d: sorted((r.kind, r.n, r.bytes, r.digest) for r in d.collect())
    assert key(made) == key(again) and [(k, n) for k, n, *_ in key(made)] == [("records", 2), ("rejections", 0)]
    with pytest.raises(FileExistsError):
        files.publish(rows, rows, str(tmp_path / "run"), ["id"])
    found = files.file_inventory(spark, str(tmp_path / "r.json"))
    assert files.verify_inventory(found, found.select("path", "sha256")).count() == 0
    assert files.verify_inventory(found, found.select("path", F.lit("0").alias("sha256"))).first().state == "changed"
    files.write_parquet(rows, str(tmp_path / "p"), ["t"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
