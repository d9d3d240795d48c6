"""Queries that have to read all of their tables, and steps that may leave nothing out."""

import random

from tests.test_builds import KINDS, POOL, plain, pools

from tessera.operators import entity as E
from tessera.operators import optimizer as O
from tessera.plans import ingestion as I


def test_every_family_of_the_table_is_joined(spark, tmp_path):
    spark.range(5_000, 5_016).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(5_000, 5_016).selectExpr("id as l_orderkey", "1 as l_linenumber", "id as l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: r.products for r in I.join_hardware_families(spark, str(tmp_path)).collect()}
    # Radeon VII has no number, so all its products are one family; names without a family meet nothing
    assert got == {k: 2 if k % 8 == 5 else 1 for k in range(5_000, 5_016) if k % 8 in (1, 2, 3, 5, 6)}


def test_no_partial_build_is_cut(spark, monkeypatch):
    rows, pairs = pools(7, requests=2, n=5)
    limits, profiles = O.Limits(60_000, base_watts=40, headroom_percent=25, supply="psu"), ["best_value", "lowest_power"]
    for name in ("BEAM", "MOST"):
        monkeypatch.setattr(O, name, 1, raising=False)
    monkeypatch.setattr(O.choose, "__defaults__", tuple(1 if d == 50_000 else d for d in O.choose.__defaults__))  # what the cap was
    got = O.choose(spark.createDataFrame(rows, POOL), KINDS, limits, profiles, spark.createDataFrame(pairs, "request_id int, left_id int, right_id int, penalty long")).collect()
    assert sorted((r.request_id, r.profile, r.place, r.objective, r.price_cents, tuple(r.ids), r.load_watts) for r in got) == sorted(plain(rows, pairs, [], limits, profiles, 2))
    assert all(r.proved for r in got)


RECORD = "id long, category string, brand string, mpn string, gtin string, title string, price double, attributes map<string,string>"


def records(seed, first, n):
    """Few brands, names, sizes, colours and identifiers, so that listings meet many products of all kinds."""
    draw, out = random.Random(seed), []
    for i in range(first, first + n):
        size = draw.choice(["", "16 GB", "2x8 GB", "16.00001 GB", "16.0004 GB", "32 GB"])
        title = f"{draw.choice(['fury', 'dash', 'RTX4070', 'rtx 4070', 'ram'])} {size} {draw.choice(['', '', 'black', 'white', 'black white'])}"
        known = {"colour": c for c in [draw.choice(["black", "white", "Black/White", ""])] if c} | {"module_count": m for m in [draw.choice(["", "", "1", "2"])] if m}
        out.append((i, draw.choice(["RAM", "memory", "CPU"]), draw.choice(["Kx", "kx", "Lo", None]), draw.choice([None] * 5 + ["A-1", "b2"]), draw.choice([None] * 5 + ["77", "78"]), title, 1.0, known or None))
    return out


def test_leading_pairs_decide_as_all_pairs_do(spark):
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    long = " ".join(f"w{i}" for i in range(1001))
    odd = [(100, "CPU", "Kx", None, None, long, 1.0, None), (101, "CPU", "Lo", None, None, "nothing alike", 1.0, None), (102, "storage", "Kx", None, None, "disk 5 TB", 1.0, None)]
    even = [(900, "CPU", "Kx", None, None, long + " extra", 1.0, None), (901, "CPU", "Kx", None, None, "w7 other", 1.0, None), (902, "storage", "Kx", None, None, "disk 6 TB", 1.0, None)]
    sides = spark.createDataFrame(records(1, 0, 90) + odd, RECORD).checkpoint(), spark.createDataFrame(records(2, 500, 60) + even, RECORD).checkpoint()
    got = {}
    for f in (E.block_pairs, E.leading_pairs):
        pairs, kept = f(*sides).checkpoint(), f(*sides, keep_conflicts=True).checkpoint()
        outcomes = E.listing_outcomes(pairs.withColumns({"score": E.exact_baseline(pairs), "conflict": E.hard_conflict(pairs)}))
        scored = kept.select("l_id", "p_id", E.exact_baseline(kept).alias("score"), E.hard_conflict(kept).alias("conflict"))
        got[f.__name__] = sorted(outcomes.collect()), sorted(map(str, E.matched(*sides, scored, authorized=True).collect())), {(r.l_id, r.p_id) for r in kept.collect()}
    whole, leading = got["block_pairs"], got["leading_pairs"]
    assert leading[:2] == whole[:2] and leading[2] < whole[2]
    assert {r.outcome for r in leading[0]} >= {"auto", "ambiguous", "reject"} and (100, 900) in leading[2]
    asked = spark.createDataFrame([(r[0], p) for r in records(1, 0, 90) + odd for p in (500, 511, 900, 902)], "l_id long, p_id long")
    assert {(r.l_id, r.p_id) for r in E.blocked_among(*sides, asked).collect()} == {(x, p) for x, p in whole[2] if p in (500, 511, 900, 902)}


def test_alike_listings_and_products_make_few_pairs(spark):
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rows = spark.range(3_000).selectExpr("id", "'CPU' as category", "'kx' as brand", "'' as mpn", "'' as gtin", "concat('chip k', id) as title", "1.0D as price")
    assert E.leading_pairs(rows, rows).count() <= 4 * 3_000  # all pairs are nine millions
