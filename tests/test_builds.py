"""Build choice against enumeration of every combination of small pools."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import optimizer as O

KINDS = ["psu", "cpu", "board", "gpu"]
POOL = "request_id int, category string, product_id int, price_cents long, power_watts int, psu_watts int, warning_penalty double, performance double, value double, reliability double, upgradeability double, efficiency double, preference double"


def worth(r, profile):
    p = O.PROFILES[profile]
    out = round(sum(w * s for w, s in zip(p.weights, r[7:], strict=True)) * 100)
    return out - (r[3] // p.price_divisor if p.price_divisor else 0) - (r[4] or 0) * p.per_watt


def plain(rows, pairs, locked, limits, profiles, differ):
    out = []
    for q in sorted({r[0] for r in rows}):
        pools = [[r for r in rows if r[:2] == (q, c) and (q, c) not in {x[:2] for x in locked}] + [r for r in rows if r[:2] == (q, c) and r[:3] in locked] for c in KINDS]
        free = [i for i, c in enumerate(KINDS) if (q, c) not in {x[:2] for x in locked}]
        links = {}
        for _, a, b, penalty in (p for p in pairs if p[0] == q):
            links.setdefault(frozenset((a, b)), []).append(penalty)
        chosen = []
        for place, profile in enumerate(profiles, 1):
            best = None
            for build in itertools.product(*pools):
                ids = tuple(r[2] for r in build)
                met = [links[frozenset(p)] for p in itertools.combinations(ids, 2) if frozenset(p) in links]
                load = limits.base_watts + sum(r[4] or 0 for r in build if r[1] != limits.supply)
                price = sum(r[3] for r in build)
                if any(None in m for m in met) or price > limits.budget_cents or load * (100 + limits.headroom_percent) > 100 * build[0][5]:
                    continue
                if any(sum(ids[i] != c[5][i] for i in free) < differ for c in chosen):
                    continue
                key = (-(sum(worth(r, profile) for r in build) - sum(max(m) for m in met)), price, ids, load)
                best = min(best, key) if best else key
            if best is None:
                break
            chosen.append((q, profile, place, -best[0], best[1], best[2], best[3]))
        out += chosen
    return out


def pools(seed, requests=4, n=6):
    rng, rows = random.Random(seed), []
    for q in range(requests):
        for k, c in enumerate(KINDS):
            for i in range(n if (q, c) != (3, "gpu") or seed % 2 else 0):
                rows.append((q, c, 100 * k + i, rng.randrange(5, 40) * 500, rng.randrange(20, 200), 300 + 100 * rng.randrange(4), None, *[float(rng.randrange(0, 40)) for _ in range(6)]))
    pairs = [(q, rng.randrange(100, 100 + n), rng.randrange(200, 200 + n), rng.choice([None, 3000, 20_000])) for q in range(requests) for _ in range(8)]
    return rows, pairs + pairs[:3] + [(q, b, a, p) for q, a, b, p in pairs[3:5]]


@pytest.mark.parametrize(("seed", "budget"), [(1, 45_000), (2, 25_000), (3, 200_000)])
def test_same_builds_as_enumeration(spark, seed, budget):
    rows, pairs = pools(seed)
    limits, profiles = O.Limits(budget, base_watts=40, headroom_percent=25, supply="psu"), ["best_value", "highest_performance", "lowest_power"]
    locked = [(1, "gpu", 302), (2, "psu", 1)] if seed == 1 else []
    df, links = spark.createDataFrame(rows, POOL), spark.createDataFrame(pairs, "request_id int, left_id int, right_id int, penalty long")
    lock = spark.createDataFrame(locked, "request_id int, category string, product_id int") if locked else None
    got = O.choose(df.union(df.limit(3)), KINDS, limits, profiles, links, lock).collect()
    want = plain(rows, pairs, locked, limits, profiles, 2)
    assert sorted((r.request_id, r.profile, r.place, r.objective, r.price_cents, tuple(r.ids), r.load_watts) for r in got) == sorted(want)
    assert all(r.proved for r in got)


def test_ties_limits_and_empty_pools(spark):
    rows = [(1, c, 10 * k + i, 100, 0, 0, None, *[1.0] * 6) for k, c in enumerate(KINDS) for i in range(4)]
    df = spark.createDataFrame(rows, POOL)
    r = O.choose(df, KINDS, O.Limits(1000), ["best_overall"]).collect()
    assert [tuple(x.ids) for x in r] == [(0, 10, 20, 30)] and r[0].proved
    r = O.choose(df, KINDS, O.Limits(1000), ["best_overall"], most=2).collect()
    assert len(r) == 1 and r[0].objective == 4 * 10_000 and not r[0].proved
    assert O.choose(df, KINDS, O.Limits(399), ["best_overall"]).count() == 0
    assert O.choose(df.where(F.col("category") != "gpu"), KINDS, O.Limits(1000), ["best_overall"]).count() == 0
    assert O.choose(df.limit(0), KINDS, O.Limits(1000), ["best_overall"]).count() == 0


def test_parts_that_others_beat_are_left_out_before_the_search(spark, monkeypatch):
    monkeypatch.setattr(O, "BEAM", 3)
    rows, _ = pools(4, requests=1, n=9)
    rows = [(*r[:4], 20 * (r[4] // 60), 300, None, *r[7:]) for r in rows]
    df, limits, profiles = spark.createDataFrame(rows, POOL).withColumn("half", F.concat_ws(":", "category", F.col("product_id") % 2)), O.Limits(55_000, base_watts=40, supply="psu"), ["best_value", "highest_performance"]
    classes = spark.createDataFrame([(0, "cpu:0", "board:1", None), (0, "board:0", "gpu:1", 3000)], "request_id int, left_id string, right_id string, penalty long")
    each = [(0, a, b, p) for c, d, p in ((1, 2, None), (2, 3, 3000)) for a in range(100 * c, 100 * c + 9) for b in range(100 * d, 100 * d + 9) if a % 2 == 0 and b % 2 == 1]
    got = O.choose(df, KINDS, limits, profiles, classes, member="half").collect()
    assert sorted((r.request_id, r.profile, r.place, r.objective, r.price_cents, tuple(r.ids), r.load_watts) for r in got) == sorted(plain(rows, each, [], limits, profiles, 2)) and all(r.proved for r in got)
    offers = df.selectExpr("request_id", "category", "product_id", "half as member", "price_cents as price", "power_watts as load", "psu_watts as supply", "bigint(value) as coef", "map(half, 1L) as links")
    assert O._undominated(offers, 1).count() < O._undominated(offers, 2).count() < len(rows) == O._undominated(offers, 9).count()
