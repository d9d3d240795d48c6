"""Bootstrap intervals against the standard library's generator, group by group."""

import random
from statistics import fmean

import numpy as np
import pytest

from tessera.operators import intervals as V


@pytest.mark.parametrize(("seed", "n"), [(0, 1), (7, 2), (20260722, 5), (2**40 + 3, 64), (-9, 100)])
def test_the_same_draws(seed, n):
    rng, held, bits = random.Random(seed), [], V.twister(seed)
    want = [rng.choice(range(n)) for _ in range(500)]
    assert [*V.choices(n, 123, bits, held), *V.choices(n, 377, bits, held)] == want


def quantile(values, q):
    values = sorted(values)
    at = (len(values) - 1) * q
    lo = int(at)
    return values[lo] * (1 - (at - lo)) + values[min(lo + 1, len(values) - 1)] * (at - lo)


def plain(units, statistic, resamples, seed, confidence=0.95):
    rng, out = random.Random(seed), []
    for _ in range(resamples):
        picked = [rng.choice(units) for _ in units]
        out.append(statistic(picked))
    return quantile(out, (1 - confidence) / 2), quantile(out, 1 - (1 - confidence) / 2)


def test_intervals_of_every_statistic(spark):
    rng = random.Random(3)
    rows = [(s, g, i, rng.uniform(1, 9), rng.uniform(1, 9)) for s in ("a", "b") for i, g in enumerate(rng.randrange(12) for _ in range(60))]
    df = spark.createDataFrame(rows, "side string, g int, i int, y double, p double").repartition(5)
    sq = lambda x: x * x

    def r2(picked):
        ys = [r[3] for u in picked for r in u]
        return 1 - sum(sq(r[4] - r[3]) for u in picked for r in u) / sum(sq(y - fmean(ys)) for y in ys)

    cases = [
        (V.mean("y"), lambda p: fmean(r[3] for u in p for r in u)), (V.absolute_error("y", "p"), lambda p: fmean(abs(r[4] - r[3]) for u in p for r in u)), (V.percentage_error("y", "p"), lambda p: fmean(abs(r[4] - r[3]) / r[3] for u in p for r in u)),
        (V.determination("y", "p"), r2), (V.pooled_ratio("p", "y"), lambda p: sum(r[4] for u in p for r in u) / sum(r[3] for u in p for r in u)), (V.macro_ratio("p", "y"), lambda p: fmean(sum(r[4] for r in u) / sum(r[3] for r in u) for u in p)),
    ]
    for statistic, value in cases:
        got = {r.side: r for r in V.interval(df, statistic, "g", "i", ["side"], resamples=200, seed=11, confidence=0.9).collect()}
        for side in "ab":
            units = {}
            for r in rows:
                if r[0] == side:
                    units.setdefault(r[1], []).append(r)
            low, high = plain(list(units.values()), value, 200, 11, 0.9)
            r = got[side]
            assert (r.low, r.high, r.value) == (pytest.approx(low), pytest.approx(high), pytest.approx(value(list(units.values())))) and r.groups == len(units)


def test_odd_frames(spark, monkeypatch):
    df = spark.createDataFrame([(None, 1.0), (1, None), (2, 3.0)], "g int, y double")
    r = V.interval(df, V.mean("y"), "g", resamples=50).first()
    assert r.value == 2.0 and r.groups == 3 and 1 <= r.low <= r.high <= 3
    none = V.interval(df.where("y is null"), V.mean("y"), "g", resamples=50).first()
    assert none.low is None and none.high is None and none.groups == 1
    assert V.interval(df.limit(0), V.mean("y"), "g").count() == 0
    gate = lambda *a: V.claim_gate(V.interval(df, V.mean("y"), "g", resamples=50), *a).first().blockers
    assert gate(3, 1.0, 0.5) == [] and gate(4, 2.5, 2.9) == ["too_few_groups", "value_too_low", "interval_too_low"]
    assert "no_interval" in V.claim_gate(V.interval(df.where("y is null"), V.mean("y"), "g", resamples=50), 1, 0, 0).first().blockers
    with pytest.raises(ValueError):
        V.interval(df, V.mean("y"), "g", resamples=1)


def test_draws_in_parts_are_the_same(monkeypatch):
    sums = {"s": np.arange(37.0), "n": np.ones(37)}
    whole = V.resampled(sums, lambda t: t["s"] / t["n"], 90, 5)
    monkeypatch.setattr(V, "AT_ONCE", 100)
    assert (V.resampled(sums, lambda t: t["s"] / t["n"], 90, 5) == whole).all()


def test_groups_beyond_one_task(spark, monkeypatch):
    df = spark.range(700).selectExpr("if(id % 7 = 0, null, id % 2) as side", "id div 2 as g", "id as i", "double(id % 13) as y", "1.0D as p")
    cases = [(V.mean("y"), ["side"]), (V.pooled_ratio("y", "p"), []), (V.determination("y", "p"), ["side"])]
    want = [V.interval(df, s, "g", "i", by, resamples=40).collect() for s, by in cases]
    monkeypatch.setattr(V, "UNITS", 64)
    monkeypatch.setattr(V, "AT_ONCE", 100)
    for (s, by), rows in zip(cases, want):
        got = V.interval(df, s, "g", "i", by, resamples=40)
        key = lambda r: str(r[0])
        for a, b in zip(sorted(got.collect(), key=key), sorted(rows, key=key), strict=True):
            assert a[: len(by)] == b[: len(by)] and a.groups == b.groups > 64 and a[len(by) : -1] == pytest.approx(b[len(by) : -1])
