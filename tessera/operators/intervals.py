"""Percentile-bootstrap intervals as published: whole groups drawn in the order of a Mersenne twister."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups whose sums one task holds, draws that are made at once, and the published defaults.
UNITS, AT_ONCE = 1 << 21, 1 << 22
RESAMPLES, CONFIDENCE, SEED = 1000, 0.95, 20260722

Sums = dict[str, np.ndarray]


class Statistic(NamedTuple):
    """What a group adds up, and the value of all groups drawn from the sums over them."""

    sums: dict[str, Column]
    value: Callable[[Sums], np.ndarray]


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def mean(value: str) -> Statistic:
    return Statistic({"s": F.sum(value), "n": F.count(value)}, lambda t: _over(t["s"], t["n"]))


def absolute_error(actual: str, predicted: str) -> Statistic:
    return Statistic({"s": F.sum(F.abs(F.col(predicted) - F.col(actual))), "n": F.count("*")}, lambda t: _over(t["s"], t["n"]))


def percentage_error(actual: str, predicted: str) -> Statistic:
    """Mean absolute error over the actual value, for groups without a zero one."""
    return Statistic({"s": F.sum(F.try_divide(F.abs(F.col(predicted) - F.col(actual)), F.abs(actual))), "n": F.count("*")}, lambda t: _over(t["s"], t["n"]))


def determination(actual: str, predicted: str) -> Statistic:
    """One less the squared error over the squared distance from the mean of the rows drawn."""
    y = F.col(actual).cast("double")
    sums = {"e": F.sum(F.pow(F.col(predicted) - y, F.lit(2))), "y": F.sum(y), "yy": F.sum(y * y), "n": F.count("*")}
    return Statistic(sums, lambda t: 1 - _over(t["e"], t["yy"] - _over(t["y"] * t["y"], t["n"])))


def pooled_ratio(part: str, whole: str) -> Statistic:
    """Sum over sum: large groups weigh more."""
    return Statistic({"a": F.sum(part), "b": F.sum(whole)}, lambda t: _over(t["a"], t["b"]))


def macro_ratio(part: str, whole: str) -> Statistic:
    """Mean of the groups' own ratios: every group weighs the same; a group without a whole doesn't count."""
    own = F.try_divide(F.sum(part).cast("double"), F.sum(whole))
    return Statistic({"a": F.coalesce(own, F.lit(0.0)), "n": F.when(own.isNotNull(), 1).otherwise(0)}, lambda t: _over(t["a"], t["n"]))


def twister(seed: int) -> np.random.MT19937:
    """The generator in the state that an integer seed gives it in the standard library."""
    *key, at = random.Random(seed).getstate()[1]
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": at}}
    return bits


def choices(n: int, count: int, bits: np.random.MT19937, held: list[np.ndarray]) -> np.ndarray:
    """The next ``count`` indices below ``n``: the upper bits of each word, drawn again if they are too large.

    ``held`` keeps the words that were drawn too many for the next call.
    """
    shift, out, have = np.uint64(32 - n.bit_length()), [held.pop()] if held else [], 0
    have = sum(map(len, out))
    while have < count:
        words = bits.random_raw(int((count - have) * (1 << n.bit_length()) / n) + 64) >> shift
        out.append(words[words < n].astype(np.int64))
        have += len(out[-1])
    all_ = np.concatenate(out) if out else np.zeros(0, np.int64)
    held.append(all_[count:])
    return all_[:count]


def drawn(sums: Sums, n: int, begin: int, resamples: int, seed: int) -> Sums:
    """What the groups from place ``begin`` on add to each resample of ``n`` groups, with replacement.

    All ``n`` are drawn, so that whoever holds other groups draws the same.
    """
    bits, held, size = twister(seed), [], len(next(iter(sums.values())))
    out, padded = {c: np.zeros(resamples) for c in sums}, {c: np.append(v, 0.0) for c, v in sums.items()}
    step, stretch = max(1, AT_ONCE // n), min(n, AT_ONCE)
    for i in range(0, resamples, step):
        many = min(step, resamples - i)
        for at in range(0, n, stretch):
            pick = choices(n, many * min(stretch, n - at), bits, held).reshape(many, -1)
            if size < n:
                pick -= begin
                pick[(pick < 0) | (pick > size)] = size
            for c, v in padded.items():
                out[c][i : i + many] += v[pick].sum(1)
    return out


def resampled(sums: Sums, value: Callable[[Sums], np.ndarray], resamples: int, seed: int) -> np.ndarray:
    """The statistic of each resample of as many groups as there are, with replacement."""
    return value(drawn(sums, len(next(iter(sums.values()))), 0, resamples, seed))


def placed(units: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``units`` with their ``place`` within ``by``, from 0 in ``order``, and the number of ``groups`` there.

    A place is the size of the sorted ranges before its own plus that in it, so no ``by`` meets in one task.
    """
    dealt = units.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()).checkpoint()
    of = Window.partitionBy(*by)
    before = F.coalesce(F.sum("size").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy(*by, "part").agg(F.count("*").alias("size")).withColumns({"before": before, "groups": F.sum("size").over(of)})
    sizes = sizes.select(*[F.col(c).alias(f"of_{c}") for c in (*by, "part")], "before", "groups")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*by, "part")])
    within = F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order))
    return dealt.withColumn("within", within).join(sizes, same).select(*units.columns, (F.col("before") + F.col("within") - 1).alias("place"), "groups")


def interval(rows: DataFrame, statistic: Statistic, group: str, order: str | None = None, by: Sequence[str] = (), resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """``(by..., value, low, high, groups)``: percentile interval of a statistic, whole groups drawn with replacement.

    Groups count in the order of their least ``order`` (the group itself, if none is given), which with the seed
    fixes every draw.  Rows are added up by group where they are; a task holds the sums of UNITS groups at most, and
    what each resample draws of them is added up over the tasks.  Resamples without a finite value are left out, and
    fewer than two finite ones give nulls; percentiles are interpolated.
    """
    if resamples < 2 or not 0 < confidence < 1:
        raise ValueError("at least two resamples and a confidence between 0 and 1 are needed")
    names, value, held = list(statistic.sums), statistic.value, UNITS
    kinds = dict(rows.dtypes)
    first = F.min(order or group).alias("first")
    units = rows.groupBy(*by, group).agg(first, *[statistic.sums[c].cast("double").alias(f"sum_{c}") for c in names])
    keys = [f"`{c}` {kinds[c]}" for c in by]
    tail = (1 - confidence) / 2

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        sums = {c: pdf[f"sum_{c}"].fillna(0.0).to_numpy(float) for c in names}
        found = drawn(sums, int(pdf["groups"].iloc[0]), int(pdf["place"].iloc[0]), resamples, seed)
        # the whole comes before the resamples
        out = pd.DataFrame({f"sum_{c}": np.append(sums[c].sum(), found[c]) for c in names})
        return out.assign(**{c: pdf[c].iloc[0] for c in (*by, "block", "groups")}, resample=np.arange(resamples + 1))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "resample"])
        all_ = {c: pdf[f"sum_{c}"].to_numpy().reshape(-1, resamples + 1).sum(0) for c in names}
        whole, *_ = value({c: v[:1] for c, v in all_.items()})
        found = value({c: v[1:] for c, v in all_.items()})
        found = found[np.isfinite(found)]
        low, high = np.quantile(found, [tail, 1 - tail]) if len(found) > 1 else (None, None)
        return pd.DataFrame([(*(pdf[c].iloc[0] for c in by), float(whole), low, high, pdf["groups"].iloc[0])], columns=[*by, "value", "low", "high", "groups"])

    blocks = placed(units, by, ["first", group]).select(*by, "groups", "place", F.floor(F.col("place") / held).cast("long").alias("block"), *[f"sum_{c}" for c in names])
    parts = blocks.groupBy(*by, "block").applyInPandas(draw, ", ".join([*keys, "block long, groups long, resample int", *(f"sum_{c} double" for c in names)]))
    return parts.groupBy(*by).applyInPandas(finish, ", ".join([*keys, "value double, low double, high double, groups long"]))


def claim_gate(intervals: DataFrame, least_groups: int, floor: float, least_low: float) -> DataFrame:
    """``intervals`` with ``blockers``: too few groups, no interval, a value below ``floor``, or a low end below ``least_low``."""
    from tessera.operators.filters import reasons

    rules = [(F.col("groups") >= least_groups, "too_few_groups"), (F.col("low").isNotNull(), "no_interval"), (F.col("value") >= floor, "value_too_low"), (F.col("low").isNull() | (F.col("low") >= least_low), "interval_too_low")]
    return intervals.withColumn("blockers", reasons(rules))
