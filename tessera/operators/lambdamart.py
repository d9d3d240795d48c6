"""LambdaMART: boosted trees on the gradients of pair swaps within a query, grown from histograms that Spark sums.

A query's candidates are one row of arrays (a pool is bounded, as candidate limits bound it), so a pass over the
queries gives all gradients, and a tree level is one aggregation of counts by leaf, feature and bin.  Only those
sums reach the driver: leaves x features x bins of them, however many rows there are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed-point unit of gradients: integer sums don't depend on how rows are dealt out.
UNIT = float(1 << 24)


class Settings(NamedTuple):
    """Trees, shrinkage, leaves and levels of a tree, least rows and curvature of a leaf, penalty on leaf values, share
    of features a tree sees, bins of a feature, rank up to which a pair counts, rounds without gain before the fit
    stops, seed, and candidates that one query may have."""

    trees: int = 200
    rate: float = 0.05
    leaves: int = 31
    levels: int = 6
    least_rows: int = 5
    least_curvature: float = 1e-3
    penalty: float = 0.5
    features: float = 0.9
    bins: int = 63
    cutoff: int = 30
    patience: int = 30
    seed: int = 20260722
    pool: int = 10_000


class Tree(NamedTuple):
    """Nodes: the feature whose bin decides (-1: a leaf), the last bin that goes left, the children, the leaf's value."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (self.feature[at] >= 0).any():
            f = self.feature[at]
            down = np.where(bins[rows, np.maximum(f, 0)] > self.bin[at], self.right[at], self.left[at])
            at = np.where(f >= 0, down, at)
        return at


class Model(NamedTuple):
    """Feature names, the upper edges of their bins, and trees, whose values are summed; ndcg of each round."""

    names: tuple[str, ...]
    edges: list[np.ndarray]
    trees: list[Tree]
    history: list[float]

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of feature rows; a missing value counts as the least."""
        x = np.where(np.isnan(x), -np.inf, x)
        return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.binned(x), np.zeros(len(x))
        for t in self.trees:
            out += t.value[t.leaf(bins)]
        return out

    def to_json(self) -> str:
        """The model with the digest of its contents, for a file that ``from_json`` reads."""
        body = {"names": list(self.names), "edges": [e.tolist() for e in self.edges], "trees": [[c.tolist() for c in t] for t in self.trees], "history": self.history}
        text = json.dumps(body, sort_keys=True)
        return json.dumps({"model": text, "sha256": hashlib.sha256(text.encode()).hexdigest()})

    @classmethod
    def from_json(cls, text: str) -> Model:
        """A model that ``to_json`` wrote; ValueError if its contents don't have the digest that stands beside them."""
        found = json.loads(text)
        if hashlib.sha256(found["model"].encode()).hexdigest() != found["sha256"]:
            raise ValueError("the model isn't the one that was written")
        body = json.loads(found["model"])
        return cls(tuple(body["names"]), [np.array(e) for e in body["edges"]], [Tree(*(np.array(c) for c in t)) for t in body["trees"]], body["history"])


def _discounts(n: int) -> np.ndarray:
    return 1 / np.log2(2 + np.arange(n))


def ideal(grades: np.ndarray, cutoff: int) -> float:
    """Discounted gain of the best order up to ``cutoff``."""
    best = np.sort(2.0**grades - 1)[::-1][:cutoff]
    return float(best @ _discounts(len(best)))


def ndcg(score: np.ndarray, grades: np.ndarray, at: int = 10) -> float:
    """Gain of the order by score (ties in row order) against the best; nan without a relevant row."""
    most = ideal(grades, at)
    top = (2.0 ** grades[np.argsort(-score, kind="stable")] - 1)[:at]
    return float(top @ _discounts(len(top))) / most if most > 0 else float("nan")


def gradients(score: np.ndarray, grades: np.ndarray, cutoff: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of each row of one query.

    Every pair of different grades of which one is among the ``cutoff`` best pulls its rows apart, the more the
    likelier the worse row is ahead and the more NDCG their swap would change; a query's pulls are scaled down by
    the logarithm of their sum, so that no query drowns the others.
    """
    order = np.argsort(-score, kind="stable")
    s, g, n = score[order], grades[order], len(score)
    slope, curve, most = np.zeros(n), np.zeros(n), ideal(grades, cutoff)
    top = min(cutoff, n)
    if most <= 0 or top == 0:
        return slope, curve
    gain, discount = 2.0**g - 1, _discounts(n)
    ahead = s[:top, None] - s[None, :]
    side = np.sign(g[:top, None] - g[None, :]) * (np.arange(n)[None, :] > np.arange(top)[:, None])
    change = np.abs(gain[:top, None] - gain[None, :]) * np.abs(discount[:top, None] - discount[None, :]) / most
    if s[0] != s[-1]:
        change /= 0.01 + np.abs(ahead)
    wrong = 1 / (1 + np.exp(np.clip(side * ahead, -50, 50)))
    pull, bend = side * wrong * change, np.abs(side) * wrong * (1 - wrong) * change
    total = 2 * np.abs(pull).sum()
    scale = np.log2(1 + total) / total if total > 0 else 1.0
    both = np.zeros(n), np.zeros(n)
    for out, pairs, sign in ((both[0], pull, -1), (both[1], bend, 1)):
        out[:top] += sign * pairs.sum(1)
        out += pairs.sum(0)
    slope[order], curve[order] = both[0] * scale, both[1] * scale
    return slope, curve


def _splits(g: np.ndarray, h: np.ndarray, n: np.ndarray, allowed: np.ndarray, s: Settings) -> tuple[float, int, int]:
    """Best gain of one leaf's histograms (features x bins), with its feature and the last bin that goes left."""
    worth = lambda g, h: g * g / (h + s.penalty)
    gl, hl, nl = (c.cumsum(1)[:, :-1] for c in (g, h, n))
    gt, ht, nt = g[0].sum(), h[0].sum(), n[0].sum()
    gain = worth(gl, hl) + worth(gt - gl, ht - hl) - worth(gt, ht)
    ok = (nl >= s.least_rows) & (nt - nl >= s.least_rows) & (hl >= s.least_curvature) & (ht - hl >= s.least_curvature) & allowed[:, None]
    gain = np.where(ok, gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def grow(histograms: Callable[[Tree, list[int]], np.ndarray], features: int, s: Settings, allowed: np.ndarray) -> Tree:
    """A tree level by level, the leaves of most gain first while there may be more of them.

    ``histograms(tree, leaves)`` gives sums of slope, curvature and rows by (3, leaf, feature, bin).
    """
    nodes = [[-1, 0, 0, 0, 0.0]]
    tree = lambda: Tree(*(np.array(c, t) for c, t in zip(zip(*nodes), (int, int, int, int, float))))
    open_, leaves = [0], 1
    for _ in range(s.levels + 1):
        found = histograms(tree(), open_)
        offers = []
        for i, node in enumerate(open_):
            g, h, n = found[:, i]
            nodes[node][4] = -s.rate * g[0].sum() / (h[0].sum() + s.penalty)
            offers.append((*_splits(g, h, n, allowed, s), node))
        open_ = []
        if _ == s.levels:
            break
        for gain, f, b, node in sorted(offers, key=lambda o: (-o[0], o[3])):
            if gain > 1e-9 and leaves < s.leaves:
                nodes[node][:4] = [f, b, len(nodes), len(nodes) + 1]
                open_ += [len(nodes), len(nodes) + 1]
                nodes += [[-1, 0, 0, 0, 0.0], [-1, 0, 0, 0, 0.0]]
                leaves += 1
        if not open_:
            break
    return tree()


STATE = "valid boolean, grades binary, bins binary, score binary, slope binary, curve binary, ndcg double"


def _blocks(rows: DataFrame, query: str, tie: str, grade: str, valid: str, model: Model, s: Settings) -> DataFrame:
    """A row for each query, its candidates in order of ``tie``; ValueError in a task if there are too many."""
    x = F.array(*[F.col(c).cast("double") for c in model.names])
    one = F.struct(F.col(tie).alias("tie"), F.col(grade).cast("int").alias("grade"), x.alias("x"))
    grouped = rows.groupBy(query).agg(F.bool_or(valid).alias("valid"), F.sort_array(F.collect_list(one)).alias("rows")).select("valid", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):
            out = []
            for valid, group in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = group.values
                if len(v) > s.pool:
                    raise ValueError(f"a query has {len(v)} candidates; {s.pool} is the most")
                grades = v.field("grade").to_numpy(zero_copy_only=False).astype(np.int32)
                wide = v.field("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(grades), -1)
                out.append({"valid": valid, "grades": grades.tobytes(), "bins": model.binned(wide).tobytes(), "score": np.zeros(len(grades)).tobytes(), "slope": b"", "curve": b"", "ndcg": float("nan")})
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return grouped.mapInArrow(run, STATE)


SCHEMA = pa.schema([("valid", pa.bool_()), *((c, pa.binary()) for c in ("grades", "bins", "score", "slope", "curve")), ("ndcg", pa.float64())])


def _stepped(state: DataFrame, tree: Tree | None, width: int, cutoff: int) -> DataFrame:
    """The state after one more tree: scores, their gradients (of queries to learn from) and each query's NDCG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.to_pylist()
            for r in out:
                score, grades = np.frombuffer(r["score"]).copy(), np.frombuffer(r["grades"], np.int32)
                if tree is not None:
                    score += tree.value[tree.leaf(np.frombuffer(r["bins"], np.uint8).reshape(-1, width))]
                slope, curve = gradients(score, grades, cutoff) if not r["valid"] else (np.zeros(0), np.zeros(0))
                r |= {"score": score.tobytes(), "slope": slope.tobytes(), "curve": curve.tobytes(), "ndcg": ndcg(score, grades)}
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return state.mapInArrow(run, STATE)


def _histograms(state: DataFrame, width: int, bins: int) -> Callable[[Tree, list[int]], np.ndarray]:
    def sums(tree: Tree, leaves: list[int]) -> np.ndarray:
        size = len(leaves) * width * bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, slot = np.zeros((3, size), np.int64), np.full(len(tree.feature), -1)
            slot[leaves] = np.arange(len(leaves))
            for batch in batches:
                x, g, h = (np.frombuffer(b"".join(batch.column(i).to_pylist()), t) for i, t in enumerate((np.uint8, np.float64, np.float64)))
                x = x.reshape(-1, width)
                own = slot[tree.leaf(x)]
                x, g, h, own = (c[own >= 0] for c in (x, g, h, own))
                at = ((own[:, None] * width + np.arange(width)) * bins + x).ravel()
                for i, c in enumerate((g, h)):
                    np.add.at(total[i], at, np.repeat(np.rint(c * UNIT).astype(np.int64), width))
                total[2] += np.bincount(at, minlength=size)
            some = np.flatnonzero(total[2])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (some, *total[:, some])], names=["at", "g", "h", "n"])

        learnt = state.where(~F.col("valid")).select("bins", "slope", "curve")
        found = learnt.mapInArrow(run, "at long, g long, h long, n long").groupBy("at").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
        out = np.zeros((3, size))
        out[:, found.column("at").to_numpy()] = [found.column("g").to_numpy() / UNIT, found.column("h").to_numpy() / UNIT, found.column("n").to_numpy()]
        return out.reshape(3, len(leaves), width, bins)

    return sums


def train(rows: DataFrame, names: Sequence[str], query: str = "query_id", tie: str = "product_id", grade: str = "grade", valid: str | None = None, settings: Settings = Settings(), keep: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> Model:
    """Learns to order the candidates of a query from their grades (0, 1, 2, ...).

    ``names`` are the feature columns, ``valid`` a boolean column that is one value throughout a query: queries where
    it is true aren't learnt from; their mean NDCG at 10 decides how many trees stay, and the fit ends after
    ``patience`` rounds without a better one.  ``keep`` stores the state of a round where executors share it.

    A null grade counts as 0 and a null query leaves its rows out; ValueError without two grades to tell apart, or
    if a query has more than ``pool`` candidates.
    """
    s, names = settings, tuple(names)
    flag = F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(False)
    own = rows.where(F.col(query).isNotNull()).select(F.col(query), F.col(tie), F.coalesce(F.col(grade).cast("int"), F.lit(0)).alias("grade"), flag.alias("valid"), *[F.col(c).cast("double").alias(c) for c in names])
    learnt = own.where(~F.col("valid"))
    low, high = learnt.agg(F.min("grade"), F.max("grade")).first()
    if low is None or low == high:
        raise ValueError("at least two grades are needed")
    at = [(i + 1) / (s.bins + 1) for i in range(s.bins)]
    edges = [np.unique(np.array(e)) for e in learnt.approxQuantile(list(names), at, 1 / (8 * s.bins))]
    model, width = Model(names, edges, [], []), len(names)
    bins = 1 + max([len(e) for e in edges])
    state = keep(_stepped(_blocks(own, query, tie, "grade", "valid", model, s), None, width, s.cutoff))
    rng, best = np.random.default_rng(s.seed), 0
    for i in range(s.trees):
        allowed = np.isin(np.arange(width), rng.choice(width, max(1, round(s.features * width)), replace=False))
        model.trees.append(grow(_histograms(state, width, bins), width, s, allowed))
        state = keep(_stepped(state, model.trees[-1], width, s.cutoff))
        judged = state.where("not isnan(ndcg)" + (" and valid" if valid else ""))
        model.history.append(round(judged.agg(F.avg("ndcg")).first()[0] or 0.0, 9))
        if model.history[i] > model.history[best]:
            best = i
        if valid and i - best >= s.patience:
            break
    return model._replace(trees=model.trees[: best + 1] if valid else model.trees)


def predict(rows: DataFrame, model: Model, query: str = "query_id", tie: str = "product_id") -> DataFrame:
    """``rows`` with ``score`` and ``rank`` within the query (highest score first, ties by id)."""
    from tessera.operators.windows import ranked

    kept = [c for c in rows.columns if c.lower() not in ("score", "rank")]
    shared = rows.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            x = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns[-len(m.names) :]], np.float64).T.reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: -len(m.names)], pa.array(m.score(x))], names=[*kept, "score"])

    wide = rows.select(*kept, *[F.col(c).cast("double").alias(f"feature_{i}") for i, c in enumerate(model.names)])
    return ranked(wide.mapInArrow(run, rows.select(*kept, F.lit(0.0).alias("score")).schema), [query], "score", tie)
