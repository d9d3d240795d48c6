"""Exact inner-product top-k: a ball tree in every shard, searched by branch and bound."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Vectors of a shard, of a leaf, and of a block of queries.
SHARD, LEAF, QUERIES = 8192, 64, 1024
#: Shards, and blocks of queries, that meet in one task at most; both sides are copied the less the more meet.
SHARDS_MET, BLOCKS_MET = 16, 32
#: Bytes of a shard's and of a block's components at most: wide vectors make them fewer rows.
SHARD_BYTES, BLOCK_BYTES = 1 << 24, 1 << 22

PACKED = "{} long, dim int, ids binary, vecs binary, tree binary"


def scaled(df: DataFrame, vec: str, scale: int) -> DataFrame:
    """``(vec_id, x)`` with x = floor(scale * component) as longs; rows with null or non-finite parts are left out."""
    usable = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(vec, lambda c: F.floor(F.lit(scale) * c.cast("double")))
    return df.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long"), x.alias("x"))


def _matrix(rows: pd.Series) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def ball_tree(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Order of the rows; nodes as (begin, end, left, right), left -1 for a leaf; centres; radii.

    A node is cut at the median of its coordinate of widest spread.
    """
    order, nodes, centres, radii = np.arange(len(x)), [], [], []

    def grow(a: int, b: int) -> int:
        at, part = len(nodes), x[order[a:b]].astype(float)
        c = part.mean(0)
        nodes.append((a, b, -1, -1))
        centres.append(c)
        radii.append(np.sqrt(((part - c) ** 2).sum(1).max()))
        spread = part.max(0) - part.min(0)
        if b - a > LEAF and spread.max(initial=0) > 0:
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, spread.argmax()], half)]
            nodes[at] = (a, b, grow(a, a + half), grow(a + half, b))
        return at

    grow(0, len(x))
    return order, nodes, np.array(centres), np.array(radii)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles are exact while every partial sum stays below 2**53."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


class Best:
    """The k best (score, vec_id) so far of every query of a block, ties to the smaller vec_id."""

    def __init__(self, n: int, k: int, kth: np.ndarray) -> None:
        self.k, self.known = k, kth
        self.score = np.zeros((n, 0), np.int64)
        self.ids = np.zeros((n, 0), np.int64)
        self.real = np.zeros((n, 0), bool)

    def kth(self) -> np.ndarray:
        """A score that the k-th best reaches at least: here or, from an earlier search, elsewhere."""
        if self.score.shape[1] < self.k:
            return self.known
        return np.maximum(self.known, np.where(self.real[:, self.k - 1], self.score[:, self.k - 1].astype(float), -np.inf))

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, real: np.ndarray) -> None:
        s = np.concatenate([self.score[rows], score], 1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, score.shape)], 1)
        r = np.concatenate([self.real[rows], real], 1)
        order = np.lexsort((i, -s, ~r), axis=1)[:, : self.k]
        s, i, r = (np.take_along_axis(m, order, 1) for m in (s, i, r))
        width = max(self.score.shape[1], s.shape[1])
        if width > self.score.shape[1]:
            grow = ((0, 0), (0, width - self.score.shape[1]))
            self.score, self.ids, self.real = (np.pad(m, grow) for m in (self.score, self.ids, self.real))
        self.score[rows, : s.shape[1]], self.ids[rows, : s.shape[1]], self.real[rows, : s.shape[1]] = s, i, r


def search(best: Best, q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, tree: tuple) -> None:
    """Visits the nodes in falling order of their bound q.c + |q| r, the largest over the queries still open there.

    A query leaves a node whose bound lies below its k-th score; equal bounds are searched, for ties.
    """
    _, nodes, centres, radii = tree
    norm = np.sqrt((q.astype(float) ** 2).sum(1))
    bound = q.astype(float) @ centres.T + norm[:, None] * radii
    bound += 1e-9 * (np.abs(bound) + norm[:, None] * (np.sqrt((centres**2).sum(1)) + radii)) + 1e-6
    heap, n = [(0.0, 0, 0, np.arange(len(q)))], 0
    while heap:
        _, _, at, rows = heapq.heappop(heap)
        rows = rows[bound[rows, at] >= best.kth()[rows]]
        if not len(rows):
            continue
        a, b, left, right = nodes[at]
        if left < 0:
            for lo in range(a, b, 4 * LEAF):
                hi = min(b, lo + 4 * LEAF)
                best.add(rows, _products(q[rows], x[lo:hi]), ids[lo:hi], qid[rows][:, None] != ids[lo:hi])
            continue
        for child in (left, right):
            n += 1
            heapq.heappush(heap, (-bound[rows, child].max(), n, child, rows))


def _pack(tree: bool):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        x, ids, built = _matrix(pdf["x"]), pdf["vec_id"].to_numpy(), None
        if tree:
            built = ball_tree(x)
            x, ids = x[built[0]], ids[built[0]]
        return pd.DataFrame([(int(key[0]), x.shape[1], ids.tobytes(), x.tobytes(), pickle.dumps(built))], columns=["at", "dim", "ids", "vecs", "tree"])

    return pack


def _wide(x: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def _met(blocks: DataFrame, shards: DataFrame, on: list[str], k: int, schema: str, give: Callable) -> DataFrame:
    """Every block of a group past all shards of that group, one after the other, its k-th scores going along."""

    def run(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for r in xs.sort_values("shard").itertuples(index=False):
            ids = np.frombuffer(r.ids, np.int64)
            sides.append((ids, np.frombuffer(r.vecs, np.int64).reshape(len(ids), r.dim), pickle.loads(r.tree)))
        out = []
        for r in qs.itertuples(index=False):
            qid = np.frombuffer(r.ids, np.int64)
            q = np.frombuffer(r.vecs, np.int64).reshape(len(qid), r.dim)
            best = Best(len(qid), k, np.frombuffer(r.kth, np.float64) if r.kth is not None else np.full(len(qid), -np.inf))
            for ids, x, tree in sides:
                dim = max(q.shape[1], x.shape[1])
                search(best, _wide(q, dim), qid, _wide(x, dim), ids, (*tree[:2], _wide(tree[2], dim), tree[3]))
            out.append(give(r.block, qid, best))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return blocks.groupBy(*on).cogroup(shards.groupBy(*on)).applyInPandas(run, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, vec: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest integer inner product for each row of ``queries``.

    Vectors are dealt into shards of about SHARD rows or SHARD_BYTES by a hash of their id, and each shard gets a
    ball tree.  Queries are packed in blocks of about QUERIES or BLOCK_BYTES.  A first round searches one shard per block and leaves each
    query's k-th score with it; in the second, groups of blocks meet groups of shards, both of bounded size, and
    the k-th score of a block only rises from shard to shard.  The best of all groups are then ranked.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; a query's own id is never
    its result; fewer candidates give fewer rows.  Null ids, and vectors that are null or hold null or non-finite
    components, take no part.  Rows of ``vectors`` repeated in full are candidates each; rows of ``queries``
    repeated in full are one query, and different ones with one id share a list of ``k``.  Shorter vectors,
    down to empty ones, are filled with zeros.  Sums beyond 64 bits wrap.  Empty tables give an empty result;
    other columns are ignored.
    """
    x, q = scaled(vectors, vec, scale), scaled(queries, vec, scale).distinct()
    sides = [df.agg(F.count("*"), F.coalesce(F.max(F.size(vec)), F.lit(0))).first() for df in (vectors, queries)]
    n_shards, n_blocks = (max(1, -(-n // rows), -(-n * 8 * dims // most)) for (n, dims), rows, most in zip(sides, (SHARD, QUERIES), (SHARD_BYTES, BLOCK_BYTES), strict=True))
    n_groups = -(-n_blocks // BLOCKS_MET)
    n_parts = max(-(-n_shards // SHARDS_MET), min(n_shards, -(-vectors.sparkSession.sparkContext.defaultParallelism // n_groups)))
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def packed(df: DataFrame, at: str, n: int, tree: bool) -> DataFrame:
        dealt = df.withColumn(at, F.pmod(F.xxhash64("vec_id"), F.lit(n)))
        return cut(dealt.groupBy(at).applyInPandas(_pack(tree), PACKED.format("at")).withColumnRenamed("at", at))

    def kth_of(block: int, qid: np.ndarray, best: Best) -> pd.DataFrame:
        return pd.DataFrame({"block": [block], "kth": [best.kth().tobytes()]})

    def rows_of(block: int, qid: np.ndarray, best: Best) -> pd.DataFrame:
        at = np.nonzero(best.real)
        return pd.DataFrame({"query_id": qid[at[0]], "vec_id": best.ids[at], "score": best.score[at]})

    shards, blocks = packed(x, "shard", n_shards, True), packed(q, "block", n_blocks, False).drop("tree")
    first = shards.where(F.col("shard") < n_blocks).withColumn("block", F.explode(F.sequence("shard", F.lit(n_blocks - 1).cast("long"), F.lit(n_shards).cast("long"))))
    kth = cut(_met(blocks.withColumn("kth", F.lit(None).cast("binary")), first, ["block"], k, "block long, kth binary", kth_of))
    known = blocks.join(kth, "block", "left").withColumn("grp", F.pmod("block", F.lit(n_groups)).cast("int")).withColumn("part", whole(n_parts))
    dealt = shards.withColumn("part", F.pmod("shard", F.lit(n_parts)).cast("int")).withColumn("grp", whole(n_groups))
    found = _met(known, dealt, ["grp", "part"], k, "query_id long, vec_id long, score long", rows_of)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
