"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U, map_batches, mix

#: Buckets of the term hash, and labelled texts to fit on (about).
BUCKETS, SAMPLE = 1 << 20, 20_000
#: A bucket is an input if so many texts of the sample hold it, near copies of one label counting once.  No share
#: of the sample and no marginal test is asked for: the penalty decides, and words of a rare language count too.
LEAST_TEXTS = 5
#: A weight leaves zero where its gradient is so many standard deviations of a chance one; most steps of the fit.
PENALTY, STEPS = 1.5, 60
#: Min-hashes of a band, and bands, by which near copies of the sample meet, and the share of terms copies have in common.
COPY_ROWS, COPY_BANDS, COPY = 6, 8, 0.7


class Machine(NamedTuple):
    """A factorization machine: sorted terms, per term its weight and its factors (rows), and the intercept."""

    terms: np.ndarray
    weights: np.ndarray
    intercept: float


def with_terms(docs: DataFrame) -> DataFrame:
    """Adds ``terms``: the hashed distinct words of the whole text (runs of letters and digits, lower case)."""
    words = F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    hashed = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    return docs.withColumn("terms", F.array_distinct(hashed))


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``; runs may be empty."""
    total = np.zeros(len(lengths), values.dtype)
    full = lengths > 0
    if full.any():
        total[full] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[full])
    return total


def _margins(weights: np.ndarray, intercept: float, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log-odds of each text, and the sums of its weights and of each of its factors."""
    sums = [_sums(w[at], lengths) for w in weights]
    own = _sums((weights[1:] ** 2).sum(0)[at], lengths)
    return intercept + sums[0] + 0.5 * (sum(s * s for s in sums[1:]) - own), sums


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def originals(labels: np.ndarray, terms: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which texts stay when of near copies with one label the first stays."""
    keep, first = np.ones(len(labels), bool), np.cumsum(lengths) - lengths
    some = np.flatnonzero(lengths > 0)
    for band in range(COPY_BANDS):
        key = labels[some].astype(np.uint64)
        for i in range(COPY_ROWS if len(some) else 0):
            low = np.minimum.reduceat(mix(terms.astype(np.uint64) + U((band * COPY_ROWS + i + 1) << 32)), first[some])
            key = mix(key * U(31) + low)
        order = np.argsort(key, kind="stable")
        center = None
        for at, new in zip(some[order], np.r_[True, np.diff(key[order]) != 0][: len(order)], strict=True):
            if new or not keep[center]:
                center = at
            elif keep[at]:
                x, y = (terms[first[i] : first[i] + lengths[i]] for i in (center, at))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[at] = both < COPY * (len(x) + len(y) - both)
    return keep


def train(labels: np.ndarray, terms: np.ndarray, lengths: np.ndarray, factors: int = 4, seed: int = 7) -> Machine:
    """Logistic loss with an absolute penalty on weights and on each term's factors, by accelerated proximal steps.

    The penalty of a term is PENALTY times the standard deviation of its gradient under a label of chance, so that
    noise stays at zero however many terms there are.  A step that raises the loss is taken back and halved.
    """
    keep = originals(labels, terms, lengths)
    terms, labels, lengths = terms[np.repeat(keep, lengths)], labels[keep], lengths[keep]
    known, at, count = np.unique(terms, return_inverse=True, return_counts=True)
    used = (count >= LEAST_TEXTS)[at]
    row = np.repeat(np.arange(len(labels)), lengths)[used]
    known, at, count = known[count >= LEAST_TEXTS], (np.cumsum(count >= LEAST_TEXTS) - 1)[at[used]], count[count >= LEAST_TEXTS]
    n, share, lengths = len(labels), labels.mean(), np.bincount(row, minlength=len(labels))
    by_term = row[np.argsort(at, kind="stable")]
    weights = np.zeros((1 + factors, len(known)), np.float32)
    weights[1:] = np.random.default_rng(seed).normal(0, 0.01, (factors, len(known)))
    noise = (PENALTY * np.sqrt(count * share * (1 - share)) / n).astype(np.float32)
    pace = (2 * n / (np.bincount(at, weights=lengths[row], minlength=len(known)) * share * (1 - share))).astype(np.float32)
    best = last = now = (weights, float(np.log(share / (1 - share))))
    speed, scale, least = 1.0, np.float32(1), np.inf
    for _ in range(STEPS):
        w, b = now
        z, sums = _margins(w, b, at, lengths)
        loss = np.mean(np.logaddexp(0, z) - labels * z) + (noise * (np.abs(w[0]) + np.sqrt((w[1:] ** 2).sum(0)))).sum()
        if not loss <= least + 1e-4:
            now, last, speed, scale, least = best, best, 1.0, scale / 2, np.inf
            continue
        best, least = now, loss
        off = ((_chance(z) - labels) / n).astype(np.float32)
        slope = np.stack([_sums((off if i == 0 else off * sums[i].astype(np.float32))[by_term], count) for i in range(1 + factors)])
        slope[1:] -= w[1:] * slope[0]
        step = pace * scale
        to = w - step * slope
        to[0] = np.sign(to[0]) * np.maximum(np.abs(to[0]) - step * noise, 0)
        to[1:] *= np.maximum(1 - step * noise / np.maximum(np.sqrt((to[1:] ** 2).sum(0)), 1e-12), 0)
        b = b - float(off.sum() / (share * (1 - share)) * scale)
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = (speed - 1) / faster
        now, last, speed = (to + np.float32(ahead) * (to - last[0]), b + ahead * (b - last[1])), (to, b), faster
    used = (best[0] != 0).any(0)
    return Machine(known[used], best[0][:, used], best[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, factors: int = 4, seed: int = 7) -> Machine | None:
    """Fits on labelled texts; None if the labels hold fewer than two classes.

    About ``sample`` labelled documents, chosen by a hash of their id, are read (all, if fewer) and meet in one
    task, whose work ``sample`` bounds.  Every hashed term of LEAST_TEXTS texts is an input; pairs of them interact
    through ``factors`` factors.  Of near copies with one label one counts.  Null ids and null labels are left out,
    a document with several labels counts with the largest.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    texts = with_terms(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")).select("doc_id", F.xxhash64("text").alias("same"), "label", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, terms, lengths = [np.zeros(0)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for batch in batches:
            y.append(batch.column(0).to_numpy().copy())
            terms.append(batch.column(1).flatten().to_numpy().copy())
            lengths.append(batch.column(1).value_lengths().to_numpy().astype(np.int64))
        y = np.concatenate(y)
        if len(y) and 0 < y.sum() < len(y):
            m = train(y, np.concatenate(terms), np.concatenate(lengths), factors, seed)
            rows = np.column_stack([np.r_[m.intercept, np.zeros(factors)], m.weights]).T
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, m.terms].astype(np.int32)), pa.array(rows.astype(np.float64).tolist(), pa.list_(pa.float64()))], names=["term", "weights"])

    one = texts.repartition(1).sortWithinPartitions("doc_id", "same").select("label", "terms")
    found = sorted(map_batches(one, run, "term int, weights array<double>").collect())
    if not found:
        return None
    weights = np.array([r.weights for r in found[1:]], np.float32).reshape(-1, 1 + factors).T
    return Machine(np.array([r.term for r in found[1:]], np.int32), np.ascontiguousarray(weights), found[0].weights[0])


def score(docs: DataFrame, model: Machine | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1); an empty or null text gets the score of a text without known terms.

    Without a model every score is 0.  Columns named score, terms, features, rawPrediction, probability or
    prediction are replaced; an empty table gives an empty result.
    """
    own = ["score", "terms", "features", "rawprediction", "probability", "prediction", "label"]
    kept = [c for c in docs.columns if c.lower() not in own]
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, intercept = shared.value
        slot = np.full(BUCKETS, len(terms), np.int32)
        slot[terms] = np.arange(len(terms))
        weights = np.column_stack([weights, np.zeros(len(weights), np.float32)])
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            z, _ = _margins(weights, intercept, slot[column.flatten().to_numpy()], column.value_lengths().to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_chance(z).astype(np.float64))], names=[*kept, "score"])

    rows = with_terms(docs.select(*kept))
    schema = rows.select(*kept, F.lit(0.0).alias("score")).schema
    return map_batches(rows, run, schema)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores every text; labels are learnt only from rows that aren't held out.

    Returns doc_id, held_out, score, predicted (1 if score >= threshold); repeated rows give repeated results.
    """
    model = fit(docs, labels.where(~held_out()))
    scored = score(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
