"""Quality scores by positive-unlabelled learning: trusted positives, unlabelled texts and an estimated class prior."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BACK, NOT_SPACE, U, byte_class, map_batches, mix, text_steps, word_hashes, word_spans

#: Buckets of the hash of word shapes, and measures of a whole text beside them.
SHAPES, MEASURES = 1024, 12
#: Trusted positives and unlabelled texts that the fit reads (about); no other statistic is sampled.
POSITIVES, UNLABELLED = 10_000, 20_000
#: A bucket of shapes is an input if so many texts of the sample hold it.
LEAST_TEXTS = 5
#: Penalty on squared weights, steps and their length; inputs are cut off at so many standard deviations.
PENALTY, STEPS, PACE, FAR = 1e-3, 400, 0.05, 5.0
#: Of the confidence bound that picks the best bin for the class prior: chance of error and weight.
ERROR, SLACK = 0.1, 0.01

#: Classes of bytes that a shape doesn't tell apart: upper case, lower case and all beyond ASCII, digits.
KIND = np.arange(256, dtype=np.uint8)
KIND[ord("A") : ord("Z") + 1], KIND[ord("a") : ord("z") + 1], KIND[128:], KIND[ord("0") : ord("9") + 1] = ord("A"), ord("a"), ord("a"), ord("0")
JOINED = byte_class(ord("A"), ord("a"), ord("0"))
LINE = ~byte_class(0x0A, 0x0D)


def _repeats(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` texts, how many of its hashes are there again, and how often the most frequent one is."""
    total = np.bincount(text, minlength=n)
    order = np.lexsort((h, text))
    t, v = text[order], h[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, t[at], np.diff(np.append(at, len(t))))
    return total - np.bincount(t[at], minlength=n), most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of MEASURES + SHAPES numbers for each text, all shares or logarithms; zeros for a text without words.

    Nothing is told apart by what words say: the measures are of repetition, case, marks, digits and lengths, and a
    shape is a word with each run of letters of one case, or of digits, made one character.
    """
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    text, words = np.repeat(np.arange(n), np.diff(first)), np.diff(first)
    h = word_hashes(data, starts, ends)
    kind = KIND[data]
    inner = np.zeros(len(kind), bool)
    inner[1:] = JOINED[kind[1:]] & (kind[1:] == kind[:-1])
    inner[starts] = False
    before = np.concatenate([[0], np.cumsum(~inner)])
    shape = word_hashes(kind[~inner], before[starts], before[ends]) % U(SHAPES)
    shapes = np.bincount(text * SHAPES + shape.astype(np.int64), minlength=n * SHAPES).reshape(n, SHAPES)
    per_byte = lambda member: np.diff(np.concatenate([[0], np.cumsum(member)])[offsets])
    upper, lower, digit = (per_byte(kind == ord(c)) for c in "Aa0")
    filled = np.maximum(per_byte(NOT_SPACE[data]), 1)
    some, share = np.maximum(words, 1), lambda a, b: a / np.maximum(b, 1)
    pair = text[:-1] == text[1:] if len(text) else np.zeros(0, bool)
    same = np.bincount(text[1:][pair & (h[1:] == h[:-1])], minlength=n)
    again, most = _repeats(text, h, n)
    twice, _ = _repeats(text[:-1][pair], mix(h[:-1][pair] * U(31) + h[1:][pair]), n) if len(text) else (np.zeros(n), None)
    ls, le, lf = word_spans(data, offsets, LINE)
    lines, _ = _repeats(np.repeat(np.arange(n), np.diff(lf)), word_hashes(data, ls, le), n)
    out = np.zeros((n, MEASURES + SHAPES), np.float32)
    measures = (
        share(same, words - 1), share(again, words), share(twice, words - 1), share(most, words), share(lines, np.diff(lf)), share(upper, upper + lower), share(digit, filled),
        1 - (upper + lower + digit) / filled, np.log1p(filled / some), np.log1p(words), share(words, filled + words), np.log1p(share(words, np.diff(lf))),
    )
    for i, m in enumerate(measures):
        out[:, i] = m
    out[:, MEASURES:] = np.sqrt(shapes / some[:, None])
    out[words == 0] = 0
    return out


def _features_of(texts: pa.Array) -> np.ndarray:
    parts = [features(data, off) for _, data, off in text_steps(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, MEASURES + SHAPES), np.float32)


class Model(NamedTuple):
    """Log-odds of quality: features less ``center`` over ``scale``, cut off at FAR, times ``weights``, plus ``bias``."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -FAR, FAR) @ self.weights + self.bias


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_slope(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative unbiased risk of logits under the logistic loss, and the slope for each logit to follow.

    Unlabelled texts count as negative; of that risk the positives' share, prior times their own risk as negative,
    is taken off, which leaves the negatives' risk.  Where that falls below zero, which no risk can, the fit has
    begun to overfit: the risk counts it as zero, and the slope leads back up.
    """
    p, u = chance(positive), chance(unlabelled)
    rest = np.mean(np.logaddexp(0, unlabelled)) - prior * np.mean(np.logaddexp(0, positive))
    risk = prior * np.mean(np.logaddexp(0, -positive)) + max(rest, 0.0)
    if rest < 0:
        return risk, prior * p / len(p), -u / len(u)
    return risk, (prior * (p - 1) - prior * p) / len(p), u / len(u)


def minimised(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = STEPS, plain: bool = False) -> tuple[np.ndarray, float]:
    """Weights and bias of least risk found (steps of length PACE, adapted to each weight); ``x`` is standardised.

    ``plain`` asks for positives against unlabelled instead, which needs no prior.
    """
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    mean, square = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    best, least = (w, b), np.inf
    for step in range(1, steps + 1):
        z = x @ w + b
        slope = np.zeros(len(x))
        if plain:
            share = positive.mean()
            risk = (1 - share) * np.mean(np.logaddexp(0, -z[positive])) + share * np.mean(np.logaddexp(0, z[~positive]))
            slope = np.where(positive, (1 - share) * (chance(z) - 1) / positive.sum(), share * chance(z) / (~positive).sum())
        else:
            risk, slope[positive], slope[~positive] = risk_slope(z[positive], z[~positive], prior)
        risk += PENALTY / 2 * float(w @ w)
        if risk < least:
            best, least = (w, b), risk
        g = np.append(slope.astype(np.float32) @ x + PENALTY * w, slope.sum())
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        move = PACE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return best


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior of the unlabelled: their share above a score over the positives', where its upper bound is least.

    Above a high score nearly all unlabelled texts are positive; the bound, of ERROR and SLACK, keeps the estimate
    from resting on the few highest ones.
    """
    cuts = np.unique(positive)
    p, u = (1 - np.searchsorted(np.sort(s), cuts, "left") / len(s) for s in (positive, unlabelled))
    spread = sum(np.sqrt(np.log(4 / ERROR) / (2 * len(s))) for s in (positive, unlabelled))
    at = np.argmin(u / p + (1 + SLACK) * spread / p)
    return float(np.clip(u[at] / p[at], 0.01, 0.99))


def train(x: np.ndarray, positive: np.ndarray) -> Model | None:
    """Fits on features of trusted positives and unlabelled texts; None without both.

    One half of them fits positives against unlabelled, the other half's scores under that give the class prior;
    then all take part in the non-negative risk.
    """
    if not 0 < positive.sum() < len(positive):
        return None
    rest = x[~positive]
    used = (x != 0).sum(0) >= LEAST_TEXTS
    center, scale = rest.mean(0), np.maximum(rest.std(0), 1e-3)
    x = np.where(used, np.clip((x - center) / scale, -FAR, FAR), 0).astype(np.float32)
    half = np.zeros(len(x), bool)
    for group in (np.flatnonzero(positive), np.flatnonzero(~positive)):
        half[group[::2]] = True
    w, b = minimised(x[half], positive[half], 0.5, plain=True)
    test = ~half if positive[~half].any() and (~positive[~half]).any() else half
    z = x[test] @ w + b
    prior = best_bin(z[positive[test]], z[~positive[test]])
    w, b = minimised(x, positive, prior)
    return Model(center, scale, np.where(used, w, 0).astype(np.float32), b, prior)


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = (POSITIVES, UNLABELLED)) -> Model | None:
    """Learns from the texts labelled 1 and from texts without regard to labels; None if there are none labelled 1.

    About ``sample`` positives and unlabelled texts, chosen by hashes of their ids and texts, are read (all, if
    fewer): their features are found where they are, and meet in one task, whose work ``sample`` bounds.  Labels of
    0 are not used.  Null ids and null labels are left out; a document with several labels counts with the largest.
    """
    trusted = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select("doc_id")
    n, all_ = trusted.count(), docs.count()
    if not n or not all_:
        return None
    chosen = lambda seed, want, of, *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 20)) < -(-(1 << 20) * want // max(want, of))
    known = F.broadcast(trusted.where(chosen(1, sample[0], n, "doc_id")))
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first = own.where("doc_id is not null").join(known, "doc_id").select("text", F.lit(1).alias("positive"))
    texts = first.unionByName(own.where(chosen(2, sample[1], all_, "doc_id", "text")).select("text", F.lit(0).alias("positive")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BACK) for b in batches for i in range(0, b.num_rows, BACK)):
            x = _features_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["positive", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy() == 1, np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(b.num_rows, -1)) for b in batches if b.num_rows]
        if held and (m := train(np.concatenate([x for _, x in held]), np.concatenate([p for p, _ in held]))):
            rows = np.stack([m.center, m.scale, m.weights]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in rows], pa.list_(pa.float64())), *(pa.array([v] * 3) for v in (m.bias, m.prior)), pa.array([0, 1, 2], pa.int32())], names=["row", "bias", "prior", "i"])

    measured = map_batches(texts, measure, "positive int, x binary").repartition(1).sortWithinPartitions("positive", "x")
    found = sorted(map_batches(measured, learn, "row array<double>, bias double, prior double, i int").collect(), key=lambda r: r.i)
    if not found:
        return None
    center, scale, weights = (np.array(r.row, np.float32) for r in found)
    return Model(center, scale, weights, found[0].bias, found[0].prior)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, of the whole text); a null text counts as an empty one.

    Without a model every score is 1.  A column named score gives way; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() != "score"]
    if model is None:
        return docs.select(*kept, F.lit(1.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in (b.slice(i, BACK) for b in batches for i in range(0, b.num_rows, BACK)):
            z = [model.logits(features(data, off)) for _, data, off in text_steps(batch.column(batch.num_columns - 1))]
            z = np.concatenate(z) if z else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(chance(z).astype(np.float64))], names=[*kept, "score"])

    rows = docs.select(*kept, F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text_in"))
    return map_batches(rows, run, docs.select(*kept, F.lit(0.0).alias("score")).schema)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Scores every text; neither a label nor an unlabelled text of the fit is of a row that is held out.

    Returns doc_id, held_out, score, predicted (1 if score >= threshold); repeated rows give repeated results.
    """
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    scored = score(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
