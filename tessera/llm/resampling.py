"""Target-distribution importance resampling: array-scored weights, ranks by parallel sorting with regular samples."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import byte_class, cut, map_batches, text_steps, word_spans

#: Buckets of the feature hash, words of the longest feature, and least words of a text that can be drawn.
BUCKETS, ORDERS, LEAST_WORDS = 10_000, 2, 20
#: Rows that one range of the sort holds, least number of ranges, and regular samples that reach the driver (about).
RANGE_ROWS, LEAST_RANGES, SAMPLES = 1_000_000, 48, 1 << 16
#: Words above this many bytes are hashed one by one.
LONG = 64

WORD = ~byte_class(range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80))
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[ord("A") : ord("Z") + 1] += 32


def _byte_table() -> np.ndarray:
    """The checksum register after one more byte, for each low byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


TABLE = _byte_table()


def _shift_tables() -> np.ndarray:
    """``[n, k, b]``: what the byte ``b`` at place ``k`` of a checksum becomes when ``n`` bytes follow.

    A checksum of joined strings is the first one's, carried on over the length of the second, exclusive-or the
    second one's; carrying on is linear over bits, so four look-ups give it.
    """
    out = np.zeros((LONG + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, LONG + 1):
        out[n] = TABLE[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
    return out


SHIFTS = _shift_tables()


class Words(NamedTuple):
    """Lower-cased bytes of a step of texts, where words start and end, each text's first word, each word's crc32."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    crc: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        data = FOLDED[data]
        starts, ends, first = word_spans(data, offsets, WORD)
        size, crc = ends - starts, np.full(len(starts), 0xFFFFFFFF, np.uint32)
        live = np.flatnonzero(size <= LONG)
        for j in range(int(size[live].max(initial=0))):
            live = live[size[live] > j]
            r = crc[live]
            crc[live] = TABLE[(r ^ data[starts[live] + j]) & np.uint32(255)] ^ (r >> np.uint32(8))
        crc ^= np.uint32(0xFFFFFFFF)
        for i in np.flatnonzero(size > LONG):
            crc[i] = zlib.crc32(data[starts[i] : ends[i]])
        return cls(data, starts, ends, first, crc)

    def joined(self, left: np.ndarray, words: int) -> np.ndarray:
        """crc32 of ``words`` words from each one on, joined by spaces; ``left`` has those of one word fewer."""
        n = len(self.crc) - words + 1
        if n <= 0:
            return np.zeros(0, np.uint32)
        r = left[:n] ^ np.uint32(0xFFFFFFFF)
        r = TABLE[(r ^ np.uint32(0x20)) & np.uint32(255)] ^ (r >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
        size, last = (self.ends - self.starts)[words - 1 :], self.crc[words - 1 :]
        tables = SHIFTS[np.minimum(size, LONG)[:, None], np.arange(4)[None, :], (r[:, None] >> (8 * np.arange(4, dtype=np.uint32))) & np.uint32(255)]
        out = np.bitwise_xor.reduce(tables, axis=1) ^ last
        for i in np.flatnonzero(size > LONG):
            out[i] = zlib.crc32(self.data[self.starts[i + words - 1] : self.ends[i + words - 1]], int(r[i]))
        return out

    def features(self, orders: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order the first words of its features and their buckets; features don't cross texts."""
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        crc = self.crc
        for k in range(1, orders + 1):
            crc = self.joined(crc, k) if k > 1 else crc
            inside = np.flatnonzero(text[: len(crc)] == text[k - 1 :]) if len(crc) else np.zeros(0, np.int64)
            yield inside, (crc[inside] % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket: every task adds its own up before the shuffle, a row a bucket comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, off in text_steps(batch.column(0)):
                for _, bucket in Words.of(data, off).features(orders, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = map_batches(docs.select(F.col("text").cast("string").alias("text")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and source, rounded down."""
    s, t, k = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, orders: int = ORDERS) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row: the floored mean of its features' gains."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, off in text_steps(batch.column(1)):
                words = Words.of(data, off)
                sums, n = np.zeros(len(words.starts) + 1, np.int64), np.zeros(len(off) - 1, np.int64)
                for at, bucket in words.features(orders, buckets):
                    sums[at + 1] += shared.value[bucket]
                    n += np.diff(np.searchsorted(at, words.first))
                sums = np.cumsum(sums)[words.first]
                weight = np.diff(sums) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, len(n)), *(pa.array(c.astype(np.int64)) for c in (np.diff(words.first), n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_words long, n_features long, weight long")


KEYS = ("score", "doc_id", "n_features", "at")


def _order_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Fixed-width byte strings that sort as the rows do: score downwards, then doc_id, n_features and place."""
    cols = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in KEYS]
    flipped = [~cols[0], *cols[1:]]
    stacked = np.stack([c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in flipped], axis=1)
    return stacked.astype(">u8").view("S32").ravel()


def ranked(runs: DataFrame, n: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``rank``, from 1, to ``runs``: stored rows, locally sorted by KEYS (score downwards), ``n`` of them.

    Parallel sorting by regular sampling.  Every run gives each ``stride``-th of its rows; of all of these, which
    are about SAMPLES in number whatever the input, every so many-th is a splitter.  Each row goes to the range
    between its splitters, a range is merged and numbered locally, and the sums of the earlier ranges' counts make
    the numbers exact ranks.  A range holds at most n / ranges + (runs + 1) * stride rows; ``at`` tells equal rows
    apart, so that no number of them makes a range larger.
    """
    spark, ranges = runs.sparkSession, max(LEAST_RANGES, -(-n // range_rows))
    stride = max(1, n // SAMPLES)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at = np.arange(-seen % stride, batch.num_rows, stride)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(_order_bytes(batch)[at].tolist(), pa.binary())], names=["key"])

    found = map_batches(runs.select(*KEYS), sample, "key binary").toArrow().column("key").to_pylist()
    samples = np.sort(np.array([k.ljust(32, b"\0") for k in found], "S32"))
    splitters = samples[np.unique(np.arange(1, ranges) * len(samples) // ranges)] if len(samples) else samples
    shared = spark.sparkContext.broadcast(splitters)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = np.searchsorted(shared.value, _order_bytes(batch), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to)], names=[*batch.schema.names, "range"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields)
    dealt = map_batches(runs, deal, f"{kinds}, range int")
    counts = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}
    before, total = [], 0
    for r in range(len(splitters) + 1):
        before.append((r, total))
        total += counts.get(r, 0)
    local = F.row_number().over(Window.partitionBy("range").orderBy(F.desc(KEYS[0]), *KEYS[1:]))
    merged = dealt.withColumn("local", local)
    return merged.join(F.broadcast(spark.createDataFrame(before, "range int, before long")), "range").withColumn("rank", F.col("before") + F.col("local")).drop("range", "local", "before")


def resample(docs: DataFrame, target: DataFrame, seed: str | int = 7, share: tuple[int, int] = (25, 100), least_words: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """Draws ``share`` of the texts of at least ``least_words`` words, the likelier the more they look like ``target``.

    A text's features are all runs of 1 to ``orders`` of its words; its weight is the mean log ratio of their hashed
    shares in ``target`` and in ``docs`` (thousandths, floored), and its score the weight plus Gumbel noise drawn
    from sha256(``seed:doc_id``), so that the highest scores are a sample without replacement.

    Returns of every row doc_id, n_features, weight, score and rank (from 1, in falling order of the score, ties to
    the smaller doc_id; null if not drawn).  A null text has no words; a null doc_id counts for the statistics,
    but has no score and is never drawn; of rows that share a doc_id each is one of the texts; an empty table gives
    an empty result, an empty target weights that only say how rare a text's features are.
    """
    gain = gains(bucket_counts(docs, orders, buckets), bucket_counts(target, orders, buckets))
    rows = weighted(docs, gain, orders)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    open_ = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    scored = rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), open_.alias("open"), F.monotonically_increasing_id().alias("at"))
    runs = cut(scored.sortWithinPartitions(F.desc("open"), F.desc("score"), *KEYS[1:]))
    n = runs.where("open").count()
    drawn = n * share[0] // share[1]
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    own = ["doc_id", "n_features", "weight", "score"]
    left = runs.where(~F.col("open")).select(*own, F.lit(None).cast("long").alias("rank"))
    return ranked(runs.where("open").select(*KEYS, "weight"), n).select(*own, rank.alias("rank")).unionByName(left)
