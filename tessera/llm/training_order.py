"""Training-order materialisation: token sequences in a keyed pseudorandom order, in fixed-stride shards."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import U, commit_files, cut, file_store, mix

ROUNDS = 8
#: Tokens of a sequence, and bytes of a token (4 for vocabularies beyond 16 bits).
LENGTH, WIDTH = 256, 2
#: Documents cut into records at once, and bytes of records dealt out together.
PART, TOGETHER = 1024, 1 << 25
#: Bytes of a shard, which one task holds, and least number of shards.
SHARD_BYTES, LEAST_SHARDS = 1 << 26, 48
MANIFEST = "shard long, file string, temporary string, records long, bytes long, sha256 string"


class Permutation:
    """A keyed permutation of ``0 .. n - 1``: a balanced Feistel network whose values beyond n walk on.

    Numbers below 2^96 are pairs of the bits above and below the 32nd, so that 64-bit ids times parts have room.
    """

    def __init__(self, n: int, key: str) -> None:
        self.n = n
        bits = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.bits, self.half, self.mask, self.whole = bits, U(bits), U((1 << bits) - 1), n == 1 << 2 * bits
        self.end = U(n >> 32), U(n & 0xFFFFFFFF)
        self.keys = [U(int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little")) for r in range(ROUNDS)]

    def _halves(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = high >> U(self.bits - 32) if self.bits >= 32 else (high << U(32 - self.bits)) | (low >> self.half)
        return left, ((high << U(32)) | low) & self.mask

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = (left << self.half) | right
        high = (left << U(self.bits - 32)) | (right >> U(32)) if self.bits >= 32 else low >> U(32)
        return high, low & U(0xFFFFFFFF)

    def _walk(self, high: np.ndarray, low: np.ndarray, once) -> tuple[np.ndarray, np.ndarray]:
        high, low = self._joined(*once(*self._halves(high, low)))
        while not self.whole and (out := (high > self.end[0]) | ((high == self.end[0]) & (low >= self.end[1]))).any():
            high[out], low[out] = self._joined(*once(*self._halves(high[out], low[out])))
        return high, low

    def slots(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def once(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            for k in self.keys:
                left, right = right, left ^ (mix(right + k) & self.mask)
            return left, right

        return self._walk(high, low, once)

    def indexes(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def once(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            for k in reversed(self.keys):
                left, right = right ^ (mix(left + k) & self.mask), left
            return left, right

        return self._walk(high, low, once)

    def _plain(self, x: np.ndarray, f) -> np.ndarray:
        x = np.asarray(x).astype(np.uint64)
        high, low = f(x >> U(32), x & U(0xFFFFFFFF))
        return (high << U(32)) | low

    def slot(self, index: np.ndarray) -> np.ndarray:
        """``slots`` of numbers below 2^64."""
        return self._plain(index, self.slots)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._plain(slot, self.indexes)


#: A place: its bits above and below the 32nd.
PLACE = np.dtype([("high", "<u8"), ("low", "<u4")])


class Domain(NamedTuple):
    """Least doc_id, number of ids up to the greatest, parts counted for each id, and shards."""

    least: int
    ids: int
    parts: int
    shards: int

    def codes(self, doc: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number below ``size`` of its own for each sequence: ids from the least on, times parts, plus the part."""
        at = doc.astype(np.uint64) - U(self.least % 2**64)
        low = (at & U(0xFFFFFFFF)) * U(self.parts) + part.astype(np.uint64)
        return (at >> U(32)) * U(self.parts) + (low >> U(32)), low & U(0xFFFFFFFF)

    @property
    def size(self) -> int:
        return self.ids * self.parts

    def shard(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Equal ranges of places, which small domains tell apart by all bits and wide ones by the upper ones."""
        if self.size < 1 << 63:
            return (((high << U(32)) | low) // U(-(-self.size // self.shards))).astype(np.int64)
        return (high // U((self.size >> 32) // self.shards + 1)).astype(np.int64)


def domain(docs: DataFrame, tokens, length: int = LENGTH, width: int = WIDTH, shards: int | None = None) -> Domain:
    """From one aggregation over ``docs``; the column ``tokens`` is a row's number of tokens, or a bound of it."""
    n = F.coalesce(tokens.cast("long"), F.lit(0))
    low, high, most, total = docs.where("doc_id is not null").agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long")), F.max(n), F.sum(F.ceil(n / length))).first()
    if low is None:
        return Domain(0, 1, 1, 1)
    ids = high - low + 1
    parts = max(1, -(-most // length))
    if parts >= 1 << 31:
        raise ValueError("a document has too many parts")
    shards = shards or max(LEAST_SHARDS, -(-int(total) * record(length, width).itemsize // SHARD_BYTES))
    return Domain(low, ids, parts, min(shards, ids * parts))


def record(length: int, width: int) -> np.dtype:
    """Document, part, tokens in use, and ``length`` tokens, the last of a document filled up with zeros."""
    return np.dtype([("doc", "<i8"), ("part", "<i4"), ("used", "<i4"), ("tokens", f"<u{width}", (length,))])


def _records(doc_ids: np.ndarray, ids: pa.Array, kind: np.dtype) -> np.ndarray:
    length = kind["tokens"].shape[0]
    ends = ids.offsets.to_numpy().astype(np.int64)
    flat, counts = ids.values.to_numpy()[ends[0] : ends[-1]], np.diff(ends)
    if len(flat) and not 0 <= flat.min() <= flat.max() < 1 << 8 * kind["tokens"].base.itemsize:
        raise ValueError("token ids don't fit the width of a token")
    parts = -(-counts // length)
    first = np.cumsum(parts) - parts
    doc = np.repeat(np.arange(len(counts)), parts)
    out = np.zeros(len(doc), kind)
    out["doc"], out["part"] = doc_ids[doc], np.arange(len(doc)) - first[doc]
    out["used"] = np.minimum(counts[doc] - out["part"].astype(np.int64) * length, length)
    where = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], counts)
    out["tokens"][np.repeat(first, counts) + where // length, where % length] = flat
    return out


def _dealt(encoded: DataFrame, at: Domain, key: str, kind: np.dtype) -> DataFrame:
    """``(shard, places, records)``: the records of one stretch of input that go to one shard, compressed as one."""

    def blocks(held: list[np.ndarray], order: Permutation) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        place = np.empty(len(rows), PLACE)
        place["high"], place["low"] = order.slots(*at.codes(rows["doc"], rows["part"]))
        shard = at.shard(place["high"], place["low"].astype(np.uint64))
        by = np.argsort(shard, kind="stable")
        shard, place, rows = shard[by], place[by], rows[by]
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        for i in range(0, len(edges) - 1, 64):
            spans = list(zip(edges[i : i + 64], edges[i + 1 : i + 65]))
            packed = [[pa.compress(x[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in spans] for x in (place, rows)]
            sizes = pa.array([int(b - a) for a, b in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shard[[a for a, _ in spans]]), sizes, *(pa.array(x, pa.binary()) for x in packed)], names=["shard", "n", "places", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, held, size = Permutation(at.size, key), [], 0
        for batch in (b.slice(i, PART) for b in batches for i in range(0, b.num_rows, PART)):
            held.append(_records(batch.column(0).to_numpy(), batch.column(1), kind))
            size += held[-1].nbytes
            if size >= TOGETHER:
                yield from blocks(held, order)
                held, size = [], 0
        if size:
            yield from blocks(held, order)

    rows = encoded.where("doc_id is not null and size(ids) > 0").select(F.col("doc_id").cast("long"), "ids")
    return rows.mapInArrow(run, "shard long, n long, places binary, records binary")


def write_training_order(encoded: DataFrame, folder: str, key: str, length: int = LENGTH, width: int = WIDTH, at: Domain | None = None) -> DataFrame:
    """Writes the sequences of ``encoded(doc_id, ids)`` in the order of a keyed permutation; returns the manifest.

    A sequence's number is made of its document's id and its part, the permutation of the whole domain of such
    numbers gives it a place, and its global slot is the rank of that place among those taken.  So the order
    depends on key and data alone, however the input is split.  Equal ranges of places are shards, of about
    equal size since places are pseudorandom; a shard holds its records one after another, all of the same
    size, and the manifest the shard's first slot, so that any slot is found by arithmetic and reading can
    resume there.  The tokens cross one shuffle, compressed, and aren't stored elsewhere.  Tasks write
    temporary files, which are renamed once their task has ended; the manifest is written last.

    ``at`` comes from ``domain``; without it, ``encoded`` is run once more to find it.  A null doc_id and a
    document without tokens give no sequence; repeated rows give sequences of their own (of one document's,
    the order is that of the records' bytes); an empty table gives an empty manifest.
    """
    spark, kind = encoded.sparkSession, record(length, width)
    at = at or domain(encoded, F.size("ids"), length, width)
    dealt = _dealt(encoded, at, key, kind).repartitionById(at.shards, F.col("shard").cast("int")).sortWithinPartitions("shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, root), attempt = file_store(folder), uuid.uuid4().hex
        now, places, rows = None, [], []

        def close() -> pa.RecordBatch:
            place, own = np.concatenate(places), np.concatenate(rows)
            by = np.lexsort((own["part"], own["doc"], place["low"], place["high"]))
            place, own = place[by], own[by]
            ties = np.flatnonzero((place[1:] == place[:-1]) & (own["doc"][1:] == own["doc"][:-1]) & (own["part"][1:] == own["part"][:-1]))
            for lo, hi in _stretches(ties):
                own[lo:hi] = own[lo + np.argsort([own[i].tobytes() for i in range(lo, hi)], kind="stable")]
            data, name = memoryview(own).cast("B"), f"_temporary/{attempt}-{now}"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pylist([{"shard": now, "file": f"shard-{now:06d}.bin", "temporary": name, "records": len(own), "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}])

        for batch in batches:
            for shard, n, p, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now and places:
                    yield close()
                    places, rows = [], []
                now = shard
                places.append(np.frombuffer(pa.decompress(p, PLACE.itemsize * n, "zstd"), PLACE))
                rows.append(np.frombuffer(pa.decompress(r, kind.itemsize * n, "zstd"), kind))
        if places:
            yield close()

    store, root = file_store(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)
    manifest = commit_files(cut(dealt.mapInArrow(write, MANIFEST)), folder)
    before = F.sum("records").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    manifest.select("*", F.coalesce(before, F.lit(0)).cast("long").alias("first_slot"), F.lit(length).alias("length"), F.lit(width).alias("width")).write.parquet(f"{folder}/_manifest")
    store.delete_dir(f"{root}/_temporary")
    return spark.read.parquet(f"{folder}/_manifest")


def _stretches(ties: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows in which each equals the next, given the places of such rows."""
    for run in np.split(ties, np.flatnonzero(np.diff(ties) > 1) + 1) if len(ties) else []:
        yield int(run[0]), int(run[-1]) + 2


def read_training_order(spark: SparkSession, folder: str, first_slot: int = 0, end_slot: int | None = None) -> DataFrame:
    """``(slot, doc_id, part, n_tokens, tokens)`` of the slots from ``first_slot`` on, each shard read in order.

    ``tokens`` are the bytes of the tokens in use, little-endian; ``token_array`` makes an array of them.
    """
    manifest = spark.read.parquet(f"{folder}/_manifest")
    end_slot = (1 << 62) if end_slot is None else end_slot
    wanted = manifest.where((F.col("first_slot") < end_slot) & (F.col("first_slot") + F.col("records") > first_slot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                kind = record(r["length"], r["width"])
                at, stop = max(first_slot, r["first_slot"]), min(end_slot, r["first_slot"] + r["records"])
                with store.open_input_file(f"{root}/{r['file']}") as f:
                    f.seek((at - r["first_slot"]) * kind.itemsize)
                    while at < stop:
                        n = min(stop - at, 4096)
                        rows = np.frombuffer(f.read(n * kind.itemsize), kind)
                        used = rows["used"].astype(np.int64)
                        flat = rows["tokens"][np.arange(r["length"]) < used[:, None]]
                        ends = np.concatenate([[0], np.cumsum(used * r["width"])]).astype(np.int32)
                        tokens = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), *(pa.array(np.ascontiguousarray(rows[c])) for c in ("doc", "part", "used")), tokens], names=["slot", "doc_id", "part", "n_tokens", "tokens"])
                        at += n

    files = wanted.select("file", "first_slot", "records", "length", "width").repartition(max(1, min(wanted.count(), 4 * spark.sparkContext.defaultParallelism)))
    return files.mapInArrow(run, "slot long, doc_id long, part int, n_tokens int, tokens binary")


def token_array(tokens, width: int = WIDTH):
    """The little-endian tokens of a binary column as an array of integers."""
    text, digits = F.hex(tokens), 2 * width
    one = lambda i: F.concat(*[F.substring(text, i * digits + 2 * b + 1, F.lit(2)) for b in reversed(range(width))])
    return F.transform(F.sequence(F.lit(0), (F.octet_length(tokens) / width).cast("int") - 1), lambda i: F.conv(one(i.cast("int")), 16, 10).cast("int"))
