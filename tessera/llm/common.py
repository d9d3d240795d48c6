"""Shared helpers: byte-level word scanning, content hashes, and tables cut out of the lineage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Words above this many bytes are hashed one by one.
LONG_WORD = 512

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the session has no such setting (tests on one machine), the warehouse folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: no lineage, no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_class(*members: int | range) -> np.ndarray:
    """A table over the 256 byte values, true for ``members``."""
    table = np.zeros(256, bool)
    for m in members:
        table[list(m) if isinstance(m, range) else m] = True
    return table


#: Complement of ``[\x20\x09-\x0D]``.
NOT_SPACE = ~byte_class(0x20, range(0x09, 0x0E))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = (h ^ (h >> U(30))) * _M2
    h = (h ^ (h >> U(27))) * _M3
    return h ^ (h >> U(31))


def text_steps(column: pa.Array | pa.ChunkedArray, size: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields ``(first row, bytes, offsets)`` in steps of about ``size`` bytes; a null is an empty text."""
    for chunk, base in _chunks(column):
        chunk = chunk.cast(pa.large_binary())
        _, offsets, data = chunk.buffers()
        off = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            j = min(j, len(chunk))
            yield base + i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def _chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[pa.Array, int]]:
    base = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            yield chunk, base
        base += len(chunk)


def word_spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes inside each text: starts, ends, and each text's first word (one more at the end)."""
    w = word_byte[data]
    before, after = np.zeros_like(w), np.zeros_like(w)
    before[1:], after[:-1] = w[:-1], w[1:]
    inner = offsets[(offsets > 0) & (offsets < len(w))]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time over all words together."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), np.uint64, buffer=padded, strides=(1,))
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(np.uint64) * _M1 + U(seed))
    live, at = np.arange(len(starts)), starts
    left = np.minimum(size, LONG_WORD)
    while len(live):
        part = blocks[at]
        short = left < 8
        if short.any():
            part = np.where(short, part & ((U(1) << (U(8) * np.minimum(left, 7).astype(np.uint64))) - U(1)), part)
        h[live] = mix((h[live] ^ part) * _M1 + _M2)
        go = left > 8
        live, at, left = live[go], at[go] + 8, left[go] - 8
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = _long_hash(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def _long_hash(word: bytes, seed: int) -> np.uint64:
    import hashlib

    return U(int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little"))


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``k`` word hashes from each position on (positions without ``k`` left are absent)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, mix(np.array([seed + k], np.uint64))[0])
    for j in range(k):
        out *= _M1
        out += h[j : j + n]
        out ^= out >> U(29)
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


#: Rows of a batch that goes back to Spark.
BACK = 2000


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in smaller batches; a worker gives its memory back at the end of each task, as it stays alive."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in run(batches):
                for i in range(0, batch.num_rows, BACK):
                    yield batch.slice(i, BACK)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Returns free memory to the system (also the C library's, where it offers that)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def add_columns(docs: DataFrame, text: str, keep: list[str], schema: str, compute: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``keep`` columns of ``docs`` plus those of ``schema``, which ``compute(texts)`` gives as arrays per batch.

    A kept column whose name clashes with a new one gives way to it.
    """
    new = {f.split()[0].lower() for f in schema.split(", ")}
    kept = [c for c in keep if c.lower() not in new]
    names = [f.split()[0] for f in schema.split(", ")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    own = kept.index(text) if text in kept and types[text] == "string" else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BACK) for b in batches for i in range(0, b.num_rows, BACK)):
            added = compute(batch.column(own))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *added], names=[*kept, *names])

    out = ", ".join([*(f"`{c}` {types[c]}" for c in kept), schema])
    more = [] if own < len(kept) else [docs[text].cast("string").alias("text_in")]
    return map_batches(docs.select(*[docs[c] for c in kept], *more), run, out)


def file_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder that a path or URI names."""
    if folder.startswith("file:"):
        folder = "file:///" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def commit_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Renames the files of ``manifest(temporary, file, bytes)`` to their final names; doing it again does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                if store.get_file_info(f"{root}/{r['temporary']}").type == fs.FileType.File:
                    store.move(f"{root}/{r['temporary']}", f"{root}/{r['file']}")
                if store.get_file_info(f"{root}/{r['file']}").size != r["bytes"]:
                    raise OSError(f"{r['file']} is not whole")
            yield batch

    return manifest.mapInArrow(run, manifest.schema).drop("temporary")
