"""WARC archives: a deterministic sharded writer, and a reader."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import commit_files, cut, file_store

#: Ids that set the bounds of the shards: about so many, chosen by a hash of the id, reach the driver.
BOUND_IDS = 20_000
LEAST_SHARDS = 256
#: Payload bytes of a shard, of the shards that one task writes, and compressed bytes after which a file is closed.
SHARD_BYTES, TASK_BYTES, FILE_BYTES = 1 << 28, 1 << 28, 1 << 25
#: Bytes that the reader decompresses at once; what follows a member in them is read again.
FEED = 1 << 13
#: WARC-Date of every record, so that equal input gives equal files.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "shard int, file string, temporary string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, block_digest string, refers_to long, block binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member; with ``refers_to`` a revisit of the page that has the same payload, which is left out."""
    revisit, digest = refers_to is not None, base32_sha1(payload)
    kind, block = ("revisit", b"") if revisit else ("response", payload)
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", f"X-Payload-Bytes: {len(payload)}",
    ]
    head += [f"X-Page-ID: {page_id}"] * (page_id is not None) + [f"WARC-Target-URI: {uri}"] * (url is not None)
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def read_records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a gzip archive, one member in memory at a time."""
    z, out = zlib.decompressobj(31), io.BytesIO()
    while piece := stream.read(1 << 20):
        at, view = 0, memoryview(piece)
        while at < len(piece):
            part = view[at : at + FEED]
            out.write(z.decompress(part))
            at += len(part) - len(z.unused_data)
            if z.eof:
                yield _parsed(out.getvalue())
                z, out = zlib.decompressobj(31), io.BytesIO()
    if out.tell():
        raise ValueError("archive ends inside a record")


def _parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    if not lines[0].startswith("WARC/") or body[size:] != b"\r\n\r\n":
        raise ValueError("malformed record")
    return headers, body[:size]


def shard_bounds(pages: DataFrame, shards: int, ids: int = BOUND_IDS) -> list[int]:
    """Upper bounds of all shards but the last, from ids whose hash picks them: they depend on the data alone."""
    rows = pages.where("page_id is not null")
    step = max(1, rows.count() // ids)
    picked = np.sort([r.page_id for r in rows.where(F.pmod(F.xxhash64("page_id"), F.lit(step)) == 0).select("page_id").distinct().collect()])
    return [int(picked[len(picked) * i // shards]) for i in range(1, shards)] if len(picked) else []


class Roll:
    """Archive files of one shard, written to temporary names; a new file starts once one has ``limit`` bytes."""

    def __init__(self, folder: str, limit: int, attempt: str) -> None:
        self.store, self.root = file_store(folder)
        self.limit, self.attempt, self.done, self.out = limit, attempt, [], None

    def add(self, shard: int, data: bytes) -> None:
        if self.out is not None and (self.shard != shard or self.size >= self.limit):
            self.close()
        if self.out is None:
            seq = self.seq + 1 if getattr(self, "shard", None) == shard else 0
            self.shard, self.seq, self.size, self.records, self.sha = shard, seq, 0, 0, hashlib.sha256()
            self.name = f"part-{shard:06d}-{seq:04d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}-{self.name}"
            self.out = self.store.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.name, self.temporary, self.records, self.size, self.sha.hexdigest()))
            self.out = None


def write_warc(pages: DataFrame, folder: str, shards: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` as WARC files below ``folder`` and returns their manifest.

    Of the records with equal payloads the one with the largest page_id is a response and the others revisit
    it.  Records are range-sorted by page_id into shards whose bounds depend on the data alone; a file is
    closed once it holds ``file_bytes`` of compressed records.  Tasks write to temporary names of their own,
    so a lost or repeated task leaves no half file behind; only files in the manifest of finished tasks are
    renamed, and the manifest is written last.  Equal input gives equal files.

    Null html is an empty payload, a null url has no target URI; a null page_id sorts first and never is a
    response while another has the payload.  Of rows repeated in full the first is the response and the
    others revisit it.  An empty table gives an empty manifest.  Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.select("page_id", F.sha2("payload", 256).alias("key"), F.length("payload").alias("size"))
    keys = cut(keyed)
    groups = cut(keys.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(LEAST_SHARDS, -(-total // SHARD_BYTES))
    bounds = np.array(shard_bounds(keys, shards), np.int64)
    marks = keys.join(groups, "key").select("page_id", "key", "refers_to").distinct()

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(bounds, b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "shard"])

    schema = "page_id long, url string, payload binary, key string, refers_to long, mark int"
    both = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("key"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("mark"))
    both = both.unionByName(marks.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "key", "refers_to", F.lit(0).alias("mark")))
    dealt = both.mapInArrow(shard_of, schema + ", shard int")
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES)))
    dealt = dealt.repartitionById(tasks, "shard").sortWithinPartitions("shard", "page_id", "key", "mark", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, now, mark, first = Roll(folder, file_bytes, uuid.uuid4().hex), None, None, True
        for batch in batches:
            for r in batch.to_pylist():
                if (r["page_id"], r["key"]) != now:
                    now, mark, first = (r["page_id"], r["key"]), None, True
                if not r["mark"]:
                    mark = r
                    continue
                revisit = mark is not None and mark["refers_to"] is not None and (mark["refers_to"] != r["page_id"] or not first)
                roll.add(r["shard"], record(r["page_id"], r["url"], r["payload"], mark["refers_to"] if revisit else None))
                first = False
        roll.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*roll.done, strict=True) if roll.done else [[]] * 6, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    store, root = file_store(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)
    manifest = cut(dealt.mapInArrow(write, MANIFEST))

    committed = commit_files(manifest, folder)
    committed.write.parquet(f"{folder}/_manifest")
    store.delete_dir(f"{root}/_temporary")
    return spark.read.schema(committed.schema).parquet(f"{folder}/_manifest")


def read_warc(spark: SparkSession, folder: str, blocks: bool = True) -> DataFrame:
    """The records of every archive in the manifest below ``folder``; sizes and digests are checked while reading.

    ``blocks=False`` leaves the block null.  A revisit carries the digest and the size of the payload it refers to.
    """
    manifest = spark.read.parquet(f"{folder}/_manifest").select("file", "bytes")
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for h, block in read_records(stream):
                        whole = h["WARC-Type"] == "revisit" or (h["WARC-Payload-Digest"], int(h["X-Payload-Bytes"])) == (h["WARC-Block-Digest"], len(block))
                        if not whole or h["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"wrong digest in {name}")
                        ids = [int(h[k]) if k in h else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                        rows.append((ids[0], h.get("WARC-Target-URI"), h["WARC-Type"], h["WARC-Payload-Digest"][5:], int(h["X-Payload-Bytes"]), h["WARC-Block-Digest"][5:], ids[1], block if blocks else None))
                        size += len(block)
                        if size > 1 << 23:
                            yield _batch(rows, types, names)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, types, names)

    files = manifest.repartition(max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism)))
    return files.mapInArrow(run, RECORD)


def _batch(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
