"""A vector index on disk: fixed-stride matrix shards, a map from ids to rows, and a manifest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Shards of an index, as many as ids are dealt over by hash; rows that a task reads or writes at once.
SHARDS, AT_ONCE = 64, 4096


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "file:///" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _sum_digest(value: str):
    """A digest of hex hashes that is a sum, so that tasks add it up and no order matters."""
    parts = [F.coalesce(F.sum(F.conv(F.substring(value, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(5)]
    return F.sha2(F.concat_ws("/", F.count("*").cast("string"), *parts), 256)


def write_index(rows: DataFrame, folder: str, version: str, dims: int, earlier: str | None = None, shards: int = SHARDS) -> DataFrame:
    """Writes ``rows`` (id, content_hash, vector) as ``version`` and returns its manifest.

    An id's shard is a hash of it, its row the rank of its id within the shard; a shard's file is named after its
    contents.  Shards that are in the ``earlier`` version with the same contents aren't written again: the manifest
    points to their files, and their part of the id map is taken over.  Tasks write under temporary names; the map and
    then the manifest come last, so that a version is either whole or not there.

    ValueError if an id is null or repeated, or a vector hasn't ``dims`` finite components.
    """
    spark = rows.sparkSession
    if earlier is not None:
        before = spark.read.parquet(f"{folder}/{earlier}/manifest")
        shards = before.first().shards
    vector = F.transform("vector", lambda x: x.cast("float"))
    fine = (F.size("vector") == dims) & F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    bad = rows.where(~F.coalesce(fine & F.col("id").isNotNull(), F.lit(False))).count()
    if bad or not rows.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError(f"{bad} rows without an id or a whole vector, or repeated ids")
    kind = dict(rows.dtypes)["id"]
    sha = F.sha2(F.to_json(F.struct(F.col("id"), F.col("content_hash"), vector.alias("v")), {"ignoreNullFields": "false"}), 256)
    placed = rows.select("id", "content_hash", vector.alias("vector"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), sha.alias("sha"))
    now = placed.groupBy("shard").agg(F.count("*").alias("rows"), _sum_digest("sha").alias("digest"))
    now = now.withColumn("file", F.concat(F.lpad(F.col("shard").cast("string"), 5, "0"), F.lit("-"), F.substring("digest", 1, 24), F.lit(".f32")))
    now.write.mode("overwrite").parquet(f"{folder}/{version}/plan")
    now = spark.read.schema("shard int, rows long, digest string, file string").parquet(f"{folder}/{version}/plan")
    fresh = now.join(before.select("shard", "digest"), ["shard", "digest"], "left_anti") if earlier is not None else now

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(f"{root}/shards", recursive=True)
        name, out, temporary, n = None, None, "", 0
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            files = batch.column(4).to_pylist()
            edges = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]] + [len(files)]
            place = np.empty(len(files), np.int64)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if files[a] != name:
                    if out is not None:
                        out.close()
                        store.move(temporary, f"{root}/shards/{name}")
                    name, temporary, n = files[a], f"{root}/shards/_{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(temporary, compression=None)
                flat = batch.column(2).slice(a, b - a).flatten().to_numpy().astype("<f4")
                out.write(flat.tobytes())
                place[a:b] = np.arange(n, n + b - a)
                n += b - a
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(place)], names=["id", "content_hash", "shard", "row"])
        if out is not None:
            out.close()
            store.move(temporary, f"{root}/shards/{name}")

    dealt = placed.join(F.broadcast(fresh.select("shard", "file")), "shard").select("id", "content_hash", "vector", "shard", "file")
    entries = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "id").mapInArrow(write, f"id {kind}, content_hash string, shard int, row long")
    entries.write.mode("overwrite").parquet(f"{folder}/{version}/ids/part=new")
    if earlier is not None:
        same = now.join(F.broadcast(fresh.select("shard")), "shard", "left_anti").select("shard")
        spark.read.parquet(f"{folder}/{earlier}/ids").drop("part").join(F.broadcast(same), "shard", "left_semi").write.mode("overwrite").parquet(f"{folder}/{version}/ids/part=old")
    first = F.coalesce(F.sum("rows").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    now.withColumns({"first_row": first, "dims": F.lit(dims), "shards": F.lit(shards)}).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{version}/manifest")
    return spark.read.parquet(f"{folder}/{version}/manifest")


def read_rows(spark: SparkSession, folder: str, version: str, first: int = 0, end: int | None = None) -> DataFrame:
    """``(shard, row, number, vector)`` of the rows from ``first`` to ``end`` of the whole matrix, found by arithmetic.

    ValueError in a task if a shard's file hasn't the size that its rows need.
    """
    end = (1 << 62) if end is None else end
    wanted = spark.read.parquet(f"{folder}/{version}/manifest").where((F.col("first_row") < end) & (F.col("first_row") + F.col("rows") > first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                width = 4 * r["dims"]
                if store.get_file_info(f"{root}/shards/{r['file']}").size != r["rows"] * width:
                    raise ValueError(f"{r['file']} is not whole")
                at, stop = max(first, r["first_row"]) - r["first_row"], min(end - r["first_row"], r["rows"])
                with store.open_input_file(f"{root}/shards/{r['file']}") as f:
                    f.seek(at * width)
                    while at < stop:
                        n = min(stop - at, AT_ONCE)
                        flat = np.frombuffer(f.read(n * width), "<f4")
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, r["dims"], dtype=np.int32)), pa.array(flat))
                        place = np.arange(at, at + n)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["shard"], np.int32)), pa.array(place), pa.array(place + r["first_row"]), lists], names=["shard", "row", "number", "vector"])
                        at += n

    tasks = max(1, min(wanted.count(), 4 * spark.sparkContext.defaultParallelism))
    return wanted.select("shard", "file", "rows", "first_row", "dims").repartition(tasks).mapInArrow(run, "shard int, row long, number long, vector array<float>")


def read_index(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """``(id, content_hash, number, vector)`` of every row of a version."""
    ids = spark.read.parquet(f"{folder}/{version}/ids").drop("part")
    return ids.join(read_rows(spark, folder, version), ["shard", "row"]).select("id", "content_hash", "number", "vector")
