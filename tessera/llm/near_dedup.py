"""MinHash near-duplicate detection: one-permutation hashing, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NOT_SPACE, U, cut, map_batches, mix, signed, text_steps, window_hashes, word_hashes, word_spans
from tessera.llm.graph import components

#: Bins of the one-permutation hash, and rows of a band.  At a similarity of 0.85 a pair misses all 30 bands
#: with a chance of 2e-8.
BINS, ROWS = 150, 5
#: A pair whose share of equal bins lies this far below the threshold isn't confirmed.  The share's measured standard
#: deviation at 0.85 is 0.035 for sets of 14 or 20 shingles and 0.028 for 200 or more, so this is seven of them: fewer
#: are lost than by the bands.
SLACK = 0.25
#: Members of one block, when the members of a bucket are compared on their full sets.
BLOCK = 128
#: Bits of the map that spares texts without a candidate from being read a second time; bounded, so false hits may pass.
MAP_BITS = 1 << 23

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: For each bin, the order in which it looks for a filled one.
_RANK = np.random.default_rng(20240501).random((BINS, BINS)).argsort(1).argsort(1)
_BIN_SEED = U(0x5851F42D4C957F2D)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles; fewer words are one shingle, no words none."""
    for _, data, off in text_steps(column):
        data = LOWER[data]
        starts, ends, first = word_spans(data, off, NOT_SPACE)
        h = word_hashes(data, starts, ends)
        windows = window_hashes(h, k)
        for i in range(len(off) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield np.unique(windows[a : b - k + 1])
            else:
                yield window_hashes(h[a:b], b - a) if b > a else h[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """One hash per bin; an empty bin borrows from the filled bin that comes first in its own random order."""
    g = mix(shingles ^ _BIN_SEED)
    bins = ((g >> U(32)) * U(BINS) >> U(32)).astype(np.int64)
    low = np.full(BINS, ~U(0))
    np.minimum.at(low, bins, g)
    full = np.zeros(BINS, bool)
    full[bins] = True
    empty, filled = np.flatnonzero(~full), np.flatnonzero(full)
    if len(empty):
        low[empty] = low[filled[_RANK[empty][:, filled].argmin(1)]]
    return low


def _band_hashes(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS)
    h = np.arange(len(rows), dtype=np.uint64)
    for j in range(ROWS):
        h = mix(h * U(31) + rows[:, j])
    return h


SIGNED = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sig binary"


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """Per row: size of the shingle set, a 128-bit fingerprint of the set, band hashes, and a byte of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp1, fp2, bands, sigs = [], [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                fp1.append(int(signed(np.atleast_1d(mix(s ^ U(11)).sum(dtype=np.uint64)))[0]))
                fp2.append(int(signed(np.atleast_1d(mix(s * U(5) + U(3)).sum(dtype=np.uint64)))[0]))
                if len(s):
                    sig = signature(s)
                    bands.append(signed(_band_hashes(sig)))
                    sigs.append((sig & U(255)).astype(np.uint8).tobytes())
                else:
                    bands.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "sig"],
            )

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SIGNED)


def _id_map(ids: DataFrame, spark) -> object:
    """A broadcast bit map of at most MAP_BITS bits over hashed ids: one row per 32768 bits reaches the driver."""
    at = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    rows = ids.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    return spark.sparkContext.broadcast({r.k: bytes(r.bits) for r in rows})


def shingle_table(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``(id, shingles)`` of the rows whose id may be among ``ids``: all of them, and a few more."""
    known = _id_map(ids, docs.sparkSession)
    at = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = {b: np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool) for b, bits in known.value.items()}
        for batch in batches:
            bucket, bit = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = np.zeros(len(bucket), bool)
            for b in np.unique(bucket):
                if (m := maps.get(int(b))) is not None:
                    here = bucket == b
                    keep[here] = m[bit[here]]
            batch = batch.filter(pa.array(keep))
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    rows = rows.select("id", "text", F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("bit"))
    return map_batches(rows, run, "id long, shingles binary")


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: int, k: int) -> DataFrame:
    """The pairs ``(a, b)`` with 100 * intersection >= threshold * union, on the full sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    table = cut(shingle_table(docs, ids, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sa, sb = batch.column(2), batch.column(3)
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                raw = sa[i].as_buffer()
                if a[i] != last or left.nbytes != raw.size:
                    last, left = a[i], np.frombuffer(raw, np.uint64).copy()
                right = np.frombuffer(sb[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                good[i] = 100 * both >= threshold * (len(left) + len(right) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    right = pairs.join(table.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    wide = table.select(F.col("id").alias("a"), F.col("shingles").alias("sa")).join(right, "a")
    return map_batches(wide.select("a", "b", "sa", "sb"), run, "a long, b long").distinct()


def _likely(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose set sizes and equal bins allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, BINS)
            y = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, BINS)
            keep = (x == y).mean(1) >= threshold / 100 - SLACK
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    side = lambda c: classes.select(F.col("rep").alias(c), F.col("sig").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    joined = joined.where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _blocks(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Pairs of blocks ``x, y`` (of ``fields``) inside buckets that hold several components.

    The component of the bucket's centre is left whole: its members are compared with the other members only.
    Blocks hold about BLOCK rows, so that neither a bucket nor its pairs meet in one task.
    """
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")).withColumn("rest", F.col("component") != F.col("main"))
    blocks = cut(rows.groupBy("key", "nb", "rest", "blk").agg(F.collect_list(F.struct(*fields)).alias("rows")))
    target = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: F.struct(F.lit(False).alias("rest"), i.alias("blk")))
    own = F.transform(F.sequence(F.col("blk"), F.col("nb") - 1), lambda i: F.struct(F.lit(True).alias("rest"), i.alias("blk")))
    left = blocks.where("rest").select("key", F.col("rows").alias("x"), F.explode(F.concat(target, own)).alias("t")).select("key", "x", "t.rest", "t.blk")
    return left.join(blocks.select("key", "rest", "blk", F.col("rows").alias("y")), ["key", "rest", "blk"]).select("key", "x", "y")


def _column(column: pa.Array, i: int, field: str) -> pa.Array:
    return column[i].values.field(field)


#: Shared shingles that one matrix product of two blocks takes.
SHARED = 8192


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The size of each intersection of a left with a right set, by products of 0/1 matrices over the shared shingles."""
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    common = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out
    placed = []
    for values, row in sides:
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        known = common[at] == values
        order = np.argsort(at[known], kind="stable")
        placed.append((at[known][order], row[known][order]))
    for lo in range(0, len(common), SHARED):
        width, both = min(SHARED, len(common) - lo), []
        for (at, row), n in zip(placed, out.shape, strict=True):
            i, j = np.searchsorted(at, [lo, lo + width])
            m = np.zeros((n, width), np.float32)
            m[row[i:j], at[i:j] - lo] = 1
            both.append(m)
        out += both[0] @ both[1].T
    return out


def _links_of_blocks(rows: DataFrame, threshold: int) -> DataFrame:
    """Links across the components of buckets.

    The full sets come along, and all pairs of two blocks are judged exactly where the blocks meet; of the links
    found there only those leave that join components which no other link of the two blocks joins, so that at most
    as many links leave as classes came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, (x, y) = [], batch.columns
            for i in range(batch.num_rows):
                up: dict[int, int] = {}

                def root(v: int, up: dict[int, int] = up) -> int:
                    while (w := up.setdefault(v, v)) != v:
                        up[v] = v = up[w]
                    return v

                (ra, ca, na), (rb, cb, nb) = ([_column(c, i, f).to_numpy() for f in ("rep", "component", "n_shingles")] for c in (x, y))
                sa, sb = ([np.frombuffer(s.as_buffer(), np.uint64) for s in _column(c, i, "shingles")] for c in (x, y))
                both = _intersections(sa, sb)
                good = (100 * both >= threshold * (na[:, None] + nb - both)) & (ca[:, None] != cb)
                for at, j in zip(*np.nonzero(good), strict=True):
                    a, b = root(int(ca[at])), root(int(cb[j]))
                    if a != b:
                        up[a] = b
                        found.append((int(ra[at]), int(rb[j])))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    met = _blocks(rows, ["rep", "component", "n_shingles", "shingles"])
    return map_batches(met.select("x", "y"), run, "a long, b long").distinct()


def _across(members: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, threshold: int, k: int) -> DataFrame:
    """The links inside buckets that still hold several components, except those within one component.

    Of buckets with the same members (two hashes of them tell) one is looked at.
    """
    node = labels.select(F.col("node").alias("rep"), "component")
    m = cut(members.join(node, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component")))
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "rep")).alias(f"h{seed}") for seed in (1, 2)]
    mixed = m.groupBy("key").agg(F.count("*").alias("n"), F.min_by("component", "rep").alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi"), *same).where("lo <> hi")
    mixed = mixed.groupBy("n", "h1", "h2").agg(F.min(F.struct("key", "main")).alias("one")).select("one.key", "one.main", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    rows = cut(m.join(cut(mixed), "key"))
    sets = cut(shingle_table(docs, rows.select(F.col("rep").alias("id")), k)).withColumnRenamed("id", "rep")
    return _links_of_blocks(rows.join(classes.select("rep", "n_shingles"), "rep").join(sets, "rep"), threshold)


def near_duplicates(docs: DataFrame, threshold: int = 85, k: int = 5) -> DataFrame:
    """Groups of documents with 100 * intersection >= threshold * union of their ``k``-word shingle sets.

    Rows with one and the same set form a class, kept as its smallest doc_id.  Classes meet in banded buckets;
    in each bucket every class is a candidate of the smallest one only (a star), and a candidate counts after
    a check on the full sets.  Where a bucket then still holds several components, the classes of different
    components are compared as well, in blocks.  A link between two classes of a bucket is lost only where their bins
    differ by more than SLACK, which is rarer than that they share no bucket.

    Returns per row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).
    Null or wordless text: an empty set, linked with nothing.  Null doc_id: takes no part, component_id null,
    kept.  Repeated rows give repeated results; rows that share a doc_id count as one node.  Other columns are
    ignored; an empty table gives an empty result.
    """
    signed_rows = cut(signatures(docs, k))
    own = ["n_shingles", "fp1", "fp2"]
    classes = cut(
        signed_rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy(*own)
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    )
    rows = classes.select("rep", F.explode("bands").alias("key"))
    shared = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("center")).where("n > 1").select("key", "center"))
    members = cut(rows.join(shared, "key"))
    star = cut(members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct())
    links = cut(confirmed(cut(_likely(star, classes, threshold)), docs, threshold, k))
    links = links.union(cut(_across(members.select("key", "rep"), classes, components(links), docs, threshold, k)))
    labels = components(links)
    node = classes.select(*own, "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    node = cut(node.select(*own, F.coalesce("component", "rep").alias("component")))
    out = signed_rows.select("doc_id", *own).join(node, own, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
