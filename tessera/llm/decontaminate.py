"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U, add_columns, byte_class, cut, mix, text_steps, word_spans

#: Complement of ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``, with A-Z, which are lower-cased first.
WORD = byte_class(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE, STOP = 0x20, 0x01

#: Bytes of windows that are broadcast at once; more are searched in several passes.
PATTERN_BYTES = 32 << 20
SHIFT_BITS = 20
#: Word starts of a lane; the lanes of a step are searched side by side.
LANE = 64


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text as `` w1 w2 ... wn `` and a stop byte; the place of the space before each word; first words."""
    starts, ends, first = word_spans(data, off, WORD)
    size = ends - starts
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    letters = LOWER[data[WORD[data]]]
    lead = np.concatenate([[0], np.cumsum(size)])
    at = lead[:-1] + np.arange(len(size)) + 2 * doc
    out = np.full(len(letters) + len(size) + 2 * (len(off) - 1), SPACE, np.uint8)
    out[np.arange(len(letters)) + np.repeat(np.arange(len(size)) + 1 + 2 * doc, size)] = letters
    out[lead[first[1:]] + first[1:] + 2 * np.arange(len(off) - 1) + 1] = STOP
    return out, at, first


def item_windows(items: DataFrame, k: int) -> DataFrame:
    """``(item_id, pattern, n)``: each run of ``k`` words of an item, or all of its words if it has fewer."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        found = []
        for _, data, off in text_steps(texts):
            text, at, first = normalised(data, off)
            for i in range(len(off) - 1):
                a, b = first[i], first[i + 1]
                ends = [*at[a:b], at[b - 1] + _word_end(text, at[b - 1])] if b > a else []
                n = min(k, b - a)
                found.append([{"pattern": text[ends[j] : ends[j + n] + 1].tobytes(), "n": int(n)} for j in range(b - a - n + 1)] if n else [])
        return [pa.array(found, pa.list_(pa.struct([("pattern", pa.binary()), ("n", pa.int32())])))]

    rows = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    rows = add_columns(rows, "text", ["item_id"], "windows array<struct<pattern:binary,n:int>>", compute)
    return rows.select("item_id", F.inline("windows")).distinct()


def _word_end(text: np.ndarray, at: int) -> int:
    return 1 + int(np.argmax(text[at + 1 :] == SPACE))


class WuManber:
    """Patterns of similar length share a block shift table and suffix-hash buckets.

    The last block of a window's first ``m`` bytes (``m``: the shortest length of the group) is looked up in
    the shift table.  A shift above 0 skips so many positions, as no pattern begins there; at 0 the suffix hash is
    tried, then the bytes.  Every pattern begins with the space before a word, so the search goes on at the next
    of these.  The text is cut into lanes, which advance together, each by its own shift.
    """

    def __init__(self, patterns: list[bytes]) -> None:
        self.patterns = patterns
        by_size: dict[int, list[int]] = defaultdict(list)
        for i, p in enumerate(patterns):
            by_size[min(len(p).bit_length(), 6)].append(i)
        self.groups = [self._group(g) for g in by_size.values()]

    def _group(self, ids: list[int]) -> tuple:
        m = min(len(self.patterns[i]) for i in ids)
        block = min(4, m)
        shift = np.full(1 << SHIFT_BITS, m - block + 1, np.uint8 if m < 200 else np.int64)
        heads = np.frombuffer(b"".join(self.patterns[i][:m] for i in ids), np.uint8).reshape(-1, m)
        for end in range(block, m + 1):
            np.minimum.at(shift, _block_hash(heads[:, end - block : end]), m - end)
        suffix = min(8, m)
        key = _key(heads[:, m - suffix :])
        order = np.argsort(key, kind="stable")
        keys, begin = np.unique(key[order], return_index=True)
        return m, block, shift, suffix, keys, np.append(begin, len(order)), np.array(ids)[order]

    def search(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(index into at, pattern)`` of every occurrence."""
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        where, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m, block, shift, suffix, keys, begin, ids in self.groups:
            live = self._unskipped(padded, at[: np.searchsorted(at, len(text) - m, "right")], m, block, shift)
            if not len(live):
                continue
            key = np.ndarray((len(text) + 1,), np.uint64, padded, strides=(1,))[at[live] + m - suffix]
            if suffix < 8:
                key &= (U(1) << U(8 * suffix)) - U(1)
            bucket = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = keys[bucket] == key
            live, bucket = live[same], bucket[same]
            if not len(live):
                continue
            order = np.argsort(bucket, kind="stable")
            live, bucket = live[order], bucket[order]
            for b, lo, hi in zip(*_runs(bucket), strict=True):
                for i in ids[begin[b] : begin[b + 1]]:
                    p = np.frombuffer(self.patterns[i], np.uint8)
                    rows = live[lo:hi][at[live[lo:hi]] + len(p) <= len(text)]
                    for j in range(0, len(rows), 4096):
                        part = rows[j : j + 4096]
                        hit = part[(text[at[part][:, None] + np.arange(len(p))] == p).all(1)]
                        where.append(hit)
                        which.append(np.full(len(hit), i))
        return np.concatenate(where), np.concatenate(which)

    @staticmethod
    def _unskipped(padded: np.ndarray, at: np.ndarray, m: int, block: int, shift: np.ndarray) -> np.ndarray:
        """Indices into ``at`` of the positions that are reached and have a shift of 0."""
        words = np.ndarray((len(padded) - 3,), np.uint32, padded, strides=(1,))
        now, found = np.arange(0, len(at), LANE), [np.zeros(0, np.int64)]
        stop = np.minimum(now + LANE, len(at))
        while len(now):
            last = words[at[now] + m - block]
            skip = shift[_fold(last & np.uint32((1 << 8 * block) - 1))]
            found.append(now[skip == 0])
            now = np.where(skip == 0, now + 1, np.searchsorted(at, at[now] + skip))
            now, stop = now[now < stop], stop[now < stop]
        return np.sort(np.concatenate(found))


def _fold(x: np.ndarray) -> np.ndarray:
    """The place of a block in the shift table."""
    return (x * np.uint32(2654435761)) >> np.uint32(32 - SHIFT_BITS)


def _block_hash(rows: np.ndarray) -> np.ndarray:
    x = np.zeros(len(rows), np.uint32)
    for j in range(rows.shape[1]):
        x |= rows[:, j].astype(np.uint32) << np.uint32(8 * j)
    return _fold(x)


def _key(rows: np.ndarray) -> np.ndarray:
    x = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        x |= rows[:, j].astype(np.uint64) << U(8 * j)
    return x


def _runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.diff(v, prepend=-1))
    return v[begin], begin, np.append(begin[1:], len(v))


def _searcher(windows: list[tuple[bytes, int, list[str]]]) -> Callable[[pa.Array], list[pa.Array]]:
    """For each text: its words, the ranges of words that are hit, and the items that occur."""
    wm = WuManber([w for w, _, _ in windows])

    def compute(texts: pa.Array) -> list[pa.Array]:
        sizes = np.array([n for _, n, _ in windows] or [0], np.int64)
        n_words, spans, items = [], [], []
        for _, data, off in text_steps(texts):
            text, at, first = normalised(data, off)
            where, which = wm.search(text, at)
            n_words += np.diff(first).tolist()
            edge = np.zeros(len(at) + 1, np.int64)
            np.add.at(edge, where, 1)
            np.add.at(edge, where + sizes[which], -1)
            hit = np.cumsum(edge[:-1]) > 0
            doc = np.searchsorted(first, where, "right") - 1
            own: dict[int, set[str]] = defaultdict(set)
            for d, i in set(zip(doc.tolist(), which.tolist(), strict=True)):
                own[d].update(windows[i][2])
            for d in range(len(off) - 1):
                items.append(sorted(own[d]) if d in own else [])
                spans.append(_ranges(hit[first[d] : first[d + 1]]) if d in own else [])
        return [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]

    return compute


def _ranges(hit: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def contamination(docs: DataFrame, items: DataFrame, k: int = 10, keep: list[str] | None = None, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """Where windows of ``k`` consecutive item words occur in the texts.

    Adds to the ``keep`` columns (default: doc_id): n_words, n_hit (words inside an occurrence), spans (ranges
    ``[first, end)`` of hit words), items (sorted ids of the items with occurring windows).

    Case of A-Z is ignored; an item with fewer words is one window, one without words has none.  The windows
    are counted first: up to ``pattern_bytes`` of them are broadcast, more are searched in passes.  Null and
    empty texts have no words; items with a null id take no part, items with equal ids count as one; repeated
    rows give repeated results; empty tables give empty or unhit results.  Other columns are ignored.
    """
    keep = ["doc_id"] if keep is None else keep
    patterns = cut(item_windows(items, k).groupBy("pattern", "n").agg(F.collect_set("item_id").alias("ids")))
    total = patterns.agg(F.sum(F.length("pattern") + F.aggregate("ids", F.lit(0), lambda t, i: t + F.length(i)))).first()[0] or 0
    passes = max(1, -(-total // pattern_bytes))
    plain = "text" in keep and docs.schema["text"].dataType.simpleString() == "string"
    own = {c: "text" if plain and c == "text" else f"kept_{i}" for i, c in enumerate(keep) if c.lower() not in ("n_words", "n_hit", "spans", "items")}
    out = docs.select(docs["text"].cast("string").alias("text"), *[docs[c].alias(n) for c, n in own.items() if n != "text"])
    for i in range(passes):
        part = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == i)
        sent = docs.sparkSession.sparkContext.broadcast([(bytes(r.pattern), r.n, list(r.ids)) for r in part.collect()])
        before = [c for c in out.columns if c != "text" and c != "n_words"]
        schema = f"n_words bigint, spans_{i} array<array<bigint>>, items_{i} array<string>"
        out = add_columns(out, "text", [*before, *(["text"] if plain or i < passes - 1 else [])], schema, _search_once(sent))
        if i:
            out = out.withColumn(f"spans_{i}", F.concat(f"spans_{i - 1}", f"spans_{i}")).withColumn(f"items_{i}", F.array_union(f"items_{i - 1}", f"items_{i}")).drop(f"spans_{i - 1}", f"items_{i - 1}")
        if passes > 1:
            out = cut(out)
    spans = F.col(f"spans_{passes - 1}")
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda t, s: t + s[1] - s[0])
    if passes > 1:
        n_hit = F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s[0], s[1] - 1))))).cast("long")
    return out.select(*[F.col(n).alias(c) for c, n in own.items()], "n_words", n_hit.alias("n_hit"), spans.alias("spans"), F.array_sort(f"items_{passes - 1}").alias("items"))


_SEARCHERS: dict[str, Callable] = {}


def _search_once(sent) -> Callable[[pa.Array], list[pa.Array]]:
    """Tables are built once for each broadcast and Python worker."""
    token = uuid.uuid4().hex

    def compute(texts: pa.Array) -> list[pa.Array]:
        if token not in _SEARCHERS:
            _SEARCHERS.clear()
            _SEARCHERS[token] = _searcher(sent.value)
        return _SEARCHERS[token](texts)

    return compute
