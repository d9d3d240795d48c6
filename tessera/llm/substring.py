"""Substring dedup: suffix automata over shards of repeated passages, streamed for matching statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NOT_SPACE, U, cut, map_batches, mix, signed, text_steps, window_hashes, word_hashes, word_spans

#: Words of the gram that anchors a window: each window belongs to its gram with the least hash.
GRAM = 5
#: Words of one automaton.
SHARD_WORDS = 50_000
#: An anchor with more distinct passages than this is dealt out by window instead.
WIDE = 256
#: Bits of the maps that spare passages and texts without a repeat from being shuffled; bounded, so false hits may pass.
ANCHOR_BITS, DOC_BITS = 1 << 26, 1 << 23

KEY = "doc_id long, fp long"


class SuffixAutomaton:
    """All substrings of several sequences; each state knows the least document in which its strings occur."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [1 << 63]

    def _state(self, size: int, link: int, after: dict[int, int], first: int) -> int:
        self.next.append(after)
        self.size.append(size)
        self.link.append(link)
        self.first.append(first)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the strings one longer than those of ``p``: ``q``, or a copy of it for the shorter ones."""
        nxt, size, link = self.next, self.size, self.link
        if size[q] == size[p] + 1:
            return q
        copy = self._state(size[p] + 1, link[q], dict(nxt[q]), 1 << 63)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def add(self, words: list[int], doc: int) -> None:
        nxt, link, first = self.next, self.link, self.first
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                last = self._split(last, q, c)
            else:
                p, cur = last, self._state(self.size[last] + 1, 0, {}, 1 << 63)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    link[cur] = self._split(p, nxt[p][c], c)
                last = cur
            if doc < first[last]:
                first[last] = doc

    def finish(self) -> None:
        """A string occurs wherever a longer one that ends in it does."""
        first, link = self.first, self.link
        for s in sorted(range(1, len(link)), key=self.size.__getitem__, reverse=True):
            if first[s] < first[link[s]]:
                first[link[s]] = first[s]

    def matches(self, words: list[int], k: int) -> list[int | None]:
        """For every place from the ``k``-th word on, the least document with the last ``k`` words, if any.

        The walk keeps the longest suffix that occurs (the matching statistic); where it has ``k`` words or
        more, the state of the last ``k`` lies above on the suffix links.
        """
        nxt, link, size, first = self.next, self.link, self.size, self.first
        at, length, out = 0, 0, []
        for i, c in enumerate(words):
            while at and c not in nxt[at]:
                at = link[at]
                length = size[at]
            if c in nxt[at]:
                at = nxt[at][c]
                length += 1
            if i >= k - 1:
                s = at
                while length >= k and size[link[s]] >= k:
                    s = link[s]
                out.append(first[s] if length >= k else None)
        return out


class _Words:
    """Word hashes of a step of texts, and the passages that its windows form."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.starts, self.ends, self.first = word_spans(data, off, NOT_SPACE)
        self.h = word_hashes(data, self.starts, self.ends)

    def passages(self, k: int) -> tuple[np.ndarray, ...]:
        """Document, first window (place in the step), number of windows, anchor, and content hash of each passage.

        A passage is a run of windows with one and the same anchor gram; it has at most k - GRAM + 1 windows.
        """
        h, n = self.h, len(self.h) - k + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, none, none.view(np.uint64), none.view(np.uint64)
        grams, windows = window_hashes(h, GRAM), window_hashes(h, k)
        least, place = grams[:n].copy(), np.arange(n)
        for j in range(1, k - GRAM + 1):
            lower = grams[j : j + n] < least
            np.copyto(least, grams[j : j + n], where=lower)
            place[lower] = np.flatnonzero(lower) + j
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        valid = doc[:n] == doc[k - 1 :]
        change = np.ones(n, bool)
        change[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
        begin = np.flatnonzero(change & valid)
        stop = np.flatnonzero(change | ~valid)
        count = np.append(stop, n)[np.searchsorted(stop, begin, "right")] - begin
        content = mix(count.astype(np.uint64))
        for j in range(int(count.max(initial=0))):
            more = count > j
            content[more] = mix(content[more] * U(31) + windows[begin[more] + j])
        return doc[begin], begin, count, grams[place[begin]], content


def _map_of(hashes: DataFrame, bits: int):
    """A broadcast bit map over the low bits of ``hash``; a row per 32768 bits reaches the driver."""
    at = F.pmod("hash", F.lit(bits))
    rows = hashes.groupBy(F.floor(at / 32768).alias("k")).agg(F.bitmap_construct_agg(at % 32768).alias("b")).collect()
    table = np.zeros(bits // 8, np.uint8)
    for r in rows:
        table[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(bytes(r.b), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(table)


def _in_map(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & U(len(table) * 8 - 1)
    return (table[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1) > 0


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))


def _repeated_anchors(rows: DataFrame, k: int) -> DataFrame:
    """Hashes of the anchors that windows of at least two documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for base, data, off in text_steps(batch.column(1)):
                doc, _, _, anchor, _ = _Words(data, off).passages(k)
                yield _batch([signed(anchor), ids[base + doc]], ["hash", "doc_id"])

    found = map_batches(rows.select("doc_id", "text"), run, "hash long, doc_id long")
    return found.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("hash")


def _occurrences(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """Passages with a repeated anchor: ``(doc_id, fp, start, n, hash, content)``; start counts the document's words."""
    known = _map_of(anchors, ANCHOR_BITS)
    names = ["doc_id", "fp", "start", "n", "hash", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for base, data, off in text_steps(batch.column(2)):
                words = _Words(data, off)
                doc, begin, count, anchor, content = (c for c in words.passages(k))
                keep = _in_map(known.value, anchor)
                doc, begin, count, anchor, content = (c[keep] for c in (doc, begin, count, anchor, content))
                yield _batch([ids[base + doc], fps[base + doc], begin - words.first[doc], count.astype(np.int32), signed(anchor), signed(content)], names)

    found = map_batches(rows, run, f"{KEY}, start long, n int, hash long, content long")
    return found.join(anchors, "hash")


def _pieces(rows: DataFrame, distinct: DataFrame, k: int) -> DataFrame:
    """The words of every distinct passage, from its first document; a wide anchor's passages by window.

    ``(hash, content, at, wide, route, words, doc_id)``: equal windows have equal routes.
    """
    many = distinct.groupBy("hash").count().where(F.col("count") > WIDE).select("hash", F.lit(True).alias("wide"))
    marked = distinct.join(cut(many), "hash", "left")
    wanted = marked.groupBy("first.doc_id", "first.fp").agg(F.collect_list(F.struct("first.start", "first.n", "hash", "content", F.coalesce("wide", F.lit(False)).alias("wide"))).alias("wanted"))
    wanted = cut(wanted)
    near = _with_map(rows, _map_of(wanted.select(F.xxhash64("doc_id").alias("hash")), DOC_BITS))
    names = ["hash", "content", "at", "wide", "route", "words", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, want = batch.column(0).to_numpy(), batch.column(2)
            for base, data, off in text_steps(batch.column(1)):
                words, out = _Words(data, off), []
                windows = window_hashes(words.h, k)
                for i in range(len(off) - 1):
                    s = want[base + i].values
                    for start, n, anchor, content, wide in zip(*(s.field(f).to_pylist() for f in ("start", "n", "hash", "content", "wide")), strict=True):
                        a = start + int(words.first[i])
                        if wide:
                            routes = signed(windows[a : a + n]).tolist()
                            out += [(anchor, content, j, True, routes[j], words.h[a + j : a + j + k].tobytes(), int(ids[base + i])) for j in range(n)]
                        else:
                            out.append((anchor, content, 0, False, anchor, words.h[a : a + n + k - 1].tobytes(), int(ids[base + i])))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield _batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names)

    joined = near.join(wanted, ["doc_id", "fp"]).dropDuplicates(["doc_id", "fp"])
    return map_batches(joined.select("doc_id", "text", "wanted"), run, "hash long, content long, at int, wide boolean, route long, words binary, doc_id long")


def _with_map(rows: DataFrame, known, inside: bool = True) -> DataFrame:
    """The rows whose doc_id may be (or surely isn't) in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = _in_map(known.value, batch.column(3).to_numpy().view(np.uint64))
            yield batch.select([0, 1, 2]).filter(pa.array(hit == inside))

    return map_batches(rows.select("doc_id", "fp", "text", F.xxhash64("doc_id").alias("k")), run, f"{KEY}, text string")


def _first_documents(pieces: DataFrame, k: int) -> DataFrame:
    """``(route, same, firsts)``: for every distinct piece the least document of each of its windows.

    Equal pieces are one row before they meet (passages are distinct already, their single windows aren't).  The
    shards hold about SHARD_WORDS words; all pieces that could share a window have equal routes, and so one shard.
    """
    own = ["route", "words", "same", "doc_id"]
    windows = cut(pieces.where("wide").groupBy("route", "words", "same").agg(F.min("doc_id").alias("doc_id")).select(*own))
    distinct = pieces.where(~F.col("wide")).select(*own).union(windows)
    total = distinct.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    shard = F.pmod(F.xxhash64("route"), F.lit(max(1, -(-int(total) // SHARD_WORDS))))

    def run(table: pa.Table) -> pa.Table:
        words = [np.frombuffer(w.as_buffer(), np.int64).tolist() for c in table.column("words").chunks for w in c]
        docs = table.column("doc_id").to_pylist()
        automaton = SuffixAutomaton()
        for w, d in zip(words, docs, strict=True):
            automaton.add(w, d)
        automaton.finish()
        firsts = pa.array([automaton.matches(w, k) for w in words], pa.list_(pa.int64()))
        return pa.Table.from_arrays([table.column("route"), table.column("same"), firsts], names=["route", "same", "firsts"])

    dealt = distinct.select(*own, shard.alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, "route long, same long, firsts array<long>")


RESULT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


def _rewritten(k: int, texts: bool):
    """For rows (doc_id, text, hits) the text without the words of the windows that ``hits`` starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(2)
            for base, data, off in text_steps(batch.column(1)):
                starts, ends, first = word_spans(data, off, NOT_SPACE)
                edge = np.zeros(len(starts) + 1, np.int64)
                for i in range(len(off) - 1):
                    if hits[base + i].is_valid:
                        at = first[i] + hits[base + i].values.to_numpy()
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + k, -1)
                gone = np.cumsum(edge[:-1]) > 0
                size = (ends - starts)[~gone]
                after = np.concatenate([[0], np.cumsum(size + 1)])
                out = np.full(int(after[-1]), 0x20, np.uint8)
                word_byte = NOT_SPACE[data]
                if gone.any():
                    removed = np.zeros(len(data) + 1, np.int64)
                    np.add.at(removed, starts[gone], 1)
                    np.add.at(removed, ends[gone], -1)
                    word_byte &= np.cumsum(removed[:-1]) == 0
                out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[word_byte]
                raw = out.tobytes()
                left = np.concatenate([[0], np.cumsum(~gone)])[first]
                kept = [raw[after[left[i]] : max(after[left[i]], after[left[i + 1]] - 1)] for i in range(len(off) - 1)]
                n = np.diff(first)
                yield _batch(
                    [batch.column(0).slice(base, len(off) - 1), pa.array(n, pa.int64()), pa.array(n - np.diff(left), pa.int64()), pa.array(kept if texts else [None] * len(kept), pa.binary()).cast(pa.string()), [hashlib.sha256(x).hexdigest() for x in kept]],
                    ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
                )

    return run


def remove_repeats(docs: DataFrame, k: int = 13, texts: bool = True) -> DataFrame:
    """Removes each word covered by a window of ``k`` words that also starts in a document with a smaller doc_id.

    1. Each window is anchored by the least of its GRAM-word hashes, so equal windows have equal anchors; only
       anchors of two or more documents matter from here on.
    2. Runs of windows with one anchor are passages.  Equal passages become one, with the least document, and
       their words are dealt by anchor into shards of bounded size: these are the reference shards.
    3. A suffix automaton of each shard is built, and its passages are streamed through it: the matching
       statistics say which windows occur, and the states in which document first.
    4. The answers go back to all occurrences of the passages, and from there to the documents.

    Returns doc_id, n_words, n_removed, kept (the kept words joined by one space; null unless ``texts``) and
    kept_sha256.  Null text has no words; a null doc_id takes no part and keeps all words; rows that share a
    doc_id don't remove each other's words; an empty table gives an empty result.  Other columns are ignored.
    """
    rows = _rows(docs)
    known = rows.where("doc_id is not null")
    anchors = cut(_repeated_anchors(known, k))
    found = cut(_occurrences(known, anchors, k))
    distinct = cut(found.groupBy("hash", "content").agg(F.min(F.struct("doc_id", "fp", "start", "n")).alias("first")))
    pieces = cut(_pieces(known, distinct, k).withColumn("same", F.xxhash64("words")))
    firsts = cut(_first_documents(pieces, k))
    answers = cut(pieces.select("hash", "content", "at", "route", "same").join(firsts, ["route", "same"]).select("hash", "content", "at", "firsts"))
    back = found.join(answers, ["hash", "content"]).where(F.array_min("firsts") < F.col("doc_id"))
    window = F.transform("firsts", lambda d, j: F.when(d < F.col("doc_id"), F.col("start") + F.col("at") + j))
    hits = back.select("doc_id", "fp", F.filter(window, lambda w: w.isNotNull()).alias("w")).groupBy("doc_id", "fp").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("hits"))
    hits = cut(hits)
    near = _map_of(hits.select(F.xxhash64("doc_id").alias("hash")), DOC_BITS)
    none = F.lit(None).cast("array<long>")
    clean = _with_map(known, near, inside=False).unionByName(rows.where("doc_id is null")).select("doc_id", "text", none.alias("hits"))
    touched = _with_map(known, near).join(hits, ["doc_id", "fp"], "left").select("doc_id", "text", "hits")
    return map_batches(clean, _rewritten(k, texts), RESULT).union(map_batches(touched, _rewritten(k, texts), RESULT))
