"""SentencePiece encoding and decoding, giant texts by a max-plus parallel scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, give_back, map_batches, text_steps

#: Code points from which a text is giant, and of its chunks; chunks joined to one group of the scan.
GIANT, CHUNK, GROUP = 65_536, 16_384, 256
#: Words remembered by a worker (some 6 MB, kept from task to task); bytes of text encoded at once.
MEMORY, STEP = 150_000, 1 << 20
SPACE = "▁"
NEVER = -np.inf


class Pieces:
    """The vocabulary of one model file (BPE with byte fallback, or unigram)."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(model)
        if spec.normalizer_spec.name not in ("identity", "") or spec.normalizer_spec.remove_extra_whitespaces or not spec.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models with the identity normaliser, a dummy prefix and kept spaces are supported")
        self.bpe = spec.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.text = [p.piece for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type in (p.NORMAL, p.USER_DEFINED)}
        self.score = [p.score for p in spec.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == p.BYTE}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == p.UNKNOWN)
        self.control = {i for i, p in enumerate(spec.pieces) if p.type == p.CONTROL}
        self.longest = max(map(len, self.ids))
        self.worst = min(self.score) - 10.0
        self.inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        spec.normalizer_spec.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.words = WordIds(self)
        self.spelled: dict[str, tuple[float, list[str]]] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    @staticmethod
    def prepared(text: str) -> str:
        """With the dummy prefix, and spaces as the piece alphabet writes them."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.plain.encode([self.prepared(t) for t in texts], num_threads=1)

    def decode(self, ids: list[int]) -> str:
        """Byte pieces are joined to UTF-8 text; bytes that aren't UTF-8 become U+FFFD; the dummy prefix goes."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.of_byte:
                run.append(self.of_byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append("" if i in self.control else " ⁇ " if i == self.unknown else self.text[i])
        out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ").removeprefix(" ")

    def ids_of(self, symbol: str) -> list[int]:
        """A piece's id, or the byte pieces (else the unknown piece) of a character that is none."""
        if symbol in self.ids:
            return [self.ids[symbol]]
        return [self.bytes[b] for b in symbol.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def merged(self, symbols: list[str]) -> list[str]:
        """Byte-pair merges, best score first, leftmost of equals."""
        while True:
            best = max(((self.score[i], -j) for j in range(len(symbols) - 1) if (i := self.ids.get(symbols[j] + symbols[j + 1])) is not None), default=None)
            if best is None:
                return symbols
            j = -best[1]
            symbols[j : j + 2] = [symbols[j] + symbols[j + 1]]

    def allows(self, left: str, right: str) -> bool:
        """Whether the two pieces may stand side by side.

        Merging is local: a row of pieces is the byte-pair encoding of its text exactly if every two neighbours
        are the encoding of theirs.  Unigram models allow every pair.
        """
        if not self.bpe or not left:
            return True
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self.merged(list(left + right)) == [left, right]
        return known

    def whole(self, symbol: str) -> bool:
        """Whether a piece is the encoding of its own text (always, for unigram models)."""
        if not self.bpe or len(symbol) == 1:
            return True
        known = self.fits.get((symbol, ""))
        if known is None:
            known = self.fits[symbol, ""] = self.merged(list(symbol)) == [symbol]
        return known

    def ending(self, text: str, at: int) -> list[str]:
        """The pieces that end at ``at``, or the single character before it."""
        found = [s for n in range(1, min(self.longest, at) + 1) if (s := text[at - n : at]) in self.ids and self.whole(s)]
        return found if any(len(s) == 1 for s in found) else [text[at - 1], *found]

    def value(self, symbol: str) -> float:
        if self.bpe:
            return 0.0
        i = self.ids.get(symbol)
        return self.worst if i is None else self.score[i]


State = tuple[int, str]


def crossing(p: Pieces, text: str, at: int) -> list[State]:
    """Boundary states at ``at``: (code points beyond it, piece) of every piece that ends there or crosses it."""
    found = []
    for end in range(at, min(len(text), at + p.longest - 1) + 1):
        found += [(end - at, s) for s in p.ending(text, end) if end - len(s) < at]
    return found


Row = dict[str, tuple[float, str]]


def _forward(p: Pieces, begin: int, end: int, entry: State, ends: list[list[str]], like: list[list[Row]] = ()) -> tuple[list[Row], float]:
    """For places from ``begin`` on, the best score of each last piece (from ``entry``), and the piece before it.

    Pieces start at or after the end of the entry's piece and before ``end``; ``ends[i]`` are the pieces that end
    at ``begin + i``.  Byte-pair rules leave one last piece at most at each place.  Paths from different entries
    soon meet: once the rows of the longest piece's length equal those of a run in ``like`` up to a constant,
    the rest of that run is taken over, and the constant returned.
    """
    rows: list[Row] = [{} for _ in range(len(ends))]
    rows[entry[0]] = {entry[1]: (0.0, "")}
    for at in range(entry[0] + 1, len(ends)):
        here = rows[at]
        for s in ends[at]:
            start = at - len(s)
            if start < entry[0] or start >= end - begin:
                continue
            best = max(((v, q) for q, (v, _) in rows[start].items() if p.allows(q, s)), default=None)
            if best is not None:
                here[s] = (best[0] + p.value(s), best[1])
        if not p.bpe and len(here) > 1 and at < end - begin:
            s, top = max(here.items(), key=lambda x: x[1][0])
            rows[at] = {s: top}
        if at % 32 == 0 and at - entry[0] > p.longest:
            last = rows[at - p.longest + 1 : at + 1]
            if not any(last):
                break
            for other in like:
                shift = _shift(last, other[at - p.longest + 1 : at + 1])
                if shift is not None:
                    return rows[: at + 1] + [{s: (v + shift, q) for s, (v, q) in r.items()} for r in other[at + 1 :]], shift
    return rows, 0.0


def _shift(a: list[Row], b: list[Row]) -> float | None:
    """The constant by which the scores of ``a`` lie above those of ``b``; None if the rows differ otherwise."""
    if any(x.keys() != y.keys() for x, y in zip(a, b, strict=True)):
        return None
    apart = [x[s][0] - y[s][0] for x, y in zip(a, b, strict=True) for s in x]
    return apart[0] if apart and max(apart) - min(apart) < 1e-9 else None


def _ends(p: Pieces, text: str, begin: int, end: int) -> list[list[str]]:
    return [p.ending(text, at) if at > 0 else [] for at in range(begin, min(len(text), end + p.longest - 1) + 1)]


def word_starts(p: Pieces, text: str, begin: int, end: int) -> list[int]:
    """Places from ``begin`` to ``end`` where a space follows another character: no piece crosses them, and no rule
    looks across, so that every path passes through one and the same state there."""
    found, at = [], begin
    while not p.inner and (at := text.find(SPACE, at, end + 1)) >= 0:
        if at > 0 and text[at - 1] != SPACE:
            found.append(at)
        at += 1
    return found


def spelled(p: Pieces, word: str) -> tuple[float, list[str]]:
    """Score and pieces of the best path through one whole word; short words are remembered."""
    known = p.spelled.get(word)
    if known is None:
        rows, _ = _forward(p, 0, len(word), (0, ""), _ends(p, word, 0, len(word)))
        s, (score, _) = max(rows[len(word)].items(), key=lambda x: x[1][0])
        known = score, _walk(rows, len(word), s, 0)
        if len(word) <= 64:
            if len(p.spelled) >= MEMORY:
                p.spelled.clear()
            p.spelled[word] = known
    return known


def _walk(rows: list[Row], at: int, s: str, stop: int) -> list[str]:
    out = []
    while at > stop:
        out.append(s)
        at, s = at - len(s), rows[at][s][1]
    return out[::-1]


def transfer(p: Pieces, text: str, begin: int, end: int, first: bool = False) -> np.ndarray:
    """The max-plus matrix of a chunk: best score from each boundary state at ``begin`` to each at ``end``.

    Between the first and the last word start inside the chunk one number, the sum of the words' scores, stands
    for all paths: the matrix is a column plus that number plus a row.
    """
    entries, exits, marks = entry_states(p, text, begin, first), crossing(p, text, end), word_starts(p, text, begin, end)
    if marks:
        lead, tail = _ends(p, text, begin, marks[0]), _ends(p, text, marks[-1], end)
        column = [max((v for v, _ in _forward(p, begin, marks[0], e, lead)[0][marks[0] - begin].values()), default=NEVER) for e in entries]
        inner = sum(spelled(p, text[a:b])[0] for a, b in zip(marks[:-1], marks[1:], strict=True))
        rows, _ = _forward(p, marks[-1], end, (0, ""), tail)
        row = [rows[over + end - marks[-1]].get(s, (NEVER, ""))[0] if over + end > marks[-1] else 0.0 for over, s in exits]
        return np.array(column)[:, None] + inner + np.array(row)
    ends = _ends(p, text, begin, end)
    out, runs = np.full((len(entries), len(exits)), NEVER), []
    for i, e in enumerate(entries):
        rows, _ = _forward(p, begin, end, e, ends, runs)
        if len(runs) < 4 and any(rows[end - begin :]):
            runs.append(rows)
        out[i] = [rows[over + end - begin].get(s, (NEVER, ""))[0] for over, s in exits]
    return out


def entry_states(p: Pieces, text: str, begin: int, first: bool) -> list[State]:
    return [(0, "")] if first else crossing(p, text, begin)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None]).max(1)


def backtrace(p: Pieces, text: str, begin: int, end: int, entry: State, leave: State) -> list[str]:
    """The pieces after ``entry`` up to and with ``leave`` on the best path of one chunk."""
    marks = word_starts(p, text, begin, end)
    if not marks:
        rows, _ = _forward(p, begin, end, entry, _ends(p, text, begin, end))
        return _walk(rows, end - begin + leave[0], leave[1], entry[0])
    rows, _ = _forward(p, begin, marks[0], entry, _ends(p, text, begin, marks[0]))
    last = max(rows[marks[0] - begin].items(), key=lambda x: x[1][0])[0]
    lead = _walk(rows, marks[0] - begin, last, entry[0])
    inner = [s for a, b in zip(marks[:-1], marks[1:], strict=True) for s in spelled(p, text[a:b])[1]]
    rows, _ = _forward(p, marks[-1], end, (0, ""), _ends(p, text, marks[-1], end))
    return lead + inner + _walk(rows, end - marks[-1] + leave[0], leave[1], 0)


def through(matrices: list[np.ndarray], entry: int, leave: int) -> list[tuple[int, int]]:
    """Entry and exit state of each matrix on the best path from ``entry`` of the first to ``leave`` of the last."""
    best, back = matrices[0][entry], []
    for m in matrices[1:]:
        both = best[:, None] + m
        back.append(both.argmax(0))
        best = both.max(0)
    if best[leave] == NEVER:
        raise ValueError("no segmentation reaches the end")
    states = [leave]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    states = [entry, *states[::-1]]
    return list(zip(states[:-1], states[1:], strict=True))


class WordIds:
    """Ids of words, each distinct one encoded once and remembered with its bytes.

    No piece goes on from another character to a space, so a text's ids are those of its words: runs of spaces
    and what follows them.  Words are told apart by their bytes.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        shown = [bytes([pieces.of_byte[i]]) if i in pieces.of_byte else b"" if i in pieces.control else " ⁇ ".encode() if i == pieces.unknown else t.replace(SPACE, " ").encode() for i, t in enumerate(pieces.text)]
        self.piece_size = np.fromiter(map(len, shown), np.int32, len(shown))
        self.piece_at = (np.cumsum(self.piece_size) - self.piece_size).astype(np.int32)
        self.piece_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.words, self.flat = pa.array([], pa.binary()), np.zeros(0, np.int32)
        self.begin, self.count, self.seen = (np.zeros(0, np.int32) for _ in range(3))

    def _learn(self, words: pa.Array) -> None:
        ids = self.pieces.plain.encode(words.cast(pa.string()).to_pylist(), num_threads=1)
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        self.begin = np.concatenate([self.begin, (len(self.flat) + np.cumsum(count) - count).astype(np.int32)])
        self.count = np.concatenate([self.count, count])
        self.seen = np.concatenate([self.seen, np.zeros(len(count), np.int32)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))])
        self.words = pa.concat_arrays([self.words, words])

    def _forget(self) -> None:
        """Keeps the words met most often, as many as half the memory; what they counted is halved."""
        keep = np.sort(np.argsort(-self.seen, kind="stable")[: MEMORY // 2])
        self.flat, edge = _spread(self.flat, self.begin[keep], self.count[keep], np.arange(len(keep) + 1))
        self.words, self.begin = self.words.take(pa.array(keep)), edge[:-1].astype(np.int32)
        self.count, self.seen = self.count[keep], self.seen[keep] // 2

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the ends of the texts' ids (one more in front); each text that isn't empty begins with a space."""
        space = data == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[off[:-1][off[1:] > off[:-1]]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = words.dictionary
        if len(self.words) > MEMORY:
            self._forget()
        known = pc.index_in(distinct, self.words)
        if known.null_count:
            before = len(self.words)
            new = known.is_null()
            self._learn(distinct.filter(new))
            place = known.fill_null(0).to_numpy().copy()
            place[np.flatnonzero(new.to_numpy(zero_copy_only=False))] = np.arange(before, len(self.words))
        else:
            place = known.to_numpy()
        word = place[words.indices.to_numpy()]
        self.seen += np.bincount(word, minlength=len(self.seen)).astype(np.int32)
        return _spread(self.flat, self.begin[word], self.count[word], np.searchsorted(starts, off))

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids stand for, and the ends of the texts' bytes; the dummy prefix shows as a space."""
        return _spread(self.piece_bytes, self.piece_at[flat], self.piece_size[flat], ends)

    def come_back(self, flat: np.ndarray, ends: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Whether each text's ids decode to its bytes."""
        out, stop = self.decode(flat, ends)
        if len(out) == len(data) and (out == data).all():
            return (stop == off)[1:] & (stop == off)[:-1]
        return np.array([np.array_equal(out[a:b], data[c:d]) for a, b, c, d in zip(stop[:-1], stop[1:], off[:-1], off[1:], strict=True)], bool)


def _spread(values: np.ndarray, begin: np.ndarray, count: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[begin : begin + count]`` one after another, and where runs ``edge`` begin in that row."""
    after = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    kind = np.int32 if after[-1] < 2**31 else np.int64
    at = np.repeat((begin - after[:-1]).astype(kind), count)
    at += np.arange(len(at), dtype=kind)
    return values[at], after[edge]


_LOADED: dict[bytes, Pieces] = {}


def load(model: bytes) -> Pieces:
    import hashlib

    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def _lists(rows: list[list[int]], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _tidied(model, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker forgets the words and pairs of the giants and gives its free memory back."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            p = load(model.value)
            p.spelled.clear()
            p.fits.clear()
            give_back()

    return tidy


ENCODED = "n_tokens bigint, ids array<int>, round_trip boolean"


def _ordinary(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for base, data, off in text_steps(texts, STEP):
                n = len(off) - 1
                if p.inner or SPACE.encode() in data.tobytes():
                    own = [t[1:] for t in texts.slice(base, n).to_pylist()]
                    ids = p.encode(own)
                    flat, ends = np.fromiter(chain.from_iterable(ids), np.int32), np.cumsum([0, *map(len, ids)])
                else:
                    flat, ends = p.words.encode(data, off)
                same = pa.array(p.words.come_back(flat, ends, data, off))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(c.slice(base, n) for c in batch.columns[:-1]), pa.array(np.diff(ends)), lists, same], names=[*batch.schema.names[:-1], "n_tokens", "ids", "round_trip"])

    return run


def _giant(texts: DataFrame, model, chunk: int) -> DataFrame:
    """``(text_key, n_tokens, ids, round_trip)`` of distinct long texts, chunk by chunk.

    1. Every chunk, with a margin of the longest piece on either side, gives its transfer matrix.
    2. Matrices are multiplied within groups of GROUP chunks, the groups' products run through in order, and
       then each group again between the states so found: this fixes the boundary states of every chunk.
    3. Every chunk is traced back on its own between its states.
    """
    names = ["text_key", "chunk", "grp", "text", "begin", "last"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = load(model.value).longest
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = Pieces.prepared(text)
                for at in range(0, len(text), chunk):
                    lo, hi = max(0, at - margin), min(len(text), at + chunk + margin)
                    n = at // chunk
                    row = [key, n, n // GROUP, text[lo:hi], at - lo, at + chunk >= len(text)]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], pa.schema([("text_key", pa.string()), ("chunk", pa.int64()), ("grp", pa.int64()), ("text", pa.string()), ("begin", pa.int64()), ("last", pa.bool_())]))

    def span(r: dict) -> tuple[str, int, int]:
        end = len(r["text"]) if r["last"] else r["begin"] + chunk
        return r["text"], r["begin"], end

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model.value)
        for batch in batches:
            out = [(r["text_key"], r["chunk"], r["grp"], m.shape[0], m.tobytes()) for r in batch.to_pylist() for m in [transfer(p, *span(r), first=r["chunk"] == 0)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["text_key", "chunk", "grp", "n", "m"])

    def unpack(pdf) -> list[np.ndarray]:
        return [np.frombuffer(m).reshape(n, -1) for n, m in zip(pdf["n"], pdf["m"], strict=True)]

    def product(pdf):
        pdf = pdf.sort_values("chunk")
        ms = unpack(pdf)
        out = ms[0]
        for m in ms[1:]:
            out = times(out, m)
        return pdf.iloc[:1][["text_key", "grp"]].assign(n=out.shape[0], m=out.tobytes())

    def ends_of(pdf):
        pdf = pdf.sort_values("grp")
        ms = unpack(pdf)
        total = ms[0][0]
        for m in ms[1:]:
            total = (total[:, None] + m).max(0)
        states = through(ms, 0, int(total.argmax()))
        return pdf[["text_key", "grp"]].assign(entry=[a for a, _ in states], leave=[b for _, b in states])

    def inside(pdf):
        pdf = pdf.sort_values("chunk")
        states = through(unpack(pdf), int(pdf["entry"].iloc[0]), int(pdf["leave"].iloc[0]))
        return pdf[["text_key", "chunk"]].assign(entry=[a for a, _ in states], leave=[b for _, b in states])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model.value)
        for batch in batches:
            ids = []
            for r in batch.to_pylist():
                text, begin, end = span(r)
                entry = entry_states(p, text, begin, r["chunk"] == 0)[r["entry"]]
                leave = crossing(p, text, end)[r["leave"]]
                ids.append(list(chain.from_iterable(map(p.ids_of, backtrace(p, text, begin, end, entry, leave)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(ids, pa.int32())], names=["text_key", "chunk", "ids"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model.value)
        for batch in batches:
            same = [p.decode(i) == t for i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(same, pa.bool_())], names=["text_key", "ids", "round_trip"])

    chunks = cut(texts.mapInArrow(_tidied(model, split), "text_key string, chunk long, grp long, text string, begin long, last boolean"))
    dealt = chunks.repartition(max(8, texts.sparkSession.sparkContext.defaultParallelism), "text_key", "chunk")
    ms = cut(dealt.mapInArrow(_tidied(model, matrices), "text_key string, chunk long, grp long, n long, m binary"))
    groups = ms.groupBy("text_key", "grp").applyInPandas(product, "text_key string, grp long, n long, m binary")
    between = groups.groupBy("text_key").applyInPandas(ends_of, "text_key string, grp long, entry long, leave long")
    states = ms.join(between, ["text_key", "grp"]).groupBy("text_key", "grp").applyInPandas(inside, "text_key string, chunk long, entry long, leave long")
    traced = dealt.join(states, ["text_key", "chunk"]).select("text_key", "chunk", "text", "begin", "last", "entry", "leave").mapInArrow(_tidied(model, trace), "text_key string, chunk long, ids array<int>")
    whole = traced.groupBy("text_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    whole = whole.join(texts.withColumnRenamed("text", "own"), "text_key").select("text_key", "ids", "own").mapInArrow(_tidied(model, check), "text_key string, ids array<int>, round_trip boolean")
    return whole.select("text_key", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def encode(docs: DataFrame, model_file: str, keep: list[str] | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """Token ids of whole texts under a SentencePiece model, and whether decoding them gives the text back.

    Adds to the ``keep`` columns (default: doc_id): n_tokens, ids, round_trip.  Texts below ``giant`` code
    points are encoded as one; longer ones by the parallel scan, once per distinct text.  The ids of every text
    are decoded again.  Null and empty texts have no ids (round_trip: true).  A text that holds U+2581 itself
    decodes to spaces there (round_trip: false).  Repeated rows give repeated results; an empty table gives an
    empty one.
    """
    keep = ["doc_id"] if keep is None else keep
    keep = [c for c in keep if c.lower() not in ("n_tokens", "ids", "round_trip")]
    with open(model_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    text = docs["text"].cast("string")
    rows = docs.select(*[docs[c] for c in keep], text.alias("text_in"))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), ENCODED])
    short = F.coalesce(F.length("text_in") < giant, F.lit(True))
    spaced = F.when(F.length("text_in") > 0, F.concat(F.lit(" "), "text_in")).otherwise(F.lit(""))
    out = map_batches(rows.where(short).withColumn("text_in", spaced), _ordinary(model), schema)
    long = rows.where(~short).withColumn("text_key", F.sha2("text_in", 256))
    texts = cut(long.select("text_key", F.col("text_in").alias("text")).dropDuplicates(["text_key"]))
    if texts.isEmpty():
        return out
    done = cut(_giant(texts, model, chunk))
    return out.unionByName(long.drop("text_in").join(done, "text_key").select(*keep, "n_tokens", "ids", "round_trip"))


def decode(encoded: DataFrame, model_file: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: doc_id) and ``text`` for rows with ``ids``; null ids give a null text."""
    keep = ["doc_id"] if keep is None else keep
    with open(model_file, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())
    types = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model.value)
        for batch in batches:
            texts = [None if x is None else p.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return encoded.select(*keep, F.col("ids").alias("ids_in")).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "text string"]))
