"""Fill-in-middle transformation: cuts in code points or bytes, found through a sparse index of multibyte characters."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BACK, map_batches, text_steps

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are transformed, and of 100 of these so many begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20

SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


class Exceptions(NamedTuple):
    """Where the characters of more than one byte are; everything between them is arithmetic.

    ``places`` counts the code points before each such character over all texts of a step, ``begins`` the bytes,
    ``excess`` the bytes beyond one of all such characters before it (one more entry at the end); ``chars`` and
    ``offsets`` are where each text begins in code points and bytes.
    """

    places: np.ndarray
    begins: np.ndarray
    excess: np.ndarray
    chars: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Exceptions:
        begins = np.flatnonzero(data >= 0xC0)
        lead = data[begins]
        excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)])
        chars = offsets - excess[np.searchsorted(begins, offsets)]
        return cls(begins - excess[:-1], begins, excess, chars, offsets)

    def to_bytes(self, text: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Byte of each text at which its code point ``cut`` begins (its length in bytes, if there is none)."""
        at = self.chars[text] + cut
        return at + self.excess[np.searchsorted(self.places, at)] - self.offsets[text]

    def to_chars(self, text: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Code points of each text before ``byte``; a byte inside a character counts as the character's first."""
        at = self.offsets[text] + byte
        k = np.searchsorted(self.begins, at)
        before = np.maximum(k - 1, 0)
        inside = (k > 0) & (at < self.begins[before] + 1 + np.diff(self.excess)[before]) if len(self.begins) else np.zeros(len(at), bool)
        return np.where(inside, self.places[before] if len(self.begins) else 0, at - self.excess[k]) - self.chars[text]


def _batch(texts: pa.Array, draws: np.ndarray, known: np.ndarray, unit: str, marks: tuple[str, ...], rate: int, suffix_first: int) -> list[pa.Array]:
    p, s, m = (x.encode() for x in marks)
    n, form, first, second, out = [], [], [], [], []
    for base, data, off in text_steps(texts):
        index, rows = Exceptions.of(data, off), np.arange(len(off) - 1)
        h = draws[:, base : base + len(rows)]
        chars, size = np.diff(index.chars), np.diff(off)
        if unit == "chars":
            ends = np.sort(h[:2] % (chars + 1), axis=0)
        else:
            ends = np.stack([index.to_chars(rows, b) for b in np.sort(h[:2] % (size + 1), axis=0)])
        cuts = [index.to_bytes(rows, e) for e in ends]
        whole, plain = data.tobytes(), (size == 0) | (h[2] % 100 >= rate) | ~known[base : base + len(rows)]
        turned = h[3] % 100 < suffix_first
        n.append(chars)
        first.append(ends[0])
        second.append(ends[1] - ends[0])
        for i in rows:
            t = whole[off[i] : off[i + 1]]
            if plain[i] or p in t or s in t or m in t:
                plain[i] = True
                out.append(t)
                continue
            a, b = cuts[0][i], cuts[1][i]
            out.append(b"".join((s, t[b:], p, t[:a], m, t[a:b]) if turned[i] else (p, t[:a], s, t[b:], m, t[a:b])))
        form.append(np.where(plain, "plain", np.where(turned, "spm", "psm")))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    form = join(form)
    none = form == "plain"
    return [pa.array(join(n)), pa.array(form.astype(object), pa.string()), *(pa.array(join(x), mask=none) for x in (first, second)), pa.array(out, pa.binary()).cast(pa.string())]


def _checked(marks: tuple[str, ...]) -> tuple[str, ...]:
    """``marks``, of which none may begin inside itself or another: only then can an output be taken apart."""
    if len(set(marks)) != 3 or any(not m or a[i : i + len(m)] == m[: len(a) - i] for m in marks for a in marks for i in range(0 if m != a else 1, len(a))):
        raise ValueError("marks must not overlap one another")
    return tuple(marks)


def fill_in_middle(docs: DataFrame, seed: str | int = 1, unit: str = "chars", keep: list[str] | None = None, marks: tuple[str, ...] = MARKS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Cuts each whole text into prefix, middle and suffix and writes them in an order that ends with the middle.

    Adds to the ``keep`` columns (default: doc_id): n (code points), form (plain, psm or spm), prefix_chars and
    middle_chars (code points; null if plain) and output.  Everything is drawn from sha256(``seed:doc_id``), so it
    depends on the row alone.  The two cuts are equally likely at each of the n + 1 places, in code points, or
    with ``unit="bytes"`` at each byte, moved back to the beginning of its character.

    A null text is an empty one; empty texts, texts that hold a mark, and rows without a doc_id stay plain;
    repeated rows give repeated results; an empty table an empty one.  Kept columns with a name of a new one
    give way.
    """
    marks, new = _checked(marks), [f.split()[0] for f in SCHEMA.split(", ")]
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() not in new]
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), docs["doc_id"].cast("string")).cast("binary"), 256)
    draws = [F.coalesce(F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long"), F.lit(-1)) for i in range(4)]
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(*[docs[c] for c in keep], text.alias("text_in"), *[d.alias(f"draw_{i}") for i, d in enumerate(draws)])
    names = [*keep, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BACK) for b in batches for i in range(0, b.num_rows, BACK)):
            *kept, texts = batch.columns[:-4]
            h = np.stack([c.to_numpy() for c in batch.columns[-4:]])
            yield pa.RecordBatch.from_arrays([*kept, *_batch(texts, h, h[0] >= 0, unit, marks, rate, suffix_first)], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return map_batches(rows, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), SCHEMA]))


def restored(output: Column, form: Column, marks: tuple[str, ...] = MARKS) -> Column:
    """The text that an output and its form were made of; the marks in it are the only ones."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
