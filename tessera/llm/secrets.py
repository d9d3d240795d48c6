"""Secret scans with DataFrame expressions: fixed patterns, and a battery of randomness tests."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Kinds in the order that breaks ties; pattern, group whose length counts, least length.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: A candidate of the battery: a whole run of these characters, with a letter and a digit in it.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}"

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


class Encoding(NamedTuple):
    """A pattern for the whole string, its symbols in order, and the sum of squared symbol shares of prose in it."""

    name: str
    pattern: str
    symbols: str
    prose2: float


#: The first that fits is the inferred encoding.
ENCODINGS = [
    Encoding("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.2),
    Encoding("base32", "^[A-Z2-7]+$", UPPER + "234567", 0.0667),
    Encoding("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 0.0667),
    Encoding("base64", "^[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGITS + "+/", 0.0667),
]
#: Of prose: sum of cubed letter shares less the square of the sum of squared ones.
PROSE3_EXCESS = 0.0011
#: A structured string shifts the standardised runs and serial correlation by at least ORDER * sqrt(n) + MARGIN
#: (all ordered or all alternating ones: by sqrt(n)).
ORDER, MARGIN = 0.5, 3.5
#: Share of false discoveries, upper ends of the length classes.
FDR, LENGTHS = 0.01, (24, 32, 48, 96)
#: Matches that one step turns into spans, code points of a block of text, and spans that can begin at one place.
STRETCH, BLOCK, KINDS_AT_ONCE = 256, 1024, 4
#: Bins of -log10 p: STEP to the unit, up to BINS.
STEP, BINS = 20, 2000


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Structs (start, rank, kind, end, value) of the leftmost non-overlapping matches; positions in code points.

    The pieces between the matches and the matches alternate, so a running sum of their lengths gives every start.
    """
    rank = F.lit([*KINDS, "random"].index(kind))
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    part = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    pieces = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), F.arrays_zip(whole.alias("m"), part.alias("g")), lambda gap, x: F.struct(F.length(gap).alias("gap"), x["m"].alias("m"), x["g"].alias("g")))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,value:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = (start + F.length(x["m"])).cast("int")
        one = F.struct(start.cast("int").alias("start"), rank.alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= least, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def stretch(acc: Column, i: Column) -> Column:
        """The spans of the next STRETCH matches; only stretches, not spans, are appended to the whole."""
        part = F.aggregate(F.slice(acc["pieces"], i + 1, F.lit(STRETCH)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return bound(part, lambda p: F.struct(p["at"].alias("at"), F.array_append(acc["out"], p["out"]).alias("out"), acc["pieces"].alias("pieces")))

    def spans(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array(none).alias("out"), pieces.alias("pieces"))
        return F.aggregate(F.sequence(F.lit(0), F.size(pieces), F.lit(STRETCH)), start, stretch, lambda acc: F.flatten(acc["out"]))

    return F.when(text.rlike(pattern), bound(pieces, spans)).otherwise(none)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` found once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by a fixed rational approximation of the error function (absolute error below 2e-7), 1e-90 at least."""
    x = F.least(F.abs(z), F.lit(20.0)) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = F.greatest(0.5 * poly * F.exp(-x * x), F.lit(1e-90))
    return F.when(z < 0, 1 - upper).otherwise(upper)


def battery(value: Column) -> Column:
    """Struct (n, encoding, p_uniform, p_runs, p_serial, p) of one string.

    Symbols are the places of the characters in the inferred alphabet of k symbols.  Each test asks how likely a
    string that isn't random would look as random as this one: p_uniform is the chance that one with the letter
    shares of prose has so small a chi-squared against uniform shares; p_runs and p_serial that one with order in
    it (ORDER, MARGIN) has so few too many or too few runs above and below the middle, or so small a lag-one
    serial correlation, both standardised with their asymptotic moments for random strings.  All three fall with
    the length.  A secret has to beat all three, so its p is the largest of them.
    """
    body = F.regexp_replace(value, "=+$", "")
    fits = [(body.rlike(e.pattern), e) for e in ENCODINGS]
    pick = lambda f: F.coalesce(*[F.when(ok, F.lit(f(e))) for ok, e in fits])
    plain = F.when(fits[0][0], F.lower(body)).otherwise(F.translate(body, "-_", "+/"))
    codes = F.transform(F.split(plain, ""), lambda c: F.position(c, pick(lambda e: e.symbols)) - 1)

    def sums(x: Column) -> Column:
        codes, k = x["codes"], x["k"]
        total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda t, v: t + f(v))
        squares = total(F.array_distinct(codes), lambda c: F.pow(F.size(F.filter(codes, lambda d: d == c)), F.lit(2.0)))
        high = total(codes, lambda c: (c >= k / 2).cast("double"))
        s1, s2 = total(codes, lambda c: c), total(codes, lambda c: c * c)
        each = [F.size(codes).cast("double").alias("n"), k.alias("k"), x["prose2"].alias("prose2"), x["encoding"].alias("encoding"), squares.alias("squares"), high.alias("high"), s1.alias("s1"), s2.alias("s2")]
        after = F.concat(F.slice(codes, 2, F.size(codes)), F.slice(codes, 1, 1))
        turns = lambda pairs: total(F.slice(pairs, 1, F.size(codes) - 1), lambda p: ((p["a"] >= k / 2) != (p["b"] >= k / 2)).cast("double"))
        return bound(F.arrays_zip(codes.alias("a"), after.alias("b")), lambda pairs: F.struct(*each, turns(pairs).alias("turns"), total(pairs, lambda p: p["a"] * p["b"]).alias("s11")))

    def tests(x: Column) -> Column:
        n, k, high = x["n"], x["k"], x["high"]
        uniform = x["squares"] * k / n - n
        mean = 2 * high * (n - high) / n
        z2 = F.when((high > 0) & (high < n) & (mean > 1), (x["turns"] - mean) / F.sqrt(mean * (mean - 1) / (n - 1))).otherwise(n)
        spread = n * x["s2"] - x["s1"] * x["s1"]
        z3 = F.when(spread > 0, ((n * x["s11"] - x["s1"] * x["s1"]) / spread + 1 / (n - 1)) * F.sqrt(n)).otherwise(n)
        like_prose = (n - 1) * (k * x["prose2"] - 1) + (k - 1)
        spread_prose = F.sqrt(4 * n * k * k * PROSE3_EXCESS + 2 * (k - 1))
        ordered = ORDER * F.sqrt(n) + MARGIN
        shifts = F.array((like_prose - uniform) / spread_prose, ordered - F.abs(z2), ordered - F.abs(z3))
        shown = lambda ps: F.struct(n.cast("int").alias("n"), x["encoding"].alias("encoding"), *[ps[i].alias(c) for i, c in enumerate(("p_uniform", "p_runs", "p_serial"))], F.array_max(ps).alias("p"))
        return bound(F.transform(shifts, _normal_tail), shown)

    known = F.struct(codes.alias("codes"), pick(lambda e: e.name).alias("encoding"), pick(lambda e: float(len(e.symbols))).alias("k"), pick(lambda e: e.prose2).alias("prose2"))
    return bound(bound(known, sums), tests)


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``base`` spans and the battery's ``candidates``, in one pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.array_sort(F.concat(*[_found(text, kind, *rule) for kind, rule in KINDS.items()]))
    runs = F.filter(_found(text, "random", RUN, 0, 20), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))

    def tested(s: Column) -> Column:
        b = battery(s["value"])
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), b.alias("b"))

    def binned(s: Column) -> Column:
        length = sum((s["b"]["n"] >= F.lit(edge)).cast("int") for edge in LENGTHS)
        level = F.least(F.floor(-F.log10(F.greatest(s["b"]["p"], F.lit(1e-90))) * STEP), F.lit(BINS)).cast("int")
        return F.struct(s["start"], s["rank"], s["kind"], s["end"], s["b"]["encoding"].alias("encoding"), length.alias("length"), level.alias("level"))

    without = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]))
    return docs.select(*keep, without(base).alias("base_spans"), F.transform(F.transform(runs, tested), binned).alias("candidates"))


def discoveries(rows: DataFrame) -> dict[int, int]:
    """For each length class the least level that keeps the share of false discoveries at FDR (Benjamini-Hochberg).

    Only counts per class and level are ordered, and one row per class reaches the driver.
    """
    bins = rows.select(F.inline("candidates")).groupBy("length", "level").count()
    by = Window.partitionBy("length")
    above = F.sum("count").over(by.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = bins.select("length", "level", above.alias("above"), F.sum("count").over(by).alias("all"))
    good = ranked.where(F.pow(F.lit(10.0), -F.col("level") / STEP) <= FDR * F.col("above") / F.col("all"))
    return {r.length: r.level for r in good.groupBy("length").agg(F.min("level").alias("level")).collect()}


def secret_spans(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All secrets of the whole texts, as spans in code points.

    Adds to the ``keep`` columns (default: doc_id): base_spans (fixed patterns) and spans (these and the
    battery's), arrays of (start, rank, kind, end) by start, then kind.  The battery keeps a run whose p, the
    largest of its tests', is a discovery within its length class over all documents.  Runs without a digit or
    without a letter aren't tested: of random keys of 20 characters that is 3 in 100 (base 62) or 2 (base 32).
    Null and empty texts have no spans; repeated rows give repeated results; an empty table an empty one.
    """
    keep = ["doc_id"] if keep is None else [c for c in keep if c.lower() not in ("base_spans", "candidates", "spans")]
    rows = cut(scanned(docs, keep))
    levels = discoveries(rows)

    def kept(s: Column) -> Column:
        limits = [F.when(s["length"] == c, F.lit(v)) for c, v in levels.items()]
        return s["level"] >= F.coalesce(*limits, F.lit(BINS + 1))

    more = F.transform(F.filter("candidates", kept), lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]))
    return rows.select(*keep, "base_spans", F.array_sort(F.concat("base_spans", more)).alias("spans"))


def written(spans: str | Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mark``; null spans are none.

    The text is taken in blocks of BLOCK code points, each with the spans that begin in it, so that no step looks at
    more than a block: the work is in proportion to the text, however many spans there are.
    """
    blocks = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda b, i: F.struct(b.alias("text"), (i * BLOCK).alias("at")))

    def step(acc: Column, s: Column, b: Column) -> Column:
        gap = F.substring(b["text"], acc["at"] - b["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        near = F.filter(F.slice(acc["spans"], acc["next"] + 1, F.lit(KINDS_AT_ONCE * BLOCK)), lambda s: s["start"] < b["at"] + BLOCK)
        begin = F.struct(F.greatest(acc["at"], b["at"]).alias("at"), F.lit("").alias("out"))

        def rest(n: Column, got: Column) -> Column:
            left = F.concat(got["out"], F.substring(b["text"], got["at"] - b["at"] + 1, F.lit(BLOCK)))
            return F.struct(acc["spans"].alias("spans"), (acc["next"] + n).alias("next"), got["at"].alias("at"), F.array_append(acc["out"], left).alias("out"))

        return bound(near, lambda near: bound(F.aggregate(near, begin, lambda a, s: step(a, s, b)), lambda got: rest(F.size(near), got)))

    def whole(spans: Column) -> Column:
        zero = F.struct(spans.alias("spans"), F.lit(0).alias("next"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(blocks, zero, block, lambda acc: F.array_join(acc["out"], ""))

    return F.when(F.size(spans) > 0, bound(spans, whole)).otherwise(text)
