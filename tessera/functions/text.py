"""Text normalisation, tokens, identifiers, numeric facts and fixed vocabularies."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

SEARCH_TOKEN = r"[a-z0-9]+(?:[._+-][a-z0-9]+)*"


@F.pandas_udf(StringType())
def search_normalised(texts: pd.Series) -> pd.Series:
    """NFKC and case folding; plain ASCII is lower-cased only."""
    return texts.map(lambda t: None if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def matching_normalised(texts: pd.Series) -> pd.Series:
    """NFKC, case folding, accents stripped, punctuation to spaces, spaces squeezed; null becomes empty."""

    def one(t: str | None) -> str:
        t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", t or "").casefold())
        return " ".join("".join(c if c.isalnum() else " " for c in t if not unicodedata.combining(c)).split())

    return texts.map(one)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; it depends on the order of its arguments.

    A matcher indexes its second text, which rows in a row often share.
    """
    matcher, out, last = SequenceMatcher(), [], ""
    for x, y in zip(a, b, strict=True):
        if (y or "") != last:
            last = y or ""
            matcher.set_seq2(last)
        matcher.set_seq1(x or "")
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def search_tokens(text: Column) -> Column:
    """Lower-case tokens that keep inner dots, underscores, plus signs and hyphens (ASCII)."""
    return F.regexp_extract_all(F.lower(text), F.lit(SEARCH_TOKEN), F.lit(0))


def search_terms(text: Column) -> Column:
    """Search tokens of any text: full-width digits, ligatures and case variants beyond ASCII count as their plain forms."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)  # ASCII, which Python needn't see
    folded = F.when(plain, F.lower(text)).otherwise(search_normalised(F.when(~plain, text)))
    return F.regexp_extract_all(folded, F.lit(SEARCH_TOKEN), F.lit(0))


def squeezed(text: Column) -> Column:
    """ASCII form of the matching normaliser, in built-in functions."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def identifier(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def unique_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(squeezed(text), " "), lambda t: t != "")))


def numeric_tokens(text: Column) -> Column:
    return F.filter(unique_tokens(text), lambda t: t.rlike("[0-9]"))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 24 hex digits over the parts, joined by the unit separator."""
    joined = F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 24))


#: Unit, dimension, factor to the dimension's base unit (fixed values).
UNITS = {
    "tb": ("capacity_gb", 1024.0), "gb": ("capacity_gb", 1.0), "mb": ("capacity_gb", 1 / 1024),
    "kw": ("power_w", 1000.0), "w": ("power_w", 1.0), "cm": ("length_mm", 10.0), "mm": ("length_mm", 1.0),
    "ghz": ("frequency_mhz", 1000.0), "mhz": ("frequency_mhz", 1.0),
}


def numeric_facts(text: Column) -> Column:
    """``name=value`` of the first quantity of each dimension, in order of name; NxM kits give a total."""
    low = F.lower(text)
    pattern = r"(?:([0-9]+)\s*x\s*)?([0-9]+(?:\.[0-9]+)?)\s*(tb|gb|mb|kw|w|cm|mm|ghz|mhz)\b"
    cols = [F.regexp_extract_all(low, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    rows = F.arrays_zip(*[c.alias(n) for c, n in zip(cols, "nvu", strict=True)])

    def fact(r: Column) -> Column:
        dim, factor = (F.coalesce(*[F.when(r["u"] == u, F.lit(v[i])) for u, v in UNITS.items()]) for i in (0, 1))
        kit = (r["n"] != "") & (dim == "capacity_gb")
        value = r["v"].cast("double") * factor * F.when(kit, r["n"].try_cast("double")).otherwise(1.0)
        return F.struct(F.when(kit, F.lit("total_capacity_gb")).otherwise(dim).alias("name"), value.alias("value"))

    facts = F.transform(rows, fact)
    names = F.array_sort(F.array_distinct(F.transform(facts, lambda f: f["name"])))
    first = lambda n: F.filter(facts, lambda f: f["name"] == n)[0]["value"]
    return F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("="), F.format_string("%.2f", first(n)))), ",")


def version_key(text: Column) -> Column:
    """An array that orders versions: numbers by value and before letters."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"\d+|[a-z]+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(p.rlike("^[a-z]").alias("letters"), F.coalesce(p.try_cast("bigint"), F.lit(0)).alias("number"), F.when(p.rlike("^[a-z]"), p).otherwise("").alias("text")))


def ladder(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first pattern that occurs; the order of the rules matters."""
    out = None
    for pattern, value in rules:
        out = F.when(text.rlike("(?i)" + pattern), value) if out is None else out.when(text.rlike("(?i)" + pattern), value)
    return out.otherwise(F.lit(default))


#: Efficiency marks from best to plainest, stock words, and component words (fixed values).
EFFICIENCY = [("titanium", "80plus_titanium"), ("platinum", "80plus_platinum"), ("gold", "80plus_gold"), ("silver", "80plus_silver"), ("bronze", "80plus_bronze")]
STOCK = [("out of stock|sold out|unavailable", "out_of_stock"), ("limited|low stock|few left", "limited_stock"), ("pre.?order", "preorder"), ("in stock|available", "in_stock")]


def inferred(text: Column, rules: Mapping[str, str], veto: str | None = None) -> Column:
    """Names of all rules whose pattern occurs, unless the veto does."""
    hits = F.filter(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(n)) for n, p in rules.items()]), lambda x: x.isNotNull())
    return hits if veto is None else F.when(text.rlike("(?i)" + veto), F.array().cast("array<string>")).otherwise(hits)


def money(text: Column) -> Column:
    """A price with an optional currency mark and thousands commas, rounded half up to cents; else null."""
    body = F.regexp_extract(text, r"^\s*(?:S\$|SGD|\$)?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*$", 1)
    return F.when(body != "", F.regexp_replace(body, ",", "").try_cast("decimal(18,6)").cast("decimal(12,2)"))


def offset_timestamp(text: Column) -> Column:
    """An ISO time; one without an offset is refused."""
    return F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))


def signed_money(value: Column) -> Column:
    return F.concat(F.when(value < 0, "-").otherwise("+"), F.lit("S$"), F.format_number(F.abs(value), 2))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host without www and in lower case, and the path without a closing slash."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return host, F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
