"""Fail-closed predicates: a missing value never satisfies a requirement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(condition: Column) -> Column:
    """True only where the condition is true; unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def normalised(c: Column) -> Column:
    """Trimmed, lower case, hyphens and spaces as underscores."""
    return F.translate(F.lower(F.trim(c)), "- ", "__")


def any_equal(values: Column, required: str) -> Column:
    """Whether one of the values equals the required one, both normalised."""
    return holds(F.exists(values, lambda v: normalised(v) == normalised(F.lit(required))))


def first_of(*aliases: Column) -> Column:
    return F.coalesce(*aliases)


def safe_number(c: Column) -> Column:
    """A plain decimal number; exponents, NaN and other spellings are null."""
    return F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.expr("1.0D") * c.try_cast("double"))


def matches_terms(terms: Sequence[str], columns: Sequence[Column]) -> Column:
    """Every term occurs, whatever its case, in at least one of the columns; % and _ are wild."""
    one = [reduce(lambda a, b: a | b, [holds(c.ilike(f"%{t}%")) for c in columns]) for t in terms]
    return reduce(lambda a, b: a & b, one, F.lit(True))


@dataclass(frozen=True)
class ProductFilter:
    """What a product must satisfy; rules with a category list bind only products of those categories."""

    allowed_ids: Sequence[int] | None = None
    excluded_brands: Sequence[str] = ()
    max_price: float | None = None
    in_stock: bool = True
    minimum: Mapping[str, tuple[Sequence[str], float]] = field(default_factory=dict)
    equals: Mapping[str, tuple[Sequence[str], str]] = field(default_factory=dict)


def product_matches(f: ProductFilter, columns: Mapping[str, Column]) -> Column:
    """``columns``: id, category, brand, price, stock, and any attribute that a rule names."""
    scoped = lambda cats, cond: ~columns["category"].isin(list(cats)) | holds(cond) if cats else holds(cond)
    terms = [F.lit(True)]
    if f.allowed_ids is not None:
        terms.append(holds(columns["id"].isin(list(f.allowed_ids))) if f.allowed_ids else F.lit(False))
    if f.excluded_brands:
        terms.append(holds(~normalised(columns["brand"]).isin([b.lower() for b in f.excluded_brands])))
    if f.max_price is not None:
        terms.append(holds(columns["price"] <= f.max_price))
    if f.in_stock:
        terms.append(holds(columns["stock"].isin("in_stock", "limited_stock")))
    terms += [scoped(cats, columns[a] >= least) for a, (cats, least) in f.minimum.items()]
    terms += [scoped(cats, normalised(columns[a]) == want) for a, (cats, want) in f.equals.items()]
    return reduce(lambda a, b: a & b, terms)


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """The texts of all rules that do not hold, in order."""
    return F.filter(F.array(*[F.when(~holds(ok), F.lit(text)) for ok, text in rules]), lambda r: r.isNotNull())


def feature_matches(actual: Column, operator: str, required: object) -> Column:
    """equals, at_least, contains (arrays), truthy."""
    kinds = {
        "equals": lambda: actual == F.lit(required),
        "at_least": lambda: actual >= F.lit(required),
        "contains": lambda: F.array_contains(actual, required),
        "truthy": lambda: actual.cast("boolean"),
    }
    return holds(kinds[operator]())


def constraint(actual: Column, operator: str, value: object = None) -> Column:
    """eq, ge, le, one_of, contains, contains_all, not_null."""
    kinds = {
        "eq": lambda: actual == F.lit(value),
        "ge": lambda: actual >= F.lit(value),
        "le": lambda: actual <= F.lit(value),
        "one_of": lambda: actual.isin(list(value)),
        "contains": lambda: F.array_contains(actual, value),
        "contains_all": lambda: F.size(F.array_except(F.array(*[F.lit(v) for v in value]), actual)) == 0,
        "not_null": lambda: actual.isNotNull(),
    }
    return holds(kinds[operator]())


def mismatch_reasons(contract: Mapping[str, object]) -> Column:
    """Names of the columns whose value isn't exactly the contract's."""
    return reasons([(F.col(c) == F.lit(v), f"{c}_mismatch") for c, v in contract.items()])


def rights_valid(expires: Column, on: Column, flags: Sequence[Column]) -> Column:
    """All flags granted and not expired on the date."""
    return reduce(lambda a, b: a & b, [holds(f) for f in flags], holds(expires >= on))


FORBIDDEN = ("score", "rank", "relevance", "grade", "label", "prediction")


def leaks_hint(payload: Column) -> Column:
    """Whether a JSON text holds a key, at any depth, that would tell a reviewer the answer."""
    return payload.rlike(r'(?i)"[^"]*(' + "|".join(FORBIDDEN) + r')[^"]*"\s*:')


def paged(df: DataFrame, order: Sequence[Column], page: int, size: int) -> tuple[DataFrame, dict[str, object]]:
    """One page, the number clamped to the last; with total, page, has_next and has_previous."""
    total = df.count()
    last = max(1, -(-total // size))
    page = min(max(1, page), last)
    return df.orderBy(*order).offset((page - 1) * size).limit(size), {"total": total, "page": page, "has_next": page < last, "has_previous": page > 1}
