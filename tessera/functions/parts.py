"""Parts as titles and attributes name them: categories, quantities, variants, connectors and hardware families."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Names of a category and the one they stand for (fixed values).
CATEGORIES = {
    "cpu": "cpu", "processor": "cpu", "gpu": "gpu", "graphics card": "gpu", "video card": "gpu", "motherboard": "motherboard", "mainboard": "motherboard", "memory": "memory", "ram": "memory",
    "storage": "storage", "ssd": "storage", "hdd": "storage", "power supply": "power_supply", "psu": "power_supply", "cooler": "cooler", "cpu cooler": "cooler", "case": "case", "pc case": "case", "chassis": "case",
}
#: Words that tell no two models of a category apart, and colours (fixed values).
GENERIC = ("card", "case", "cooler", "cpu", "desktop", "gpu", "graphics", "hdd", "memory", "motherboard", "new", "power", "psu", "ram", "ssd", "supply")
COLOURS = ("black", "white", "silver", "gray", "grey", "red", "blue", "green", "orange", "pink", "purple", "brown")
#: Dimensions, their units and the factors to the base unit (fixed values).
QUANTITIES = {
    "capacity": {"tb": 1024.0, "gb": 1.0, "mb": 1 / 1024},
    "power": {"kw": 1000.0, "w": 1.0},
    "length": {"cm": 10.0, "mm": 1.0},
    "frequency": {"ghz": 1000.0, "mhz": 1.0},
}
#: Fields that tell variants apart: categories, names of the attribute, and its units (fixed values).
VARIANTS: dict[str, tuple[tuple[str, ...], tuple[str, ...], Mapping[str, float]]] = {
    "capacity_gb": (("memory", "storage"), ("capacity_gb", "memory_capacity_gb", "storage_capacity_gb", "total_capacity_gb", "capacity"), QUANTITIES["capacity"]),
    "vram_gb": (("gpu",), ("vram_gb", "vram_capacity_gb", "gpu_memory_gb", "memory_gb"), QUANTITIES["capacity"]),
    "module_count": (("memory",), ("module_count", "modules", "stick_count"), {}),
    "wattage_w": (("power_supply",), ("wattage_w", "wattage", "power_w"), QUANTITIES["power"]),
    "radiator_size_mm": (("cooler",), ("radiator_size_mm", "radiator_mm", "radiator_size"), QUANTITIES["length"]),
}


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def category(name: Column) -> Column:
    """The canonical category, or null."""
    known = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return F.try_element_at(known, T.squeezed(name))


def model_tokens(text: Column) -> Column:
    return F.array_except(T.unique_tokens(text), _words(GENERIC))


def _factor(unit: Column, units: Mapping[str, float]) -> Column:
    return F.coalesce(*[F.when(unit == u, F.lit(f)) for u, f in units.items()], F.lit(1.0))


def _scaled(kind: str, units: Mapping[str, float]) -> Callable[[Column], Column]:
    return lambda r: F.struct(F.lit(kind).alias("kind"), (r["v"].cast("double") * _factor(r["u"], units)).alias("value"))


def facts(text: Column) -> Column:
    """Quantities with a unit, distinct and in order: structs (kind, value) in base units.

    A kit (2 x 16 GB) gives its module_count and its total_capacity.  Bare numbers are no facts.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    fact = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    cut = lambda pattern, names: F.arrays_zip(*[F.regexp_extract_all(low, F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(names, 1)])
    found = []
    for kind, units in QUANTITIES.items():
        rows = cut(rf"(?<![a-z0-9])(\d+(?:\.\d+)?)\s*({'|'.join(units)})(?![a-z])", "vu")
        found.append(F.transform(rows, _scaled(kind, units)))
    kits = cut(r"(?<![a-z0-9])(\d+)\s*x\s*(\d+(?:\.\d+)?)\s*(tb|gb|mb)(?![a-z])", "nvu")
    found.append(F.transform(kits, lambda r: fact("module_count", r["n"].cast("double"))))
    found.append(F.transform(kits, lambda r: fact("total_capacity", r["n"].cast("double") * r["v"].cast("double") * _factor(r["u"], QUANTITIES["capacity"]))))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def written_facts(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat(f["kind"], F.lit("="), F.format_string("%.10f", f["value"]))), ",")


def _most(found: Column, kind: str) -> Column:
    return F.array_max(F.transform(F.filter(found, lambda f: f["kind"] == kind), lambda f: f["value"]))


def measured(text: Column, units: Mapping[str, float]) -> Column:
    """A number with or without a unit, in base units; anything else is null."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*(tb|gb|mb|kw|w|cm|mm)?\s*$"
    low = F.lower(text)
    return F.regexp_extract(low, pattern, 1).try_cast("double") * _factor(F.regexp_extract(low, pattern, 2), units)


def variants(attributes: Column, found: Column) -> Column:
    """A struct of the fields that tell variants apart: the attribute, or (also if that is 0) what the title says."""
    said = {
        "capacity_gb": F.coalesce(_most(found, "total_capacity"), _most(found, "capacity")), "vram_gb": F.coalesce(_most(found, "total_capacity"), _most(found, "capacity")),
        "module_count": _most(found, "module_count"), "wattage_w": _most(found, "power"), "radiator_size_mm": F.lit(None).cast("double"),
    }
    out = []
    for field, (_, names, units) in VARIANTS.items():
        own = F.coalesce(*[measured(F.try_element_at(attributes, F.lit(n)), units) for n in names])
        out.append(F.when(own != 0, own).otherwise(said[field]).alias(field))
    return F.struct(*out)


def conflicts(kind: Column, listing: Column, product: Column) -> Column:
    """Structs (field, listing, product) of the category's variant fields that both know and that differ."""
    each = []
    for field, (kinds, _, _) in VARIANTS.items():
        a, b = listing[field], product[field]
        differ = F.abs(a - b) > F.greatest(F.lit(1e-9), F.abs(b) * 1e-6)
        each.append(F.when(kind.isin(list(kinds)) & differ, F.struct(F.lit(field).alias("field"), a.alias("listing"), b.alias("product"))))
    return F.filter(F.array(*each), lambda c: c.isNotNull())


def colours(text: Column) -> Column:
    return F.array_intersect(T.unique_tokens(text), _words(COLOURS))


def colour_conflict(title: Column, colour: Column) -> Column:
    """Several colours in a title, or one that the product's colour doesn't name."""
    said, own = colours(title), colours(colour)
    return (F.size(said) > 1) | ((F.size(said) == 1) & (F.size(own) > 0) & ~F.arrays_overlap(said, own))


def begins_with_brand(title: Column, brand: Column) -> Column:
    words = lambda c: F.filter(F.split(T.squeezed(c), " "), lambda w: w != "")
    return (F.size(words(brand)) > 0) & (F.slice(words(title), F.lit(1), F.size(words(brand))) == words(brand))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def connector(name: Column, family: str | None = None) -> Column:
    """The canonical name of a power connector, its own compact name if it is an unknown one, else null."""
    raw, short = F.lower(name), compact(name)
    has = lambda *parts: _any([F.contains(short, F.lit(p)) for p in parts])
    eight = lambda: has("8pin") | short.isin("8", "8p")
    eps = F.lit(family == "eps") | has("eps", "cpu")
    return (
        F.when(short == "", F.lit(None)).when(has("12v2x6"), "12v_2x6").when(has("12vhpwr", "16pin"), "12vhpwr")
        .when(eps & (has("4plus4", "44pin") | F.contains(raw, F.lit("4+4")) | eight()), "eps_8_pin").when(eps & (has("4pin") | short.isin("4", "4p")), "eps_4_pin")
        .when(has("6plus2", "62pin") | F.contains(raw, F.lit("6+2")) | eight(), "pcie_8_pin").when(has("6pin") | short.isin("6", "6p"), "pcie_6_pin")
        .when(raw.rlike("pin|pcie|eps"), short)
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def connectors(text: Column, family: str | None = None) -> Column:
    """Struct (counts, unknown) of a list like ``2x 8-pin PCIe, 12VHPWR``; counts are null for a missing list."""
    entries = F.filter(F.transform(F.split(text, "[,;|]"), lambda e: F.trim(e)), lambda e: e != "")
    pattern = r"(?i)^(\d+)\s*[x×]\s*(.+)$"

    def parsed(e: Column) -> Column:
        several = F.rlike(e, F.lit(pattern))
        name = connector(F.when(several, F.regexp_extract(e, pattern, 2)).otherwise(e), family)
        return F.struct(e.alias("entry"), name.alias("name"), F.when(several, F.regexp_extract(e, pattern, 1).try_cast("int")).otherwise(1).alias("n"))

    rows = F.transform(entries, parsed)
    names = F.array_sort(F.array_distinct(F.filter(F.transform(rows, lambda r: r["name"]), lambda n: n.isNotNull())))
    total = lambda n: F.aggregate(F.filter(rows, lambda r: r["name"] == n), F.lit(0), lambda t, r: t + r["n"])
    counts = F.when(F.trim(text) != "", F.map_from_arrays(names, F.transform(names, total)))
    return F.struct(counts.alias("counts"), F.transform(F.filter(rows, lambda r: r["name"].isNull()), lambda r: r["entry"]).alias("unknown"))


def shortages(required: Column, available: Column) -> Column:
    """What is lacking of each connector; spare 8-pin leads stand in for 6-pin ones."""
    have = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    spare = F.greatest(F.lit(0), have(available, F.lit("pcie_8_pin")) - have(required, F.lit("pcie_8_pin")))
    lacking = F.transform_values(required, lambda k, n: F.greatest(F.lit(0), n - have(available, k) - F.when(k == "pcie_6_pin", spare).otherwise(0)))
    return F.map_filter(lacking, lambda _, n: n > 0)


def _only(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern as an array, if all its matches agree, else null."""
    rows = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, groups + 1)])
    one = F.array_distinct(rows)
    return F.when(F.size(one) == 1, F.array(*[one[0][f"g{i}"] for i in range(1, groups + 1)]))


def _named(prefix: str, *parts: Column) -> Column:
    kept = F.filter(F.array(*parts), lambda p: p != "")
    return F.concat(F.lit(prefix), F.array_join(kept, "_"))


#: Names of processors and graphics chips, most specific first: category, pattern, groups, and the family's name (fixed patterns).
FAMILIES: list[tuple[str, str, int, Callable[[Column], Column]]] = [
    ("cpu", r"amd(?: r)? ryzen (threadripper(?: pro)?|[3579])\s*(\d{4,5})([a-z]{0,3})\b", 3, lambda g: _named("cpu:amd_ryzen_", F.replace(g[0], F.lit(" "), F.lit("_")), F.concat(g[1], g[2]))),
    ("cpu", r"intel(?: r)? core(?: tm)? i([3579])\s*(\d{4,5})([a-z]{0,3})\b", 3, lambda g: _named("cpu:intel_core_i", g[0], F.concat(g[1], g[2]))),
    ("cpu", r"amd(?: r)? epyc\s*(\d{4})([a-z]{0,2})\b", 2, lambda g: _named("cpu:amd_epyc_", F.concat(g[0], g[1]))),
    ("gpu", r"(?:nvidia )?geforce\s*(rtx|gtx|gt)\s*(\d{3,4})(?:\s*(ti|super))?(?:\s*(laptop gpu))?", 4, lambda g: _named("gpu:nvidia_geforce_", g[0], g[1], g[2], F.when(g[3] != "", "laptop").otherwise(""))),
    ("gpu", r"(?:amd )?radeon\s*(rx|r9|r7|r5|hd)\s*(\d{3,4})(?:\s*(xtx|xt|gre|x2))?", 3, lambda g: _named("gpu:amd_radeon_", g[0], g[1], g[2])),
    ("gpu", r"(?:nvidia )?quadro\s*rtx\s*(\d{4})", 1, lambda g: _named("gpu:nvidia_quadro_rtx_", g[0])),
    ("gpu", r"(?:nvidia )?rtx\s*a\s*(\d{4})", 1, lambda g: _named("gpu:nvidia_rtx_a", g[0])),
    ("gpu", r"((?:amd )?radeon\s*vii)(?:\s|$)", 1, lambda g: F.lit("gpu:amd_radeon_vii")),
]


def hardware_family(name: Column, kind: str) -> Column:
    """The exact silicon family that a name gives, if it gives one only."""
    text, out = T.squeezed(name), []
    for category_, pattern, groups, named in FAMILIES:
        if category_ == kind:
            g = _only(text, pattern, groups)
            out.append(F.when(g.isNotNull(), named(g)))
    return F.coalesce(*out)


def explicit_vram(name: Column) -> Column:
    values = F.array_distinct(F.transform(F.regexp_extract_all(T.squeezed(name), F.lit(r"(\d{1,3})\s*gb(?:\s|$)"), F.lit(1)), lambda v: v.cast("int")))
    return F.when(F.size(values) == 1, values[0])


def leakage_family(family: Column) -> Column:
    """Close package and performance variants under one name, so that no split parts them."""
    gpu = F.regexp_replace(F.regexp_replace(family, r":\d+gb$", ""), "_(?:ti|super)$", "")
    intel, ryzen = (F.regexp_replace(family, rf"(?<=\d)(?:{ends})$", "") for ends in ("kf|ks|k|f|g|t|h|u|p", "xt|x|g|t|h|u|p"))
    return F.when(family.startswith("gpu:"), gpu).when(family.startswith("cpu:intel_core_"), intel).when(family.startswith("cpu:amd_ryzen_"), ryzen).otherwise(family)


def series(family: Column) -> Column:
    """The generation that a family's number gives, or unknown."""
    ge, ra, ry, co = (F.regexp_extract(family, p, 1) for p in (r"nvidia_geforce_(?:rtx|gtx|gt)_(\d{3,4})", r"amd_radeon_(?:rx|r9|r7|r5|hd)_(\d)\d{2,3}", r"cpu:amd_ryzen_[^_]+_(\d)\d{3,4}", r"cpu:intel_core_i\d_(\d{4,5})"))
    maker = lambda p: F.regexp_extract(family, p, 1)
    return (
        F.when(ge != "", F.concat(F.lit("nvidia_"), maker(r"geforce_(rtx|gtx|gt)_"), F.lit("_"), F.substring(ge, F.lit(1), F.length(ge) - 2), F.lit("_series")))
        .when(ra != "", F.concat(F.lit("amd_"), maker(r"radeon_(rx|r9|r7|r5|hd)_"), F.lit("_"), ra, F.lit("_series")))
        .when(ry != "", F.concat(F.lit("amd_ryzen_"), ry, F.lit("000_series")))
        .when(co != "", F.concat(F.lit("intel_core_gen_"), F.substring(co, F.lit(1), F.length(co) - 3)))
        .otherwise("unknown")
    )


#: Vocabularies of sources and their canonical values (fixed values).
MEMORY_TYPES = {"ddr3": "ddr3", "ddr4": "ddr4", "ddr5": "ddr5"}
BOARD_FORMS = {"miniitx": "mini_itx", "microatx": "micro_atx", "matx": "micro_atx", "atx": "atx", "eatx": "e_atx", "extendedatx": "e_atx"}
PSU_FORMS = {"atx": "atx", "sfx": "sfx", "sfxl": "sfx_l", "sfxlarge": "sfx_l"}
MODULARITY = {"fullmodular": "fully_modular", "fullymodular": "fully_modular", "semimodular": "semi_modular", "nonmodular": "non_modular", "fixed": "non_modular"}
STORAGE_FORMS = {
    "m22230": "m2_2230", "m22242": "m2_2242", "m22260": "m2_2260", "m22280": "m2_2280", "m222110": "m2_22110", "25": "2_5_inch", "25inch": "2_5_inch", "35": "3_5_inch", "35inch": "3_5_inch", "addincard": "add_in_card",
}
EFFICIENCY = ("titanium", "platinum", "gold", "silver", "bronze")


def _known(values: Mapping[str, str]) -> Callable[[Column], Column]:
    table = lambda: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return lambda text: F.try_element_at(table(), compact(text))


memory_type, board_form, psu_form, modularity, storage_form = (_known(v) for v in (MEMORY_TYPES, BOARD_FORMS, PSU_FORMS, MODULARITY, STORAGE_FORMS))


def efficiency(text: Column) -> Column:
    """The best mark named; a plain 80 PLUS is standard."""
    out, short = F.when(F.lit(False), F.lit("")), compact(text)
    for mark in EFFICIENCY:
        out = out.when(F.contains(short, F.lit(mark)), mark)
    return out.when(short.isin("80", "80plus", "standard"), "standard")


def storage_interface(text: Column, nvme: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.coalesce(nvme, F.lit(False)) | low.contains("nvme"), "nvme_pcie").when(low.contains("sata"), "sata").when(low.contains("pcie") | low.contains("pci-e"), "pcie").when(low.contains("usb"), "usb")


def case_size(text: Column) -> Column:
    low = F.lower(text)
    tower = lambda size: low.contains(size) & low.contains("tower")
    return F.when(tower("full"), "full_tower").when(tower("mid"), "mid_tower").when(tower("mini"), "mini_tower").when(low.rlike("small form|sff|mini-itx|mini itx"), "small_form_factor")
