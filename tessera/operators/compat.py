"""Compatibility rules over one row per build; a missing value is never a pass.

A build row has the columns the rules name (all nullable); absent columns count as null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.parts import compact, shortages
from tessera.functions.text import version_key

PRIORITY = {"pass": 0, "warning": 1, "unknown": 2, "fail": 3}
HEADROOM, ACCESSORY_W, TRANSIENT = 0.25, 100, 1.25


def status(needs: Sequence[Column], ok: Column, warn: Column | None = None) -> Column:
    """unknown if a needed value is missing, pass (or warning) if the condition holds, else fail."""
    known = F.lit(True)
    for c in needs:
        known = known & c.isNotNull()
    good = F.lit("pass") if warn is None else F.when(F.coalesce(warn, F.lit(False)), "warning").otherwise("pass")
    return F.when(~known, "unknown").when(F.coalesce(ok, F.lit(False)), good).otherwise("fail")


def token(c: Column) -> Column:
    """Lower-case letters and digits only; an empty one is null."""
    short = compact(c)
    return F.when(short != "", short)


def tokens(c: Column) -> Column:
    """The tokens of an array; null without any."""
    found = F.filter(F.transform(c, token), lambda t: t.isNotNull())
    return F.when(F.size(found) > 0, found)


def form(c: Column) -> Column:
    """A token with the short names of board sizes written out."""
    t = token(c)
    return F.when(t.isin("matx", "uatx"), "microatx").when(t == "mitx", "miniitx").when(t == "extendedatx", "eatx").otherwise(t)


def equal(a: str, b: str) -> Column:
    return status([token(F.col(a)), token(F.col(b))], token(F.col(a)) == token(F.col(b)))


def within(a: str, limit: str, positive: bool = False) -> Column:
    """a <= limit; a negative measure (or, for counts and sizes, 0) is as good as unknown."""
    use = lambda c: F.when(F.col(c) > 0 if positive else F.col(c) >= 0, F.col(c))
    return status([use(a), use(limit)], F.col(a) <= F.col(limit))


def member(a: str, allowed: str) -> Column:
    return status([token(F.col(a)), tokens(F.col(allowed))], F.array_contains(tokens(F.col(allowed)), token(F.col(a))))


def covers(needed: str, offered: str, none_needed: bool = False) -> Column:
    """No connector is short; with ``none_needed`` an empty map of needs passes whatever is offered."""
    lacking = F.size(shortages(F.col(needed), F.col(offered))) == 0
    known = status([F.col(needed), F.col(offered)], lacking)
    return F.when(F.size(needed) == 0, "pass").otherwise(known) if none_needed else known


def bios() -> Column:
    """Chipset and processor by what board and processor publish, then the least BIOS version.

    A negative in any published list fails; nothing published, or nothing that names the processor, is unknown.  An
    older BIOS warns where an update exists, fails where none does, and is unknown where that isn't known.
    """
    generation, chipset, model = token(F.col("cpu_generation")), token(F.col("board_chipset")), token(F.col("cpu_model"))
    generations, models, chipsets, matrix = tokens(F.col("board_generations")), tokens(F.col("board_models")), tokens(F.col("cpu_chipsets")), F.when(F.size("board_support") > 0, F.col("board_support"))
    entry = F.coalesce(F.try_element_at(matrix, model), F.try_element_at(matrix, generation))
    yes = lambda c: F.coalesce(c, F.lit(False))
    by_model = models.isNotNull() & model.isNotNull()
    against = [yes(~F.array_contains(generations, generation)), yes(by_model & ~F.array_contains(models, model)), yes(~F.array_contains(chipsets, chipset)), yes(matrix.isNotNull() & (entry.isNull() | ~F.coalesce(entry["supported"], F.lit(True))))]
    in_favour = [generations.isNotNull(), by_model, chipsets.isNotNull(), matrix.isNotNull()]
    some = lambda cs: reduce(lambda x, y: x | y, cs)
    published = some([c.isNotNull() for c in (generations, models, chipsets, matrix)])
    least = F.coalesce(entry["minimum_bios"], F.try_element_at("board_minimum_bios", model), F.try_element_at("board_minimum_bios", generation))
    update = F.coalesce(entry["update_available"], F.col("board_update_available"))
    own, want = version_key(F.col("board_bios")), version_key(least)
    older = F.when(F.col("board_bios").isNull() | (F.size(own) == 0) | (F.size(want) == 0), "unknown").when(own >= want, F.lit(None)).when(update.isNull(), "unknown").when(update, "warning").otherwise("fail")
    required = tokens(F.col("board_update_required"))
    warned = yes(token(entry["support_status"]).isin("beta", "preview", "experimental")) | yes(F.array_contains(required, generation)) | yes(F.array_contains(required, model))
    rest = F.coalesce(F.when(least.isNotNull(), older), F.when(warned, "warning").otherwise("pass"))
    return F.when(generation.isNull() | chipset.isNull() | ~published, "unknown").when(some(against), "fail").when(~some(in_favour), "unknown").otherwise(rest)


def slot() -> Column:
    """A slot for a card on PCI Express; another host interface isn't judged."""
    host = F.coalesce(token(F.col("gpu_interface")), F.lit("pcie"))
    return F.when(~host.contains("pcie"), "unknown").otherwise(status([F.col("board_pcie_slots")], F.col("board_pcie_slots") >= 1))


def board_in_case() -> Column:
    forms = F.when(F.size("case_forms") > 0, F.transform("case_forms", form))
    return status([form(F.col("board_form")), forms], F.array_contains(forms, form(F.col("board_form"))))


def _watts(*more: tuple[str, bool]) -> list[Column]:
    """Loads of 0 or more, supplies above 0; a published value that is invalid makes all unknown."""
    out = [F.when(F.col(c) >= 0, F.col(c)) for c in ("cpu_watts", "gpu_watts")] + [F.when(F.col("psu_watts") > 0, F.col("psu_watts"))]
    return out + [F.when(F.col(c).isNull() | (F.col(c) > 0 if positive else F.col(c) >= 0), F.lit(0)) for c, positive in more]


def psu_load() -> Column:
    return F.ceil((F.col("cpu_watts") + F.col("gpu_watts") + ACCESSORY_W) * (1 + HEADROOM))


def transient_load() -> Column:
    """Peaks of the card: the published one or the usual factor, never below its board power."""
    peak = F.greatest(F.col("gpu_watts"), F.coalesce(F.col("gpu_transient_watts"), F.col("gpu_watts") * TRANSIENT))
    return F.ceil(F.col("cpu_watts") + peak + ACCESSORY_W)


def transient() -> Column:
    offered = F.coalesce(F.col("psu_transient_watts"), F.col("psu_watts"))
    return status(_watts(("gpu_transient_watts", False), ("psu_transient_watts", True)), offered >= transient_load())


def conflicts() -> Column:
    """A published rule is broken if all of its features are in use at once; a rule of fewer than two is malformed."""
    rules, active = F.transform("board_conflicts", lambda r: F.array_distinct(F.transform(r, token))), F.transform("active_features", token)
    hit = F.exists(rules, lambda r: F.size(F.array_except(r, active)) == 0)
    return F.when(F.exists(rules, lambda r: F.size(r) < 2), "unknown").otherwise(status([rules, active], ~hit))


#: Words for coolers (fixed values).
AIR, LIQUID = ("air", "aircooler", "tower", "lowprofile", "passive"), ("aio", "liquid", "liquidcooler", "water", "watercooler")


def cooler() -> Column:
    """Height of an air cooler; size, position and thickness of a radiator."""
    kind, size, place = token(F.col("cooler_kind")), F.when((F.col("radiator_mm") >= 0) & (F.col("radiator_mm") % 1 == 0), F.col("radiator_mm")), token(F.col("radiator_position"))
    positions = F.when(F.size("case_radiators_at") > 0, F.map_from_entries(F.transform(F.map_entries("case_radiators_at"), lambda e: F.struct(token(e["key"]).alias("key"), e["value"].alias("value")))))
    sizes = F.coalesce(F.flatten(F.map_values(positions)), F.when(F.size("case_radiators") > 0, F.col("case_radiators")))
    fits = F.when(sizes.isNotNull(), F.array_contains(sizes, size)).otherwise(size <= F.col("case_radiator_max"))
    at = F.try_element_at(positions, place)
    limits = F.map_from_entries(F.transform(F.map_entries("case_thickness_at"), lambda e: F.struct(token(e["key"]).alias("key"), e["value"].alias("value"))))
    open_ = F.map_keys(F.map_filter(positions, lambda _, v: F.array_contains(v, size)))
    limit = F.coalesce(F.col("case_thickness_max"), F.when(place.isNotNull(), F.try_element_at(limits, place)).otherwise(F.array_max(F.map_values(F.map_filter(limits, lambda k, _: F.array_contains(open_, k))))))
    has_limit = F.col("case_thickness_max").isNotNull() | F.col("case_thickness_at").isNotNull()
    thick = F.when(F.col("radiator_thickness").isNull() & ~has_limit, F.lit(None)).when(F.col("radiator_thickness").isNull() | ~has_limit | limit.isNull(), "unknown").when(F.col("radiator_thickness") > limit, "fail")
    liquid = (
        F.when(size.isNull() | (sizes.isNull() & F.col("case_radiator_max").isNull()), "unknown").when(place.isNotNull() & positions.isNull(), "unknown")
        .when(place.isNotNull() & ~F.coalesce(F.array_contains(at, size), F.lit(False)), "fail").when(thick.isNotNull(), thick).when(F.coalesce(fits, F.lit(False)), "pass").otherwise("fail")
    )
    return F.when(kind.isin(*AIR), within("cooler_height_mm", "case_cooler_mm")).when(kind.isin(*LIQUID), liquid).otherwise("unknown")


def interface(c: Column) -> Column:
    t = token(c)
    return F.when(t.contains("nvme") | t.startswith("m2pcie"), "m2_nvme").when(t.contains("sata") & t.contains("m2"), "m2_sata").when(t.contains("sata"), "sata").when(t.contains("pcie"), "pcie").otherwise(t)


def drive_form() -> Column:
    """m2, 2_5_inch, 3_5_inch, or another form's token; an M.2 interface says as much."""
    t, own = token(F.col("storage_form")), interface(F.col("storage_interface"))
    named = F.when(t.startswith("m2") | t.isin("2230", "2242", "2260", "2280", "22110"), "m2").when(t.isin("25", "25in") | t.contains("25inch"), "2_5_inch").when(t.isin("35", "35in") | t.contains("35inch"), "3_5_inch").otherwise(t)
    return F.coalesce(named, F.when(own.isin("m2_nvme", "m2_sata"), "m2"))


def storage_interface() -> Column:
    own = interface(F.col("storage_interface"))
    listed = F.when(F.size("board_storage_interfaces") > 0, F.transform("board_storage_interfaces", interface))
    slots = {"m2_nvme": "board_m2", "sata": "board_sata", "pcie": "board_pcie_slots"}
    derived = F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(n)) for n, c in slots.items()]), lambda x: x.isNotNull())
    offered = F.coalesce(listed, F.when(F.coalesce(*[F.col(c) for c in slots.values()]).isNotNull(), derived))
    return status([own, offered], F.array_contains(offered, own))


def storage_slots() -> Column:
    own = interface(F.col("storage_interface"))
    free = F.when(own.isin("m2_nvme", "m2_sata"), F.coalesce("board_m2", F.lit(0))).when(own == "sata", F.coalesce("board_sata", F.lit(0))).when(own == "pcie", F.coalesce("board_pcie_slots", F.lit(0)))
    return status([free, F.coalesce("board_m2", "board_sata", "board_pcie_slots")], free >= 1)


def drive_bay() -> Column:
    """A bay of the drive's form; an M.2 drive needs none, an unknown form isn't judged."""
    kind = drive_form()
    bays = F.coalesce(F.try_element_at("case_bays_by_form", kind), F.when(F.col("case_bays_by_form").isNotNull(), 0))
    return F.when(kind == "m2", "pass").when(~kind.isin("2_5_inch", "3_5_inch"), "unknown").otherwise(status([kind, bays], bays >= 1))


def radiator_bays() -> Column:
    left = F.greatest(F.lit(0), F.col("case_bays") - F.col("radiator_bays"))
    return F.when(drive_form() == "m2", "pass").otherwise(status([F.col("case_bays"), F.col("radiator_bays")], left >= F.coalesce(F.col("storage_bays"), F.lit(0))))


def lifecycle() -> Column:
    state = token(F.col("lifecycle"))
    gone = state.isin("discontinued", "eol", "endoflife")
    return F.when(state.isin("active", "current", "available"), "pass").when(gone & F.coalesce("retained", F.lit(False)), "warning").when(gone | state.isin("upcoming", "notreleased"), "fail").otherwise("unknown")


RULES: dict[str, Callable[[], Column]] = {
    "cpu_board.socket": lambda: equal("cpu_socket", "board_socket"),
    "cpu_board.chipset_bios": bios,
    "memory_board.generation": lambda: equal("memory_type", "board_memory_type"),
    "memory_board.capacity": lambda: within("memory_gb", "board_memory_gb", positive=True),
    "memory_board.modules": lambda: within("memory_modules", "board_memory_slots", positive=True),
    "gpu_board.slot": slot,
    "board_case.form_factor": board_in_case,
    "gpu_case.length": lambda: within("gpu_length_mm", "case_gpu_mm"),
    "gpu_case.slots": lambda: within("gpu_slots", "case_slots", positive=True),
    "cooler_case.clearance": cooler,
    "cooler_cpu.socket": lambda: member("cpu_socket", "cooler_sockets"),
    "psu.capacity": lambda: status(_watts(), F.col("psu_watts") >= psu_load()),
    "psu.transient": transient,
    "psu.gpu_connectors": lambda: covers("gpu_connectors", "psu_connectors", none_needed=True),
    "psu.eps_connectors": lambda: covers("board_connectors", "psu_connectors"),
    "storage_board.interface": storage_interface,
    "storage_board.slots": storage_slots,
    "storage_case.bays": drive_bay,
    "psu_case.form_factor": lambda: member("psu_form", "case_psu_forms"),
    "board.conflicts": conflicts,
    "radiator.bays": radiator_bays,
    "lifecycle": lifecycle,
}

#: Types of the columns that rules need and a build row may lack.
TYPES: Mapping[str, str] = {
    **dict.fromkeys(("cpu_socket", "cpu_generation", "cpu_model", "board_socket", "board_bios", "board_chipset", "memory_type", "board_memory_type", "gpu_interface", "board_form", "cooler_kind", "radiator_position", "psu_form",
                     "storage_interface", "storage_form", "lifecycle"), "string"),
    **dict.fromkeys(("cpu_chipsets", "board_generations", "board_models", "board_update_required", "case_forms", "cooler_sockets", "case_psu_forms", "active_features", "board_storage_interfaces"), "array<string>"),
    **dict.fromkeys(("gpu_connectors", "psu_connectors", "board_connectors", "case_bays_by_form"), "map<string,int>"),
    **dict.fromkeys(("board_update_available", "retained"), "boolean"),
    **dict.fromkeys(("memory_gb", "board_memory_gb", "memory_modules", "board_memory_slots", "board_pcie_slots", "gpu_length_mm", "case_gpu_mm", "gpu_slots", "case_slots", "cooler_height_mm", "case_cooler_mm", "radiator_mm",
                     "case_radiator_max", "radiator_thickness", "case_thickness_max", "cpu_watts", "gpu_watts", "gpu_transient_watts", "psu_watts", "psu_transient_watts", "board_m2", "board_sata", "storage_bays", "case_bays", "radiator_bays"), "double"),
    "case_radiators": "array<double>",
    "case_radiators_at": "map<string,array<double>>",
    "case_thickness_at": "map<string,double>",
    "board_conflicts": "array<array<string>>",
    "board_minimum_bios": "map<string,string>",
    "board_support": "map<string,struct<supported:boolean,minimum_bios:string,support_status:string,update_available:boolean>>",
}


def check(builds: DataFrame, rules: Sequence[str] | None = None) -> DataFrame:
    """``(build_id, rule, status)``; of a build without authoritative evidence every rule is unknown."""
    rows = builds.select("*", *[F.lit(None).cast(t).alias(c) for c, t in TYPES.items() if c not in builds.columns])
    gate = F.col("authoritative") if "authoritative" in builds.columns else F.lit(True)
    each = [F.struct(F.lit(name).alias("rule"), F.when(~F.coalesce(gate, F.lit(False)), "unknown").otherwise(RULES[name]()).alias("status")) for name in (rules or RULES)]
    return rows.select("build_id", F.inline(F.array(*each)))


def cardinality(parts: DataFrame, categories: Sequence[str]) -> DataFrame:
    """``(build_id, rule, status)``: exactly one part of every category."""
    have = parts.groupBy("build_id", "category").agg(F.count("*").alias("n"))
    want = parts.select("build_id").distinct().withColumn("category", F.explode(F.array(*[F.lit(c) for c in categories])))
    n = F.coalesce("n", F.lit(0))
    return want.join(have, ["build_id", "category"], "left").select("build_id", F.concat(F.lit("cardinality."), "category").alias("rule"), F.when(n == 1, "pass").otherwise("fail").alias("status"))


def retained(parts: DataFrame, kept: DataFrame) -> DataFrame:
    """Parts to be kept, ``(build_id, product_id)``, fail where the build no longer has them."""
    have = parts.select("build_id", "product_id", F.lit("pass").alias("status")).distinct()
    return kept.join(have, ["build_id", "product_id"], "left").select("build_id", "product_id", F.lit("existing.retained").alias("rule"), F.coalesce("status", F.lit("fail")).alias("status"))


def report(results: DataFrame) -> DataFrame:
    """Worst status, counts, and the risk from missing data: none, elevated, or critical from three unknowns on."""
    level = F.coalesce(*[F.when(F.col("status") == s, p) for s, p in PRIORITY.items()])
    agg = results.groupBy("build_id").agg(F.max(level).alias("level"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in PRIORITY], F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "fail", F.col("rule")))), ",").alias("failed"))
    worst = F.coalesce(*[F.when(F.col("level") == p, s) for s, p in PRIORITY.items()])
    risk = F.when(F.col("n_unknown") == 0, "none").when(F.col("n_unknown") < 3, "elevated").otherwise("critical")
    return agg.select("build_id", worst.alias("status"), *[f"n_{s}" for s in PRIORITY], "failed", risk.alias("missing_data_risk"))
