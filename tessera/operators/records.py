"""Turning source records into typed rows, each with the reason where it is refused."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import parts as P
from tessera.functions import text as T


def with_reasons(rows: DataFrame, rules: Sequence[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reasons``); a rule that is unknown fails."""
    why = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in rules]), lambda r: r.isNotNull())
    marked = rows.withColumn("reasons", why)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def reconciled(*signals: Column) -> Column:
    """The one known signal; conflict if known signals differ, unknown without any."""
    known = F.array_distinct(F.filter(F.array(*signals), lambda s: s.isNotNull() & (s != "unknown")))
    return F.when(F.size(known) == 0, "unknown").when(F.size(known) == 1, known[0]).otherwise("conflict")


def authority(rows: DataFrame, by: str, source_type: str) -> DataFrame:
    """authoritative if all of an item's sources are the manufacturer's, else unknown."""
    return rows.groupBy(by).agg(F.when(F.bool_and(F.coalesce(F.col(source_type) == "manufacturer", F.lit(False))), "authoritative").otherwise("unknown").alias("authority"))


def release_precision(precision: Column, date: Column) -> Column:
    """A date written as precisely as it is known (9 year, 10 month, 11 or more day)."""
    return F.when(precision == 9, F.date_format(date, "yyyy")).when(precision == 10, F.date_format(date, "yyyy-MM")).when(precision >= 11, F.date_format(date, "yyyy-MM-dd"))


def keyed_single(rows: DataFrame, text: str, rules: Mapping[str, str], limit: int) -> DataFrame:
    """Text cut to ``limit`` and its one inferred category; several or none are refused with a reason."""
    kinds = T.inferred(F.col(text), rules)
    return rows.withColumns({
        "title": F.substring(text, 1, limit), "category": F.when(F.size(kinds) == 1, kinds[0]),
        "reason": F.when(F.size(kinds) == 0, "no_category").when(F.size(kinds) > 1, "ambiguous_category"),
    })


def assembled(products: DataFrame, offers: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Products with their cheapest offer, their number of offers and their score, by left joins."""
    best = offers.groupBy(key).agg(F.min(F.struct("price", "listing")).alias("b"), F.count("*").alias("offers"))
    best = best.select(key, F.col("b.price").alias("price"), F.col("b.listing").alias("listing"), "offers")
    return products.join(best, key, "left").join(scores, key, "left").withColumn("offers", F.coalesce("offers", F.lit(0)))


def json_ld(pages: DataFrame, html: str) -> DataFrame:
    """One row per node of every ld+json block, @graph lists opened: ``node`` (JSON text), ``type``, ``name``, ``price``."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    nodes = pages.withColumn("block", F.explode(blocks)).withColumn("graph", F.get_json_object("block", "$.@graph"))
    listed = F.from_json(F.coalesce("graph", F.when(F.trim("block").startswith("["), F.col("block"))), "array<string>")
    out = nodes.withColumn("node", F.explode(F.coalesce(listed, F.array("block")))).drop("block", "graph")
    return out.withColumns({"type": F.get_json_object("node", "$.@type"), "name": F.get_json_object("node", "$.name"), "price": F.get_json_object("node", "$.offers.price").try_cast("decimal(12,2)")})


def _text(source: Column, path: str) -> Column:
    t = F.trim(F.get_json_object(source, path))
    return F.when(t != "", t)


def _positive(source: Column, path: str) -> Column:
    v = _text(source, path).try_cast("double")
    return F.when(v > 0, v)


def _whole(source: Column, path: str, least: int) -> Column:
    v = _text(source, path).try_cast("double")
    return F.when((v >= least) & (v == F.floor(v)), v.cast("long"))


def _reason(rules: Sequence[tuple[Column, str]]) -> Column:
    """The text of the first rule that doesn't hold, else null; a rule that is unknown fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in rules])


def accelerator_results(rows: DataFrame, source: str, available_only: bool = False, single_only: bool = False) -> DataFrame:
    """Typed benchmark results of JSON objects, with ``reason`` where one is refused.

    A result without accelerators is the processor's.  One component is answerable only for an available result of
    one node, one accelerator and no errors.  A unit of latency or milliseconds is better when lower.
    """
    m = F.from_json(source, "map<string,string>")

    def text(n: str) -> Column:
        t = F.trim(F.try_element_at(m, F.lit(n)))
        return F.when(t != "", t)

    def whole(n: str, least: int) -> Column:
        v = text(n).try_cast("double")
        return F.when((v >= least) & (v == F.floor(v)), v.cast("long"))

    score = text("Performance_Result").try_cast("double")
    total, nodes, errors = whole("Total Accelerators", 0), whole("Nodes", 1), whole("errors", 0)
    unit, model = text("Performance_Units"), F.coalesce(text("UsedModel"), text("Model"))
    out = rows.withColumns({
        "result_id": text("ID"), "availability": F.lower(F.coalesce(text("Availability"), F.lit("unknown"))), "accelerators": total, "score": F.when(score > 0, score), "unit": unit, "model": model, "scenario": text("Scenario"),
        "hardware_role": F.when(total == 0, "cpu").otherwise("accelerator"), "hardware": F.when(total == 0, text("Processor")).otherwise(text("Accelerator")), "higher_is_better": ~F.lower(unit).contains("latency") & ~F.lower(unit).endswith("ms"),
    })
    if available_only:
        out = out.where("availability = 'available'")
    if single_only:
        out = out.where("accelerators = 1")
    alone = (F.col("availability") == "available") & (F.coalesce(nodes, F.lit(1)) == 1) & F.coalesce(total == 1, F.lit(False)) & (F.coalesce(errors, F.lit(0)) == 0)
    reason = _reason([(F.col(c).isNotNull(), f"missing_{c}") for c in ("result_id", "score", "unit", "model", "scenario", "hardware")])
    ids = {"benchmark_id": T.stable_id("bench", *[F.col(c) for c in ("result_id", "model", "scenario", "unit")]), "product_id": T.stable_id("ext", F.col("hardware_role"), F.col("hardware"))}
    return out.withColumns({"component_eligible": alone, "reason": reason, **ids})


SUBMISSION = """id string, created_at string, data array<struct<device_info:struct<device_type:string,compute_devices:array<struct<type:string,name:string>>>,
stats:struct<samples_per_minute:double,total_render_time:double,render_time_no_sync:double>,scene:struct<label:string>,version:string,timestamp:string>>"""


def render_observations(rows: DataFrame, source: str) -> DataFrame:
    """One row per observation of JSON submissions, with ``reason`` where it is refused.

    The device must be one name of the kind in question; the score is the first of samples a minute, total time and
    time without synchronising that is positive; a time comes from the observation, else from the submission.
    """
    j = F.from_json(source, SUBMISSION.replace("\n", ""))
    out = rows.withColumn("j", j).select("*", F.posexplode("j.data").alias("place", "o"))
    kind, cpu = F.upper(F.trim("o.device_info.device_type")), F.lit("CPU")
    own = F.filter("o.device_info.compute_devices", lambda d: (F.upper(d["type"]) == cpu) == (kind == cpu))
    names = F.array_distinct(F.filter(F.transform(own, lambda d: F.trim(d["name"])), lambda n: n != ""))
    stats = [("samples_per_minute", "samples/minute", True), ("total_render_time", "seconds", False), ("render_time_no_sync", "seconds", False)]
    pick = F.coalesce(*[F.when(F.col(f"o.stats.{f}") > 0, F.struct(F.col(f"o.stats.{f}").alias("score"), F.lit(u).alias("unit"), F.lit(h).alias("higher"), F.lit(f).alias("field"))) for f, u, h in stats])
    at = F.coalesce(T.offset_timestamp(F.col("o.timestamp")), T.offset_timestamp(F.col("j.created_at")))
    rules = [
        (F.trim("j.id") != "", "missing_submission_id"), (kind.isin("CPU", "CUDA", "OPTIX"), "unsupported_device_type"), (F.size(names) == 1, "ambiguous_device"), (pick.isNotNull(), "no_positive_score"), (at.isNotNull(), "missing_timestamp"),
    ]
    return out.select(
        *rows.columns, F.col("j.id").alias("submission_id"), "place", kind.alias("device_type"), F.when(F.size(names) == 1, names[0]).alias("hardware"), pick["score"].alias("score"), pick["unit"].alias("unit"),
        pick["higher"].alias("higher_is_better"), pick["field"].alias("score_field"), F.coalesce("o.scene.label", F.lit("unknown")).alias("scene"), at.alias("observed_at"), _reason(rules).alias("reason"),
    )


#: Attributes of a product by category: name, place in the source, kind of value (fixed names and places).
ATTRIBUTES: dict[str, list[tuple[str, str, str]]] = {
    "cpu": [("socket", "socket", "text"), ("architecture", "microarchitecture", "text"), ("generation", "series", "text"), ("core_count", "cores.total", "count"), ("thread_count", "cores.threads", "count"), ("base_clock_ghz", "clocks.performance.base", "number"),
            ("boost_clock_ghz", "clocks.performance.boost", "number"), ("tdp_watts", "specifications.tdp", "number"), ("peak_power_watts", "specifications.ppt", "number"), ("maximum_memory_gb", "specifications.memory.maxSupport", "count")],
    "gpu": [("architecture", "chipset", "text"), ("vram_gb", "memory", "count"), ("vram_type", "memory_type", "text"), ("memory_bus_bits", "memory_bus", "count"), ("compute_unit_count", "core_count", "count"), ("base_clock_mhz", "core_base_clock", "number"),
            ("boost_clock_mhz", "core_boost_clock", "number"), ("length_mm", "length", "number"), ("slot_width", "total_slot_width", "number"), ("board_power_watts", "tdp", "number"), ("recommended_psu_watts", "recommended_psu_wattage", "count")],
    "motherboard": [("socket", "socket", "text"), ("chipset", "chipset", "text"), ("form_factor", "form_factor", "board_form"), ("memory_type", "memory.ram_type", "memory_type"), ("maximum_memory_gb", "memory.max", "count"), ("memory_slots", "memory.slots", "count"), ("bios_version", "bios_version", "text")],
    "memory": [("memory_type", "ram_type", "memory_type"), ("capacity_gb", "capacity", "count"), ("module_count", "modules.quantity", "count"), ("speed_mt_s", "speed", "count"), ("cas_latency", "cas_latency", "number"), ("voltage", "voltage", "number"), ("module_height_mm", "height", "number")],
    "storage": [("capacity_gb", "capacity", "count"), ("interface", "interface", "storage_interface"), ("form_factor", "form_factor", "storage_form"), ("sequential_read_mbps", "sequential_read", "number"), ("sequential_write_mbps", "sequential_write", "number"), ("endurance_tbw", "endurance", "number")],
    "power_supply": [("wattage", "wattage", "count"), ("efficiency_rating", "efficiency_rating", "efficiency"), ("form_factor", "form_factor", "psu_form"), ("modular_type", "modular", "modularity"), ("eps_connectors", "connectors.eps_8_pin", "zero_count"), ("atx_version", "atx_version", "text"), ("warranty_years", "warranty", "number")],
    "cooler": [("cooler_type", "water_cooled", "cooler"), ("height_mm", "height", "number"), ("radiator_size_mm", "radiator_size", "count"), ("fan_count", "fan_quantity", "count"), ("estimated_cooling_capacity_watts", "cooling_capacity", "number")],
    "case": [("case_size", "form_factor", "case_size"), ("maximum_gpu_length_mm", "max_video_card_length", "number"), ("maximum_gpu_slot_width", "max_video_card_slot_width", "number"), ("maximum_cooler_height_mm", "max_cpu_cooler_height", "number"), ("included_fans", "included_fans", "zero_count")],
}


def _attribute(source: Column, path: str, kind: str) -> Column:
    place = "$." + path
    text = _text(source, place)
    plain: dict[str, Callable[[], Column]] = {
        "text": lambda: text, "number": lambda: _positive(source, place), "count": lambda: _whole(source, place, 1), "zero_count": lambda: _whole(source, place, 0), "board_form": lambda: P.board_form(text), "psu_form": lambda: P.psu_form(text),
        "memory_type": lambda: P.memory_type(text), "storage_form": lambda: P.storage_form(text), "efficiency": lambda: P.efficiency(text), "modularity": lambda: P.modularity(text), "case_size": lambda: P.case_size(text),
        "storage_interface": lambda: P.storage_interface(text, _text(source, "$.nvme") == "true"), "cooler": lambda: F.when(text == "true", "aio").when(text == "false", "air"),
    }
    return plain[kind]().cast("string")


def part_number(values: Column, name: Column) -> Column:
    """The first part number that is no UUID and not just the name again."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    good = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: (v != "") & ~v.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$") & (bare(v) != bare(name)))
    return F.try_element_at(good, F.lit(1))


def canonical_products(rows: DataFrame, source: str, category: str) -> DataFrame:
    """Products of one category from their source's JSON: identity, attributes (a map of text), confidence, ``reason``.

    Attributes that are missing or not positive are left out of the map; a part number is the first usable one.
    """
    j = F.col(source)
    name, brand, uid = _text(j, "$.metadata.name"), _text(j, "$.metadata.manufacturer"), _text(j, "$.opendb_id")
    values = {n: _attribute(j, path, kind) for n, path, kind in ATTRIBUTES[category]}
    attributes = F.map_filter(F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    numbers = F.from_json(F.get_json_object(j, "$.metadata.part_numbers"), "array<string>")
    year = _whole(j, "$.metadata.releaseYear", 1)
    confidence = F.when(T.offset_timestamp(_text(j, "$.metadata.last_manually_spec_verified_at")).isNotNull(), 0.95).when(_text(j, "$.general_product_information.manufacturer_url").isNotNull(), 0.90).otherwise(0.80)
    return rows.withColumns({
        "product_id": F.concat(F.lit("prod_"), uid), "category": F.lit(category), "brand": brand, "model": F.coalesce(_text(j, "$.metadata.variant"), _text(j, "$.metadata.series"), name), "mpn": part_number(numbers, name), "canonical_name": name,
        "release_year": F.when(year.between(1970, F.year(F.current_date()) + 2), year), "attributes": attributes, "confidence": confidence, "reason": _reason([(uid.isNotNull(), "missing_id"), (name.isNotNull() & brand.isNotNull(), "missing_name_or_brand")]),
    })


def identifier_records(ids: DataFrame) -> DataFrame:
    """Records of a device id list (``sources.files.read_device_ids``): ``source_record_id``, kind and ids, and the label."""
    sub = F.split("code", " ")
    kind = F.when(F.col("level") == 0, "vendor").when(F.col("level") == 1, "device").otherwise("subsystem")
    parts = F.array(F.lit("pci"), kind, F.col("vendor"), F.when(F.col("level") > 0, F.col("device")), F.when(F.col("level") == 2, sub[0]), F.when(F.col("level") == 2, F.try_element_at(sub, F.lit(2))))
    known = F.filter(parts, lambda p: p.isNotNull())
    return ids.select(F.array_join(known, ":").alias("source_record_id"), kind.alias("identifier_type"), "vendor", "device", F.col("name").alias("canonical_label"), F.col("name").isin("").alias("empty_label"))


def feed_listings(rows: DataFrame, merchant: str, hosts: Sequence[str], currencies: Sequence[str] = ("SGD",), most: float = 100_000.0) -> DataFrame:
    """Listings of a merchant's feed (columns of text, and line), with ``reason`` where one is refused.

    Of several rows with one product id the first line stays.  Stock comes from four signals that must agree.
    """
    price, shipping = T.money(F.col("price")).cast("double"), T.money(F.col("shipping")).cast("double")
    yes = lambda c: F.lower(F.trim(c)).isin("1", "true", "yes", "y")
    no = lambda c: F.lower(F.trim(c)).isin("0", "false", "no", "n")
    words = {"in_stock": ("in_stock", "instock", "available"), "out_of_stock": ("out_of_stock", "outofstock", "sold_out"), "backorder": ("backorder", "back_order"), "preorder": ("preorder", "pre_order")}
    said = F.regexp_replace(F.lower(F.trim("stock_status")), "[ -]+", "_")
    named = F.coalesce(*[F.when(said.isin(list(w)), F.lit(k)) for k, w in words.items()])
    stock = reconciled(named, F.when(yes("in_stock"), "in_stock").when(no("in_stock"), "out_of_stock"), F.when(no("for_sale"), "out_of_stock"), F.when(yes("pre_order"), "preorder"))
    host = F.lower(F.try_parse_url(F.col("url"), F.lit("HOST")))
    rules = [
        (F.trim("merchant_id") == merchant, "merchant_id_mismatch"), (F.trim("product_id") != "", "product_id_missing"), (F.trim("title").isNotNull() & (F.trim("title") != ""), "title_missing"), (F.length("title") <= 1000, "title_too_long"),
        (F.upper("currency").isin(list(currencies)), "currency_not_allowed"), (price.isNotNull() & (price > 0), "price_missing"), (price <= most, "price_above_limit"), (shipping.isNotNull(), "shipping_price_missing"),
        (host.isin([h.lower() for h in hosts]), "link_host_not_allowed"), (F.lower(F.coalesce("condition", F.lit("new"))) == "new", "non_new_condition"), (stock != "conflict", "stock_signal_conflict"),
    ]
    typed = rows.withColumns({"base_price": price, "shipping_price": shipping, "stock": stock, "listing_id": T.stable_id("listing", F.trim("merchant_id"), F.trim("product_id")), "reason": _reason(rules)})
    w = Window.partitionBy("listing_id", F.col("reason").isNull()).orderBy("line")
    return typed.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(w) > 1), "duplicate_product_id").otherwise(F.col("reason")))


def offers_of_page(nodes: DataFrame, page: str, currencies: Sequence[str]) -> DataFrame:
    """Typed offers of Product nodes (``json_ld``), with ``reason``: several offers need ids of their own.

    A price of another currency, an unknown condition or shipping cost, and ids that two offers share are refused.
    """
    listed = F.from_json(F.get_json_object("node", "$.offers"), "array<string>")
    single = F.get_json_object("node", "$.offers")
    rows = nodes.select(*[c for c in nodes.columns if c not in ("offers", "type", "price")], F.explode(F.coalesce(F.when(F.trim(single).startswith("["), listed), F.array(single))).alias("offer"))
    o = F.col("offer")
    currency, price = F.upper(F.coalesce(_text(o, "$.priceCurrency"), _text(o, "$.priceSpecification.priceCurrency"))), F.coalesce(_text(o, "$.price"), _text(o, "$.priceSpecification.price")).try_cast("decimal(12,2)")
    shipping = _text(o, "$.shippingDetails.shippingRate.value").try_cast("decimal(12,2)")
    identity, url = F.coalesce(_text(o, "$.sku"), _text(o, "$.gtin"), _text(o, "$.mpn")), _text(o, "$.url")
    schema_word = lambda path: F.lower(F.regexp_extract(_text(o, path), r"([A-Za-z]+)$", 1))
    condition = F.when(schema_word("$.itemCondition") == "newcondition", "new").when(schema_word("$.itemCondition") == "usedcondition", "used").when(schema_word("$.itemCondition") == "refurbishedcondition", "refurbished").otherwise("unknown")
    stock = F.coalesce(*[F.when(schema_word("$.availability") == w, F.lit(s)) for w, s in (("instock", "in_stock"), ("limitedavailability", "limited_stock"), ("outofstock", "out_of_stock"), ("soldout", "out_of_stock"), ("preorder", "preorder"), ("backorder", "backorder"))], F.lit("unknown"))
    out = rows.withColumns({"currency": currency, "base_price": price, "shipping_price": shipping, "identity": identity, "condition": condition, "stock": stock, "url": url})
    of_page = Window.partitionBy(page)
    several, shared = F.count("*").over(of_page) > 1, F.count("identity").over(Window.partitionBy(page, "identity")) > 1
    rules = [
        (F.length(F.trim("name")) > 0, "name_missing"), (F.col("currency").isin(list(currencies)), "currency_not_allowed"), (F.col("base_price") > 0, "price_invalid"), (F.col("shipping_price").isNotNull(), "shipping_unknown"),
        (F.col("condition") != "unknown", "condition_unknown"), (F.col("condition") == "new", "non_new_condition"), (~several | F.col("identity").isNotNull(), "offer_identity_missing"), (~several | ~shared, "offer_identity_repeated"),
    ]
    return out.withColumn("several", several).withColumn("reason", _reason(rules)).drop("several", "offer")


def labelled_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pair labels (id, left_id, right_id, label, split) of two source tables (id, title, ...) with ``reason`` if refused."""
    known = pairs.join(left.select(F.col("id").alias("left_id"), F.col("title").alias("left_title")).dropDuplicates(["left_id"]), "left_id", "left").join(right.select(F.col("id").alias("right_id"), F.col("title").alias("right_title")).dropDuplicates(["right_id"]), "right_id", "left")
    twice = F.row_number().over(Window.partitionBy("left_id", "right_id").orderBy("split", "id")) > 1
    rules = [(F.col("label").isin(0, 1), "invalid_label"), (F.col("left_title").isNotNull() & F.col("right_title").isNotNull(), "unknown_record"), (~twice, "duplicate_pair")]
    return known.select("id", "left_id", "right_id", "label", "split", F.concat_ws(":", "split", "id").alias("source_pair_id"), _reason(rules).alias("reason"))


def adapted_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, assigned: str = "split") -> DataFrame:
    """Labelled pairs as listing and product records: ids with their side, no price in the catalogue's currency."""
    side = lambda d, key, name, p: d.select(F.col("id").alias(key), F.concat(F.lit(f"{p}-"), F.col("id").cast("string")).alias(f"{name}_id"), F.col("title").alias(f"{name}_title"), F.col("brand").alias(f"{name}_brand"), F.create_map(F.lit("source_side"), F.lit(p), F.lit("source_currency"), F.lit("USD")).alias(f"{name}_attributes"))
    both = pairs.join(side(left, "left_id", "listing", "left"), "left_id").join(side(right, "right_id", "product", "right"), "right_id")
    return both.select(F.concat_ws("-", F.lit("pair"), F.col(assigned), "source_pair_id").alias("pair_id"), "listing_id", "listing_title", "listing_brand", "listing_attributes", "product_id", "product_title", "product_brand", "product_attributes", "label")


def search_text(parts: Sequence[Column]) -> Column:
    """One searchable line: the known parts, trimmed, joined by single spaces."""
    return F.regexp_replace(F.trim(F.concat_ws(" ", *[F.trim(p.cast("string")) for p in parts])), r"\s+", " ")


@F.pandas_udf(StringType())
def flattened(values: pd.Series) -> pd.Series:
    """``path value`` of every leaf of a JSON text, in order of the path; null for what isn't JSON."""

    def leaves(node: object, path: str) -> list[tuple[str, str]]:
        if isinstance(node, dict):
            return [x for k, v in node.items() for x in leaves(v, f"{path}.{k}" if path else k)]
        if isinstance(node, list):
            return [x for v in node for x in leaves(v, path)]
        return [] if node is None else [(path, str(node).lower() if isinstance(node, bool) else str(node))]

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else " ".join(f"{p} {v}" for p, v in sorted(leaves(json.loads(text), "")))
        except ValueError:
            return None

    return values.map(one)


@F.pandas_udf(StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON text with its keys in order and no spaces; null for what isn't JSON or holds a number that isn't finite."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except ValueError:
            return None

    return values.map(one)


def content_version(value: Column) -> Column:
    return F.sha2(canonical_json(value), 256)


def query_text(rows: DataFrame) -> Column:
    """The search text of a structured request: its own words, workloads by name, then each requirement; never empty.

    Columns: raw_query, workloads (array), performance_target, minimum_gpu_vram_gb, minimum_memory_gb, storage_gb,
    wifi_required, case_size, noise, upgradeability, power_efficiency; absent ones count as null.
    """
    have = set(rows.columns)
    get = lambda c, t="string": F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    plain = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    some = lambda c, before, after="": F.when(get(c).isNotNull(), F.concat(F.lit(before), plain(get(c)), F.lit(after)))
    workloads = plain(F.array_join(F.array_sort(get("workloads", "array<string>")), " "))
    parts = [
        F.when(get("raw_query") != "", get("raw_query")), F.when(workloads != "", workloads), some("performance_target", ""), some("minimum_gpu_vram_gb", "GPU ", " GB VRAM"), some("minimum_memory_gb", "memory ", " GB"), some("storage_gb", "storage ", " GB"),
        F.when(get("wifi_required", "boolean"), "Wi-Fi"), some("case_size", ""), some("noise", "", " noise"), some("upgradeability", "", " upgradeability"), some("power_efficiency", "", " power efficiency"),
    ]
    text = F.concat_ws(" ", *parts)
    return F.when(text == "", "desktop PC component").otherwise(text)


def query_id(*parts: Column) -> Column:
    """A stable id of what was asked for: equal questions have equal ids."""
    return F.concat(F.lit("query_"), F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256), 1, 32))
