"""Choosing one candidate of each category for every request, under a budget.

Candidates have request_id, category, product_id, price_cents, power_watts and the six scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.filters import reasons

SCORES = ("performance", "value", "reliability", "upgradeability", "efficiency", "preference")


class Profile(NamedTuple):
    weights: tuple[int, ...]
    price_divisor: int | None = None
    per_watt: int = 0


#: Weights in the order of SCORES, price divisor, penalty for a watt (fixed values).
PROFILES = {
    "best_overall": Profile((45, 25, 10, 10, 5, 5)),
    "best_value": Profile((20, 55, 10, 5, 5, 5), price_divisor=100),
    "highest_performance": Profile((70, 10, 5, 5, 5, 5)),
    "most_upgradeable": Profile((20, 10, 10, 50, 5, 5)),
    "lowest_power": Profile((10, 10, 10, 5, 60, 5), per_watt=1000),
}


def coefficient(profile: str) -> Column:
    """Integer worth of a candidate: weighted scores in hundredths, less warning, price and power penalties."""
    p = PROFILES[profile]
    worth = sum(w * F.col(s) for w, s in zip(p.weights, SCORES, strict=True))
    out = F.bround(worth * 100).cast("long") - F.bround(F.coalesce(F.col("warning_penalty"), F.lit(0.0)) * 100).cast("long")
    if p.price_divisor:
        out = out - F.floor(F.col("price_cents") / p.price_divisor)
    return out - F.coalesce(F.col("power_watts"), F.lit(0)).cast("long") * p.per_watt


class Limits(NamedTuple):
    """Hard limits of a build: cents, load without parts, and percent of head room of the supply's category."""

    budget_cents: int
    base_watts: int = 0
    headroom_percent: int = 0
    supply: str | None = None


def _load(supply: str | None) -> Column:
    return F.when(F.col("category") == (supply or ""), 0).otherwise(F.coalesce(F.col("power_watts"), F.lit(0))).cast("long")


#: Partial builds that the first pass, which only finds a build to beat, keeps of a request at each level; shares in which a request's partial builds are dealt out.
BEAM, SHARES = 64, 16
#: Prices of a cent and of a watt that the bound tries: this many powers of two about the request's own ratio, and shares about the best.
POWERS, NEAR = range(-6, 5), (0.6, 0.75, 0.9, 1.0, 1.15, 1.35, 1.6)


def _lagrange(offers: DataFrame, limits: Limits, count: int) -> DataFrame:
    """``(request_id, lam, mu)``: a price of a cent and one of a watt that make the bound on a request's worth small.

    For any such prices, the sum over the categories of the best worth less what the part uses, plus what the
    limits hold, is at least the worth of every build within them.  Two rounds of a grid, each one aggregation, look
    for the least; requests that lack a category are left out.
    """
    spread = lambda c: (F.max(c) - F.min(c)).cast("double")
    seen = offers.groupBy("request_id").agg(F.count_distinct("category").alias("n"), spread("coef").alias("w"), spread("price").alias("p"), spread("load").alias("l")).where(F.col("n") == count)
    per_cent = F.coalesce(F.try_divide("w", "p"), F.lit(0.0))
    per_watt = F.coalesce(F.try_divide("w", F.col("l") * (100 + limits.headroom_percent)), F.lit(0.0)) if limits.supply else F.lit(0.0)
    powers = [0.0, *(2.0**k for k in POWERS)]
    pair = lambda lam, mu: F.struct(lam.alias("lam"), mu.alias("mu"))

    def best(grid: DataFrame) -> DataFrame:
        tried = offers.join(grid.select("request_id", "per_watt", F.explode(F.array_distinct("grid")).alias("g")), "request_id")
        top = tried.groupBy("request_id", "per_watt", "g", "category").agg(F.max(_reduced(F.col("g.lam"), F.col("g.mu"), limits)).alias("top"))
        held = F.col("g.lam") * limits.budget_cents - F.col("g.mu") * (100 + limits.headroom_percent) * limits.base_watts
        return top.groupBy("request_id", "per_watt", "g").agg((F.sum("top") + held).alias("bound")).groupBy("request_id", "per_watt").agg(F.min_by("g", "bound").alias("g"))

    first = best(seen.select("request_id", per_watt.alias("per_watt"), F.array(*[pair(per_cent * k, F.lit(0.0)) for k in powers]).alias("grid")))
    second = F.array(*[pair(F.col("g.lam") * k, F.col("per_watt") * m) for k in NEAR for m in powers])
    return best(first.select("request_id", "per_watt", second.alias("grid"))).select("request_id", "g.lam", "g.mu")


def _reduced(lam: Column, mu: Column, limits: Limits) -> Column:
    """A part's worth less the price of what it uses; the supply gives instead of using."""
    gives = F.when(F.col("category") == (limits.supply or ""), mu * 100 * F.col("supply")).otherwise(0.0)
    return F.col("coef") - lam * F.col("price") - mu * (100 + limits.headroom_percent) * F.col("load") + gives


def _undominated(offers: DataFrame, layers: int) -> DataFrame:
    """``offers`` without the parts that no best build needs, where a pool has more than BEAM.

    A part is beaten by another one of its category with the same links, load and supply that is worth no less and
    costs no more, by its id if both are equal: it can take the part's place in any build.  Earlier builds hold one
    part of a category each, so ``layers`` of them, one more than there are earlier builds, leave one that differs.
    Products with several offers are left alone.
    """
    pool, one = ["request_id", "category"], ["request_id", "category", "product_id"]
    rows = offers.withColumn("wide", (F.count("*").over(Window.partitionBy(*pool)) > BEAM) & (F.count("*").over(Window.partitionBy(*one)) == 1))
    kept, left = [rows.where("not wide")], rows.where("wide")
    alike = Window.partitionBy(*pool, F.when(F.col("links").isNotNull(), F.col("member")), "load", "supply").orderBy("price", F.desc("coef"), "product_id").rowsBetween(Window.unboundedPreceding, -1)
    layer = F.lit(None).cast("int")
    for n in range(layers):
        left = left.withColumn("layer", layer)
        before = F.max(F.when(F.col("layer").isNull(), F.col("coef"))).over(alike)
        layer = F.coalesce("layer", F.when(before.isNull() | (F.col("coef") > before), n))
    kept.append(left.withColumn("layer", layer).where("layer is not null").drop("layer"))
    return kept[0].unionByName(kept[1]).drop("wide")


def choose(candidates: DataFrame, categories: Sequence[str], limits: Limits, profiles: Sequence[str], pairs: DataFrame | None = None, locked: DataFrame | None = None, differ: int = 2, most: int | None = None, member: str = "product_id") -> DataFrame:
    """``(request_id, profile, place, objective, price_cents, load_watts, ids, proved)`` of the best builds, one per profile.

    One candidate of each category within budget and supply, out of whole pools; ``pairs`` (request_id, left_id,
    right_id, penalty) forbids two candidates together (null) or charges for them (the most, if several rows say so);
    ids of pairs are values of ``member``, a column of the candidates: pairs of classes of parts stand for the pairs of all
    their parts.  ``locked`` (request_id, category, product_id) fixes one.  Each build differs from every earlier one in at least
    ``differ`` categories without a lock; a request ends at the first profile without a build.  Objective, then price,
    then ids decide.

    Partial builds of all requests grow together, a join per category.  A first pass keeps BEAM of each request and
    ends in a build to beat; the second keeps every partial build that can still reach it, by a Lagrangian bound over
    budget and supply, unless another one of the same load, supply, open links and differences to earlier builds is worth
    no less and costs no more: whatever completes the one completes the other.  The result is exact, and ``proved`` says so.
    A caller may give ``most``, which counts beaten ones too: should there be more partial builds of a request at one level,
    the most promising stay, and ``proved`` is false.
    """
    has_supply = F.coalesce(F.col("psu_watts"), F.lit(0)).cast("long") if "psu_watts" in candidates.columns else F.lit(0).cast("long")
    rows = candidates.select("request_id", "category", "product_id", F.col(member).alias("member"), F.col("price_cents").cast("long").alias("price"), _load(limits.supply).alias("load"), has_supply.alias("supply"), *[coefficient(p).alias(f"coef_{p}") for p in profiles])
    rows = rows.where(F.col("category").isin(*categories)).distinct()
    fixed = F.array().cast("array<string>")
    if locked is not None:
        rows = rows.join(locked.select("request_id", "category", F.col("product_id").alias("locked_id")), ["request_id", "category"], "left").where("locked_id is null or locked_id = product_id")
        fixed = F.col("fixed")
    if pairs is not None:
        one = lambda a, b: pairs.select("request_id", F.col(a).alias("member"), F.col(b).alias("with"), F.coalesce(F.col("penalty").cast("long"), F.lit(-1)).alias("charge"), F.col("penalty").isNull().alias("no"))
        links = one("left_id", "right_id").union(one("right_id", "left_id")).groupBy("request_id", "member", "with").agg(F.when(F.bool_or("no"), -1).otherwise(F.max("charge")).alias("charge"))
        # a part's links are open until the last category that holds a part they name
        last = rows.groupBy("request_id", F.col("member").alias("with")).agg(F.max(_position(categories, limits)).alias("last"))
        linked = links.join(last, ["request_id", "with"]).groupBy("request_id", "member").agg(F.map_from_entries(F.collect_list(F.struct("with", "charge"))).alias("links"), F.max("last").alias("until"))
        rows = rows.join(linked, ["request_id", "member"], "left").fillna(-1, ["until"])
    else:
        rows = rows.withColumns({"links": F.lit(None).cast(f"map<{dict(rows.dtypes)['member']},bigint>"), "until": F.lit(-1)})
    kind, group = dict(rows.dtypes)["product_id"], dict(rows.dtypes)["member"]
    rows = rows.checkpoint()
    order = _order(categories, limits)
    n, percent = len(order), 100 + limits.headroom_percent
    old, out = None, None
    for place, profile in enumerate(profiles, 1):
        offers = rows.withColumnRenamed(f"coef_{profile}", "coef").drop(*[f"coef_{p}" for p in profiles])
        offers = _undominated(offers, place).checkpoint()
        offers = offers.join(_lagrange(offers, limits, n), "request_id").withColumn("reduced", _reduced(F.col("lam"), F.col("mu"), limits)).checkpoint()
        own = lambda f, c: [f(F.when(F.col("category") == categories[i], F.col(c))).alias(f"{c}_{k}") for k, i in enumerate(order)]
        locks = F.collect_set(F.when(F.col("locked_id").isNotNull(), F.col("category"))) if locked is not None else fixed
        known = offers.groupBy("request_id", "lam", "mu").agg(*own(F.max, "reduced"), *own(F.min, "price"), *own(F.min, "load"), *([locks.alias("fixed")] if locked is not None else []))
        if old is not None:
            known = known.join(old, "request_id")
        rest = lambda c, k: " + ".join(["0", *(f"{c}_{j}" for j in range(k, n))])
        start = known.selectExpr(
            "request_id", "lam", "mu", "old" if old is not None else f"cast(array() as array<array<{kind}>>) as old", "fixed" if locked is not None else "cast(array() as array<string>) as fixed",
            "array(" + ", ".join(f"struct(cast({rest('reduced', k + 1)} as double) as worth, cast({rest('price', k + 1)} as bigint) as price, cast({rest('load', k + 1)} as bigint) as load)" for k in range(n)) + ") as rests",
            f"{rest('reduced', 0)} + lam * {limits.budget_cents} - mu * {percent * limits.base_watts} as bound", "0L as worth", "0L as cents", f"{limits.base_watts}L as watts", "cast(null as bigint) as power", f"cast(array() as array<{kind}>) as picked", f"cast(array() as array<struct<member:{group},until:int>>) as members", "false as lost",
        )

        def grown(start: DataFrame, offers: DataFrame, goal: bool, keep: int | None) -> DataFrame:
            now, same = start, ["request_id", "lam", "mu", "old", "fixed", "rests", "lost", *(["goal"] if goal else [])]
            gives = "mu * 100 * coalesce(power, 0)" if limits.supply else "0"
            for k, i in enumerate(order):
                part = offers.where(F.col("category") == categories[i]).select("request_id", "product_id", "member", "until", "coef", "price", "load", "supply", "links", "reduced")
                if goal:
                    # most pairs are judged by two numbers, before anything is made of them; the tolerance is wider than that of the bound below
                    now = now.withColumns({"share": F.pmod(F.xxhash64("picked"), F.lit(SHARES)).cast("int"), "ahead": F.expr(f"worth - lam * cents - mu * {percent} * watts + {gives} + rests[{k}].worth + lam * {limits.budget_cents}")})
                    part = part.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
                    near = F.col("now.ahead") + F.col("part.reduced") + 2e-6 * F.greatest(F.lit(1.0), F.abs(F.col("now.ahead")) + F.abs(F.col("part.reduced"))) >= F.col("now.goal")
                    on = (F.col("now.request_id") == F.col("part.request_id")) & (F.col("now.share") == F.col("part.share")) & near & (F.col("now.cents") + F.col("part.price") <= limits.budget_cents)
                    met = now.alias("now").join(part.alias("part"), on).select("now.*", *[F.col(f"part.{c}") for c in part.columns if c not in ("request_id", "share")])
                else:
                    met = now.join(part, "request_id")
                step = met.selectExpr(
                    *same, "transform(members, x -> coalesce(try_element_at(links, x.member), 0L)) as charges", "worth + coef as gross", "cents + price as cents", "watts + load as watts",
                    f"{'supply' if categories[i] == limits.supply else 'power'} as power", "concat(picked, array(product_id)) as picked", f"filter(concat(members, array(struct(member, until))), x -> x.until > {k}) as members", f"rests[{k}] as left",
                )
                # a category with a lock holds the same part in every build, so it never counts as a difference
                free = " + ".join(["0", *(f"if(array_contains(fixed, '{categories[j]}'), 0, 1)" for j in order[k + 1 :])])
                ok = ["not exists(charges, c -> c < 0)", f"cents + left.price <= {limits.budget_cents}"]
                if limits.supply:
                    ok.append(f"(power is null or (watts + left.load) * {percent} <= power * 100)")
                if old is not None:
                    ok.append(f"forall(old, b -> aggregate(zip_with(picked, slice(b, 1, {k + 1}), (x, y) -> if(x <> y, 1, 0)), 0, (t, x) -> t + x) + {free} >= {differ})")
                step = step.where(" and ".join(ok)).selectExpr(*same, "left", "gross - aggregate(charges, 0L, (t, c) -> t + c) as worth", "cents", "watts", "power", "picked", "members")
                step = step.selectExpr(*same, f"worth - lam * cents - mu * {percent} * watts + {gives} + left.worth + lam * {limits.budget_cents} as bound", "worth", "cents", "watts", "power", "picked", "members")
                if goal:
                    step = step.where("bound + 1e-6 * greatest(1, abs(bound)) >= goal")
                if keep is None:
                    # a plan of all levels would take longer to make than to run
                    now = _unbeaten(step, order[: k + 1], differ if old is not None else None, limits).checkpoint()
                    continue
                step = step.selectExpr(*[c for c in step.columns if c != "lost"], f"lost or count(*) over (partition by request_id) > {keep} as lost", "row_number() over (partition by request_id order by bound desc, picked) as nth")
                now = step.where(f"nth <= {keep}").drop("nth")
            final = ", ".join(f"picked[{order.index(i)}]" for i in range(n))
            return now.groupBy("request_id").agg(F.expr(f"min(struct(-worth as worth, cents, array({final}) as ids, watts, picked)) as best"), F.bool_or("lost").alias("lost"))

        first = grown(start, offers, False, BEAM).select("request_id", "best").checkpoint()
        goal = start.select("request_id", F.col("bound").alias("whole")).join(first, "request_id", "left").selectExpr("request_id", "whole", "coalesce(-best.worth, double('-inf')) as goal")
        # a part whose best completion doesn't reach the goal is in no better build
        useful = offers.join(goal, "request_id").withColumn("top", F.max("reduced").over(Window.partitionBy("request_id", "category"))).where("whole - top + reduced + 1e-6 * greatest(1, abs(whole)) >= goal").select(*offers.columns)
        exact = grown(start.join(goal.select("request_id", "goal"), "request_id"), useful, True, most)
        both = exact.select("request_id", "best", (~F.col("lost")).alias("proved")).unionByName(first.withColumn("proved", F.lit(False)))
        found = both.groupBy("request_id").agg(F.min("best").alias("best"), F.bool_or("proved").alias("proved")).checkpoint()
        shown = found.select("request_id", F.lit(profile).alias("profile"), F.lit(place).alias("place"), (-F.col("best.worth")).alias("objective"), F.col("best.cents").alias("price_cents"), F.col("best.watts").alias("load_watts"), "best.ids", "proved")
        out = shown if out is None else out.unionByName(shown)
        picked = found.select("request_id", F.col("best.picked").alias("new"))
        old = picked.select("request_id", F.array("new").alias("old")) if old is None else old.join(picked, "request_id").select("request_id", F.concat("old", F.array("new")).alias("old"))
    return out


def _order(categories: Sequence[str], limits: Limits) -> list[int]:
    """Places of the categories in the order of the search: the supply's first."""
    return sorted(range(len(categories)), key=lambda i: categories[i] != limits.supply)


def _position(categories: Sequence[str], limits: Limits) -> Column:
    found = F.lit(-1)
    for k, i in enumerate(_order(categories, limits)):
        found = F.when(F.col("category") == categories[i], k).otherwise(found)
    return found


def _unbeaten(partial: DataFrame, picked: Sequence[int], differ: int | None, limits: Limits) -> DataFrame:
    """Partial builds without those that another of the same request, open links, load, supply and differences beats.

    It is worth no less and costs no more, and its ids, in the order of the categories, are smaller if both are equal.
    """
    apart = [f"transform(old, b -> least({differ}, aggregate(zip_with(picked, slice(b, 1, {len(picked)}), (x, y) -> if(x <> y, 1, 0)), 0, (t, x) -> t + x)))"] if differ is not None else []
    ids = ", ".join(f"picked[{picked.index(i)}]" for i in sorted(picked))
    group = [F.col("request_id"), F.col("members"), *map(F.expr, apart), *([F.col("watts"), F.col("power")] if limits.supply else [])]
    alike = Window.partitionBy(*group).orderBy("cents", F.desc("worth"), F.expr(f"array({ids})")).rowsBetween(Window.unboundedPreceding, -1)
    rows = partial.withColumn("before", F.max("worth").over(alike))
    return rows.where("before is null or worth > before").drop("before")


def build_errors(builds: DataFrame, candidates: DataFrame, categories: Sequence[str], limits: Limits, pairs: DataFrame | None = None, locked: DataFrame | None = None, member: str = "product_id") -> DataFrame:
    """``(request_id, build_id, errors)``: every hard limit judged again from the parts, without the search.

    ``builds`` (request_id, build_id, product_id) has a row for each part; ids of ``pairs`` are values of ``member``.
    """
    parts = builds.join(candidates.select("request_id", "product_id", F.col(member).alias("member"), "category", "price_cents", _load(limits.supply).alias("load"), *([F.col("psu_watts")] if "psu_watts" in candidates.columns else [F.lit(None).cast("long").alias("psu_watts")])), ["request_id", "product_id"])
    key = ["request_id", "build_id"]
    total = parts.groupBy(*key).agg(
        *[F.count_if(F.col("category") == c).alias(f"n_{i}") for i, c in enumerate(categories)], F.sum("price_cents").alias("price"), (F.sum("load") + limits.base_watts).alias("load"),
        F.max(F.when(F.col("category") == (limits.supply or ""), F.col("psu_watts"))).alias("supply"),
    )
    bad = {"forbidden": None, "lock": None}
    if pairs is not None:
        one = parts.select(*key, F.col("member").alias("left_id")).join(pairs.where("penalty is null").select("request_id", "left_id", "right_id"), ["request_id", "left_id"])
        hit = one.join(parts.select(*key, F.col("member").alias("right_id")), [*key, "right_id"])
        bad["forbidden"] = hit.groupBy(*key).agg(F.count("*").alias("n_forbidden"))
    if locked is not None:
        want = builds.select(*key).distinct().join(locked.select("request_id", "product_id"), "request_id")
        bad["lock"] = want.join(parts.select(*key, "product_id"), [*key, "product_id"], "left_anti").groupBy(*key).agg(F.count("*").alias("n_lock"))
    for found in bad.values():
        if found is not None:
            total = total.join(found, key, "left")
    rules = [(F.col(f"n_{i}") == 1, f"needs_one_{c}") for i, c in enumerate(categories)]
    rules += [(F.col("price") <= limits.budget_cents, "over_budget")]
    if pairs is not None:
        rules += [(F.coalesce("n_forbidden", F.lit(0)) == 0, "forbidden_pair")]
    if locked is not None:
        rules += [(F.coalesce("n_lock", F.lit(0)) == 0, "locked_part_missing")]
    if limits.supply:
        rules += [(F.col("load") * (100 + limits.headroom_percent) <= F.col("supply") * 100, "supply_too_small")]
    return total.select(*key, reasons(rules).alias("errors"))


def component_scores(rows: DataFrame) -> DataFrame:
    """The six scores of candidates (workload_scores and workload_weights maps, component_score, signals map, brand, preferred_brands).

    Shares of 1 or less are percentages already divided; all end within 0..100.
    """
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    signal = lambda n: F.coalesce(F.try_element_at("signals", F.lit(n)), F.lit(0.0))
    percent = lambda n: inside(F.when(signal(n) <= 1, signal(n) * 100).otherwise(signal(n)))
    known = F.map_filter("workload_weights", lambda k, _: F.map_contains_key("workload_scores", k))
    weight = F.aggregate(F.map_values(known), F.lit(0.0), lambda t, w: t + w)
    worth = F.aggregate(F.map_entries(known), F.lit(0.0), lambda t, e: t + e["value"] * F.try_element_at("workload_scores", e["key"]))
    liked = F.coalesce(F.array_contains(F.transform("preferred_brands", F.lower), F.lower("brand")), F.lit(False))
    out = {
        "performance": inside(F.when(weight > 0, worth / weight).otherwise(0.0)), "value": F.col("component_score"), "reliability": percent("reliability_score"), "upgradeability": percent("upgradeability_score"),
        "efficiency": percent("power_efficiency_score"), "preference": inside(F.when(liked, 100.0).otherwise(100 * signal("preference_match_score"))),
    }
    return rows.withColumns(out)


def workload_delta(new: Column, old: Column, weights: Column) -> Column:
    """Weighted mean gain over the workloads that both have; null without any."""
    both = F.map_filter(weights, lambda k, _: F.map_contains_key(new, k) & F.map_contains_key(old, k))
    weight = F.aggregate(F.map_values(both), F.lit(0.0), lambda t, w: t + w)
    gain = F.aggregate(F.map_entries(both), F.lit(0.0), lambda t, e: t + e["value"] * (F.try_element_at(new, e["key"]) - F.try_element_at(old, e["key"])))
    return F.when(weight > 0, F.round(gain / weight, 6))


def replaced(builds: DataFrame, replacement: DataFrame, reoptimize: bool, owned: DataFrame | None = None) -> DataFrame:
    """Locks for another search: ``(request_id, category, product_id)`` with one part replaced.

    ``builds`` has (request_id, category, product_id), ``replacement`` the same for the parts that come in.  All other
    parts stay, or with ``reoptimize`` only those in ``owned`` (request_id, product_id).
    """
    kept = builds.join(replacement.select("request_id", "category"), ["request_id", "category"], "left_anti")
    if reoptimize:
        kept = kept.join(owned.select("request_id", "product_id"), ["request_id", "product_id"], "left_semi") if owned is not None else kept.limit(0)
    return kept.select("request_id", "category", "product_id").unionByName(replacement.select("request_id", "category", "product_id"))


#: What a request could give up: the category that lacks candidates (null: any), the requirement, the advice (fixed texts).
RELAXATIONS = [
    ("gpu", "minimum_gpu_vram_gb", "lower the minimum GPU VRAM requirement"), ("memory", "minimum_memory_gb", "lower the minimum system-memory capacity"), ("storage", "storage_gb", "lower the required storage capacity"),
    ("motherboard", "wifi_required", "allow a separate Wi-Fi adapter"), (None, "excluded_brands", "remove one or more brand exclusions"), (None, "in_stock_only", "include backorder or unknown-stock listings"),
]


def relaxations(empty: Column) -> Column:
    """Advice for a request whose categories in ``empty`` (an array) have no candidate; the budget always comes last."""
    asked = lambda c: F.coalesce(F.col(c).cast("string").isin("true") | (F.col(c).try_cast("double") > 0) | (F.col(c).cast("string").rlike("[^0-9. ]") & (F.lower(F.col(c).cast("string")) != "false")), F.lit(False))
    each = [F.when(asked(c) & (F.array_contains(empty, kind) if kind else F.lit(True)), F.lit(text)) for kind, c, text in RELAXATIONS]
    return F.filter(F.array(*each, F.lit("increase the acquisition budget")), lambda x: x.isNotNull())


def alternatives(candidates: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """The ``n`` other candidates of a chosen part's category that are worth most, with what they add and cost."""
    rows = candidates.select("request_id", "category", F.col("product_id").alias("other"), F.col("coef").alias("other_coef"), F.col("price_cents").alias("other_price"))
    both = chosen.join(rows, ["request_id", "category"]).where("other <> product_id")
    w = Window.partitionBy("request_id", "category", "product_id").orderBy(F.desc("other_coef"), "other_price", "other")
    ranked = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.select("request_id", "category", "product_id", "other", "rank", (F.col("other_coef") - F.col("coef")).alias("gain"), (F.col("other_price") - F.col("price_cents")).alias("extra_cents"))


def infeasible(candidates: DataFrame, categories: Sequence[str], budget_cents: int) -> DataFrame:
    """Per request the categories without a candidate, and whether the cheapest choice is over the budget."""
    low = candidates.groupBy("request_id", "category").agg(F.min("price_cents").alias("low"))
    agg = low.groupBy("request_id").agg(F.collect_set("category").alias("have"), F.sum("low").alias("least_cents"))
    missing = F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(c) for c in categories]), F.col("have"))), ",")
    return agg.select("request_id", missing.alias("missing"), "least_cents", (F.col("least_cents") > budget_cents).alias("over_budget"))
