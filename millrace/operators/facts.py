"""From relational tables to one fact row per load: checked star join, error codes, enrichment from a weighted table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.exprs import hash_uniform, in_order, month_key
from millrace.functions.json_answers import LISTS, missing_fields
from millrace.operators.quality import assert_unique, pivot_pairs

EVENT_KINDS = ("Pickup", "Delivery")


def lookup(value: Column, mapping: dict[str, str]) -> Column:
    """Mapped value, null where the mapping has none."""
    pairs = [F.lit(x) for kv in sorted(mapping.items()) for x in kv]
    return F.try_element_at(F.create_map(*pairs), value)


def star(loads: DataFrame, routes: DataFrame, customers: DataFrame, events: DataFrame) -> DataFrame:
    """Loads with their route, customer and pair of events; all left joins, the right sides checked to be unique.

    Only needed columns are joined; the optimizer chooses how by the sizes it sees.
    """
    r = assert_unique(routes.select("route_id", "origin_city", "origin_state", "destination_city", "destination_state"), ["route_id"], "routes")
    c = assert_unique(customers.select("customer_id", "customer_name", "primary_freight_type"), ["customer_id"], "customers")
    e = pivot_pairs(events, "load_id", "event_type", EVENT_KINDS, ["scheduled_datetime", "location_city", "location_state"], "location_city")
    return (
        loads.join(r.withColumn("_route", F.lit(True)), "route_id", "left")
        .join(c.withColumn("_customer", F.lit(True)), "customer_id", "left")
        .join(e.withColumn("_events", F.lit(True)), "load_id", "left")
    )


def first_error(joined: DataFrame, required: Sequence[str], domains: dict[str, dict[str, str]], cities: Sequence[str] | None = None) -> Column:
    """The first error code that fits a joined row, null for a good one.

    Precedence: MISSING_VALUE (a required column is null), MISSING_ROUTE,
    MISSING_CUSTOMER, EVENTS (not one pickup and one delivery), UNKNOWN_VALUE
    (no mapping), UNKNOWN_CITY (a city of the route is not in ``cities``, a
    catalog of names), INVALID (bounds of the fact).
    """
    null = F.lit(False)
    for c in required:
        null = null | F.col(c).isNull()
    unknown = F.lit(False)
    for c, m in domains.items():
        unknown = unknown | (F.col(c).isNotNull() & lookup(F.col(c), m).isNull())
    foreign = F.lit(False)
    if cities is not None:
        foreign = ~F.coalesce(F.col("origin_city").isin(*cities) & F.col("destination_city").isin(*cities), F.lit(False))
    invalid = (F.col("pieces") < 1) | (F.col("weight_lbs") <= 0) | (F.to_date("delivery_scheduled_datetime") < F.to_date("pickup_scheduled_datetime"))
    return (
        F.when(null, "MISSING_VALUE").when(F.col("_route").isNull(), "MISSING_ROUTE").when(F.col("_customer").isNull(), "MISSING_CUSTOMER")
        .when(F.col("_events").isNull(), "EVENTS").when(unknown, "UNKNOWN_VALUE").when(foreign, "UNKNOWN_CITY").when(invalid, "INVALID")
    )


def build_facts(loads: DataFrame, routes: DataFrame, customers: DataFrame, events: DataFrame, equipment: dict[str, str], cargo: dict[str, str], cities: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, issues): every load is either one fact or one issue with its first error code.

    A caller that must refuse the whole batch checks that issues is empty.
    """
    joined = star(loads, routes, customers, events)
    required = ("load_id", "route_id", "customer_id", "load_date", "load_type", "weight_lbs", "pieces")
    coded = joined.withColumn("code", first_error(joined, required, {"load_type": equipment, "primary_freight_type": cargo}, cities))
    place = lambda side: F.struct(F.col(f"{side}_city").alias("city"), F.col(f"{side}_state").alias("region"))
    facts = coded.filter("code is null").select(
        "load_id", "route_id", "customer_id", F.col("customer_name").alias("shipper_name"),
        lookup(F.col("primary_freight_type"), cargo).alias("cargo_category"), lookup(F.col("load_type"), equipment).alias("equipment_type"),
        "pieces", "weight_lbs", place("origin").alias("origin"), place("destination").alias("destination"),
        F.to_date("pickup_scheduled_datetime").alias("pickup_date"), F.to_date("delivery_scheduled_datetime").alias("delivery_date"),
        month_key("load_date").alias("load_month"),
    )
    issues = coded.filter("code is not null").select(
        F.col("load_id").alias("record_id"), F.lit(None).cast("string").alias("split"), "code", F.concat(F.lit("load "), F.coalesce("load_id", F.lit("?"))).alias("message")
    )
    return facts, issues


def weighted_pick(u: Column, table: Sequence[tuple[str, float]]) -> Column:
    """The name whose cumulative share first exceeds ``u`` in [0, 1); the last one for the rest.

    ValueError where the shares don't sum to 1 within 1e-9 or a name repeats.
    """
    names = [n for n, _ in table]
    if abs(sum(s for _, s in table) - 1) > 1e-9 or len(set(names)) != len(names):
        raise ValueError("shares must sum to 1 and names must differ")
    out, bound = F.lit(names[-1]), 1.0
    for n, s in reversed(table[:-1]):
        bound = sum(x for m, x in table[: names.index(n) + 1])
        out = F.when(u < bound, n).otherwise(out)
    return out


def assign_profiles(facts: DataFrame, key: str, category: str, tables: dict[str, Sequence[tuple[str, float]]], seed: int, otherwise: str = "none") -> DataFrame:
    """``facts`` with a ``profile`` drawn for each row by its key from the table of its category: the same row draws the same."""
    u = hash_uniform(seed, F.lit("profile"), F.col(key).cast("string"))
    pick = F.lit(otherwise)
    for c, t in sorted(tables.items()):
        pick = F.when(F.col(category) == c, weighted_pick(u, t)).otherwise(pick)
    return facts.withColumn("profile", pick)


def draw_between(seed: int, key: Column, name: str, low: float, high: float, digits: int = 1) -> Column:
    """A number drawn evenly from a range by the key and the name of the draw, rounded."""
    return F.round(F.lit(float(low)) + hash_uniform(seed, F.lit(name), key) * (float(high) - float(low)), digits)


def assign_conditions(facts: DataFrame, key: str, category: str, tables: dict[str, Sequence[dict]], seed: int) -> DataFrame:
    """Facts of the second version: equipment, pieces and special conditions of a profile drawn for each row.

    ``tables``: category -> profiles, each a dict of name, share, equipment and,
    where it has them, temperature (min, max), methods, types, parameters (lists),
    dimensions (side -> (low, high) in metres) and pieces (low, high). Lists come
    out in their fixed order, conditions in that of the kinds; every draw is by
    seed, row and name, so a row gets the same in any order. Rows of a category
    without a table keep their values and have no conditions.
    """
    out = assign_profiles(facts, key, category, {c: [(p["name"], p["share"]) for p in ps] for c, ps in tables.items()}, seed)
    k, text, side = F.col(key).cast("string"), "array<string>", "struct<value: double, unit: string>"
    null = lambda t: F.lit(None).cast(t)

    def condition(kind: str, **values: Column) -> Column:
        parts = [("min_c", "double"), ("max_c", "double"), ("methods", text), ("types", text), *[(s, side) for s in ("length", "width", "height")], ("parameters", text)]
        return F.struct(F.lit(kind).alias("kind"), *[values.get(n, null(t)).cast(t).alias(n) for n, t in parts])

    def of_profile(p: dict) -> Column:
        listed = lambda n: in_order(F.array(*[F.lit(x) for x in p[n]]), LISTS[n])
        found = []
        if "temperature" in p:
            low, high = p["temperature"]
            found.append(condition("temperature", min_c=F.lit(float(low)), max_c=F.lit(float(high))))
        if "methods" in p:
            found.append(condition("securing", methods=listed("methods")))
        if "types" in p:
            found.append(condition("packaging", types=listed("types")))
        if "dimensions" in p:
            found.append(condition("oversize", **{n: F.struct(draw_between(seed, k, n, *span).alias("value"), F.lit("m").alias("unit")) for n, span in p["dimensions"].items()}))
        if "parameters" in p:
            found.append(condition("sensors", parameters=listed("parameters")))
        return F.array(*found) if found else F.array_remove(F.array(condition("none")), condition("none"))

    mine = lambda c, p: (F.col(category) == c) & (F.col("profile") == p["name"])
    every = [(mine(c, p), p) for c, ps in sorted(tables.items()) for p in ps]
    conditions, equipment, pieces = of_profile({}), F.col("equipment_type"), F.col("pieces")
    for here, p in every:
        conditions = F.when(here, of_profile(p)).otherwise(conditions)
        equipment = F.when(here, F.lit(p["equipment"])).otherwise(equipment)
        if "pieces" in p:
            low, high = p["pieces"]
            pieces = F.when(here, (F.lit(low) + F.floor(hash_uniform(seed, F.lit("pieces"), k) * (high - low + 1))).cast("bigint")).otherwise(pieces)
    return out.select("*", conditions.alias("special_conditions"), equipment.alias("_e"), pieces.alias("_n")).withColumn("equipment_type", F.col("_e")).withColumn("pieces", F.col("_n")).drop("_e", "_n")


def completeness(facts: DataFrame, key: str) -> DataFrame:
    """(record_id, split, code, message): MISSING issues of facts of the second version whose fully stated card lacks something its rules ask for."""
    weight = F.struct(F.col("weight_lbs").cast("double").alias("value"), F.lit("lb").alias("unit"))
    card = F.struct(
        "origin", "destination", F.col("pickup_date").cast("string").alias("pickup_date"), "equipment_type", "pieces", F.when(F.col("weight_lbs").isNotNull(), weight).alias("weight_total"),
        F.lit(None).cast("struct<value: double, unit: string>").alias("weight_per_piece"), "special_conditions",
    )
    lost = facts.withColumn("_card", card).select(F.col(key).cast("string").alias("record_id"), F.explode(missing_fields(F.col("_card"), "card_v2")).alias("field"))
    return lost.select("record_id", F.lit(None).cast("string").alias("split"), F.lit("MISSING").alias("code"), F.concat(F.lit("missing "), F.col("field")).alias("message"))
