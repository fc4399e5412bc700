"""Scores of answers against gold answers: fields, conditions, lists of missing fields, swaps and unit mistakes.

Flags are three-valued: null where a field does not apply. A failed answer
(generation error, or not readable even leniently) is wrong in every field the
gold has, and its invented values and critical errors are not assessable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import squeeze, to_kg
from millrace.functions.json_answers import FIELDS, answer_flags, target, version_of
from millrace.operators import conditions as co

# Tolerance of weights, ratios that a mistaken unit makes, the fields that must all be right.
TOLERANCE_KG = 0.5
UNIT_RATIOS = (0.45359237, 1 / 0.45359237, 1000.0, 0.001)
RATIO_TOLERANCE = 0.02
KEY_FIELDS = ("origin", "destination", "pickup_date", "equipment_type", "pieces")
WEIGHTS = ("weight_total", "weight_per_piece")
PLACES = ("origin", "destination")


def last_predictions(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in the order of the log: later answers replace earlier ones. Null keys are left out."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return log.filter(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def known(flag: Column) -> Column:
    """Null as false."""
    return F.coalesce(flag, F.lit(False))


def kilograms(quantity: Column) -> Column:
    return to_kg(quantity["value"], quantity["unit"])


def stated_mass(card: Column) -> Column:
    """Kilograms the card states: the total, else weight per piece times pieces; null without pieces (one is not assumed)."""
    return F.coalesce(kilograms(card["weight_total"]), kilograms(card["weight_per_piece"]) * card["pieces"])


def same_place(a: Column, b: Column) -> Column:
    """City and region without case and outer spaces; where neither has a region, the city."""
    plain = lambda x: F.lower(F.trim(x))
    return (plain(a["city"]) == plain(b["city"])) & plain(a["region"]).eqNullSafe(plain(b["region"]))


def same_value(field: str, gold: Column, answer: Column) -> Column:
    """Weights within 0.5 kg whatever the unit; places by city and region; shippers without case and extra spaces; the rest exactly."""
    g, a = gold[field], answer[field]
    if field in WEIGHTS:
        return F.abs(kilograms(g) - kilograms(a)) <= TOLERANCE_KG
    if field in PLACES:
        return same_place(g, a)
    if field == "shipper_name":
        return squeeze(g) == squeeze(a)
    return g == a


def field_flag(field: str, gold: Column, answer: Column) -> Column:
    """Right, wrong, or null where neither has a value."""
    g, a = gold[field].isNotNull(), answer[field].isNotNull()
    return F.when(g | a, known(g & a & same_value(field, gold, answer)))


def scalar_errors(gold: Column, answer: Column) -> list[Column]:
    """Labels or nulls: pieces and weight swapped, a weight off by a factor between units, origin and destination swapped."""
    numbers = lambda c: F.transform(F.array_compact(F.array(*[c[w]["value"] for w in WEIGHTS])), lambda x: x.cast("double"))
    gw, aw, gp, ap = numbers(gold), numbers(answer), gold["pieces"].cast("double"), answer["pieces"].cast("double")
    swap = (known(~ap.eqNullSafe(gp)) & known(F.array_contains(gw, ap))) | (known(F.array_contains(aw, gp)) & known(~F.array_contains(gw, gp)))

    def mistaken(w: str) -> Column:
        g, a = kilograms(gold[w]), kilograms(answer[w])
        off = [F.abs(a / g / r - 1) <= RATIO_TOLERANCE for r in UNIT_RATIOS]
        return known((g > 0) & (F.abs(g - a) > TOLERANCE_KG) & reduce(Column.__or__, off))

    turned = known(~same_place(gold["origin"], gold["destination"]) & same_place(answer["origin"], gold["destination"]) & same_place(answer["destination"], gold["origin"]))
    return [
        F.when(swap, F.lit("pieces_weight_swap")),
        F.when(reduce(Column.__or__, map(mistaken, WEIGHTS)), F.lit("wrong_unit_magnitude")),
        F.when(turned, F.lit("origin_destination_swap")),
    ]


def score_cases(gold: DataFrame, predictions: DataFrame, version: str = "card_short") -> DataFrame:
    """Case scores of one version: ``gold`` (record_id, gold_text, slices...), ``predictions`` (record_id, output, error), one row each.

    A gold without a prediction is a failed case ("no answer"). Golds that do
    not read are left out. Extra columns of ``gold`` are kept.
    """
    v = version_of(version)
    scalars = [f for f in v.fields if f != "special_conditions"]
    # Each text is read once where it lies, before the join moves it.
    p = predictions.select("record_id", "error", F.lit(True).alias("_there"), answer_flags(F.col("output"), version).alias("_f"))
    read = gold.withColumn("_gold", answer_flags(F.col("gold_text"), version)["body"]).drop("gold_text")
    j = read.filter("_gold is not null").join(p, "record_id", "left")
    j = j.withColumn("_g", target(F.col("_gold"))).withColumn("_a", target(F.col("_f.body")))
    error = F.when(F.col("_there").isNull(), F.lit("no answer")).otherwise(F.col("error"))
    failed = error.isNotNull() | ~known(F.col("_f.json_parsed_lenient"))
    g, a, gc, ac = F.col("_g"), F.col("_a"), F.col("_g.card"), F.col("_a.card")
    names = F.array().cast("array<string>")
    gm, am = F.array_distinct(g["missing_fields"]), F.array_distinct(F.coalesce(a["missing_fields"], names))
    conflicting = F.transform(g["conflicts"], lambda c: c["field"])
    stated = F.coalesce(F.transform(a["conflicts"], lambda c: c["field"]), names)

    # What the answer states and the gold does not: a conflict missed, a total worked out from pieces, or invented.
    extra = F.array_compact(F.array(*[F.when(gc[f].isNull() & ac[f].isNotNull(), F.lit(f)) for f in scalars]))
    worked_out = F.lit(False)
    if "weight_per_piece" in v.fields:
        worked_out = known(gc["weight_per_piece"].isNotNull() & (F.abs(kilograms(ac["weight_total"]) - stated_mass(gc)) <= TOLERANCE_KG))
    missed = F.size(F.array_intersect(extra, conflicting)) > 0
    free = F.array_except(extra, conflicting)
    note = known(F.array_contains(free, "weight_total")) & worked_out
    invented = F.when(note, F.array_remove(free, F.lit("weight_total"))).otherwise(free)
    flags = {f: F.when(failed, F.when(gc[f].isNotNull(), F.lit(False))).otherwise(field_flag(f, gc, ac)) for f in scalars}
    labels = [F.when(missed, F.lit("missed_conflict")), F.when(F.size(F.array_intersect(invented, gm)) > 0, F.lit("hallucinated_required_field")), *scalar_errors(gc, ac)]
    kinds_g = kinds_a = F.lit(None).cast("array<string>")
    by_kind = F.lit(None).cast("map<string, boolean>")
    more = names
    if "special_conditions" in v.fields:
        j, c = co.compared(j, gc["special_conditions"], ac["special_conditions"], gm, failed)
        kinds_g, kinds_a, by_kind = c.gold_kinds, F.when(failed, names).otherwise(c.answer_kinds), F.create_map(*[x for k in co.KINDS for x in (F.lit(k), c.correct[k])])
        wrong = reduce(Column.__or__, [known(~c.correct[k]) for k in co.KINDS])
        some = (F.size(c.gold_kinds) > 0) | (F.size(c.answer_kinds) > 0)
        flags["special_conditions"] = F.when(failed, F.when(F.size(c.gold_kinds) > 0, F.lit(False))).otherwise(F.when(some, ~wrong))
        invented = F.when(c.invented, F.concat(invented, F.array(F.lit("special_conditions")))).otherwise(invented)
        more = c.labels
    j = j.select("*", *[c.alias(f"_r_{f}") for f, c in flags.items()], invented.alias("_invented"), F.array_compact(F.array(*labels)).alias("_labels"), stated_mass(gc).alias("_mg"), stated_mass(ac).alias("_ma"))
    flags = {f: F.col(f"_r_{f}") for f in flags}
    invented, mass_g, mass_a = F.col("_invented"), F.col("_mg"), F.col("_ma")
    applies = reduce(Column.__and__, [gc[f].isNotNull() for f in KEY_FIELDS]) & mass_g.isNotNull()
    right = reduce(Column.__and__, [known(flags[f]) for f in KEY_FIELDS]) & known(F.abs(mass_g - mass_a) <= TOLERANCE_KG)
    if "special_conditions" in v.fields:
        right = right & F.coalesce(flags["special_conditions"], F.lit(True))
    ok = lambda value: F.when(~failed, value)
    return j.select(
        *gold.drop("gold_text").columns, F.lit(version).alias("schema_version"),
        known(F.col("_f.json_parsed")).alias("json_parsed"), known(F.col("_f.schema_valid")).alias("schema_valid"), (~failed).alias("json_parsed_lenient"),
        error.alias("generation_error"), failed.alias("failed"),
        F.create_map(*[x for f in FIELDS for x in (F.lit(f), flags.get(f, F.lit(None).cast("boolean")))]).alias("field_correct"),
        F.when(applies, right & ~failed).alias("key_fields_correct"),
        F.coalesce(ok(F.size(F.array_intersect(gm, am))), F.lit(0)).alias("missing_tp"), F.coalesce(ok(F.size(F.array_except(am, gm))), F.lit(0)).alias("missing_fp"),
        F.coalesce(ok(F.size(F.array_except(gm, am))), F.size(gm)).alias("missing_fn"), F.coalesce(ok(F.array_sort(gm) == F.array_sort(am)), F.lit(False)).alias("missing_exact"),
        F.when(F.size(conflicting) > 0, F.coalesce(ok(F.size(F.array_except(conflicting, stated)) == 0), F.lit(False))).alias("conflict_detected"),
        F.coalesce(ok(invented), names).alias("hallucinated_fields"),
        F.coalesce(ok(F.array_sort(F.array_distinct(F.concat("_labels", more)))), names).alias("critical_errors"),
        F.coalesce(ok(F.array_compact(F.array(F.when(note, F.lit("computed_weight_total"))))), names).alias("notes"),
        kinds_g.alias("conditions_gold"), kinds_a.alias("conditions_answer"), by_kind.alias("condition_correct"),
    )
