"""Special conditions of a shipment: found in text, matched by kind, scored and summed up."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.exprs import same_set, to_m
from millrace.functions.json_answers import KINDS, LISTS, SIDES, lacks_values, of_kind

# The words that speak of each kind, the largest difference of equal dimensions.
WORDS = {
    "temperature": r"градус|режим|degrees|°c|temperature", "securing": r"ремн|штанг|цеп|коврик|straps|load bars|chains|anti-slip|lashing", "packaging": r"упаков|обрешет|пл[её]нк|crated|wrapped|packaging",
    "oversize": r"негабарит|габарит|oversize|wide load", "sensors": r"логгер|датчик|термопис|logger|sensor|recorder",
}
TOLERANCE_M = 0.01
#: What each kind states besides its name.
VALUES = {"temperature": ("min_c", "max_c"), "securing": ("methods",), "packaging": ("types",), "oversize": SIDES, "sensors": ("parameters",)}
_LISTS = set(LISTS)


def kinds_in(text: Column) -> Column:
    """Array of the kinds a text speaks of, in fixed order; empty for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(WORDS[k]), F.lit(k)) for k in KINDS]))


def same_value(name: str, a: Column, b: Column) -> Column:
    """Lists as sets (null as empty), dimensions in metres within 1 cm whatever their unit, the rest exactly; nulls equal."""
    if name in _LISTS:
        none = F.array().cast("array<string>")
        return same_set(F.coalesce(a, none), F.coalesce(b, none))
    if name in SIDES:
        x, y = to_m(a["value"], a["unit"]), to_m(b["value"], b["unit"])
        return F.coalesce(F.abs(x - y) <= TOLERANCE_M + 1e-9, x.isNull() & y.isNull())
    return a.eqNullSafe(b)


def same_condition(kind: str, a: Column, b: Column) -> Column:
    return reduce(Column.__and__, [same_value(n, a[n], b[n]) for n in VALUES[kind]])


def invents(kind: str, gold: Column, answer: Column) -> Column:
    """Whether the answer states a value the gold (which may be null) lacks."""
    out = []
    for n in VALUES[kind]:
        if n in _LISTS:
            none = F.array().cast("array<string>")
            out.append(F.size(F.array_except(F.coalesce(answer[n], none), F.coalesce(gold[n], none))) > 0)
        else:
            out.append(answer[n].isNotNull() & gold[n].isNull())
    return reduce(Column.__or__, out)


@dataclass(frozen=True)
class Compared:
    """Two lists of conditions matched by kind: kinds of each, right or wrong per kind (null where neither has it), labels, whether anything is invented."""

    gold_kinds: Column
    answer_kinds: Column
    correct: dict[str, Column]
    labels: Column
    invented: Column


def compared(df: DataFrame, gold: Column, answer: Column, missing: Column, failed: Column) -> tuple[DataFrame, Compared]:
    """Full outer match by kind. A condition lost, added or invented where the gold asks for it has one critical label each.

    What is used several times becomes a column of ``df`` (names beginning with ``_c_``), so that it is worked out once per row.
    """
    asked = lambda k: F.array_contains(missing, f"special_conditions.{k}")
    df = df.select("*", *[x for k in KINDS for x in (of_kind(gold, k).alias(f"_c_g_{k}"), of_kind(answer, k).alias(f"_c_a_{k}"))])
    g, a = {k: F.col(f"_c_g_{k}") for k in KINDS}, {k: F.col(f"_c_a_{k}") for k in KINDS}
    df = df.select("*", *[x for k in KINDS for x in ((a[k].isNotNull() & invents(k, g[k], a[k])).alias(f"_c_n_{k}"), F.coalesce(g[k].isNotNull() & a[k].isNotNull() & same_condition(k, g[k], a[k]), F.lit(False)).alias(f"_c_s_{k}"))])
    correct, labels, added = {}, [], []
    for k in KINDS:
        new = F.col(f"_c_n_{k}")
        correct[k] = F.when(failed, F.when(g[k].isNotNull(), F.lit(False))).otherwise(F.when(g[k].isNotNull() | a[k].isNotNull(), F.col(f"_c_s_{k}")))
        labels.append(F.when(g[k].isNotNull() & a[k].isNull(), F.lit("missed_condition")).when(asked(k) & new, F.lit("hallucinated_required_field")).when(a[k].isNotNull() & g[k].isNull() & ~asked(k), F.lit("hallucinated_condition")))
        added.append(F.coalesce(new | (a[k].isNotNull() & g[k].isNull()), F.lit(False)))
    kinds = lambda side: F.array_compact(F.array(*[F.when(side[k].isNotNull(), F.lit(k)) for k in KINDS]))
    df = df.select("*", kinds(g).alias("_c_gold"), kinds(a).alias("_c_answer"), F.create_map(*[x for k in KINDS for x in (F.lit(k), correct[k])]).alias("_c_ok"), F.array_compact(F.array(*labels)).alias("_c_labels"), reduce(Column.__or__, added).alias("_c_new"))
    return df, Compared(F.col("_c_gold"), F.col("_c_answer"), {k: F.col("_c_ok")[k] for k in KINDS}, F.col("_c_labels"), F.col("_c_new"))


def missing_conditions(equipment: Column, conditions: Column) -> Column:
    """Kinds that are required (temperature for a reefer, all dimensions for a lowbed) or named, and have no values."""
    needs = {"temperature": F.coalesce(equipment == "reefer", F.lit(False)), "oversize": F.coalesce(equipment == "lowbed", F.lit(False))}
    out = []
    for k in KINDS:
        c, must = of_kind(conditions, k), needs.get(k, F.lit(False))
        out.append(F.when((c.isNull() & must) | (c.isNotNull() & lacks_values(c, k, must)), F.lit(k)))
    return F.array_compact(F.array(*out))


def conditions_report(df: DataFrame, id_col: str, conditions: str) -> DataFrame:
    """(kind, n, share, first_id): rows with each kind, 'none' for those without any."""
    kinds = F.when(F.size(F.coalesce(F.col(conditions), F.array().cast("array<string>"))) == 0, F.array(F.lit("none"))).otherwise(F.col(conditions))
    each = df.select(F.col(id_col).alias("id"), F.explode(kinds).alias("kind"))
    n = each.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    total = df.count()
    return n.select("kind", "n", F.round(F.col("n") / F.lit(max(total, 1)), 4).alias("share"), "first_id")


def unused_values(df: DataFrame, conditions: str) -> DataFrame:
    """(list, value): values of the closed lists that no row uses."""
    spark = df.sparkSession
    every = spark.createDataFrame([(n, v) for n, vs in LISTS.items() for v in vs], "list string, value string")
    each = df.select(F.explode(conditions).alias("c"))
    used = reduce(DataFrame.unionByName, [each.select(F.lit(n).alias("list"), F.explode(f"c.{n}").alias("value")) for n in LISTS]).distinct()
    return every.join(used, ["list", "value"], "left_anti")
