"""Metrics over case scores: a registry of ratios of sums, slices by grouping sets, intervals, worst cases.

Every metric is one sum over another, so all of them, in every slice and every
bootstrap resample, come out of one pass of partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.json_answers import FIELDS, KINDS
from millrace.operators.stats import weighted_sums

# The labels of critical errors.
CRITICAL = ("pieces_weight_swap", "wrong_unit_magnitude", "origin_destination_swap", "hallucinated_required_field", "missed_conflict", "hallucinated_condition", "missed_condition")


@dataclass(frozen=True)
class Metric:
    """sum(top) / sum(bottom); the plain sum without ``bottom``. ``empty`` is the value where there are cases but nothing to divide by."""

    top: Column
    bottom: Column | None = None
    higher: bool = True
    empty: float | None = None

    def value(self) -> Column:
        return ratio(F.sum(self.top), F.sum(self.bottom) if self.bottom is not None else None, self.empty)


def ratio(top: Column, bottom: Column | None, empty: float | None) -> Column:
    return top if bottom is None else F.when(bottom == 0, F.lit(empty).cast("double")).otherwise(top / bottom)


def rate(flag: Column, higher: bool = True) -> Metric:
    """Mean over the cases where the flag applies; null without any."""
    return Metric(flag.cast("double"), flag.isNotNull().cast("double"), higher)


def total(n: Column) -> Metric:
    return Metric(n.cast("double"), None, False)


def micro(values: Column) -> Metric:
    """Right over judged, pooled over cases. ``values``: array of three-valued flags."""
    return Metric(F.size(F.filter(values, lambda v: v)).cast("double"), F.size(F.filter(values, lambda v: v.isNotNull())).cast("double"))


def pooled_f1(tp: Column, fp: Column, fn: Column) -> Metric:
    """2TP / (2TP + FP + FN); 1 where all are zero, null without cases."""
    t = 2 * tp.cast("double")
    return Metric(t, t + fp + fn, True, 1.0)


def pooled_share(hit: Column, miss: Column) -> Metric:
    """Hits over hits and misses: precision or recall of sets, pooled."""
    return Metric(hit.cast("double"), (hit + miss).cast("double"))


def registry() -> dict[str, Metric]:
    """All 47 metrics of a case-score table by name. What only answers with conditions have is null for the others."""
    failed, fields = F.col("failed"), F.col("field_correct")
    ok = lambda x: F.when(~failed, x)
    with_conditions = F.col("conditions_gold").isNotNull()
    out = {
        "json_valid_rate": rate(F.col("schema_valid")), "lenient_parse_rate": rate(F.col("json_parsed_lenient")), "failed_output_rate": rate(failed, False),
        "key_field_accuracy": rate(F.col("key_fields_correct")), "missing_exact_rate": rate(F.col("missing_exact")), "conflict_recall": rate(F.col("conflict_detected")),
        "hallucination_rate": rate(ok(F.size("hallucinated_fields") > 0), False), "critical_error_count": total(ok(F.size("critical_errors"))),
        "field_accuracy_micro": micro(F.map_values(fields)), "missing_f1": pooled_f1(F.col("missing_tp"), F.col("missing_fp"), F.col("missing_fn")),
        "special_conditions_exact_rate": rate(F.when(with_conditions, ~failed & F.coalesce(fields["special_conditions"], F.lit(True)))),
    }
    for f in FIELDS:
        out[f"field_accuracy.{f}"] = rate(fields[f])
    for k in CRITICAL:
        out[f"critical_error_count.{k}"] = total(ok(F.array_contains("critical_errors", k).cast("int")))
    for k in KINDS:
        out[f"field_accuracy.special_conditions.{k}"] = rate(F.col("condition_correct")[k])
    g, a = F.col("conditions_gold"), F.col("conditions_answer")
    for name, wanted in (("", KINDS), *[(f".{k}", (k,)) for k in KINDS]):
        only = lambda x, w=wanted: F.array_intersect(x, F.array(*[F.lit(k) for k in w]))
        hit = F.size(F.array_intersect(only(g), only(a)))
        out[f"condition_precision{name}"] = pooled_share(F.when(with_conditions, hit), F.size(F.array_except(only(a), only(g))))
        out[f"condition_recall{name}"] = pooled_share(F.when(with_conditions, hit), F.size(F.array_except(only(g), only(a))))
    return out


def record_kind(family: Column, hard_cases: Column, has_conditions: Column) -> Column:
    """manual, clean, conditions, missing (dropped fields only) or hard."""
    none = F.coalesce(F.size(hard_cases) <= 0, F.lit(True))
    return (
        F.when(family.isin("manual", "manual_mock"), "manual").when(none, F.when(has_conditions, "conditions").otherwise("clean"))
        .when(hard_cases == F.array(F.lit("dropped_fields")), "missing").otherwise("hard")
    )


def slice_columns(has_conditions: Column | None = None) -> dict[str, Column]:
    """The eight dimensions of a report as columns of a record."""
    family, hard = F.col("template_family"), F.col("variant.hard_cases")
    manual = family.isin("manual", "manual_mock")
    return {
        "task": F.col("task"), "language": F.col("language"), "template_family": family, "distribution": F.when(F.col("variant.ood_reason").isNotNull(), "ood").otherwise("in_dist"),
        "ood_reason": F.coalesce("variant.ood_reason", F.lit("—")), "kind": record_kind(family, hard, has_conditions if has_conditions is not None else F.lit(False)),
        "hard_case": F.when(manual, "manual").otherwise(F.coalesce(F.nullif(F.array_join(hard, ","), F.lit("")), F.lit("clean"))), "source": F.when(F.col("synthetic"), "synthetic").otherwise("manual"),
    }


def long(aggregated: DataFrame, keys: Sequence[str], names: Sequence[str], digits: int = 9) -> DataFrame:
    """(keys..., metric, value), one row per metric."""
    cols = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(F.col(f"`{n}`"), digits).alias("value")) for n in names])
    return aggregated.select(*keys, F.explode(cols).alias("m")).select(*keys, "m.metric", "m.value")


def metrics_overall(scores: DataFrame, metrics: dict[str, Metric] | None = None) -> DataFrame:
    """(metric, value)."""
    metrics = metrics or registry()
    return long(scores.agg(*[m.value().alias(n) for n, m in metrics.items()]), [], list(metrics))


def metrics_with_intervals(scores: DataFrame, key: str, metrics: dict[str, Metric] | None = None, reps: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(metric, value, n, higher_is_better, low, high): all metrics with their bootstrap intervals, the resamples shared by all.

    n is the number of cases that count for the metric. low and high are the
    nearest-rank percentiles of the resamples in which the metric is defined.
    """
    metrics = metrics or registry()
    names = list(metrics)
    columns = {}
    for i, n in enumerate(names):
        columns[f"t{i}"] = metrics[n].top
        columns[f"b{i}"] = metrics[n].bottom if metrics[n].bottom is not None else metrics[n].top.isNotNull().cast("double")
    # Rep -1 weighs every row once: the value itself.
    sums = weighted_sums(scores, key, columns, reps, seed, plain=True)
    value = lambda i, n: ratio(F.col(f"t{i}"), F.col(f"b{i}") if metrics[n].bottom is not None else None, metrics[n].empty)
    each = F.array(*[F.struct(F.lit(n).alias("metric"), value(i, n).alias("v"), F.col(f"c{i}").alias("n"), F.lit(metrics[n].higher).alias("higher_is_better")) for i, n in enumerate(names)])
    counted = scores.agg(*[F.count(metrics[n].top).alias(f"c{i}") for i, n in enumerate(names)])
    rows = sums.crossJoin(F.broadcast(counted)).select("rep", F.explode(each).alias("m")).select("rep", "m.*")  # one row on the right
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    sampled = F.when(F.col("rep") >= 0, F.col("v"))
    at = lambda p: F.percentile_disc(p, sampled) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY CASE WHEN rep >= 0 THEN v END)")
    return rows.groupBy("metric").agg(
        F.round(F.max(F.when(F.col("rep") < 0, F.col("v"))), 9).alias("value"), F.max("n").alias("n"), F.max("higher_is_better").alias("higher_is_better"), F.round(at(lo), 9).alias("low"), F.round(at(hi), 9).alias("high")
    )


def metrics_by_slice(scores: DataFrame, slices: Sequence[str], metrics: dict[str, Metric] | None = None) -> DataFrame:
    """(slice, slice_value, n_cases, metric, value) for every value of every slice, and 'all': one pass over grouping sets."""
    metrics = metrics or registry()
    sets = [[], *[[F.col(s)] for s in slices]]
    agg = scores.groupingSets(sets, *[F.col(s) for s in slices]).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n_cases"), *[m.value().alias(n) for n, m in metrics.items()])
    name, value = F.lit("all"), F.lit(None).cast("string")
    full = (1 << len(slices)) - 1
    for i, s in enumerate(slices):
        mask = full & ~(1 << (len(slices) - 1 - i))
        name = F.when(F.col("_g") == mask, s).otherwise(name)
        value = F.when(F.col("_g") == mask, F.col(s).cast("string")).otherwise(value)
    return long(agg.withColumn("slice", name).withColumn("slice_value", value), ["slice", "slice_value", "n_cases"], list(metrics))


def crosstab(scores: DataFrame, kinds: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """(kind, one count per column): critical errors by overlapping column conditions."""
    each = scores.select("*", F.explode("critical_errors").alias("error")).filter(F.col("error").isin(*kinds))
    return each.groupBy(F.col("error").alias("kind")).agg(*[F.count_if(c).alias(n) for n, c in columns.items()])


def worst_cases(scores: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` worst cases: failed first, then most critical errors, most wrong fields, then the id. The limit is the feature."""
    wrong = F.size(F.filter(F.map_values("field_correct"), lambda v: v == F.lit(False)))
    return scores.select("record_id", "failed", F.size("critical_errors").alias("n_critical"), wrong.alias("n_wrong")).orderBy(F.desc("failed"), F.desc("n_critical"), F.desc("n_wrong"), "record_id").limit(n)
