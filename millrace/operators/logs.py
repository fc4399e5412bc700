"""Measures over logs: values over time, running numbers, newest first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area_under(log: DataFrame, key: str, time: str, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """(key, area, peak, n): value over time as trapezoids, in value-hours, the largest value and the rows of each key.

    Rows are taken in the order of time, then ``ties``; a null value adds no
    trapezoid on either side. One row has area 0.
    """
    w = Window.partitionBy(key).orderBy(time, *ties)
    lagged = log.withColumn("_v", F.lag(value).over(w)).withColumn("_t", F.lag(time).over(w))
    seconds = F.timestamp_diff("SECOND", F.col("_t"), F.col(time)) if hasattr(F, "timestamp_diff") else F.expr(f"timestampdiff(SECOND, _t, {time})")
    area = F.sum((F.col(value) + F.col("_v")) / 2 * seconds / 3600)
    return lagged.groupBy(key).agg(F.coalesce(area, F.lit(0.0)).alias("area"), F.max(value).alias("peak"), F.count(F.lit(1)).alias("n"))


def running_number(df: DataFrame, by: str, order: Sequence[str], name: str = "number") -> DataFrame:
    """``df`` with the 1-based number of each row within its ``by`` in an order: a person's cases, a run's attempts."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def newest(df: DataFrame, time: str, key: str, n: int | None = None) -> DataFrame:
    """Newest first, ties by key; the first ``n`` where that is asked for."""
    out = df.orderBy(F.col(time).desc_nulls_last(), key)
    return out if n is None else out.limit(n)


def token_audit(examples: DataFrame, by: str, prompt: str, answer: str, most: int) -> DataFrame:
    """(by, n, n_too_long, too_long_rate, trainable_share): what a limit of ``most`` tokens costs, and how many of the kept tokens are trained on.

    Rows without counts are left out; a group without a kept row has a null share.
    """
    whole = F.col(prompt) + F.col(answer)
    kept = F.when(whole <= most, whole)
    rows = examples.filter(whole.isNotNull()).groupBy(by)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(whole > most).alias("n_too_long"), F.round(F.avg((whole > most).cast("double")), 6).alias("too_long_rate"),
        F.round(F.try_divide(F.sum(F.when(kept.isNotNull(), F.col(answer))).cast("double"), F.sum(kept)), 6).alias("trainable_share"),
    )


def within_skipped_share(skipped: int, total: int, most: float) -> None:
    """ValueError where more than the share ``most`` of the examples had to be skipped; nothing to skip of nothing is fine."""
    if total and skipped / total > most:
        raise ValueError(f"{skipped} of {total} examples skipped, more than {most:.1%}")


def training_steps(n: Column, micro: int, accumulate: int, epochs: int) -> Column:
    """Optimizer steps: whole batches of micro * accumulate examples, the last one of an epoch counted, times the epochs."""
    return (F.ceil(n / float(micro * accumulate)) * epochs).cast("bigint")


def training_cost(steps: Column, seconds_per_step: float, hourly_rate: float) -> Column:
    """Money for the steps at a rate per hour."""
    return F.round(steps * seconds_per_step / 3600.0 * hourly_rate, 2)


def latest_values(log: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """(key, step, value): the value at the largest step of each key; of several at one step the largest value. NaN values don't count."""
    rows = log.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return rows.groupBy(key).agg(F.max(F.struct(step, value)).alias("m")).select(key, f"m.{step}", f"m.{value}")
