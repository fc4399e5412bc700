"""Statistics of evaluations: bootstrap intervals, paired differences, exact McNemar."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Resamples of a bootstrap, and how many weights a worker holds at a time.
REPS = 2000
_CHUNK = 4_000_000
#: Cumulative probabilities of a Poisson variable of mean 1, far beyond what 53 bits can tell from 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])


def poisson_weights(keys: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """(reps, keys) of how often each row is drawn in each resample: Poisson(1) by a hash of row and resample alone."""
    x = keys.view(np.uint64)[None, :] + (reps.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(_POISSON, u, side="right").astype(np.float64)


def weighted_sums(df: DataFrame, key: str, columns: dict[str, Column], reps: int = REPS, seed: int = 42, plain: bool = False) -> DataFrame:
    """(rep, one sum per column) of ``reps`` bootstrap resamples of the rows; with ``plain`` also rep -1, the sums themselves.

    Each row is drawn a Poisson(1) number of times, independently, by a hash of
    (seed, key, rep): the resampling for data that don't fit one machine. It
    tends to drawing n of n with replacement, needs neither positions nor the
    number of rows, and is one pass in which a task hands over one row per
    resample. Nulls add nothing; a sum without any value is null. Resamples of
    one seed draw the same keys for every column and table.
    """
    names = list(columns)
    rows = df.select(F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("_key"), *[columns[n].cast("double").alias(n) for n in names])
    first = -1 if plain else 0

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((reps - first, len(names))), np.zeros((reps - first, len(names)))
        some = False
        for pdf in batches:
            keys, values = pdf["_key"].to_numpy(np.int64), pdf[names].to_numpy(np.float64)
            there = ~np.isnan(values)
            both = np.concatenate([np.where(there, values, 0.0), there], axis=1)
            step = max(1, _CHUNK // max(1, len(keys)))
            for at in range(first, reps, step):
                which = np.arange(at, min(at + step, reps))
                w = np.where(which[:, None] < 0, 1.0, poisson_weights(keys, np.maximum(which, 0))) @ both
                sums[which - first] += w[:, : len(names)]
                counts[which - first] += w[:, len(names) :]
            some = some or len(keys) > 0
        if some:
            sums[counts == 0] = np.nan
            out = pd.DataFrame(sums, columns=names)
            out.insert(0, "rep", np.arange(first, reps, dtype=np.int32))
            yield out

    parts = rows.mapInPandas(add, ", ".join(["rep int", *[f"{n} double" for n in names]]))
    return parts.groupBy("rep").agg(*[F.sum(F.nanvl(F.col(n), F.lit(None).cast("double"))).alias(n) for n in names])


def bootstrap_ci(df: DataFrame, key: str, columns: Sequence[str], reps: int = REPS, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(metric, low, high) of the mean of each column: percentile bootstrap by nearest rank; resamples without a value are dropped."""
    parts = {x: y for c in columns for x, y in ((f"s_{c}", F.col(c).cast("double")), (f"n_{c}", F.col(c).isNotNull().cast("double")))}
    sums = weighted_sums(df, key, parts, reps, seed)
    rates = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.try_divide(F.col(f"s_{c}"), F.col(f"n_{c}")).alias("v")) for c in columns])).alias("x")).select("x.metric", "x.v").filter("v is not null")
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    return rates.groupBy("metric").agg(
        F.round(F.expr(f"percentile_disc({lo}) WITHIN GROUP (ORDER BY v)"), 9).alias("low"), F.round(F.expr(f"percentile_disc({hi}) WITHIN GROUP (ORDER BY v)"), 9).alias("high")
    )


def paired_difference(a: DataFrame, b: DataFrame, key: str, column: str, reps: int = REPS, seed: int = 42) -> DataFrame:
    """(difference, low, high, verdict) of mean(b) - mean(a) over the keys both have, resampled together.

    verdict: better or worse where the interval is on one side of zero, else indistinguishable.
    """
    both = a.select(key, F.col(column).cast("double").alias("a")).join(b.select(key, F.col(column).cast("double").alias("b")), key)
    parts = {"a": F.col("a"), "na": F.col("a").isNotNull().cast("double"), "b": F.col("b"), "nb": F.col("b").isNotNull().cast("double")}
    d = F.try_divide("b", "nb") - F.try_divide("a", "na")
    sums = weighted_sums(both, key, parts, reps, seed, plain=True).select("rep", d.alias("d"))
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY CASE WHEN rep >= 0 THEN d END)")
    one = sums.agg(F.max(F.when(F.col("rep") < 0, F.col("d"))).alias("difference"), at(0.025).alias("low"), at(0.975).alias("high"))
    return one.withColumn("verdict", F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("indistinguishable"))


def mcnemar_p(fixed: int, broken: int) -> float:
    """Exact two-sided p of ``fixed`` against ``broken`` discordant pairs; 1 without any."""
    n = fixed + broken
    if not n:
        return 1.0
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(fixed, broken) + 1)) / 2**n)


def changed_pairs(a: DataFrame, b: DataFrame, key: str, flag: str) -> DataFrame:
    """(key, change): keys whose flag differs between two runs, ``fixed`` or ``broken``; null flags are left out."""
    j = a.select(key, F.col(flag).alias("a")).join(b.select(key, F.col(flag).alias("b")), key).filter("a <> b")
    return j.select(key, F.when(F.col("b"), "fixed").otherwise("broken").alias("change"))


def mcnemar(a: DataFrame, b: DataFrame, key: str, flag: str) -> DataFrame:
    """(n_pairs, fixed, broken, p_value) of two runs over the same keys; null flags are left out."""
    j = a.select(key, F.col(flag).alias("a")).join(b.select(key, F.col(flag).alias("b")), key).filter("a is not null and b is not null")
    row = j.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(~F.col("a") & F.col("b")).alias("fixed"), F.count_if(F.col("a") & ~F.col("b")).alias("broken")).first()
    p = round(mcnemar_p(row["fixed"], row["broken"]), 9)
    return a.sparkSession.createDataFrame([(row["n_pairs"], row["fixed"], row["broken"], p)], "n_pairs bigint, fixed bigint, broken bigint, p_value double")
