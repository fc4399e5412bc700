"""Table profiling and integrity checks: counts, keys, references, ranges, null rates, distributions.

Every check returns a small result DataFrame or an issues DataFrame; all are
single passes with partial aggregation, none collects rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows), one job."""
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, d in tables.items()])


def count_mismatches(counts: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(table_name, n_rows, expected) of tables whose configured count differs; tables without one pass."""
    want = counts.sparkSession.createDataFrame(list(expected.items()) or [("", 0)], "table_name string, expected bigint")
    return counts.join(F.broadcast(want), "table_name").filter("n_rows <> expected")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n_copies) of non-null keys that occur more than once."""
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return df.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df`` itself, checked at run time: a join on a duplicate key fails instead of fanning out.

    The check is a window over the key, which a following join on the same key reuses as its partitioning.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    wrong = F.concat(F.lit(f"{what}: duplicate key "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key has no parent. A null key is an orphan unless the parent's column holds a null."""
    keys = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return child.join(keys, F.col(key).eqNullSafe(F.col("_pk")), "left_anti")


def null_rates(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """(column_name, null_rate): one pass, then one row per column; 0 for an empty table."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    one = df.agg(*[F.round(F.count_if(F.col(c).isNull()) / n, digits).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column_name", "null_rate")


def out_of_range(df: DataFrame, id_col: str, ranges: dict[str, tuple[float, float]], domains: dict[str, Sequence[str]]) -> DataFrame:
    """(record_id, column_name, value): values outside inclusive ranges or closed domains; nulls pass."""
    checks = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), (~F.col(c).between(lo, hi)).alias("bad")) for c, (lo, hi) in ranges.items()]
    checks += [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), (~F.col(c).isin(*v)).alias("bad")) for c, v in domains.items()]
    return df.select(F.col(id_col).cast("string").alias("record_id"), F.explode(F.array(*checks)).alias("c")).filter("c.bad").select("record_id", "c.column_name", "c.value")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), nulls included."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def quantiles_linear(df: DataFrame, column: str, shares: Sequence[float] = (0, 0.05, 0.25, 0.5, 0.75, 0.95, 1)) -> DataFrame:
    """(share, value): exact quantiles with linear interpolation."""
    qs = df.agg(F.percentile(F.col(column), F.array(*[F.lit(float(s)) for s in shares])).alias("q"))
    return qs.select(F.explode(F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), F.col("q").alias("value"))).alias("x")).select("x.share", F.round("x.value", 6).alias("value"))


def quantiles_nearest_rank(df: DataFrame, by: str, column: str) -> DataFrame:
    """(by, n, min, p50, p95, max): the smallest value whose rank reaches the share."""
    return df.groupBy(by).agg(
        F.count(column).alias("n"), F.min(column).alias("min_value"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})").cast("double").alias("p50"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {column})").cast("double").alias("p95"),
        F.max(column).alias("max_value"),
    )


def quantile_rounded_index(df: DataFrame, by: str, column: str, share: float) -> DataFrame:
    """(by, value): the value at index round(share * (n - 1)), half to even: a third definition, by rank.

    Equal values are counted first, so a group of many rows is sorted by its different values only.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(by, column).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(by)
    ranked = counted.withColumn("_upto", F.sum("_c").over(w.orderBy(column))).withColumn("_n", F.sum("_c").over(w))
    index = F.bround(F.lit(share) * (F.col("_n") - 1))
    return ranked.filter((F.col("_upto") > index) & (F.col("_upto") - F.col("_c") <= index)).select(by, F.col(column).alias("value"))


def pair_counts(events: DataFrame, key: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """(key, one count per kind): events per key and kind; null keys dropped, missing kinds 0."""
    return events.filter(F.col(key).isNotNull()).groupBy(key).pivot(kind, list(kinds)).agg(F.count(F.lit(1))).na.fill(0, list(kinds))


def unpaired(events: DataFrame, key: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Keys that don't have exactly one event of each kind."""
    return pair_counts(events, key, kind, kinds).filter(reduce(Column.__or__, [F.col(k) != 1 for k in kinds]))


def single_events(events: DataFrame, key: str, kind: str) -> DataFrame:
    """Events whose (key, kind) occurs once: all copies of a repeated one are dropped."""
    w = Window.partitionBy(key, kind)
    return events.withColumn("_n", F.count(F.lit(1)).over(w)).filter("_n = 1").drop("_n")


def pivot_pairs(events: DataFrame, key: str, kind: str, kinds: Sequence[str], columns: Sequence[str], required: str) -> DataFrame:
    """One row per key, the columns of each kind beside each other as ``<kind>_<column>``; keys lacking a required one dropped."""
    wide = single_events(events.filter(F.col(kind).isin(*kinds)), key, kind).groupBy(key).agg(
        *[F.max(F.when(F.col(kind) == k, F.col(c))).alias(f"{k.lower()}_{c}") for k in kinds for c in columns]
    )
    return wide.dropna(subset=[f"{k.lower()}_{required}" for k in kinds])


def mismatch(a: Column, b: Column) -> Column:
    """Inequality in which a null on either side, and on both, is a mismatch."""
    return ~F.coalesce(a == b, F.lit(False))


def match_rate(bad: Column, digits: int = 6) -> Column:
    """Share of rows that match; 1 without rows."""
    return F.coalesce(F.round(1 - F.avg(bad.cast("double")), digits), F.lit(1.0))


def ambiguous(df: DataFrame, name: str, value: str) -> DataFrame:
    """(name, n_values): names with more than one value."""
    return df.groupBy(name).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def examples(df: DataFrame, id_col: str, limit: int = 10) -> DataFrame:
    """(n_distinct, ids): how many distinct ids, and the first few in order: the short form of a finding.

    The ids come from a top-k, not from a collected set; the limit is the feature.
    """
    ids = df.select(F.col(id_col).cast("string").alias("id")).distinct()
    few = ids.orderBy("id").limit(limit).agg(F.lit(None).cast("bigint").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    count = ids.agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("array<string>").alias("ids"))
    return count.unionByName(few).agg(F.max("n").alias("n_distinct"), F.max("ids").alias("ids"))
