"""References to records that do not exist: missing, deleted or late parents.

Plan: every parent table and the tombstones are reduced to one validity
interval per key (first arrival, first deletion) by one aggregation; the
children are reduced to one row per child with its first arrival. Both streams
are co-partitioned and sorted on (parent table, key) and merged linearly: a
sort-merge join whose right side has one row per key, so the merge buffers
nothing. Hot keys are salted.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import canonical_key
from millrace.session import hot_keys, salted_join, written


@dataclass(frozen=True)
class Child:
    """A table whose ``refs`` columns refer to parent tables: ``{field: parent table}``."""

    name: str
    df: DataFrame
    id_col: str
    period_col: str
    refs: dict[str, str] = field(default_factory=dict)
    arrival_col: str = "ingested_at"


def parent_intervals(
    parents: dict[str, tuple[DataFrame, str]], tombstones: DataFrame, arrival_col: str = "ingested_at"
) -> DataFrame:
    """(parent_table, ref_key, arrived_at, deleted_at): one row per key that has a row or a tombstone.

    arrived_at is null where only the tombstone is left.
    """
    none = F.lit(None).cast("timestamp_ntz")
    rows = [
        df.select(F.lit(t).alias("parent_table"), canonical_key(k).alias("ref_key"), F.col(arrival_col).cast("timestamp_ntz").alias("a"), none.alias("d"), F.lit(1).alias("r"))
        for t, (df, k) in parents.items()
    ]
    rows.append(
        tombstones.select(F.lower(F.trim("table_name")).alias("parent_table"), canonical_key("record_id").alias("ref_key"), none.alias("a"), F.col("deleted_at").cast("timestamp_ntz").alias("d"), F.lit(0).alias("r"))
    )
    return (
        reduce(DataFrame.unionByName, rows)
        .filter(F.col("ref_key").isNotNull())
        .groupBy("parent_table", "ref_key")
        .agg(F.min("a").alias("arrived_at"), F.min("d").alias("deleted_at"), (F.max("r") == 1).alias("has_row"), (F.min("r") == 0).alias("has_tombstone"))
    )


def child_references(child: Child) -> DataFrame:
    """One row per child id and field: (child_table, child_id, ref_field, parent_table, ref_key, child_arrival, period).

    The arrival is the earliest of the child's rows. Where copies of a child
    disagree, the reference of its earliest row that has one holds; of rows as
    early, the smallest key.
    """
    arrival = F.col(child.arrival_col).cast("timestamp_ntz")
    keyed = child.df.select(
        F.coalesce(canonical_key(child.id_col), F.col(child.id_col)).alias("_id"),
        F.col(child.id_col).alias("_raw"),
        arrival.alias("_a"),
        F.col(child.period_col).cast("timestamp_ntz").alias("_p"),
        *[canonical_key(f).alias(f"_k_{f}") for f in child.refs],
    )
    one = keyed.groupBy("_id").agg(
        F.min("_raw").alias("child_id"),
        F.min("_a").alias("child_arrival"),
        F.min("_p").alias("_p"),
        *[
            F.min(F.when(F.col(f"_k_{f}").isNotNull(), F.struct(F.col("_a").isNull(), "_a", F.col(f"_k_{f}").alias("k")))).getField("k").alias(f"_k_{f}")
            for f in child.refs
        ],
    )
    pairs = F.array(
        *[F.struct(F.lit(f).alias("ref_field"), F.lit(p).alias("parent_table"), F.col(f"_k_{f}").alias("ref_key")) for f, p in child.refs.items()]
    )
    return (
        one.withColumn("_r", F.explode(pairs))
        .filter(F.col("_r.ref_key").isNotNull())
        .select(F.lit(child.name).alias("child_table"), "child_id", "_r.*", "child_arrival", F.date_format("_p", "yyyy-MM").alias("period"))
    )


def broken_references(
    children: list[Child], parents: dict[str, tuple[DataFrame, str]], tombstones: DataFrame, hot_share: float = 0.005
) -> DataFrame:
    """(child_table, child_id, ref_field, kind, period) of every reference whose parent is not there in time.

    kind: ``deleted`` where the key has a tombstone and either no row of it is
    left or deleted_at <= the child's arrival; else ``missing`` where no row has
    the key; else ``late`` where its first row arrives after the child.

    A value without a digit (null, empty, ``N/A``) is no reference. A child
    without arrival can't be late, and only a tombstone without a row makes its
    reference deleted. Null periods stay null. Copies of rows change nothing.
    Empty tables: no parents make all references missing, no children give no
    rows. Extra columns are not read.
    """
    # Both the search for hot keys and the join read them: the children are aggregated once.
    refs = written(reduce(DataFrame.unionByName, [child_references(c) for c in children]))
    rows = sum(c.df.count() * len(c.refs) for c in children)
    hot = hot_keys(refs, ["parent_table", "ref_key"], rows, hot_share)
    merged = salted_join(refs, parent_intervals(parents, tombstones), ["parent_table", "ref_key"], hot, "child_id")
    has_row, dead = F.coalesce("has_row", F.lit(False)), F.coalesce("has_tombstone", F.lit(False))
    kind = (
        F.when(dead & (~has_row | F.coalesce(F.col("deleted_at") <= F.col("child_arrival"), F.lit(False))), "deleted")
        .when(~has_row, "missing")
        .when(F.col("arrived_at") > F.col("child_arrival"), "late")
    )
    return merged.withColumn("kind", kind).filter("kind is not null").select("child_table", "child_id", "ref_field", "kind", "period")


def references_by_period(broken: DataFrame) -> DataFrame:
    """Counts per child table, field, month of the child and kind."""
    return broken.groupBy("child_table", "ref_field", "period", "kind").agg(F.count(F.lit(1)).alias("n_refs"))
