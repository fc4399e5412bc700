"""Queries of the general training-data operators (problems 1 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.keys import canonical_key_sql
from millrace.operators.references import Child, broken_references, references_by_period
from millrace.operators.units import foreign_units, weights_in_kilograms
from millrace.session import table


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    t = {n: table(spark, sf, n) for n in ("loads", "routes", "customers", "delivery_events", "tombstones")}
    return broken_references(
        [
            Child("loads", t["loads"], "load_id", "load_date", {"customer_id": "customers", "route_id": "routes"}),
            Child("delivery_events", t["delivery_events"], "event_id", "scheduled_datetime", {"load_id": "loads"}),
        ],
        {"loads": (t["loads"], "load_id"), "routes": (t["routes"], "route_id"), "customers": (t["customers"], "customer_id")},
        t["tombstones"],
    )


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _broken(spark, sf).select("child_table", "child_id", "ref_field", "kind")


def p1_by_period(spark: SparkSession, sf: str) -> DataFrame:
    return references_by_period(_broken(spark, sf))


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    return weights_in_kilograms(table(spark, sf, "loads"), table(spark, sf, "extractions"), table(spark, sf, "sft_records"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return foreign_units(_weights(spark, sf))


def p5_converted(spark: SparkSession, sf: str) -> DataFrame:
    """Every weight of the three tables in kilograms, with its unit."""
    return _weights(spark, sf)


QUERIES = {q.__name__: q for q in (p1_found, p1_by_period, p5_found, p5_converted)}

_K = canonical_key_sql
_BROKEN_SQL = f"""
WITH l AS (SELECT {_K("load_id")} k, min(load_id) id, min(ingested_at) a, min(load_date) p, arg_min({_K("customer_id")}, ingested_at) c, arg_min({_K("route_id")}, ingested_at) r
           FROM loads GROUP BY 1),
e AS (SELECT {_K("event_id")} k, min(event_id) id, min(ingested_at) a, min(scheduled_datetime) p, arg_min({_K("load_id")}, ingested_at) l FROM delivery_events GROUP BY 1),
refs AS (SELECT 'loads' child_table, id child_id, 'customer_id' ref_field, 'customers' parent, c ref_key, a, CAST(p AS TIMESTAMP) p FROM l WHERE c IS NOT NULL
   UNION ALL SELECT 'loads', id, 'route_id', 'routes', r, a, CAST(p AS TIMESTAMP) FROM l WHERE r IS NOT NULL
   UNION ALL SELECT 'delivery_events', id, 'load_id', 'loads', l, a, p FROM e WHERE l IS NOT NULL),
parents AS (SELECT 'loads' parent, k ref_key, a arrived FROM l
   UNION ALL SELECT 'routes', {_K("route_id")}, min(ingested_at) FROM routes GROUP BY 2
   UNION ALL SELECT 'customers', {_K("customer_id")}, min(ingested_at) FROM customers GROUP BY 2),
dead AS (SELECT table_name parent, {_K("record_id")} ref_key, min(deleted_at) deleted FROM tombstones GROUP BY 1, 2),
broken AS (SELECT refs.*, CASE WHEN deleted IS NOT NULL AND (arrived IS NULL OR deleted <= a) THEN 'deleted'
    WHEN arrived IS NULL THEN 'missing' WHEN arrived > a THEN 'late' END kind
  FROM refs LEFT JOIN parents USING (parent, ref_key) LEFT JOIN dead USING (parent, ref_key))
"""

ORACLE = {
    "p1_found": _BROKEN_SQL + "SELECT child_table, child_id, ref_field, kind FROM broken WHERE kind IS NOT NULL",
    "p1_by_period": _BROKEN_SQL
    + "SELECT child_table, ref_field, strftime(p, '%Y-%m') AS period, kind, count(*) AS n_refs FROM broken WHERE kind IS NOT NULL GROUP BY ALL",
}
