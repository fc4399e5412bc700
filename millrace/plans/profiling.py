"""Profile, integrity, facts and sampling queries over the test tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import canonical_key, canonical_key_sql
from millrace.operators.logs import newest, running_number
from millrace.functions import exprs as E
from millrace.operators import facts as fa
from millrace.operators import quality as q
from millrace.operators import sampling as sa
from millrace.operators.validate import first_rows
from millrace.plans import sqltext as S
from millrace.session import table

ALL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "loads", "routes", "customers", "delivery_events", "sft_records")
EQUIPMENT = {"Dry Van": "dry_van", "Refrigerated": "reefer"}
CARGO = {"Automotive": "automotive", "Food/Beverage": "food_beverage", "Retail": "retail", "General": "general", "Electronics": "electronics", "Consumer Goods": "consumer_goods"}
PROFILES = {"dry_van": [("plain", 0.5), ("secured", 0.3), ("sealed", 0.2)], "reefer": [("chilled", 0.6), ("frozen", 0.4)]}


def _one(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    return first_rows(table(spark, sf, name).filter(F.col(key).isNotNull()), key, [F.col("ingested_at")])


def q_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return q.row_counts({n: table(spark, sf, n) for n in ALL})


def q_pk_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return q.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def q_key_copies(spark: SparkSession, sf: str) -> DataFrame:
    keys = {"loads": "load_id", "routes": "route_id", "customers": "customer_id", "delivery_events": "event_id"}
    parts = [q.duplicate_keys(table(spark, sf, t), [k]).select(F.lit(t).alias("table_name"), F.col(k).alias("record_id"), "n_copies") for t, k in keys.items()]
    return reduce(DataFrame.unionByName, parts)


_FKS = (("loads", "customer_id", "customers", "customer_id"), ("loads", "route_id", "routes", "route_id"), ("delivery_events", "load_id", "loads", "load_id"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"))


def q_fk_orphans(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        q.orphans(table(spark, sf, c), k, table(spark, sf, p), pk).agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(f"{c}.{k}").alias("relation"), "n_orphans")
        for c, k, p, pk in _FKS
    ]
    return reduce(DataFrame.unionByName, parts)


def q_orphan_examples(spark: SparkSession, sf: str) -> DataFrame:
    """How many loads have an unknown route, and the first ten of them."""
    lost = q.orphans(table(spark, sf, "loads"), "route_id", table(spark, sf, "routes"), "route_id")
    return q.examples(lost, "load_id").select("n_distinct", F.array_join("ids", ",").alias("ids"))


_NULLABLE = ("customer_id", "route_id", "load_date", "weight_lbs", "pieces", "revenue", "load_status", "booking_type", "feed")


def q_null_rates(spark: SparkSession, sf: str) -> DataFrame:
    return q.null_rates(table(spark, sf, "loads"), _NULLABLE)


def q_value_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return q.out_of_range(table(spark, sf, "loads"), "load_id", {"weight_lbs": (10000, 45000), "pieces": (1, 28)}, {"load_type": ["Dry Van", "Refrigerated"]})


_DISTRIBUTIONS = ("load_type", "load_status", "booking_type", "feed")


def q_distributions(spark: SparkSession, sf: str) -> DataFrame:
    loads = table(spark, sf, "loads")
    return reduce(DataFrame.unionByName, [q.value_counts(loads, c).withColumn("column_name", F.lit(c)) for c in _DISTRIBUTIONS])


def q_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by freight type: count and share of all."""
    n = table(spark, sf, "customers").groupBy("primary_freight_type").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def q_month_hist(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "loads").groupBy(E.month_key("load_date").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("load_id").alias("n_loads"))


def q_quantiles_linear(spark: SparkSession, sf: str) -> DataFrame:
    return q.quantiles_linear(table(spark, sf, "lineitem"), "l_quantity")


def q_length_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("chars", F.length("text").cast("bigint"))
    return q.quantiles_nearest_rank(docs, "lang", "chars")


def q_rank_rounded(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("chars", F.length("text").cast("bigint"))
    return q.quantile_rounded_index(docs.filter("source is not null"), "source", "chars", 0.9)


def q_event_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return q.unpaired(table(spark, sf, "delivery_events"), "load_id", "event_type", ["Pickup", "Delivery"]).select("load_id", F.col("Pickup").alias("n_pickup"), F.col("Delivery").alias("n_delivery"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return q.pivot_pairs(table(spark, sf, "delivery_events"), "load_id", "event_type", ["Pickup", "Delivery"], ["scheduled_datetime", "location_city", "location_state"], "location_city").filter("load_id is not null")


def q_pivot_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("load_id", "pickup_location_city", "delivery_location_city", F.date_format("pickup_scheduled_datetime", "yyyy-MM-dd HH:mm").alias("pickup_at"), F.date_format("delivery_scheduled_datetime", "yyyy-MM-dd HH:mm").alias("delivery_at"))


def q_route_match(spark: SparkSession, sf: str) -> DataFrame:
    """Share of loads whose events are in the cities and states of their route; nulls are mismatches."""
    j = _one(spark, sf, "loads", "load_id").select("load_id", "route_id").join(_pairs(spark, sf), "load_id").join(_one(spark, sf, "routes", "route_id"), "route_id")
    sides = {"origin_city": "pickup_location_city", "origin_state": "pickup_location_state", "destination_city": "delivery_location_city", "destination_state": "delivery_location_state"}
    rates = j.agg(*[q.match_rate(q.mismatch(F.col(a), F.col(b))).alias(a) for a, b in sides.items()])
    return rates.unpivot([], list(sides), "column_name", "match_rate")


def q_transit_days(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).groupBy(E.transit_days("pickup_scheduled_datetime", "delivery_scheduled_datetime").cast("bigint").alias("days")).agg(F.count(F.lit(1)).alias("n"))


def q_pickup_is_load_date(spark: SparkSession, sf: str) -> DataFrame:
    j = _one(spark, sf, "loads", "load_id").select("load_id", "load_date").join(_pairs(spark, sf), "load_id")
    return j.filter(q.mismatch(F.to_date("pickup_scheduled_datetime"), F.col("load_date"))).select("load_id")


def _places(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "routes")
    return r.select(F.col("origin_city").alias("city"), F.col("origin_state").alias("state")).union(r.select("destination_city", "destination_state")).distinct()


def q_city_states(spark: SparkSession, sf: str) -> DataFrame:
    return q.ambiguous(_places(spark, sf), "city", "state")


def q_city_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Cities only the routes or only the events have."""
    a = _places(spark, sf).select("city").distinct()
    b = table(spark, sf, "delivery_events").select(F.col("location_city").alias("city")).distinct()
    return a.exceptAll(b).withColumn("only_in", F.lit("routes")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("events")))


def _facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fa.build_facts(_one(spark, sf, "loads", "load_id"), _one(spark, sf, "routes", "route_id"), _one(spark, sf, "customers", "customer_id"), table(spark, sf, "delivery_events"), EQUIPMENT, CARGO)


def q_facts(spark: SparkSession, sf: str) -> DataFrame:
    f, _ = _facts(spark, sf)
    return f.select("load_id", "route_id", "customer_id", "shipper_name", "cargo_category", "equipment_type", "pieces", "weight_lbs", F.col("origin.city").alias("origin_city"), F.col("destination.city").alias("destination_city"), F.date_format("pickup_date", "yyyy-MM-dd").alias("pickup_date"), "load_month")


def q_fact_issues(spark: SparkSession, sf: str) -> DataFrame:
    _, issues = _facts(spark, sf)
    return issues.select("record_id", "code")


def q_star_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem, orders, customer and nation, by market segment and month of the order."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def q_profiles(spark: SparkSession, sf: str) -> DataFrame:
    loads = _one(spark, sf, "loads", "load_id").withColumn("equipment", fa.lookup(F.col("load_type"), EQUIPMENT))
    return fa.assign_profiles(loads, "load_id", "equipment", PROFILES, 42).select("load_id", "profile")


_SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


def q_group_split(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "sft_records").select("id", "group_id").filter("group_id is not null").distinct()
    return sa.group_split(r, F.col("group_id"), _SHARES, 42).select("id", "split")


def q_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return q_group_split(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def q_systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return sa.systematic_sample(o, "o_orderkey", ["o_orderpriority", "month"], 500, 42).select("o_orderkey")


def q_floored_sample(spark: SparkSession, sf: str) -> DataFrame:
    """200 loads over the feeds, none below a tenth if it can be. The quotas are worked out outside SQL."""
    return sa.floored_sample(_one(spark, sf, "loads", "load_id"), "load_id", "feed", 200, 0.1, 42).select("load_id", "feed")


def q_holdout_pairs(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "routes").select(F.col("origin_city").alias("origin"), F.col("destination_city").alias("destination"))
    cities = _places(spark, sf).select("city").filter("city is not null").distinct()
    places = cities.withColumn("lat", E.hash_uniform(1, "city") * 180 - 90).withColumn("lon", E.hash_uniform(2, "city") * 360 - 180)
    return sa.holdout_pairs(r, places, 5, 42)


def q_loads_without_events(spark: SparkSession, sf: str) -> DataFrame:
    """Loads that no event names, whatever the spelling of the key."""
    events = table(spark, sf, "delivery_events").select(canonical_key("load_id").alias("event_load")).filter("event_load is not null")
    loads = _one(spark, sf, "loads", "load_id").withColumn("k", canonical_key("load_id"))
    return q.orphans(loads, "k", events, "event_load").select("load_id")


def q_attempt_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Running number of each answer within its record."""
    return running_number(table(spark, sf, "generation_results").filter("record_id is not null").dropDuplicates(["result_id"]), "record_id", ["attempt", "result_id"]).select("record_id", "result_id", F.col("number").cast("bigint").alias("number"))


def q_newest_results(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty newest answers: the limit is the feature."""
    return newest(table(spark, sf, "generation_results").filter("result_id is not null").dropDuplicates(["result_id"]), "created_at", "result_id", 50).select("result_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


def q_slices(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "sft_records").groupBy("id").agg(F.min("task").alias("task"), F.min("language").alias("language"))
    slices = [("ru_extraction", (F.col("task") == "shipment_extraction") & (F.col("language") == "ru"), 40), ("extraction", F.col("task") == "shipment_extraction", 30), ("english", F.col("language") == "en", 20)]
    return sa.disjoint_slices(r, "id", slices, 42).withColumn("rank", F.col("rank").cast("bigint"))


def q_top_loads(spark: SparkSession, sf: str) -> DataFrame:
    """The three loads of the highest revenue on each route."""
    one = _one(spark, sf, "loads", "load_id").filter("route_id is not null and revenue is not null")
    return sa.top_per_group(one, ["route_id"], [F.desc("revenue"), F.col("load_id")], 3).select("route_id", "load_id", "revenue")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

_PAIRS_SQL = """single AS (SELECT *, count(*) OVER (PARTITION BY load_id, event_type) n FROM delivery_events WHERE event_type IN ('Pickup', 'Delivery')),
pairs AS (SELECT load_id, max(scheduled_datetime) FILTER (event_type = 'Pickup') pickup_at, max(scheduled_datetime) FILTER (event_type = 'Delivery') delivery_at,
  max(location_city) FILTER (event_type = 'Pickup') pickup_city, max(location_city) FILTER (event_type = 'Delivery') delivery_city,
  max(location_state) FILTER (event_type = 'Pickup') pickup_state, max(location_state) FILTER (event_type = 'Delivery') delivery_state
  FROM single WHERE n = 1 AND load_id IS NOT NULL GROUP BY 1 HAVING pickup_city IS NOT NULL AND delivery_city IS NOT NULL)"""
_L, _R, _C = (S.first_rows(f"(FROM {t} WHERE {k} IS NOT NULL)", k) for t, k in (("loads", "load_id"), ("routes", "route_id"), ("customers", "customer_id")))


def _case(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


_FACTS_SQL = f"""WITH {_PAIRS_SQL}, j AS (SELECT l.*, r.route_id rr, r.origin_city, r.destination_city, c.customer_id cc, c.customer_name, c.primary_freight_type, e.load_id ee, e.pickup_at, e.delivery_at,
  {_case("l.load_type", EQUIPMENT)} equipment_type, {_case("c.primary_freight_type", CARGO)} cargo_category
  FROM {_L} l LEFT JOIN {_R} r USING (route_id) LEFT JOIN {_C} c USING (customer_id) LEFT JOIN pairs e USING (load_id)),
coded AS (SELECT *, CASE WHEN load_id IS NULL OR route_id IS NULL OR customer_id IS NULL OR load_date IS NULL OR load_type IS NULL OR weight_lbs IS NULL OR pieces IS NULL THEN 'MISSING_VALUE'
  WHEN rr IS NULL THEN 'MISSING_ROUTE' WHEN cc IS NULL THEN 'MISSING_CUSTOMER' WHEN ee IS NULL THEN 'EVENTS'
  WHEN equipment_type IS NULL OR (primary_freight_type IS NOT NULL AND cargo_category IS NULL) THEN 'UNKNOWN_VALUE'
  WHEN pieces < 1 OR weight_lbs <= 0 OR CAST(delivery_at AS DATE) < CAST(pickup_at AS DATE) THEN 'INVALID' END code FROM j) """

_U = S.hash_uniform


def _profile_sql() -> str:
    u = _U(42, "'profile'", "load_id")
    return f"""SELECT load_id, CASE load_type WHEN 'Dry Van' THEN CASE WHEN {u} < 0.5 THEN 'plain' WHEN {u} < 0.8 THEN 'secured' ELSE 'sealed' END
  WHEN 'Refrigerated' THEN CASE WHEN {u} < 0.6 THEN 'chilled' ELSE 'frozen' END ELSE 'none' END AS profile FROM {_L}"""


_SPLIT_SQL = f"SELECT id, CASE WHEN {_U(42, 'group_id')} < 0.8 THEN 'train' WHEN {_U(42, 'group_id')} < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT id, group_id FROM sft_records WHERE group_id IS NOT NULL)"

ORACLE = {
    "q_loads_without_events": f"SELECT load_id FROM {_L} WHERE {canonical_key_sql('load_id')} IS NULL OR {canonical_key_sql('load_id')} NOT IN (SELECT {canonical_key_sql('load_id')} FROM delivery_events WHERE {canonical_key_sql('load_id')} IS NOT NULL)",
    "q_attempt_numbers": "SELECT record_id, result_id, row_number() OVER (PARTITION BY record_id ORDER BY attempt NULLS FIRST, result_id) AS number FROM (SELECT result_id, min(record_id) record_id, min(attempt) attempt FROM generation_results WHERE record_id IS NOT NULL GROUP BY 1)",
    "q_newest_results": "SELECT result_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM (SELECT result_id, max(created_at) created_at FROM generation_results WHERE result_id IS NOT NULL GROUP BY 1) ORDER BY created_at DESC NULLS LAST, result_id LIMIT 50",
    "q_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ALL),
    "q_pk_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n_copies FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "q_key_copies": " UNION ALL ".join(f"SELECT '{t}' AS table_name, {k} AS record_id, count(*) AS n_copies FROM {t} WHERE {k} IS NOT NULL GROUP BY ALL HAVING count(*) > 1" for t, k in (("loads", "load_id"), ("routes", "route_id"), ("customers", "customer_id"), ("delivery_events", "event_id"))),
    "q_fk_orphans": " UNION ALL ".join(f"SELECT '{c}.{k}' AS relation, count(*) AS n_orphans FROM {c} c WHERE NOT EXISTS (SELECT 1 FROM {p} p WHERE p.{pk} IS NOT DISTINCT FROM c.{k})" for c, k, p, pk in _FKS),
    "q_orphan_examples": "WITH o AS (SELECT DISTINCT load_id FROM loads c WHERE NOT EXISTS (SELECT 1 FROM routes p WHERE p.route_id IS NOT DISTINCT FROM c.route_id)) SELECT count(*) AS n_distinct, array_to_string(list(load_id ORDER BY load_id)[:10], ',') AS ids FROM o",
    "q_null_rates": " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(count(*) FILTER ({c} IS NULL) / greatest(count(*), 1), 6) AS null_rate FROM loads" for c in _NULLABLE),
    "q_value_ranges": """SELECT load_id AS record_id, 'weight_lbs' AS column_name, CAST(weight_lbs AS VARCHAR) AS value FROM loads WHERE weight_lbs NOT BETWEEN 10000 AND 45000
UNION ALL SELECT load_id, 'pieces', CAST(pieces AS VARCHAR) FROM loads WHERE pieces NOT BETWEEN 1 AND 28 UNION ALL SELECT load_id, 'load_type', load_type FROM loads WHERE load_type NOT IN ('Dry Van', 'Refrigerated')""",
    "q_distributions": " UNION ALL ".join(f"SELECT {c} AS value, count(*) AS n, '{c}' AS column_name FROM loads GROUP BY ALL" for c in _DISTRIBUTIONS),
    "q_shares": "SELECT primary_freight_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM customers GROUP BY 1",
    "q_month_hist": "SELECT strftime(load_date, '%Y-%m') AS month, count(*) AS n, count(DISTINCT load_id) AS n_loads FROM loads GROUP BY 1",
    "q_quantiles_linear": "SELECT unnest([0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])::DOUBLE AS share, unnest(quantile_cont(l_quantity, [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])) AS value FROM lineitem",
    "q_length_nearest_rank": "SELECT lang, count(text) AS n, min(length(text)) AS min_value, quantile_disc(length(text), 0.5)::DOUBLE AS p50, quantile_disc(length(text), 0.95)::DOUBLE AS p95, max(length(text)) AS max_value FROM documents GROUP BY 1",
    "q_rank_rounded": "WITH r AS (SELECT source, length(text) v, row_number() OVER (PARTITION BY source ORDER BY length(text)) r, count(*) OVER (PARTITION BY source) n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) SELECT source, v AS value FROM r WHERE r = round_even(0.9::DOUBLE * (n - 1), 0) + 1",
    "q_event_pairs": "SELECT load_id, count(*) FILTER (event_type = 'Pickup') AS n_pickup, count(*) FILTER (event_type = 'Delivery') AS n_delivery FROM delivery_events WHERE load_id IS NOT NULL GROUP BY 1 HAVING n_pickup <> 1 OR n_delivery <> 1",
    "q_pivot_pairs": f"WITH {_PAIRS_SQL} SELECT load_id, pickup_city AS pickup_location_city, delivery_city AS delivery_location_city, strftime(pickup_at, '%Y-%m-%d %H:%M') AS pickup_at, strftime(delivery_at, '%Y-%m-%d %H:%M') AS delivery_at FROM pairs",
    "q_route_match": f"WITH {_PAIRS_SQL}, j AS (SELECT r.*, p.* FROM {_L} l JOIN pairs p USING (load_id) JOIN {_R} r USING (route_id)) "
    + " UNION ALL ".join(f"SELECT '{a}' AS column_name, coalesce(round(1 - avg(CASE WHEN coalesce({a} = {b}, false) THEN 0 ELSE 1 END), 6), 1.0) AS match_rate FROM j" for a, b in (("origin_city", "pickup_city"), ("origin_state", "pickup_state"), ("destination_city", "delivery_city"), ("destination_state", "delivery_state"))),
    "q_transit_days": f"WITH {_PAIRS_SQL} SELECT date_diff('day', CAST(pickup_at AS DATE), CAST(delivery_at AS DATE)) AS days, count(*) AS n FROM pairs GROUP BY 1",
    "q_pickup_is_load_date": f"WITH {_PAIRS_SQL} SELECT load_id FROM {_L} l JOIN pairs p USING (load_id) WHERE NOT coalesce(CAST(pickup_at AS DATE) = load_date, false)",
    "q_city_states": "WITH p AS (SELECT origin_city city, origin_state state FROM routes UNION SELECT destination_city, destination_state FROM routes) SELECT city, count(DISTINCT state) AS n_values FROM p GROUP BY 1 HAVING count(DISTINCT state) > 1",
    "q_city_differences": "WITH a AS (SELECT origin_city city FROM routes UNION SELECT destination_city FROM routes), b AS (SELECT DISTINCT location_city city FROM delivery_events) SELECT city, 'routes' AS only_in FROM (FROM a EXCEPT FROM b) UNION ALL SELECT city, 'events' FROM (FROM b EXCEPT FROM a)",
    "q_facts": _FACTS_SQL + "SELECT load_id, route_id, customer_id, customer_name AS shipper_name, cargo_category, equipment_type, pieces, weight_lbs, origin_city, destination_city, strftime(pickup_at, '%Y-%m-%d') AS pickup_date, strftime(load_date, '%Y-%m') AS load_month FROM coded WHERE code IS NULL",
    "q_fact_issues": _FACTS_SQL + "SELECT load_id AS record_id, code FROM coded WHERE code IS NOT NULL",
    "q_star_revenue": "SELECT c_mktsegment, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "q_profiles": _profile_sql(),
    "q_group_split": _SPLIT_SQL,
    "q_split_counts": f"SELECT split, count(*) AS n FROM ({_SPLIT_SQL}) GROUP BY 1",
    "q_systematic_sample": f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, strftime(o_orderdate, '%Y-%m'), {_U(42, 'o_orderkey')}, o_orderkey) - 1 p, count(*) OVER () t FROM orders) SELECT o_orderkey FROM r WHERE t <= 500 OR p = 0 OR (p * 500) // t > ((p - 1) * 500) // t",
    "q_holdout_pairs": f"""WITH p AS (SELECT DISTINCT origin_city o, destination_city d FROM routes WHERE origin_city IS NOT NULL AND destination_city IS NOT NULL),
c AS (SELECT city, radians({_U(1, "city")} * 180 - 90) lat, radians({_U(2, "city")} * 360 - 180) lon FROM (SELECT origin_city city FROM routes UNION SELECT destination_city FROM routes)),
k AS (SELECT o, d, round(6371.0 * acos(greatest(-1.0, least(1.0, sin(a.lat) * sin(b.lat) + cos(a.lat) * cos(b.lat) * cos(b.lon - a.lon)))), 6) km FROM p JOIN c a ON a.city = o JOIN c b ON b.city = d),
r AS (SELECT o, d, ((row_number() OVER (ORDER BY km, o, d) - 1) * 5) // count(*) OVER () band FROM k),
h AS (SELECT arg_min(o, ({_U(42, "o", "d")}, o, d)) o, arg_min(d, ({_U(42, "o", "d")}, o, d)) d FROM r GROUP BY band)
SELECT o AS origin, d AS destination FROM p WHERE (o, d) IN (SELECT (o, d) FROM h) OR (d, o) IN (SELECT (o, d) FROM h)""",
    "q_slices": f"""WITH r AS (SELECT id, min(task) task, min(language) language FROM sft_records GROUP BY 1),
s AS (SELECT id, CASE WHEN task = 'shipment_extraction' AND language = 'ru' THEN 'ru_extraction' WHEN task = 'shipment_extraction' THEN 'extraction' WHEN language = 'en' THEN 'english' END slice FROM r),
k AS (SELECT id, slice, row_number() OVER (PARTITION BY slice ORDER BY {_U(42, "id")}, id) AS rank FROM s WHERE slice IS NOT NULL)
SELECT id, slice, rank, CASE WHEN rank <= CASE slice WHEN 'ru_extraction' THEN 40 WHEN 'extraction' THEN 30 ELSE 20 END THEN 'main' ELSE 'reserve' END AS role FROM k""",
    "q_top_loads": f"SELECT route_id, load_id, revenue FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY revenue DESC, load_id) r FROM {_L} l WHERE route_id IS NOT NULL AND revenue IS NOT NULL) WHERE r <= 3",
}
