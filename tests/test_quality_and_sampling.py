from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import facts as fa
from millrace.operators import quality as q
from millrace.operators import sampling as sa


def test_unique_is_asserted(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert q.assert_unique(df, ["k"], "t").count() == 2
    with pytest.raises(Exception, match="duplicate key 1"):
        q.assert_unique(df.union(df.filter("k = 1")), ["k"], "t").collect()


def test_null_foreign_key(spark):
    child = spark.createDataFrame([("a",), (None,), ("x",)], "k string")
    assert {r["k"] for r in q.orphans(child, "k", spark.createDataFrame([("a",)], "p string"), "p").collect()} == {None, "x"}
    assert {r["k"] for r in q.orphans(child, "k", spark.createDataFrame([("a",), (None,)], "p string"), "p").collect()} == {"x"}


def test_mismatch_truth_table(spark):
    rows = [(1, 1), (1, None), (None, None), (1, 2)]
    assert [r[0] for r in spark.createDataFrame(rows, "a int, b int").select(q.mismatch(F.col("a"), F.col("b"))).collect()] == [False, True, True, True]
    assert spark.createDataFrame([], "a int, b int").agg(q.match_rate(q.mismatch(F.col("a"), F.col("b")))).first()[0] == 1.0


def test_three_percentiles(spark):
    df = spark.createDataFrame([("g", x) for x in (1, 2, 3, 4)], "g string, v bigint")
    assert {r["share"]: r["value"] for r in q.quantiles_linear(df, "v", (0, 0.5, 1)).collect()} == {0.0: 1.0, 0.5: 2.5, 1.0: 4.0}
    assert q.quantiles_nearest_rank(df, "g", "v").first()["p50"] == 2.0
    assert q.quantile_rounded_index(df, "g", "v", 0.5).first()["value"] == 3


def test_pairs_drop_all_copies(spark):
    e = spark.createDataFrame([("l1", "Pickup", "A"), ("l1", "Delivery", "B"), ("l2", "Pickup", "A"), ("l2", "Pickup", "A"), ("l2", "Delivery", "B"), (None, "Pickup", "A"), ("l3", "Other", "C")], "k string, kind string, city string")
    assert [r["k"] for r in q.pivot_pairs(e.filter("k is not null"), "k", "kind", ["Pickup", "Delivery"], ["city"], "city").collect()] == ["l1"]
    assert {r["k"] for r in q.unpaired(e, "k", "kind", ["Pickup", "Delivery"]).collect()} == {"l2", "l3"}


def test_examples_and_counts(spark):
    df = spark.range(25).select(F.format_string("i%02d", "id").alias("id"))
    r = q.examples(df.union(df), "id", 3).first()
    assert r["n_distinct"] == 25 and r["ids"] == ["i00", "i01", "i02"]
    assert {tuple(x) for x in q.count_mismatches(q.row_counts({"a": df, "b": df}), {"a": 25, "b": 7}).collect()} == {("b", 25, 7)}


def test_group_split_shares_and_order(spark):
    df = spark.range(1000).select(F.concat(F.lit("load:"), "id").alias("g"))
    split = lambda d: {r["g"]: r["split"] for r in sa.group_split(d, F.col("g"), {"train": 0.8, "val": 0.1, "test": 0.1}, 42).collect()}
    a = split(df)
    n = Counter(a.values())
    assert 760 <= n["train"] <= 840 and 70 <= n["val"] <= 130 and 70 <= n["test"] <= 130
    assert split(df.orderBy(F.rand(1)).repartition(7)) == a


def test_numbered(spark):
    df = spark.range(997).select(F.xxhash64("id").alias("h"), "id").repartition(9)
    got = sorted((r["pos"], r["h"]) for r in sa.numbered(df, ["h"]).collect())
    assert [p for p, _ in got] == list(range(997)) and [h for _, h in got] == sorted(h for _, h in got)
    assert sa.numbered(df.limit(0), ["h"]).count() == 0


@pytest.mark.parametrize(("n", "want"), [(10, 10), (100, 100), (1000, 300)])
def test_systematic(spark, n, want):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("s"))
    got = sa.systematic_sample(df, "id", ["s"], n, 42).collect()
    assert len(got) == want
    assert max(Counter(r["s"] for r in got).values()) - min(Counter(r["s"] for r in got).values()) <= 1


def test_quotas_and_interleave(spark):
    assert sa.floored_quotas({"a": 90, "b": 10}, 20, 0.25) == {"a": 16, "b": 4}
    assert sum(sa.floored_quotas({"a": 3, "b": 500, "c": 0}, 100, 0.1).values()) == 100
    assert sa.floored_quotas({}, 5, 0.1) == {} and sa.floored_quotas({"a": 2}, 50, 0.1) == {"a": 2}
    dealt = [r["label"] for r in sa.interleave(spark, {"x": 6, "y": 3, "none": 0}).orderBy("pos").collect()]
    assert dealt[:3] == ["x", "y", "x"] and Counter(dealt) == {"x": 6, "y": 3}
    for n in range(1, 10):  # never more than one place from its share
        assert abs(dealt[:n].count("x") - n * 2 / 3) <= 1


def test_sample_plan(spark):
    facts = spark.range(600).select(F.format_string("L%04d", "id").alias("k"), (F.col("id") % 12).cast("string").alias("route"), (F.col("id") % 3).alias("s"))
    held = spark.createDataFrame([("3",), ("7",), (None,)], "route string")
    pools = {"train": 100, "val": 20, "test": 30, "test_ood": 20}
    rows = sa.sample_plan(facts, "k", F.col("route"), held, pools, ["s"], 5).join(facts, "k").collect()
    assert Counter(r["split"] for r in rows) == pools and len({r["k"] for r in rows}) == 170
    assert all((r["route"] in ("3", "7")) == (r["ood_reason"] in ("route", "both")) for r in rows)
    assert Counter(r["ood_reason"] for r in rows if r["split"] == "test_ood") == {"family": 8, "route": 6, "both": 6}
    assert max(Counter(r["s"] for r in rows if r["split"] == "train").values()) <= 40


def test_weighted_pick(spark):
    df = spark.range(4000).select(F.col("id"), F.lit("c").alias("cat"))
    n = Counter(r["profile"] for r in fa.assign_profiles(df, "id", "cat", {"c": [("a", 0.5), ("b", 0.3), ("d", 0.2)]}, 1).collect())
    assert abs(n["a"] / 4000 - 0.5) < 0.04 and abs(n["d"] / 4000 - 0.2) < 0.03
    with pytest.raises(ValueError, match="shares"):
        fa.weighted_pick(F.lit(0.1), [("a", 0.5), ("b", 0.4)])


def test_fact_error_codes(spark):
    import datetime as d

    day, t = d.date(2024, 1, 1), d.datetime(2024, 1, 1, 8)
    loads = spark.createDataFrame([(f"L{i}", r, c, day, k, w, 1) for i, (r, c, k, w) in enumerate([("R1", "C1", "Dry Van", 100), (None, "C1", "Dry Van", 100), ("R9", "C1", "Dry Van", 100), ("R1", "C9", "Dry Van", 100), ("R1", "C1", "Boat", 100), ("R1", "C1", "Dry Van", 0), ("R1", "C1", "Dry Van", 5)])], "load_id string, route_id string, customer_id string, load_date date, load_type string, weight_lbs bigint, pieces bigint")
    routes = spark.createDataFrame([("R1", "A", "a", "B", "b")], "route_id string, origin_city string, origin_state string, destination_city string, destination_state string")
    customers = spark.createDataFrame([("C1", "N", "Retail")], "customer_id string, customer_name string, primary_freight_type string")
    events = spark.createDataFrame([(f"L{i}", k, t, "A", "a") for i in range(6) for k in ("Pickup", "Delivery")], "load_id string, event_type string, scheduled_datetime timestamp_ntz, location_city string, location_state string")
    facts, issues = fa.build_facts(loads, routes, customers, events, {"Dry Van": "dry_van"}, {"Retail": "retail"})
    assert [r["load_id"] for r in facts.collect()] == ["L0"]
    assert {r["record_id"]: r["code"] for r in issues.collect()} == {"L1": "MISSING_VALUE", "L2": "MISSING_ROUTE", "L3": "MISSING_CUSTOMER", "L4": "UNKNOWN_VALUE", "L5": "INVALID", "L6": "EVENTS"}


def test_conditions_of_profiles(spark):
    tables = {"food": [{"name": "cold", "share": 0.5, "equipment": "reefer", "temperature": (2, 6)}, {"name": "big", "share": 0.5, "equipment": "lowbed", "dimensions": {"length": (6, 9)}, "methods": ["straps", "chains"][::-1], "pieces": (1, 2)}]}
    facts = spark.range(200).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") < 150, "food").otherwise("other").alias("c"), F.lit("van").alias("equipment_type"), F.lit(9).cast("bigint").alias("pieces"))
    out = {r["k"]: r for r in fa.assign_conditions(facts, "k", "c", tables, 3).collect()}
    again = {r["k"]: r for r in fa.assign_conditions(facts.repartition(7), "k", "c", tables, 3).collect()}
    assert out == again and {r["profile"] for r in out.values()} == {"cold", "big", "none"}
    for r in out.values():
        got = {c["kind"]: c for c in r["special_conditions"]}
        if r["profile"] == "cold":
            assert (got["temperature"]["min_c"], r["equipment_type"], r["pieces"]) == (2.0, "reefer", 9) and list(got) == ["temperature"]
        elif r["profile"] == "big":
            assert 6 <= got["oversize"]["length"]["value"] <= 9 and got["securing"]["methods"] == ["straps", "chains"] and list(got) == ["securing", "oversize"] and r["pieces"] in (1, 2)
        else:
            assert r["special_conditions"] == [] and r["equipment_type"] == "van"
    lost = fa.completeness(facts.limit(1).select("k", F.lit("lowbed").alias("equipment_type"), F.lit(1).cast("bigint").alias("pieces"), F.lit(5).alias("weight_lbs"), F.struct(F.lit("A").alias("city"), F.lit("a").alias("region")).alias("origin"), F.struct(F.lit("A").alias("city"), F.lit("a").alias("region")).alias("destination"), F.lit("2024-01-01").cast("date").alias("pickup_date"), fa.assign_conditions(facts, "k", "c", tables, 3).schema["special_conditions"].dataType and F.array().cast(fa.assign_conditions(facts, "k", "c", tables, 3).schema["special_conditions"].dataType).alias("special_conditions")), "k")
    assert [r["message"] for r in lost.collect()] == ["missing special_conditions.oversize"]
