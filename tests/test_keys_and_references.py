from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions.keys import canonical_key
from millrace.operators.references import Child, broken_references, references_by_period
from millrace.session import hot_keys, salted_join

T = [datetime(2024, 1, d) for d in range(1, 10)]


def test_canonical_key(spark):
    rows = [("CUST0000007",), (" cust-7 ",), ("Cust 07",), ("CUST7",), ("N/A",), ("",), (None,), ("-",), ("X000",), ("7",)]
    got = [r[0] for r in spark.createDataFrame(rows, "k string").select(canonical_key("k")).collect()]
    assert got == ["CUST7", "CUST7", "CUST7", "CUST7", None, None, None, None, "X0", "7"]


def tables(spark, children, parents, dead):
    c = spark.createDataFrame(children, "id string, ref string, day timestamp_ntz, ingested_at timestamp_ntz, kind string, ref_key string, _salt int")
    p = spark.createDataFrame(parents, "pid string, ingested_at timestamp_ntz, ref_key string")
    d = spark.createDataFrame(dead, "table_name string, record_id string, deleted_at timestamp_ntz, kind string")
    return broken_references([Child("c", c, "id", "day", {"ref": "p"})], {"p": (p, "pid")}, d)


def test_kinds(spark):
    x = ("x", "y", 1)
    children = [
        ("a1", "P1", T[1], T[2], *x), ("a2", "p-2", T[1], T[2], *x), ("a3", "P3", T[1], T[2], *x), ("a4", "P4", T[1], T[2], *x), ("a5", "P5", T[1], T[5], *x),
        ("a6", "P5", T[1], T[2], *x), ("a7", "N/A", T[1], T[2], *x), ("a8", None, None, None, *x), ("a9", "P9", None, None, *x),
        ("a1", "P1", T[1], T[8], *x), ("a1", "P1", T[1], T[2], *x), ("b1", "P6", T[1], T[2], *x), ("b1", "P6", T[1], T[5], *x),
    ]
    parents = [("P01", T[0], "z"), ("P4", T[6], "z"), ("P4", T[5], "z"), ("P5", T[0], "z"), ("P 6", T[3], "z"), (None, T[0], "z")]
    dead = [("p", "P3", T[1], "k"), ("p", "P5", T[4], "k"), ("p", "p5", T[4], "k"), ("p", None, T[4], "k"), ("other", "P1", T[0], "k")]
    got = {(r["child_id"], r["kind"]) for r in tables(spark, children, parents, dead).collect()}
    assert got == {("a2", "missing"), ("a3", "deleted"), ("a4", "late"), ("a5", "deleted"), ("a9", "missing"), ("b1", "late")}


def test_empty_tables(spark):
    assert tables(spark, [], [("P1", T[0], "z")], []).count() == 0
    assert [r["kind"] for r in tables(spark, [("a", "P1", T[0], T[0], "", "", 0)], [], []).collect()] == ["missing"]


def test_periods_keep_null(spark):
    b = tables(spark, [("a", "P1", None, T[0], "", "", 0), ("b", "P1", T[0], T[0], "", "", 0)], [], [])
    assert {(r["period"], r["n_refs"]) for r in references_by_period(b).collect()} == {(None, 1), ("2024-01", 1)}


def test_hot_key_is_salted(spark):
    left = spark.range(4000).select(F.when(F.col("id") < 3000, "H1").otherwise(F.concat(F.lit("K"), F.col("id").cast("string"))).alias("k"), F.col("id"))
    right = left.select("k").distinct().withColumn("v", F.length("k"))
    hot = hot_keys(left, ["k"], 4000, share=0.1, floor=10)
    assert [r["k"] for r in hot.collect()] == ["H1"]
    j = salted_join(left, right, ["k"], hot, "id", salts=8)
    assert j.count() == 4000 and j.filter("v is null").count() == 0


def test_quick_keys_as_the_rule(spark):
    """Keys of one number go another way than the rest; both follow the one rule."""
    import re

    keys = ["CUST0007", " cust-0007 ", "Cust_7", "cust 00 07", "7", "007", "0", "000", "A0B0C1", "R-1-2", "ключ 012", "É09x", "x0", "12ab", "ab", "", "-", "N/A", "a\t01\n", "RTE00.01", "#5#", "load:LOAD0001", "١٢", "ß1"]

    def rule(k):
        letters = "".join(ch for ch in k if ch.isalpha()).upper()
        digits = re.sub(r"^0+(?=[0-9])", "", re.sub(r"[^0-9]", "", k))
        return letters + digits if digits else None

    rows = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string").select("k", canonical_key("k").alias("c")).collect()
    assert {r["k"]: r["c"] for r in rows} == {k: rule(k) for k in keys} | {None: None}
