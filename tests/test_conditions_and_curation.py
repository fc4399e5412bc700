import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.operators import backends as b
from millrace.operators import conditions as c
from millrace.operators import curation as u
from millrace.schemas import CONDITION

ROW = f"id string, gold array<{CONDITION}>, answer array<{CONDITION}>"


def cond(kind, lo=None, hi=None, methods=None, length=None):
    return (kind, lo, hi, methods, None, length, None, None, None)


def compared(spark, rows, missing=()):
    df = spark.createDataFrame(rows, ROW).withColumn("m", F.array(*[F.lit(x) for x in missing]) if missing else F.array().cast("array<string>"))
    df, got = c.compared(df, F.col("gold"), F.col("answer"), F.col("m"), F.lit(False))
    labels = got.labels
    return {r["id"]: r for r in df.select("id", F.create_map(*[x for k in c.KINDS for x in (F.lit(k), got.correct[k])]).alias("ok"), labels.alias("labels"), got.invented.alias("invented"), got.gold_kinds.alias("g"), got.answer_kinds.alias("a")).collect()}


def test_conditions(spark):
    rows = [
        ("same", [cond("temperature", 2.0, 8.0), cond("securing", methods=["a", "b"])], [cond("securing", methods=["b", "a"]), cond("temperature", 2.0, 8.0)]),
        ("missed", [cond("temperature", 2.0, 8.0)], []), ("invented", [], [cond("sensors")]), ("none", [], []),
        ("metres", [cond("oversize", length=(6.1, "m"))], [cond("oversize", length=(611.0, "cm"))]), ("far", [cond("oversize", length=(6.1, "m"))], [cond("oversize", length=(612.0, "cm"))]),
        ("off", [cond("temperature", 2.0, 8.0)], [cond("temperature", 3.0, 8.0)]),
    ]
    got = compared(spark, rows)
    assert got["same"]["ok"] == {"temperature": True, "securing": True, "packaging": None, "oversize": None, "sensors": None} and not got["same"]["invented"] and got["same"]["labels"] == []
    assert got["metres"]["ok"]["oversize"] and got["far"]["ok"]["oversize"] is False and got["off"]["ok"]["temperature"] is False and got["off"]["labels"] == []
    assert got["missed"]["labels"] == ["missed_condition"] and got["invented"]["labels"] == ["hallucinated_condition"] and got["invented"]["invented"] and set(got["none"]["ok"].values()) == {None}
    assert got["same"]["a"] == ["temperature", "securing"] and got["none"]["g"] == []


def test_asked_conditions(spark):
    """Where the gold asks for a condition, values of it are invented required fields; naming it without values is not."""
    rows = [("valued", [], [cond("temperature", 2.0, 8.0)]), ("named", [], [cond("temperature")]), ("more", [cond("temperature", None, 8.0)], [cond("temperature", 2.0, 8.0)])]
    got = compared(spark, rows, ["special_conditions.temperature"])
    assert got["valued"]["labels"] == ["hallucinated_required_field"] == got["more"]["labels"] and got["named"]["labels"] == [] and got["named"]["ok"]["temperature"] is False


def test_missing_and_kinds(spark):
    df = spark.createDataFrame([("reefer", [cond("temperature")]), ("reefer", [cond("temperature", 2.0)]), ("lowbed", []), (None, []), ("tent", [cond("sensors")])], f"e string, s array<{CONDITION}>")
    assert [r[0] for r in df.select(c.missing_conditions(F.col("e"), F.col("s"))).collect()] == [["temperature"], [], ["oversize"], [], ["sensors"]]
    t = spark.createDataFrame([("1", "Крепить 15 ремней, режим плюс 2 градуса"), ("2", None)], "id string, t string").withColumn("k", c.kinds_in(F.col("t")))
    assert {(r["kind"], r["n"]) for r in c.conditions_report(t, "id", "k").collect()} == {("temperature", 1), ("securing", 1), ("none", 1)}
    used = spark.createDataFrame([([cond("securing", methods=["straps", "chains"])],)], f"s array<{CONDITION}>")
    left = {(r["list"], r["value"]) for r in c.unused_values(used, "s").collect()}
    assert ("methods", "load_bars") in left and ("methods", "straps") not in left and len(left) == 13


def test_backends(spark):
    req = spark.createDataFrame([("1", "a"), ("2", None), ("3", "c")], "id string, text string").coalesce(1)
    assert {tuple(r) for r in b.answer_batches(req, lambda xs: [x.upper() for x in xs]).collect()} == {("1", "A", None), ("2", None, "no request"), ("3", "C", None)}
    assert {r["error"] for r in b.answer_batches(req, lambda xs: xs[:1]).collect()} == {"1 answers to 2 requests", "no request"}
    assert {r["error"] for r in b.answer_batches(req, lambda xs: 1 / 0).collect()} == {"ZeroDivisionError: division by zero", "no request"}
    known = spark.createDataFrame([("a", "x"), ("c", "__timeout__")], "t string, output string").select(F.sha2("t", 256).alias("sha256"), "output")
    got = b.answers_by_text(req, known)
    assert {(r["id"], r["output"], r["error"]) for r in got.collect()} == {("1", "x", None), ("2", None, "unknown request"), ("3", None, "timeout")}
    assert {r["id"] for r in b.pending(req, got).collect()} == {"2", "3"}
    pairs, gaps = b.paired(req, req.filter("id <> '2'").union(spark.createDataFrame([("9", "z")], "id string, text string")), "id")
    assert pairs.count() == 2 and {tuple(r) for r in gaps.collect()} == {("2", "a"), ("9", "b")}


def test_curation(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", ["z"]), ("d", ["x"]), (None, ["q"]), ("e", None)], "id string, fs array<string>")
    two, four = u.cover(df, "id", "fs", 2), u.cover(df, "id", "fs", 4)
    assert two == ["a", "c"] and four[:2] == two and set(four[2:]) <= {"b", "d"} and u.cover(df.limit(0), "id", "fs", 3) == [] and set(u.cover(df, "id", "fs", 99)) == {"a", "b", "c", "d"}
    cand, lost = u.apply_verdicts(df.select("id"), spark.createDataFrame([("a", "ok"), ("zz", "drop")], "id string, verdict string"))
    assert cand.filter("verdict = 'ok'").count() == 1 and [r["record_id"] for r in lost.collect()] == ["zz"]
    rows = spark.createDataFrame([(f"k{i}", "hard" if i < 2 else "clean", i) for i in range(20)], "k string, case string, n int")
    made = u.top_up(rows, "k", "case", {"hard": F.col("n") > 5, "other": F.lit(True)}, {"hard": 5, "other": 4}, 1).collect()
    assert sorted(r["case"] for r in made) == ["hard"] * 3 + ["other"] * 4 and len({r["k"] for r in made}) == 7
    w = spark.createDataFrame([("A", "Q", date(2024, 1, 2), date(2024, 1, 1), date(2024, 1, 3), 30_000.0), ("A", "B", None, None, None, None)], "origin string, destination string, pickup_date date, delivery_date date, request_date date, weight_kg double")
    assert [r[0] for r in w.select(u.value_warnings(["A", "B"])).collect()] == [["unknown_city", "pickup_before_request", "delivery_before_pickup", "weight_implausible"], []]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cover_is_greedy(spark, seed):
    """Each choice adds as many new features as any other would, until all are shown and the next pass begins."""
    rnd = random.Random(seed)
    rows = [(f"r{i:02}", sorted({rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 5))})) for i in range(40)]
    fs, left, shown = dict(rows), {r[0] for r in rows}, set()
    for chosen in u.cover(spark.createDataFrame(rows, "id string, fs array<string>"), "id", "fs", 25, seed):
        most = max(len(set(fs[i]) - shown) for i in left)
        if not most:
            shown, most = set(), max(len(fs[i]) for i in left)
        assert len(set(fs[chosen]) - shown) == most
        shown |= set(fs[chosen])
        left.discard(chosen)
