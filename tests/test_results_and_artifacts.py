import datetime as d
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import json_answers as ja
from millrace.operators import backends as b
from millrace.operators import extract as ex
from millrace.operators import logs as lg
from millrace.sources import artifacts as ar
from millrace.sources import records as rec
from millrace.sources import tables as tb

V2 = {"shipper_name": None, "cargo_category": None, "equipment_type": "tent", "pieces": None, "weight_total": None, "weight_per_piece": {"value": 2, "unit": "t"}, "origin": {"city": "A", "region": "a"}, "destination": {"city": "Q", "region": "q"}, "pickup_date": "2024-01-05", "delivery_date": "2024-01-02", "special_conditions": []}


def text(**changes):
    return json.dumps({"card": V2 | changes, "missing_fields": ["pieces"], "conflicts": []})


def test_results(spark):
    rows = [("ok", text(), None), ("fenced", f"```json\n{text(pieces=3)}\n```", None), ("bad", "{", None), ("none", None, None), ("late", text(), "timeout"), ("heavy", text(pieces=20, destination=None), None)]
    got = {r["id"]: r for r in b.assemble_results(spark.createDataFrame(rows, "id string, output string, error string"), "card_v2", ["A", "B"]).collect()}
    assert {i: r["status"] for i, r in got.items()} == {"ok": "ok", "fenced": "ok", "bad": "invalid_output", "none": "backend_error", "late": "backend_error", "heavy": "ok"}
    assert got["ok"]["weight_kg"] == 2000 and got["ok"]["assumptions"] == ["pieces=1"] and got["ok"]["warnings"] == ["unknown_city", "delivery_before_pickup"]
    assert got["fenced"]["weight_kg"] == 6000 and got["fenced"]["assumptions"] == [] and got["heavy"]["warnings"] == ["delivery_before_pickup", "weight_implausible"]
    assert got["late"]["weight_kg"] is None and got["bad"]["missing_fields"] is None and got["ok"]["missing_fields"] == ["pieces"]


def test_back_ends(spark):
    req = spark.createDataFrame([("1", "from Craywick to Dunmarsh, 5 pallets"), ("2", None)], "id string, text string")
    got = {r["id"]: r for r in b.rules_backend(req, ex.Gazetteer({"Craywick": "C", "Dunmarsh": "D"}), {"C": "Region"}).collect()}
    card = json.loads(got["1"]["output"])["card"]
    assert (card["origin"], card["pieces"], got["2"]["error"]) == ({"city": "C", "region": "Region"}, 5, "no request")
    for version in ja.VERSIONS:
        assert ja.read(b.empty_backend(req, version).first()["output"], ja.VERSIONS[version])[0] is None
    state = lambda rows: spark.createDataFrame(rows, "key string, value string")
    diff = b.state_changes(state([("a", "1"), ("b", "2"), ("c", None)]), state([("a", "1"), ("b", "3"), ("c", None), ("d", "4")]))
    assert {tuple(r) for r in diff.collect()} == {("b", "2", "3"), ("d", None, "4")}


def test_logs(spark):
    t = [("m", 600, 200), ("m", 900, 200), ("m", None, 5), ("k", 2000, 1)]
    got = {r["model"]: tuple(r)[1:] for r in lg.token_audit(spark.createDataFrame(t, "model string, p bigint, a bigint"), "model", "p", "a", 1000).collect()}
    assert got == {"m": (2, 1, 0.5, 0.25), "k": (1, 1, 1.0, None)}
    one = spark.createDataFrame([(33,), (0,)], "n bigint")
    assert [r[0] for r in one.select(lg.training_steps(F.col("n"), 2, 8, 3)).collect()] == [9, 0]
    assert one.select(lg.training_cost(F.lit(360), 10.0, 368.18)).first()[0] == 368.18
    lg.within_skipped_share(0, 0, 0.1), lg.within_skipped_share(1, 10, 0.1)
    with pytest.raises(ValueError, match="2 of 10"):
        lg.within_skipped_share(2, 10, 0.1)
    log = spark.createDataFrame([("loss", 1, 3.0), ("loss", 3, float("nan")), ("loss", 2, 2.0), ("loss", 2, None), ("nothing", 1, None)], "key string, step int, value double")
    assert [tuple(r) for r in lg.latest_values(log, "key", "step", "value").collect()] == [("loss", 2, 2.0)]
    power = spark.createDataFrame([("g", d.datetime(2024, 1, 1, 0), 10.0), ("g", d.datetime(2024, 1, 1, 2), 30.0), ("h", d.datetime(2024, 1, 1), 5.0)], "k string, t timestamp, v double")
    assert {tuple(r) for r in lg.area_under(power, "k", "t", "v").collect()} == {("g", 40.0, 30.0, 2), ("h", 0.0, 5.0, 1)}
    assert [r["number"] for r in lg.running_number(power, "k", ["t"]).orderBy("k", "t").collect()] == [1, 2, 1] and lg.newest(power, "t", "k", 1).first()["v"] == 30.0


def test_artifacts(spark, tmp_path):
    df = spark.range(10)
    first = ar.write_artifact(df, f"{tmp_path}/a", "facts", "v1", extra={"n": 10})
    second = ar.write_artifact(df.limit(3), f"{tmp_path}/b", "sample", "v2", [first])
    data, manifest = ar.read_artifact(spark, f"{tmp_path}/b", "sample", {"v2"})
    assert data.count() == 3 and manifest["parents"][0]["sha256"] == first["sha256"] and ar.read_artifact(spark, f"{tmp_path}/a", "facts", {"v1"})[1]["extra"] == {"n": 10}
    with pytest.raises(FileExistsError):
        ar.write_artifact(df, f"{tmp_path}/a", "facts", "v1")
    with pytest.raises(ValueError, match="not facts"):
        ar.read_artifact(spark, f"{tmp_path}/b", "facts", {"v2"})
    edges = ar.manifest_edges(spark, [first, second])
    roots = spark.createDataFrame([(second["sha256"],)], "node string")
    assert {(r["node"], r["depth"]) for r in ar.lineage(edges, roots).collect()} == {(second["sha256"], 0), (first["sha256"], 1)}
    assert {(r["kind"], r["version"]) for r in ar.list_artifacts(spark, str(tmp_path)).collect()} == {("facts", "v1"), ("sample", "v2")}
    spark.range(99).write.mode("append").parquet(f"{tmp_path}/a/data")
    with pytest.raises(ValueError, match="hash differs"):
        ar.read_artifact(spark, f"{tmp_path}/a", "facts", {"v1"})


def test_facts_and_reports(spark, tmp_path):
    facts = spark.createDataFrame([(f"L{i}", i) for i in (3, 1, 2)], "load_id string, pieces bigint")
    rec.save_facts(facts, f"{tmp_path}/facts")
    assert sorted((r["load_id"], r["pieces"]) for r in rec.load_facts(spark, f"{tmp_path}/facts").collect()) == [("L1", 1), ("L2", 2), ("L3", 3)]
    (tmp_path / "bad.json").write_text('{"load_id": "L1"}\n{"load_id": \n')
    with pytest.raises(ValueError, match="bad.json"):
        rec.load_facts(spark, f"{tmp_path}/bad.json")
    issues = spark.createDataFrame([(f"r{i}", None, "CODE", "why") for i in range(5)], "record_id string, split string, code string, message string")
    with pytest.raises(ValueError, match="5 issues, e.g. r0: CODE why; r1"):
        rec.refuse(issues, "facts")
    rec.refuse(issues.limit(0), "facts")
    tb.json_report(f"{tmp_path}/r.json", {"facts": facts.orderBy("load_id"), "none": facts.limit(0)})
    assert json.loads((tmp_path / "r.json").read_text()) == {"facts": [{"load_id": f"L{i}", "pieces": i} for i in (1, 2, 3)], "none": []}
    with pytest.raises(ValueError, match="more than 2"):
        tb.json_report(f"{tmp_path}/r.json", {"facts": facts}, 2)
    tb.write_review(spark.createDataFrame([("b", 'say "hi",\nyou'), ("a", "x")], "id string, text string"), f"{tmp_path}/review")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/review")
    assert [(r["id"], r["text"], r["verdict"]) for r in back.orderBy("id").collect()] == [("a", "x", None), ("b", 'say "hi",\nyou', None)]
