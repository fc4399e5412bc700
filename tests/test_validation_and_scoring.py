import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import json_answers as ja
from millrace.operators import metrics as m
from millrace.operators import stats as st
from millrace.operators import validate as v
from millrace.operators.scoring import last_predictions, score_cases
from millrace.plans import evaluation

REC = "id string, split string, group_id string, task string, messages array<struct<role: string, content: string>>"
CARD = {"shipper_name": "A B", "cargo_category": "general", "equipment_type": "reefer", "pieces": 7, "weight_total": {"value": 12000, "unit": "kg"}, "origin": {"city": "X"}, "destination": {"city": "Y"}, "pickup_date": "2024-01-02"}


def answer(missing=(), conflicts=(), **card):
    return json.dumps({"card": CARD | card, "missing_fields": list(missing), "conflicts": list(conflicts)}, ensure_ascii=False)


def rec(i, split, group, text, roles=("system", "user", "assistant")):
    return (i, split, group, "t", [(r, text if r == "user" else r) for r in roles])


@pytest.fixture(scope="module")
def records(spark):
    rows = [rec("a", "train", "load:1", "Request date: 1\n\nHello  World"), rec("b", "test", "load:1", "x"), rec("c", "val", "load:2", "Request date: 2\n\nhello world"), rec("d", "train", "load:3", "y"), rec("e", "train", None, "Y "), rec("d", "train", "load:3", "y"), ("f", None, "load:9", "t", None), rec(None, "bench", "load:7", "z")]
    return spark.createDataFrame(rows, REC)


def codes(df):
    return {(r["record_id"], r["code"]) for r in df.collect()}


def test_checks(records):
    assert codes(v.duplicate_ids(records)) == {("d", "DUP_ID")}
    assert codes(v.duplicate_texts(records)) == {("a", "DUP_EXACT"), ("c", "DUP_EXACT"), ("d", "DUP_EXACT_IN_SPLIT"), ("e", "DUP_EXACT_IN_SPLIT")}
    assert codes(v.group_leaks(records)) == {("a", "GROUP_LEAK"), ("b", "GROUP_LEAK")}
    assert codes(v.role_order(records)) == {("f", "ROLE_ORDER")}
    assert ("f", "PROMPT_MISMATCH") in codes(v.prompt_mismatch(records, {"t": "system"})) and len(codes(v.prompt_mismatch(records, {"t": "system"}))) == 1


def test_route_leaks_by_key_and_every_route(spark):
    loads = spark.createDataFrame([("LOAD0001", "rte0000242"), ("LOAD0002", "RTE00000001"), ("load-2", "Rte 0001685"), ("LOAD0003", "RTE00000003"), ("LOAD0004", None), ("n/a", "RTE00000242")], "load_id string, route_id string")
    held = spark.createDataFrame([("RTE00000242",), ("rte-1685",), ("none",), (None,)], "route_id string")
    rows = [rec("a", "train", "load:LOAD0001", "x"), rec("b", None, "load:LOAD0002", "x"), rec("c", "test_ood", "load:LOAD0001", "x"), rec("d", "train", "load:load 3", "x"), rec("e", "val", "load:LOAD0009", "x"), rec("f", "val", "load:LOAD0004", "x"), rec("g", "val", "load:n/a", "x"), rec("h", "val", None, "x")]
    got = sorted((r["record_id"], r["code"], r["message"]) for r in v.route_leaks(spark.createDataFrame(rows, REC), loads, held).collect())
    assert got == [("a", "OOD_ROUTE_LEAK", "load LOAD0001"), ("b", "OOD_ROUTE_LEAK", "load LOAD0002"), ("e", "UNKNOWN_LOAD", "load LOAD0009"), ("g", "UNKNOWN_LOAD", "load n/a")]


def test_contamination_priority(spark, records):
    bench = spark.createDataFrame([rec("a", "bench", "load:3", "q"), rec("n", "bench", "load:3", "hello world"), rec("o", "bench", "load:8", "Hello\tworld"), rec("p", "bench", None, "new")], REC)
    got = {r["record_id"]: r["message"] for r in v.contamination(bench, records.filter("split in ('train', 'val')")).collect()}
    assert got == {"a": "id in train", "n": "group in train", "o": "text in train"}


def test_report_and_empty(records):
    every = v.report([v.duplicate_ids(records), v.duplicate_texts(records)])
    assert {r["severity"] for r in every.filter("code = 'DUP_EXACT_IN_SPLIT'").collect()} == {"warning"}
    none = records.limit(0)
    assert v.report([v.duplicate_ids(none), v.duplicate_texts(none), v.group_leaks(none), v.contamination(none, none)]).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (answer(), (True, True, True, None)), (" " + answer(), (False, False, True, "format")), ("```json\n" + answer() + "\n```", (False, False, True, "format")), (answer()[:-3], (False, False, False, "format")), (None, (False, False, False, "format")),
        (answer(pieces="7"), (True, False, False, "schema")), (answer(pieces=True), (True, False, False, "schema")), (answer(extra=1), (True, False, False, "schema")), (answer(pickup_date="2024-13-01"), (True, False, False, "schema")),
        (answer().replace('"pieces": 7', '"pieces": 7, "pieces": 8'), (False, False, False, "format")), (answer().replace("12000", "NaN"), (False, False, False, "format")), ("[]", (True, False, False, "schema")),
        (answer(conflicts=[{"field": "pieces", "values": [1, 1.0]}], pieces=None), (True, False, False, "schema")), (answer(conflicts=[{"field": "pieces", "values": [1, 2]}], pieces=None, missing=["pieces"]), (True, True, True, None)),
    ],
)
def test_strict_and_lenient(text, want):
    assert ja.flags_of(text, ja.VERSIONS["card_short"])[:4] == want


def test_canonical_and_consistency(spark):
    flags_of = lambda t: ja.flags_of(t, ja.VERSIONS["card_short"])
    body = flags_of(answer(weight_total={"value": 12000.0, "unit": "kg"}))[4]
    assert '"value":12000,' in body and " " not in body.replace("A B", "")
    t = spark.createDataFrame([(body,), (flags_of(answer(pieces=None))[4],)], "b string").select(ja.target(F.col("b")).alias("t"))
    assert [r[0] for r in t.select(ja.consistency(F.col("t"))).collect()] == [[], ["missing_fields"]]


def scores(spark, pairs):
    gold = spark.createDataFrame([(f"r{i}", g, "ru" if i % 2 else "en") for i, (g, _, _) in enumerate(pairs)], "record_id string, gold_text string, language string")
    return score_cases(gold, spark.createDataFrame([(f"r{i}", o, e) for i, (_, o, e) in enumerate(pairs) if o != "-"], "record_id string, output string, error string"))


def test_scores(spark):
    swap = answer(origin={"city": "Y"}, destination={"city": "X"})
    rows = scores(spark, [(answer(), answer(shipper_name=" a  b "), None), (answer(), answer(weight_total={"value": 12, "unit": "kg"}), None), (answer(), swap, None), (answer(), "garbage", None), (answer(), answer(), "timeout"), (answer(), "-", None),
                          (answer(), answer(pieces=12000), None), (answer(pieces=None, missing=["pieces"]), answer(pieces=3), None), (answer(), answer(weight_total={"value": 12, "unit": "t"}), None)]).collect()
    by = {r["record_id"]: r for r in rows}
    assert by["r0"]["key_fields_correct"] and set(by["r0"]["field_correct"].values()) == {True, None} and by["r0"]["critical_errors"] == []
    assert by["r1"]["critical_errors"] == ["wrong_unit_magnitude"] and by["r2"]["critical_errors"] == ["origin_destination_swap"] and by["r6"]["critical_errors"] == ["pieces_weight_swap"]
    assert [by[f"r{i}"]["failed"] for i in (3, 4, 5)] == [True] * 3 and by["r5"]["generation_error"] == "no answer" and not any(by["r3"]["field_correct"].values())
    assert by["r7"]["hallucinated_fields"] == ["pieces"] and by["r7"]["critical_errors"] == ["hallucinated_required_field"] and by["r7"]["missing_fn"] == 1 and by["r7"]["key_fields_correct"] is None
    assert by["r8"]["key_fields_correct"]


def test_metrics(spark):
    s = scores(spark, [(answer(), answer(), None)] * 3 + [(answer(), "bad", None)])
    got = {r["metric"]: r["value"] for r in m.metrics_overall(s).collect()}
    assert got["json_valid_rate"] == 0.75 and got["key_field_accuracy"] == 0.75 and got["missing_f1"] == 1.0 and got["conflict_recall"] is None and got["field_accuracy_micro"] == 0.75
    by = {(r["slice"], r["slice_value"]): r["n_cases"] for r in m.metrics_by_slice(s, ["language"]).collect()}
    assert by == {("all", None): 4, ("language", "ru"): 2, ("language", "en"): 2}
    assert m.worst_cases(s, 1).first()["record_id"] == "r3"
    assert {r["metric"]: r["value"] for r in m.metrics_overall(s.limit(0)).collect()}["json_valid_rate"] is None


@pytest.mark.parametrize(("fixed", "broken", "p"), [(5, 0, 0.0625), (6, 2, 74 / 256), (3, 3, 1.0), (0, 0, 1.0)])
def test_mcnemar(fixed, broken, p):
    assert st.mcnemar_p(fixed, broken) == p


def test_bootstrap(spark):
    df = spark.range(80).select(F.col("id").cast("string").alias("k"), (F.col("id") % 4 == 0).alias("f"), F.lit(True).alias("g"), F.lit(None).cast("boolean").alias("n"))
    ci = {r["metric"]: (r["low"], r["high"]) for r in st.bootstrap_ci(df, "k", ["f", "g", "n"], 100).collect()}
    assert ci["g"] == (1.0, 1.0) and ci["f"][0] < 0.25 < ci["f"][1] and "n" not in ci
    same = st.paired_difference(df, df, "k", "f", 50).first()
    assert (same["difference"], same["low"], same["high"], same["verdict"]) == (0.0, 0.0, 0.0, "indistinguishable")
    better = st.paired_difference(df, df.withColumn("f", F.lit(True)), "k", "f", 50).first()
    assert better["verdict"] == "better"


def test_last_wins(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), (None, 9, "q"), ("b", None, "w")], "id string, n int, v string")
    assert {(r["id"], r["v"]) for r in last_predictions(log, "id", ["n"]).collect()} == {("a", "z"), ("b", "w")}


def test_rates_count_every_record(spark, tmp_path):
    gold = answer(shipper_name=None, missing=["shipper_name"])
    texts = {"bare": gold, "fenced": f"```json\n{gold}\n```", "spaced": f"\n {gold} ", "ordered": json.dumps(dict(reversed(json.loads(gold).items()))), "preamble": f"Here it is: {gold}", "cut": gold[:-9], "failed": None}
    rows = [(i, "shipment_extraction", "g", "test", "en", "f", True, {"hard_cases": [], "ood_reason": None}, [("assistant", gold)]) for i in [*texts, "unanswered"]]
    spark.createDataFrame(rows, "id string, task string, group_id string, split string, language string, template_family string, synthetic boolean, variant struct<hard_cases: array<string>, ood_reason: string>, messages array<struct<role: string, content: string>>").write.parquet(f"{tmp_path}/sft_records.parquet")
    log = [(n, i, 1, t, None if t else "timeout") for n, (i, t) in enumerate(texts.items())]
    spark.createDataFrame(log, "result_id bigint, record_id string, attempt bigint, text string, error string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/generation_results.parquet")
    rates = {(r["slice"], r["metric"]): (r["n_cases"], r["value"]) for r in evaluation.q_city_accuracy(spark, str(tmp_path)).collect()}
    assert {rates["all", k] for k in ("origin", "destination", "micro")} == {(8, 0.5)} and rates["language", "micro"] == (8, 0.5)
    assert {r["metric"]: r["value"] for r in evaluation.q_missing_f1(spark, str(tmp_path)).collect()} == {"f1": round(8 / 12, 9), "precision": 1.0, "recall": 0.5}


CARD_V1 = {"shipper_name": "A", "cargo_category": "general", "equipment_type": "reefer", "pieces": 4, "weight_total": None, "weight_per_piece": {"value": 500, "unit": "kg"}, "origin": {"city": "X", "region": "R"}, "destination": {"city": "Y", "region": "R"}, "pickup_date": "2024-01-02", "delivery_date": None, "temperature_c": None}


def v1(missing=("temperature_c",), conflicts=(), **changes):
    return json.dumps({"card": CARD_V1 | changes, "missing_fields": list(missing), "conflicts": list(conflicts)}, ensure_ascii=False, separators=(",", ":"))


def test_scores_of_the_first_version(spark):
    """Pieces times weight stated as a total is a note, not an invention; regions count; a conflict overwritten is missed."""
    torn = v1(missing=["pieces", "temperature_c"], conflicts=[{"field": "pieces", "values": [3, 4]}], pieces=None)
    pairs = [(v1(), v1()), (v1(), v1(weight_total={"value": 2, "unit": "t"}, weight_per_piece=None)), (v1(), v1(origin={"city": "X", "region": "Q"})), (v1(), v1(temperature_c=4.0, missing=[])), (torn, v1()), (v1(), v1(weight_per_piece={"value": 226796.185, "unit": "kg"})), (v1(), v1(weight_per_piece={"value": 226.796185, "unit": "kg"}))]
    gold = spark.createDataFrame([(f"r{i}", g) for i, (g, _) in enumerate(pairs)], "record_id string, gold_text string")
    got = {r["record_id"]: r for r in score_cases(gold, spark.createDataFrame([(f"r{i}", a, None) for i, (_, a) in enumerate(pairs)], "record_id string, output string, error string"), "card_v1").collect()}
    assert got["r0"]["key_fields_correct"] and got["r0"]["field_correct"]["temperature_c"] is None and got["r0"]["critical_errors"] == []
    assert got["r1"]["notes"] == ["computed_weight_total"] and got["r1"]["hallucinated_fields"] == [] and got["r1"]["field_correct"]["weight_total"] is False and got["r1"]["key_fields_correct"]
    assert got["r2"]["field_correct"]["origin"] is False and got["r2"]["key_fields_correct"] is False
    assert got["r3"]["critical_errors"] == ["hallucinated_required_field"] and got["r3"]["missing_fn"] == 1
    assert got["r4"]["critical_errors"] == ["missed_conflict"] and got["r4"]["conflict_detected"] is False and got["r4"]["hallucinated_fields"] == []
    assert got["r5"]["critical_errors"] == [] and got["r6"]["critical_errors"] == ["wrong_unit_magnitude"]  # 453.6 is no mistake between units, 0.4536 is


V2 = {k: v for k, v in CARD_V1.items() if k != "temperature_c"} | {"special_conditions": [{"kind": "temperature", "min_c": 2, "max_c": 6.0}, {"kind": "oversize", "length": {"value": 6, "unit": "m"}, "width": None, "height": None}]}


@pytest.mark.parametrize(
    ("version", "card", "stage"),
    [
        ("card_v1", CARD_V1, None), ("card_v1", CARD_V1 | {"origin": {"city": "X"}}, "schema"), ("card_v1", CARD_V1 | {"temperature_c": -18}, None), ("card_v1", CARD_V1 | {"equipment_type": "tent"}, "schema"),
        ("card_v2", V2, None), ("card_v2", V2 | {"equipment_type": "tent"}, "schema" if False else None), ("card_v2", V2 | {"special_conditions": V2["special_conditions"][:1] * 2}, "schema"), ("card_v2", V2 | {"special_conditions": [{"kind": "temperature", "min_c": 9, "max_c": 2}]}, "schema"),
        ("card_v2", V2 | {"special_conditions": [{"kind": "securing", "methods": ["straps", "straps"]}]}, "schema"), ("card_v2", V2 | {"special_conditions": [{"kind": "boat"}]}, "schema"), ("card_v2", CARD_V1, "schema"),
    ],
)
def test_versions(version, card, stage):
    v = ja.VERSIONS[version]
    text = json.dumps({"card": card, "missing_fields": [], "conflicts": []})
    assert ja.read(text, v)[0] == stage
    if stage is None:
        spelled = v.target.spell(ja.read(text, v)[1])
        assert ja.read(spelled, v)[0] is None and spelled == v.target.spell(ja.read(spelled, v)[1]) and ".0" not in spelled


def test_rules_of_the_versions(spark):
    def wrong(card, missing, version):
        text = json.dumps({"card": card, "missing_fields": missing, "conflicts": []})
        body = ja.flags_of(text, ja.VERSIONS[version])[4]
        return spark.createDataFrame([(body,)], "b string").select(ja.consistency(ja.target(F.col("b")), version)).first()[0]

    assert wrong(CARD_V1, ["temperature_c"], "card_v1") == [] and wrong(CARD_V1, [], "card_v1") == ["missing_fields"] and wrong(CARD_V1 | {"temperature_c": 3}, [], "card_v1") == []
    assert wrong(CARD_V1 | {"weight_total": {"value": 1, "unit": "t"}}, ["temperature_c"], "card_v1") == ["both_weights"]
    assert wrong(V2, [], "card_v2") == [] and wrong(V2 | {"equipment_type": "lowbed"}, ["special_conditions.oversize"], "card_v2") == []
    assert wrong(V2 | {"special_conditions": V2["special_conditions"][::-1]}, [], "card_v2") == ["condition_order"]
    assert wrong(V2 | {"special_conditions": [V2["special_conditions"][0], {"kind": "securing", "methods": ["chains", "straps"]}]}, [], "card_v2") == ["list_order"]
    assert wrong(V2 | {"special_conditions": [V2["special_conditions"][0], {"kind": "sensors", "parameters": []}]}, ["special_conditions.sensors"], "card_v2") == []
    for card, version in ((CARD_V1, "card_v1"), (V2, "card_v2"), (V2 | {"equipment_type": "lowbed", "pieces": None, "special_conditions": []}, "card_v2")):
        one = spark.createDataFrame([(ja.flags_of(json.dumps({"card": card, "missing_fields": [], "conflicts": []}), ja.VERSIONS[version])[4],)], "b string")
        assert one.select(ja.missing_fields(ja.target(F.col("b"))["card"], version)).first()[0] == ja.missing_of(card, ja.VERSIONS[version])
    assert set(ja.json_schema("card_v2")["properties"]) == {"card", "missing_fields", "conflicts"}


def test_registry_has_all_metrics():
    assert len(m.registry()) == 47


def test_intervals_of_all_metrics(spark):
    s = scores(spark, [(answer(), answer(), None)] * 30 + [(answer(), "bad", None)] * 10)
    got = {r["metric"]: r for r in m.metrics_with_intervals(s, "record_id", reps=300).collect()}
    assert len(got) == 47 and got["json_valid_rate"]["value"] == 0.75 and 0.5 < got["json_valid_rate"]["low"] < 0.75 < got["json_valid_rate"]["high"] < 0.95
    assert got["conflict_recall"]["value"] is None and got["conflict_recall"]["low"] is None and got["json_valid_rate"]["n"] == 40 and not got["failed_output_rate"]["higher_is_better"]


def test_poisson_weights():
    import numpy as np

    w = st.poisson_weights(np.arange(2000, dtype=np.int64) * 7919, np.arange(500))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert np.array_equal(w[3:5, :7], st.poisson_weights(np.arange(7, dtype=np.int64) * 7919, np.arange(3, 5)))


def test_record_checks(spark):
    good = answer()
    rows = [("ok", "x", "v", good), ("task", "boat", "v", good), ("schema", "x", "w", good), ("empty", "x", "v", " "), ("null", "x", "v", None), ("parse", "x", "v", "{"), ("shape", "x", "v", "{}"), ("both", "x", "v", json.dumps(json.loads(answer(pieces=None)))), ("free", "t", "v", "any text")]
    r = spark.createDataFrame([(i, "train", t, s, [("assistant", a)]) for i, t, s, a in rows], "id string, split string, task string, schema_version string, messages array<struct<role: string, content: string>>")
    canonical = ja.flags_of(good, ja.VERSIONS["card_short"])[4]
    r = r.withColumn("messages", F.when(F.col("id") == "ok", F.array(F.struct(F.lit("assistant").alias("role"), F.lit(canonical).alias("content")))).otherwise(F.col("messages")))
    got = {}
    for x in v.record_checks(r, {"x": {"v": "card_short"}, "t": {"v": ""}}).collect():
        got.setdefault(x["record_id"], []).append((x["code"], x["message"]))
    assert {i: sorted(c for c, _ in x) for i, x in got.items()} == {"task": ["UNKNOWN_TASK"], "schema": ["UNSUPPORTED_SCHEMA"], "empty": ["EMPTY_ASSISTANT"], "null": ["EMPTY_ASSISTANT"], "parse": ["TARGET_PARSE"], "shape": ["TARGET_PARSE"], "both": ["NOT_CANONICAL", "TARGET_INCONSISTENT"]}
    assert got["parse"][0][1] == "refused as format" and got["shape"][0][1] == "refused as schema"


def test_duplicates_as_rows(spark):
    """Every row of an id but its first in the order of the splits is an issue; copies of one id are places of its text."""
    rows = [("a", "val", "t1"), ("a", "train", "t2"), ("a", "train", "t2"), ("b", "test", "t3"), (None, "val", "t9"), ("c", None, "t4"), ("c", None, "t5")]
    r = spark.createDataFrame([(i, s, [("user", t)]) for i, s, t in rows], "id string, split string, messages array<struct<role: string, content: string>>")
    assert sorted((x["record_id"], x["split"], x["message"]) for x in v.duplicate_ids(r).collect() if x["split"]) == [("a", "train", "id also in train"), ("a", "val", "id also in train")]
    assert v.duplicate_ids(r).count() == 3
    assert [(x["record_id"], x["code"]) for x in v.duplicate_texts(r).collect()] == [("a", "DUP_EXACT_IN_SPLIT")] * 2
