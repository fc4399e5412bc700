import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import json_answers as ja
from millrace.operators import extract as ex
from millrace.operators.render import HARD_CASES, render_requests
from millrace.plans import validation
from millrace.sources import artifacts, records, tables
from millrace.streaming.logs import last_epoch, log_stream, sessions, upsert_last, windowed_counts


def test_schemas(spark):
    assert schemas.columns(schemas.RECORD)[:3] == ["id", "task", "group_id"] and len(schemas.columns(schemas.RECORD)) == 12
    with pytest.raises(ValueError, match="can't be read"):
        schemas.schema_of("facts", "facts_v9")
    assert "special_conditions" in schemas.schema_of("facts", "facts_v2").names


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_issues(spark, tmp_path):
    head = "load_id,customer_id,route_id,load_date,load_type,weight_lbs,pieces,revenue,fuel_surcharge,accessorial_charges,load_status,booking_type\n"
    p = write(tmp_path / "loads.csv", head + "L1,C1,R1,2024-01-05,Dry Van,100,2,1.5,0,0,ok,Spot\nL2,C1,R1,05.01.2024,Dry Van,x,2,1.5,0,0,ok,Spot\nL3,C1,R1,,Dry Van,,,,,,,\n")
    rows, issues = tables.read_table(spark, p, "loads")
    assert [(r["load_id"], r["load_date"], r["weight_lbs"]) for r in rows.collect()] == [("L1", date(2024, 1, 5), 100), ("L2", None, None), ("L3", None, None)]
    assert {(r["record_id"], r["code"]) for r in issues.collect()} == {("L2", "DATE_FORMAT"), ("L2", "DTYPE")}
    bad = write(tmp_path / "bad.csv", head.replace("pieces", "parts"))
    with pytest.raises(ValueError, match="missing column pieces; unexpected column parts"):
        tables.read_table(spark, bad, "loads")


@pytest.mark.parametrize("sep", [",", ";"])
def test_review(spark, tmp_path, sep):
    p = write(tmp_path / "r.csv", "﻿" + f"id{sep}verdict\na{sep} OK \nb{sep}maybe\nc{sep}drop\n")
    good, bad = tables.read_review(spark, p)
    assert {tuple(r) for r in good.collect()} == {("a", "ok"), ("c", "drop")} and [r["record_id"] for r in bad.collect()] == ["b"]


def test_reports(spark, tmp_path):
    tables.write_text(str(tmp_path / "d" / "x.md"), tables.markdown(spark.createDataFrame([(1, "a|b")], "n int, s string")))
    assert (tmp_path / "d" / "x.md").read_text() == "| n | s |\n| - | - |\n| 1 | a\\|b |"


def test_records(spark, tmp_path):
    good = {"id": "a", "task": "t", "group_id": None, "source_id": "s", "language": "ru", "template_family": "T1", "schema_version": "card_v1", "split": "train", "reviewed": False, "synthetic": True,
            "variant": {"request_date": "2024-01-05", "dropped_fields": []}, "messages": [{"role": r, "content": "ё"} for r in ("system", "user", "assistant")]}
    lines = [json.dumps(good), "{broken", json.dumps(good | {"extra": 1, "id": "b"}), json.dumps(good | {"messages": [], "id": "c"}), "", "[1]"]
    rows, issues = records.read_records(spark, write(tmp_path / "r.jsonl", "\n".join(lines)), "train")
    assert [(r["id"], r["messages"][1]["content"], r["variant"]["request_date"]) for r in rows.collect()] == [("a", "ё", date(2024, 1, 5))]
    assert {(r["record_id"], r["code"]) for r in issues.collect()} == {(None, "SCHEMA"), ("b", "SCHEMA"), ("c", "ROLE_ORDER")}
    records.write_records(rows, str(tmp_path / "out"))
    again, none = records.read_records(spark, str(tmp_path / "out"))
    assert again.collect() == rows.collect() and none.count() == 0


def test_logs_and_gauges(spark, tmp_path):
    p = str(tmp_path / "log")
    records.append_log(spark.createDataFrame([("a", 1)], "id string, n int"), p)
    records.append_log(spark.createDataFrame([("b", 2)], "id string, n int"), p)
    write(tmp_path / "log" / "cut.json", '{"id": "c", "n')
    log = records.read_log(spark, p, "id string, n int").cache()
    assert sorted(r["id"] for r in log.filter("_bad is null").collect()) == ["a", "b"] and log.filter("_bad is not null").count() == 1
    g = records.parse_gauges(spark.createDataFrame([("1, 2.5",), ("x,3",), ("1,2,3",), (None,)], "l string"), "l", ["a", "b"])
    assert {tuple(r) for r in g.collect()} == {(1.0, 2.5), (None, 3.0)}


def test_artifacts(spark, tmp_path):
    (tmp_path / "f").mkdir()
    a = write(tmp_path / "f" / "a.txt", "one")
    h = artifacts.folder_hash(spark, str(tmp_path / "f"))
    want = artifacts.file_hashes(spark, str(tmp_path / "f")).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "sha256").collect()
    expected = spark.createDataFrame([tuple(r) for r in want] + [(a + ".gone", "0")], "path string, sha256 string")
    assert [r["problem"] for r in artifacts.verify(spark, str(tmp_path / "f"), expected).collect()] == ["missing"]
    write(tmp_path / "f" / "a.txt", "two")
    assert artifacts.folder_hash(spark, str(tmp_path / "f")) != h
    assert {r["problem"] for r in artifacts.verify(spark, str(tmp_path / "f"), expected).collect()} == {"missing", "changed"}


def test_lineage(spark):
    edges = spark.createDataFrame([("m", "d"), ("d", "raw"), ("m", "raw"), ("raw", "m"), ("z", "q"), (None, "x"), ("m", None)], "node string, parent string")
    got = {r["node"]: r["depth"] for r in artifacts.lineage(edges, spark.createDataFrame([("m",)], "node string")).collect()}
    assert got == {"m": 0, "d": 1, "raw": 1}
    lost = artifacts.missing_parents(edges.filter("parent is not null and node is not null"), spark.createDataFrame([("m",), ("d",), ("raw",), ("z",)], "node string"))
    assert [tuple(r) for r in lost.collect()] == [("z", "q")]
    runs = spark.createDataFrame([("e", "completed", 1, "r1", "p1"), ("e", "completed", 1, "r2", "p2"), ("e", "failed", 2, "r3", "p3")], "experiment string, status string, seed int, run_id string, path string")
    assert [tuple(r) for r in artifacts.latest_per_seed(runs, "e").collect()] == [(1, "r2")]


def test_stream_upsert(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "id string, n int"
    spark.createDataFrame([("a", 1), ("b", 1)], schema).write.json(src)
    upsert_last(log_stream(spark, src, schema), out, "id", "n", ck).awaitTermination()
    spark.createDataFrame([("a", 2), ("c", 1)], schema).write.mode("append").json(src)
    upsert_last(log_stream(spark, src, schema), out, "id", "n", ck).awaitTermination()
    assert {(r["id"], r["n"]) for r in last_epoch(spark, out).collect()} == {("a", 2), ("b", 1), ("c", 1)}


def test_stream_upsert_of_many_batches(spark, tmp_path):
    """Batches touch some buckets each; the table is the last row of every key, and only two epochs of a bucket remain."""
    import os

    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    want = {}
    for n in range(5):
        rows = [(f"k{i}", 10 * n + i) for i in range(n, n + 6)]
        want.update(rows)
        spark.createDataFrame(rows, "id string, n int").coalesce(1).write.mode("append").json(src)
        upsert_last(log_stream(spark, src, "id string, n int"), out, "id", "n", ck, buckets=4).awaitTermination()
    assert {(r["id"], r["n"]) for r in last_epoch(spark, out).collect()} == set(want.items())
    held = [b for e in os.listdir(out) if e.startswith("epoch=") for b in os.listdir(f"{out}/{e}") if b.startswith("bucket=")]
    assert max(held.count(b) for b in set(held)) <= 2


def test_stream_windows_as_batch(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, m), "x" if m else "y", float(h)) for h in range(6) for m in (0, 30)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(log_stream(spark, str(tmp_path / "in"), "ts timestamp, k string, v double", "parquet"), "ts", ["k"], "v")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windowed_counts(df, "ts", ["k"], "v").collect()))
    assert sessions(df, "ts", "k", "45 minutes").count() == 12


PLACES = ex.Gazetteer({"Craywick": "Craywick", "Dunmarsh": "Dunmarsh", "Velden Falls": "Velden Falls"})


def test_extraction():
    read = ex.Extractor(PLACES).read
    c = read("Request date: 2023-03-09\n\nDrop at Dunmarsh, pick up from Velden Falls tomorrow. 6 pieces, total weight 12061 kgs. Unload October 21 before 21:00. Keep plus 5 to plus 8 degrees. Secure with 9 straps. For Vicmil Retail.")
    assert (c["origin"], c["destination"], c["pickup_date"], c["delivery_date"]) == ("Velden Falls", "Dunmarsh", date(2023, 3, 10), date(2023, 10, 21))
    assert (c["weight"].value, c["weight"].unit, c["pieces"], c["shipper_name"]) == (12061.0, "kg", 6, "Vicmil Retail")
    assert c["special_conditions"] == [{"kind": "temperature", "min_c": 5.0, "max_c": 8.0}, {"kind": "securing", "methods": ["straps"]}]
    c = read("Unloading: Dunmarsh. Loading: Craywick.")
    assert (c["origin"], c["destination"]) == ("Craywick", "Dunmarsh")
    assert read(None)["origin"] is None and read("")["special_conditions"] == []


@pytest.mark.parametrize(
    ("text", "today", "want"),
    [
        ("31.02.2024 then 05.03.2024", None, [date(2024, 3, 5)]), ("забор 5 мая, доставка 07/13/2024", date(2023, 1, 1), [date(2023, 5, 5), date(2024, 7, 13)]),
        ("may 3rd, 2024 or 2024-05-04", None, [date(2024, 5, 3), date(2024, 5, 4)]), ("послезавтра", date(2024, 2, 28), [date(2024, 3, 1)]), ("120.5.2024.1, 1-2-3, 99 мая, the day after tomorrow", None, []),
    ],
)
def test_dates(text, today, want):
    assert [d for _, d in ex.dates_in(text, ex.Marks().find(text + " "), today)] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("температура не выше +5 °c", {"temperature": {"min_c": None, "max_c": 5.0}}), ("keep not below +2 °c", {"temperature": {"min_c": 2.0, "max_c": None}}), ("режим -18 °c", {"temperature": {"min_c": -18.0, "max_c": -18.0}}),
        ("от минус 20 до минус 18 градусов", {"temperature": {"min_c": -20.0, "max_c": -18.0}}), ("нужен температурный режим", {"temperature": {"min_c": None, "max_c": None}}),
        ("length 820 cm, width 290 cm", {"oversize": {"length": {"value": 820, "unit": "cm"}, "width": {"value": 290, "unit": "cm"}, "height": None}}), ("габариты 6.1x2.4x2.9 м", {"oversize": {"length": {"value": 6.1, "unit": "m"}, "width": {"value": 2.4, "unit": "m"}, "height": {"value": 2.9, "unit": "m"}}}),
        ("chains and anti-slip mats, crating, logger", {"securing": {"methods": ["chains", "anti_slip_mats"]}, "packaging": {"types": ["crate"]}, "sensors": {"parameters": ["temperature"]}}), ("nothing special", {}),
    ],
)
def test_conditions_in_text(text, want):
    assert ex.conditions_in(text, ex.Marks().find(text + " ")) == [{"kind": k, **v} for k, v in want.items()]


def test_answers_never_break():
    e = ex.Extractor(PLACES)
    for text in (None, "", "Дата запроса: 2026-02-30\n\n30 февраля", "+5…-5 °C", "Режим +9…+2 °C", "Dunmarsh " * 2000):
        assert ja.read(e.answer(text, {}), ja.VERSIONS["card_v2"])[0] is None
    got = e.read("from Craywick to Dunmarsh") | {"pieces": 3, "special_conditions": [{"kind": "temperature", "min_c": 9, "max_c": 2}]}
    kept = json.loads(ex.answer_of(got, {}))["card"]
    assert kept["pieces"] == 3 and kept["special_conditions"] == [] and json.loads(ex.answer_of(got | {"pieces": -1}, {}))["card"]["pieces"] is None
    assert json.loads(ex.empty_answer("card_v1"))["missing_fields"] == list(ja.REQUIRED)


def test_russian_places():
    e = ex.Extractor(ex.Gazetteer.of(["Казань", "Velden Falls", "Newtown", None]))
    places = lambda t: tuple(e.read(t)[k] for k in ("origin", "destination"))
    assert places("Откуда: Велижанск, ул. Гархол, 404. Куда: СТУДЕНОВСК, ворота 80.") == ("Велижанск", "Студёновск")
    assert places("Везём из Серебрянца в Казань.") == ("Серебрянец", "Казань") and places("Доставить до Приозёрова из Новокедрянска-Затона") == ("Новокедрянск-Затон", "Приозёрово")
    assert places("Pick up in Velden Falls, drop at Newtown.") == ("Беловержск", "Newtown") and places("Сверхказань, Казань-2") == (None, None)
    assert places("Погрузка: Казань, ул. 1. Выгрузка: Казань, ул. 2.") == ("Казань", "Казань")


def test_many_places():
    e = ex.Extractor(ex.Gazetteer.of([f"Town {i}" for i in range(150_000)]))
    got = e.read("from Town 149999 to Town 14999, not Town 150000")
    assert (got["origin"], got["destination"]) == ("Town 149999", "Town 14999")


def test_cards_of_both_languages_have_places(spark, sf):
    cards = validation.q_extract_cards(spark, sf).join(spark.read.parquet(f"{sf}/sft_records.parquet").select("id", "language").distinct(), "id")
    got = {r["language"]: r["share"] for r in cards.groupBy("language").agg(F.avg(F.col("origin").isNotNull().cast("int")).alias("share")).collect()}
    assert set(got) == {"ru", "en"} and min(got.values()) > 0.9


def test_extract_operator(spark):
    df = spark.createDataFrame([("1", "Нужен рефрижератор"), ("2", None), ("3", "dry van to Dunmarsh")], "i string, t string")
    got = {r["id"]: (r["card"]["equipment_type"], r["card"]["destination"]) for r in ex.extract_cards(df, "i", "t", ex.Gazetteer({"Dunmarsh": "D"})).collect()}
    assert got == {"1": ("reefer", None), "2": (None, None), "3": ("van", "D")}
    assert ex.extract_cards(df.limit(0), "i", "t", ex.Gazetteer({})).count() == 0
    assert [r[0] for r in df.select(ex.named_class(F.col("t"), ex.CLASSES["equipment_type"])).collect()] == ["reefer", None, "van"]


def test_render_is_deterministic_and_self_consistent(spark):
    facts = spark.range(200).select(
        F.format_string("L%04d", "id").alias("load_id"), (F.col("id") % 28 + 1).alias("pieces"), (10000 + F.col("id") * 7919 % 35001).alias("weight_lbs"),
        F.struct(F.lit("Craywick").alias("city")).alias("origin"), F.struct(F.lit("Dunmarsh").alias("city")).alias("destination"),
        F.date_add(F.lit("2022-01-01").cast("date"), (F.col("id") * 13 % 1000).cast("int")).alias("pickup_date"), F.date_add(F.lit("2022-01-03").cast("date"), (F.col("id") * 13 % 1000).cast("int")).alias("delivery_date"),
    )
    a = {r["load_id"]: r for r in render_requests(facts).collect()}
    b = {r["load_id"]: r for r in render_requests(facts.repartition(7)).collect()}
    assert a == b and {r["hard_case"] for r in a.values()} == set(HARD_CASES)
    read = ex.Extractor(PLACES).read
    for r in a.values():
        card, gold = read(r["text"]), r["gold"]
        w = card["weight"]
        assert card["pieces"] == gold["pieces"] and (card["origin"], card["destination"]) == ("Craywick", "Dunmarsh") and card["pickup_date"] == gold["pickup_date"], r["text"]
        if r["hard_case"] in ("clean", "per_piece_weight", "distractor_numbers"):
            assert (w.value, w.unit, w.per_piece) == (gold["weight"], gold["unit"], gold["per_piece"]), r["text"]
        assert ("weight" in gold["missing_fields"]) == (gold["weight"] is None)
