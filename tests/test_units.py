import numpy as np
import pandas as pd
import pytest

from millrace.functions.unit_text import KILOGRAMS, find_weights, parse_number
from millrace.operators.units import FINE, extraction_units, fit_feed, foreign_units, load_units, prior_cells, stated_weights, weight_cells, weights_in_kilograms


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("9 коробок, брутто 8 550 кило.", [(8550, "kg", False)]), ("7 x 5 124 lb (паллет).", [(5124, "lb", True)]), ("Вес 12,7т, 10 грузомест.", [(12.7, "t", False)]),
        ("16 pallets at 1 048 kilograms per piece.", [(1048, "kg", True)]), ("20 packages, 825 lbs. each.", [(825, "lb", True)]), ("129.1 quintals altogether.", [(129.1, "q", False)]),
        ("всего 241,2 амер. квинталов (100 фунтов).", [(241.2, "cwt", False)]), ("17 packages, 153.2 US hundredweight altogether.", [(153.2, "cwt", False)]),
        ("Weight 16.33 US tons, 2 crates.", [(16.33, "st", False)]), ("общий вес пятнадцать тонн", [(15, "t", False)]), ("gross twenty two tonnes", [(22, "t", False)]),
        ("Прицеп грузоподъёмностью 22 т, номер 8.", []), ("Forklift at X lifts 51,000 lb, driver Y.", []), ("Ставка 7205, 15 дней, 2024 г.", []), ("", []), (None, []),
        ("брутто 12,7\nт.", [(12.7, "t", False)]), ("Trailer payload 23 t, plate XZ. 7062 KG altogether.", [(7062, "kg", False)]),
    ],
)
def test_find_weights(text, want):
    assert [(w.value, w.unit, w.per_piece) for w in find_weights(text)] == want


def test_numbers():
    assert parse_number("1,234", "kg") == 1234 and parse_number("1,234", "t") == 1.234
    assert parse_number("12 345,6", "kg") == 12345.6 and parse_number("1.234,5", "kg") == 1234.5 and parse_number("x", "kg") is None


RECORD = "id string, group_id string, source_id string, messages array<struct<role: string, content: string>>, unit string, kg string, value string"


def record(i, load, text):
    return (i, f"load:{load}", f"d:{load}", [("system", "s"), ("user", text)], "u", "k", "v")


def loads(spark, rows):
    return spark.createDataFrame(rows, "load_id string, weight_lbs bigint, feed string, load_date date, ingested_at timestamp_ntz, unit string, size string, seen string")


def test_loads_by_request_and_profile(spark):
    import datetime as d

    day, at = d.date(2024, 1, 5), d.datetime(2024, 1, 5)
    rows = [(f"L{i}", 20_700 + 100 * i, "lbfeed", day, at, "", "", "") for i in range(60)] + [(f"K{i}", 5_000 + 100 * i, "kgfeed", day, at, "", "", "") for i in range(60)]
    rows += [("L900", 9000, "lbfeed", day, at, "", "", ""), ("L901", 12, "lbfeed", day, at, "", "", ""), ("L902", None, "lbfeed", day, at, "", "", ""), ("L903", 12_000_000, None, None, None, "", "", ""), ("L900", 9000, "lbfeed", day, at, "", "", "")]
    stated = stated_weights(spark.createDataFrame([record("r1", "L900", "Вес 9000 кг."), record("r2", "K1", "Вес 5100 кг."), record("r3", None, "Вес 1 т")], RECORD))
    got = {r["load_id"]: r["unit"] for r in load_units(loads(spark, rows), stated).collect()}
    assert got["L5"] == "lb" and got["K5"] == "kg" and got["L900"] == "kg" and got["L901"] == "t" and got["L903"] == "g" and "L902" not in got
    assert len(got) == 123


def test_mixture_recovers_what_was_mixed():
    """Months in pounds, months in kilograms and a feed that mixes in tonnes and grams; half of the kilograms have been judged by requests."""
    rnd = np.random.default_rng(3)
    kg = np.exp(rnd.normal(np.log(11_000), 0.35, 4000))
    months = np.array([f"2024-{1 + i % 8:02}" for i in range(4000)])
    unit = np.where(months < "2024-05", "lb", "kg").astype(object)
    unit[rnd.random(4000) < 0.05] = "t"
    unit[rnd.random(4000) < 0.02] = "g"
    value = kg / np.array([KILOGRAMS[u] for u in unit])
    seen = np.where(rnd.random(4000) < 0.2, unit, None)
    rows = pd.DataFrame({"month": months, "cell": np.floor(np.log(value) * FINE).astype(int), "seen": seen, "n": 1})
    overall = weight_cells(np.log(kg[seen != None]), np.ones((seen != None).sum())) + 20 * prior_cells()  # noqa: E711
    got = fit_feed(rows, overall / overall.sum())["unit"].to_numpy()
    hidden = seen == None  # noqa: E711
    for u in ("lb", "kg", "t", "g"):
        assert (got[hidden & (unit == u)] == u).mean() > 0.98


def test_numbers_in_text_of_any_length():
    assert [w.value for w in find_weights("общий вес одна тысяча двести тридцать четыре килограмма")] == [1234] and [w.value for w in find_weights("weight twenty-one thousand three hundred and forty-five pounds")] == [21345]
    assert [(w.value, w.pieces) for w in find_weights("12000 коробок, вес 1 234 567 890 123 456 789,5 кг")] == [(1234567890123456789.5, 12000)]


def test_extractions(spark):
    stated = stated_weights(spark.createDataFrame([record("r1", "L1", "10 мест, вес 12 000 кг."), record("r1", "L1", "10 мест, вес 12 000 кг.")], RECORD))
    schema = "extraction_id bigint, record_id string, derived struct<weight_total_kg: double, pieces: bigint>, kg double, unit string"
    rows = [(1, "r1", (12000.0, 10)), (2, "r1", (12.0, 10)), (3, "r1", (26455.47, 10)), (4, "r1", (120.0, 10)), (5, "r1", (1200.0, 10)), (6, None, (9.5, None)), (7, "r1", (None, None)), (8, "zz", (8000.0, 1)), (9, "r1", None), (2, "r1", (12.0, 10))]
    got = {r["extraction_id"]: r["unit"] for r in extraction_units(spark.createDataFrame([(*r, 1.0, "x") for r in rows], schema), stated).collect()}
    assert got == {1: "kg", 2: "t", 3: "lb", 4: "q", 5: "kg", 6: "t", 8: "kg"}


def test_union_and_empty(spark):
    records = spark.createDataFrame([record("r1", "L1", "Вес 2 т. Вес 2000 кг."), (None, None, None, None, "", "", ""), ("r2", None, None, [], "", "", "")], RECORD)
    ex = spark.createDataFrame([], "extraction_id bigint, record_id string, derived struct<weight_total_kg: double, pieces: bigint>")
    w = weights_in_kilograms(loads(spark, []), ex, records)
    assert sorted((r["row_id"], r["unit"], r["weight_kg"]) for r in w.collect()) == [("r1", "kg", 2000.0), ("r1", "t", 2000.0)]
    assert [tuple(r) for r in foreign_units(w).collect()] == [("sft_records", "r1", "t")]
