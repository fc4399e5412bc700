from datetime import date
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from millrace.functions import exprs as E


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_group_hash_golden(spark):
    assert one(spark, E.hash_uniform(42, F.lit("load:1"))) == 0.7597620428641914


def test_render_weight_exact(spark):
    rows = [(w, p) for w in range(10000, 45001, 397) for p in (1, 3, 7)]
    got = spark.createDataFrame(rows, "w bigint, p bigint").select("w", "p", *[E.render_weight("w", F.lit(u), "p").alias(u) for u in ("kg", "t", "lb")]).collect()
    for r in got:
        kg = Decimal(r["w"]) * Decimal("0.45359237") / r["p"]
        assert r["kg"] == float(kg.quantize(Decimal(1), ROUND_HALF_UP)) and r["t"] == float((kg / 1000).quantize(Decimal("0.1"), ROUND_HALF_UP))
        assert r["lb"] == float((Decimal(r["w"]) / r["p"]).quantize(Decimal(1), ROUND_HALF_UP))
    assert one(spark, E.render_weight(F.lit(0), F.lit("kg"))) is None and one(spark, E.render_weight(F.lit(5), F.lit("stone"))) is None


def cases():
    return [
        (E.to_kg(F.lit(12.6), F.lit("t")), 12600.0), (E.to_kg(F.lit(1), F.lit("x")), None), (E.to_m(F.lit(250), F.lit("cm")), 2.5), (E.spell_number(F.lit(13.0)), "13"), (E.spell_number(F.lit(12.6)), "12.6"),
        (E.round_kg(F.lit(1.25)), 1.2), (E.great_circle_km(F.lit(10.0), F.lit(20.0), F.lit(10.0), F.lit(20.0)), 0.0), (E.relative_day(F.lit(date(2024, 1, 3)), F.lit(date(2024, 1, 2))), "tomorrow"),
        (E.written_date(F.lit(date(2024, 5, 5)), "ru"), "5 мая 2024"), (E.written_date(F.lit(date(2024, 5, 5))), "May 5, 2024"), (E.group_number(F.lit(12345.6), 1, "ru"), "12 345,6"), (E.group_number(F.lit(12345)), "12,345"),
        (E.join_words(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), "a, b and c"), (E.join_words(F.array(F.lit("a")), "ru"), "a"), (E.join_words(F.lit(None).cast("array<string>")), ""),
        (E.temperature_text(F.lit(2.0), F.lit(8.0)), "+2..+8"), (E.temperature_text(F.lit(None).cast("double"), F.lit(-18.0)), "up to -18"), (E.temperature_text(F.lit(5.0), F.lit(5.0)), "+5"),
        (E.dimensions_text(F.lit(6.1), F.lit(2.4), F.lit(None).cast("double")), "6.1 x 2.4 m"), (E.dimensions_text(F.lit(6.1), F.lit(2.4), F.lit(2.0), "cm"), "610 x 240 x 200 cm"),
        (E.squeeze(F.lit(" A  b\n C ")), "a b c"), (E.normal_request(F.lit("Дата запроса: 2024-01-01\n\nА  Б")), "а б"), (E.normal_request(F.lit("Hello\n\nA")), "hello a"), (E.language_of(F.lit("abc ж")), "ru"),
        (E.joined_or(F.array().cast("array<string>")), "clean"), (E.canonical_json(F.struct(F.lit(13.0).alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.5).alias("c"))), '{"a":13,"b":null,"c":0.5}'),
        (E.first_divergence(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3))), 1), (E.first_divergence(F.array(F.lit(1)), F.array(F.lit(1))), -1), (E.padded_width(F.lit(13)), 16),
        (E.pad_right(F.array(F.lit(1), F.lit(2)), 4, 0), [1, 2, 0, 0]), (E.attention_mask(F.array(F.lit(7)), 3), [1, 0, 0]), (E.prompt_masked(F.lit(2), F.array(F.lit(5))), [-100, -100, 5]),
        (E.in_order(F.array(F.lit("c"), F.lit("a"), F.lit("z")), ["a", "b", "c"]), ["a", "c"]), (E.same_set(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1), F.lit(1))), True),
    ]


def test_values(spark):
    every = cases()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(every)]).first()
    for i, (_, want) in enumerate(every):
        got = row[f"c{i}"]
        assert got == want or (isinstance(want, float) and abs(got - want) < 1e-3), (i, got, want)


def test_plural(spark):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (1, 2, 5, 11, 14, 21, 22, 111)], "n int").select(E.plural_ru("n", "место", "места", "мест")).collect()]
    assert got == ["место", "места", "мест", "мест", "мест", "место", "места", "мест"]
