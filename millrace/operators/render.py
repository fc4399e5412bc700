"""Requests rendered from facts: templates as data, hash-drawn choices, and a gold card beside each text.

Fragments, families and hard cases are rows of tables, so a rendering is a
projection: every choice is drawn by the hash of the record and the name of
the draw, and the same fact gives the same text on any cluster. A request that
drops a required field lists it as missing in its gold card.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.exprs import group_number, hash_uniform, render_weight, spell_number, written_date
from millrace.functions.json_answers import canonical_answer, missing_fields, target
from millrace.operators.extract import Gazetteer, extract_cards

#: Families: language, order of the fragments, what parts them.
FAMILIES = {
    "R1": ("ru", ("greeting", "places", "dates", "cargo"), " "), "R2": ("ru", ("places", "cargo", "dates"), "\n"),
    "E1": ("en", ("greeting", "places", "dates", "cargo"), " "), "E2": ("en", ("cargo", "places", "dates"), "\n"),
}
GREETINGS = {"ru": ("Здравствуйте.", "Добрый день.", "Коллеги, новая заявка."), "en": ("Hello.", "Good morning.", "Team, a new request.")}
HARD_CASES = ("clean", "dropped_fields", "per_piece_weight", "conflict_weight", "distractor_numbers")


def pick(seed: int, key: Column, draw: str, values: tuple[str, ...]) -> Column:
    """One of ``values`` drawn by hash."""
    i = F.floor(hash_uniform(seed, key, F.lit(draw)) * len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), i)


def _weight(unit: Column, value: Column, language: str) -> Column:
    names = {"kg": "кг", "t": "т", "lb": "фунтов"} if language == "ru" else {"kg": "kg", "t": "t", "lb": "lb"}
    spelled = F.when(unit == "t", spell_number(value)).otherwise(group_number(value, 0, language))
    return F.concat(spelled, F.lit(" "), reduce(lambda o, u: F.when(unit == u, names[u]).otherwise(o), names, F.lit("?")))


def _fragments(language: str, case: Column, key: Column, seed: int) -> dict[str, Column]:
    ru = language == "ru"
    unit, each = F.col("unit"), F.col("each")
    mass = _weight(unit, F.when(case == "per_piece_weight", each).otherwise(F.col("stated")), language)
    other = _weight(unit, F.round(F.col("stated") * 1.1 + F.when(unit == "t", 0.1).otherwise(1.0), 1), language)
    n = F.col("pieces").cast("string")
    whole = F.concat(n, F.lit(" мест, вес " if ru else " pieces, weight "), mass)
    cargo = (
        F.when(case == "per_piece_weight", F.concat(n, F.lit(" мест, каждое " if ru else " pieces, "), mass, F.lit("" if ru else " each")))
        .when(case == "conflict_weight", F.concat(whole, F.lit(", по накладной " if ru else ", by the waybill "), other))
        .when(case == "dropped_fields", F.concat(n, F.lit(" мест" if ru else " pieces")))
        .when(case == "distractor_numbers", F.concat(whole, F.lit(", договор " if ru else ", contract "), F.floor(hash_uniform(seed, key, F.lit("contract")) * 90000 + 10000).cast("string")))
        .otherwise(whole)
    )
    return {
        "greeting": pick(seed, key, f"greeting:{language}", GREETINGS[language]),
        "places": F.concat(F.lit("Погрузка: " if ru else "From "), F.col("origin.city"), F.lit(", выгрузка: " if ru else " to "), F.col("destination.city"), F.lit(".")),
        "dates": F.concat(F.lit("Забрать " if ru else "Pick up "), written_date("pickup_date", language), F.lit(", доставить " if ru else ", deliver "), written_date("delivery_date", language), F.lit(".")),
        "cargo": F.concat(cargo, F.lit(".")),
    }


def render_requests(facts: DataFrame, seed: int = 42, hard_share: float = 0.4) -> DataFrame:
    """(id, load_id, language, template_family, hard_case, request_date, text, gold): one request per fact.

    gold: pieces, unit and stated weight (null where the text drops it or states
    two), places and dates, missing_fields, conflicts. Facts with null fields
    that a fragment needs give a null text and are left to the caller to refuse.
    """
    key = F.col("load_id")
    f = facts.select("*", pick(seed, key, "family", tuple(FAMILIES)).alias("template_family"), pick(seed, key, "unit", ("kg", "t", "lb")).alias("unit"))
    hard = hash_uniform(seed, key, F.lit("hard")) < hard_share
    f = f.withColumn("hard_case", F.when(hard, pick(seed, key, "case", HARD_CASES[1:])).otherwise(HARD_CASES[0]))
    f = f.withColumn("stated", render_weight("weight_lbs", "unit")).withColumn("each", render_weight("weight_lbs", "unit", "pieces"))
    f = f.withColumn("request_date", F.date_sub("pickup_date", F.floor(hash_uniform(seed, key, F.lit("ahead")) * 8).cast("int")))
    text, language = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (lang, order, gap) in FAMILIES.items():
        parts = _fragments(lang, F.col("hard_case"), key, seed)
        header = F.concat(F.lit("Дата запроса: " if lang == "ru" else "Request date: "), F.date_format("request_date", "yyyy-MM-dd"), F.lit("\n\n"))
        body = reduce(lambda a, b, gap=gap: F.concat(a, F.lit(gap), b), [parts[p] for p in order])
        text = F.when(F.col("template_family") == name, F.concat(header, body)).otherwise(text)
        language = F.when(F.col("template_family") == name, lang).otherwise(language)
    lost = F.col("hard_case").isin("dropped_fields", "conflict_weight")
    gold = F.struct(
        F.col("pieces").alias("pieces"), F.when(~lost, F.col("unit")).alias("unit"),
        F.when(~lost, F.when(F.col("hard_case") == "per_piece_weight", F.col("each")).otherwise(F.col("stated"))).alias("weight"),
        (F.col("hard_case") == "per_piece_weight").alias("per_piece"), F.col("origin.city").alias("origin"), F.col("destination.city").alias("destination"),
        F.col("pickup_date").alias("pickup_date"), F.col("delivery_date").alias("delivery_date"),
        F.when(lost, F.array(F.lit("weight"))).otherwise(F.array().cast("array<string>")).alias("missing_fields"),
        F.when(F.col("hard_case") == "conflict_weight", F.array(F.lit("weight"))).otherwise(F.array().cast("array<string>")).alias("conflicts"),
    )
    return f.select(F.concat(F.lit("req-"), key).alias("id"), "load_id", language.alias("language"), "template_family", "hard_case", "request_date", text.alias("text"), gold.alias("gold"))


# Conditions, grammar and checks ----------------------------------------------------------------

# How the requests name equipment (with the gender of the Russian noun) and the values of conditions.
EQUIPMENT_WORDS = {
    "ru": {"tent": ("тент", "m"), "van": ("цельнометаллический фургон", "m"), "reefer": ("рефрижератор", "m"), "isotherm": ("изотермический фургон", "m"), "container": ("контейнерная площадка", "f"), "lowbed": ("низкорамная платформа", "f"), "mega": ("мега-фура", "f"), "flatbed": ("открытая бортовая машина", "f")},
    "en": {"tent": ("curtainsider", ""), "van": ("box van", ""), "reefer": ("reefer", ""), "isotherm": ("insulated van", ""), "container": ("container chassis", ""), "lowbed": ("lowbed", ""), "mega": ("mega trailer", ""), "flatbed": ("flatbed", "")},
}
NEEDED = {"ru": {"m": "Нужен", "f": "Нужна", "n": "Нужно"}, "en": {"": "We need a", "an": "We need an"}}
VALUE_WORDS = {
    "ru": {"straps": "ремни", "chains": "цепи", "wheel_chocks": "башмаки", "anti_slip_mats": "коврики", "load_bars": "штанги", "crate": "обрешётка", "stretch_film": "стрейч-плёнка", "moisture_protection": "влагозащита", "shock_protection": "амортизация",
           "temperature": "термописец", "humidity": "влажность", "pressure": "датчик давления", "tilt": "наклон", "shock": "датчик удара", "door_opening": "открытие двери"},
    "en": {"straps": "straps", "chains": "chains", "wheel_chocks": "chocks", "anti_slip_mats": "anti-slip mats", "load_bars": "load bars", "crate": "crating", "stretch_film": "stretch film", "moisture_protection": "moisture protection", "shock_protection": "shock protection",
           "temperature": "temperature logger", "humidity": "humidity", "pressure": "pressure sensor", "tilt": "tilt", "shock": "shock sensor", "door_opening": "door opening"},
}
#: Three styles of each kind: a sentence, a list item, a note.
CONDITION_STYLES = {
    "ru": {"temperature": ("Держать температуру {}.", "температура: {}", "температурный режим {}"), "securing": ("Крепление: {}.", "крепить: {}", "закрепить ({})"), "packaging": ("Упаковка: {}.", "упаковать: {}", "упаковка ({})"), "oversize": ("Груз негабаритный: {}.", "габариты: {}", "негабарит ({})"), "sensors": ("Нужны датчики: {}.", "датчики: {}", "сенсоры ({})")},
    "en": {"temperature": ("Keep the temperature {}.", "temperature: {}", "temperature ({})"), "securing": ("Secure with {}.", "securing: {}", "lashing ({})"), "packaging": ("Packaging: {}.", "packed in: {}", "packaging ({})"), "oversize": ("Oversize cargo: {}.", "dimensions: {}", "oversize ({})"), "sensors": ("Sensors: {}.", "sensor: {}", "sensors ({})")},
}
SIDE_WORDS = {"ru": {"length": "длина", "width": "ширина", "height": "высота"}, "en": {"length": "length", "width": "width", "height": "height"}}
UNSTATED = {"ru": "уточним позже", "en": "details to follow"}


def equipment_phrase(equipment: Column, language: str) -> Column:
    """'Нужна низкорамная платформа', 'We need an insulated van': the verb or article agrees with the noun; null for an unknown type."""
    out = F.lit(None).cast("string")
    for name, (words, gender) in EQUIPMENT_WORDS[language].items():
        form = gender if language == "ru" else ("an" if words[0] in "aeiou" else "")
        out = F.when(equipment == name, f"{NEEDED[language][form]} {words}").otherwise(out)
    return out


def _degrees(low: Column, high: Column, language: str) -> Column:
    sign = lambda x: F.concat(F.when(x >= 0, "+").otherwise("-"), spell_number(F.abs(x)))
    unit = F.lit(" °C")
    above, below = ("не ниже ", "не выше ") if language == "ru" else ("not below ", "not above ")
    return (
        F.when(low.isNull() & high.isNull(), None).when(high.isNull(), F.concat(F.lit(above), sign(low), unit)).when(low.isNull(), F.concat(F.lit(below), sign(high), unit))
        .when(low == high, F.concat(sign(low), unit)).otherwise(F.concat(sign(low), F.lit("…"), sign(high), unit))
    )


def condition_text(condition: Column, language: str, style: int = 0) -> Column:
    """One condition in words, in one of three styles; without values it is named and its details put off. Null for null."""
    names, sides = VALUE_WORDS[language], SIDE_WORDS[language]
    word = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    listed = F.array_join(F.transform(F.coalesce(condition["methods"], condition["types"], condition["parameters"], F.array().cast("array<string>")), lambda v: F.coalesce(word[v], v)), ", ")
    metre = {"m": " м" if language == "ru" else " m", "cm": " см" if language == "ru" else " cm"}
    length = lambda n: F.when(condition[n].isNotNull(), F.concat(F.lit(sides[n] + " "), spell_number(condition[n]["value"]), F.when(condition[n]["unit"] == "cm", metre["cm"]).otherwise(metre["m"])))
    dims = F.concat_ws(", ", *map(length, sides))
    value = F.when(condition["kind"] == "temperature", _degrees(condition["min_c"], condition["max_c"], language)).when(condition["kind"] == "oversize", F.nullif(dims, F.lit(""))).otherwise(F.nullif(listed, F.lit("")))
    said = F.coalesce(value, F.lit(UNSTATED[language]))
    out = F.lit(None).cast("string")
    for kind, styles in CONDITION_STYLES[language].items():
        head, tail = styles[style].split("{}")
        out = F.when(condition["kind"] == kind, F.concat(F.lit(head), said, F.lit(tail))).otherwise(out)
    return out


def render_conditioned(facts: DataFrame, seed: int = 42) -> DataFrame:
    """(id, load_id, language, style, text, gold): requests of facts of the second version, with equipment and conditions in words.

    gold is the fact's canonical answer; language and style are drawn by hash.
    """
    key = F.col("load_id")
    f = facts.select("*", pick(seed, key, "language", ("ru", "en")).alias("language"), F.floor(hash_uniform(seed, key, F.lit("style")) * 3).cast("int").alias("style"))
    said = F.lit(None).cast("string")
    for language in ("ru", "en"):
        for style in range(3):
            parts = F.array_join(_each(F.col("special_conditions"), language, style), " " if style == 0 else "; ")
            said = F.when((F.col("language") == language) & (F.col("style") == style), parts).otherwise(said)
    ru = F.col("language") == "ru"
    weight = F.concat(F.col("weight_lbs").cast("bigint").cast("string"), F.when(ru, " фунтов").otherwise(" lb"))
    places = F.when(ru, F.concat(F.lit("Погрузка: "), F.col("origin.city"), F.lit(". Выгрузка: "), F.col("destination.city"), F.lit("."))).otherwise(F.concat(F.lit("From "), F.col("origin.city"), F.lit(" to "), F.col("destination.city"), F.lit(".")))
    cargo = F.concat(F.col("pieces").cast("string"), F.when(ru, " мест, общий вес ").otherwise(" pieces, total weight "), weight, F.lit("."))
    dates = F.concat(F.when(ru, "Забрать ").otherwise("Pick up "), F.date_format("pickup_date", "yyyy-MM-dd"), F.when(ru, ", доставить ").otherwise(", deliver "), F.date_format("delivery_date", "yyyy-MM-dd"), F.lit("."))
    lead = F.concat(F.when(ru, equipment_phrase(F.col("equipment_type"), "ru")).otherwise(equipment_phrase(F.col("equipment_type"), "en")), F.lit("."))
    card = F.struct(
        F.lit(None).cast("string").alias("shipper_name"), F.lit(None).cast("string").alias("cargo_category"), "equipment_type", "pieces", F.struct(F.col("weight_lbs").cast("double").alias("value"), F.lit("lb").alias("unit")).alias("weight_total"),
        F.lit(None).cast("struct<value: double, unit: string>").alias("weight_per_piece"), "origin", "destination", F.date_format("pickup_date", "yyyy-MM-dd").alias("pickup_date"), F.date_format("delivery_date", "yyyy-MM-dd").alias("delivery_date"), "special_conditions",
    )
    out = f.withColumn("_card", card)
    text = F.concat_ws(" ", lead, places, cargo, dates, F.nullif(said, F.lit("")))
    return out.select(F.concat(F.lit("rv-"), key).alias("id"), "load_id", "language", "style", text.alias("text"), canonical_answer(F.col("_card"), missing_fields(F.col("_card"), "card_v2"), "card_v2").alias("gold"))


def _each(conditions: Column, language: str, style: int) -> Column:
    return F.transform(conditions, lambda c: condition_text(c, language, style))


def lost_fields(rendered: DataFrame) -> DataFrame:
    """(record_id, split, code, message): LOST_FIELD issues of requests whose text lacks a number, place or date that their gold answer states."""
    t, g = F.col("text"), target(F.col("gold"))["card"]
    stated = {
        "pieces": g["pieces"].cast("string"), "weight_total": spell_number(g["weight_total"]["value"]), "origin": g["origin"]["city"], "destination": g["destination"]["city"], "pickup_date": g["pickup_date"], "delivery_date": g["delivery_date"],
    }
    lost = F.array_compact(F.array(*[F.when(v.isNotNull() & ~F.contains(t, v), F.lit(n)) for n, v in stated.items()]))
    return rendered.select(F.col("id").alias("record_id"), F.lit(None).cast("string").alias("split"), F.lit("LOST_FIELD").alias("code"), F.explode(lost).alias("message"))


def self_check(rendered: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """(record_id, field, gold, read): what the extractor reads otherwise than the gold answer says: a rendering that can't be read back is no example."""
    cards = extract_cards(rendered, "id", "text", gazetteer).select("id", F.col("card.*"))
    g = rendered.select("id", target(F.col("gold"))["card"].alias("g")).join(cards, "id")
    kinds = lambda c: F.array_join(F.transform(c, lambda x: x["kind"]), ",")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    pairs = [
        ("pieces", F.col("g.pieces").cast("string"), F.col("pieces").cast("string")), ("equipment_type", F.col("g.equipment_type"), F.col("equipment_type")), ("weight", spell_number(F.col("g.weight_total.value")), spell_number(F.col("weight_value"))),
        ("origin", F.col("g.origin.city"), F.col("origin")), ("destination", F.col("g.destination.city"), F.col("destination")), ("pickup_date", F.col("g.pickup_date"), day("pickup_date")), ("delivery_date", F.col("g.delivery_date"), day("delivery_date")),
        ("conditions", kinds(F.col("g.special_conditions")), F.array_join(F.transform("conditions", lambda c: F.get_json_object(c, "$.kind")), ",")),
    ]
    each = g.select(F.col("id").alias("record_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), a.alias("gold"), b.alias("read")) for n, a, b in pairs])).alias("x")).select("record_id", "x.*")
    return each.filter(~F.col("gold").eqNullSafe(F.col("read")))
