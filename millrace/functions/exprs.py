"""Scalar library: units, geography, dates, numbers, text, hashing, arrays and padding, all as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion factors, mean radius of the Earth, names of months.
LB_KG = "0.45359237"
EARTH_KM = 6371.0
MONTHS_RU = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
MONTHS_EN = "January February March April May June July August September October November December".split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Units -----------------------------------------------------------------------------------------


def to_kg(value: Column | str, unit: Column | str) -> Column:
    """Kilograms of a value in kg, t or lb; null for another unit."""
    v, u = _c(value).cast("double"), _c(unit)
    return F.when(u == "kg", v).when(u == "t", v * 1000).when(u == "lb", v * F.lit(float(LB_KG)))


def from_kg(kg: Column | str, unit: Column | str) -> Column:
    k, u = _c(kg).cast("double"), _c(unit)
    return F.when(u == "kg", k).when(u == "t", k / 1000).when(u == "lb", k / F.lit(float(LB_KG)))


def to_m(value: Column | str, unit: Column | str) -> Column:
    v, u = _c(value).cast("double"), _c(unit)
    return F.when(u == "m", v).when(u == "cm", v / 100)


def round_kg(kg: Column | str) -> Column:
    """To 0.1 kg, half to even."""
    return F.bround(_c(kg), 1)


def render_weight(lbs: Column | str, unit: Column | str, pieces: Column | str | int = 1) -> Column:
    """Weight in pounds as written in a request: whole kg or lb, tonnes to 0.1, per piece; exact decimals, half up.

    Null where the pounds or pieces are not positive, or the unit is another.
    """
    n = F.lit(pieces) if isinstance(pieces, int) else _c(pieces)
    lb = _c(lbs).cast("decimal(18,0)")
    kg = lb * F.expr(f"{LB_KG}BD")
    each = n.cast("decimal(10,0)")
    u = _c(unit)
    value = (
        F.when(u == "kg", F.round(kg / each, 0).cast("double"))
        .when(u == "t", F.round(kg / F.lit(1000).cast("decimal(10,0)") / each, 1).cast("double"))
        .when(u == "lb", F.round(lb / each, 0).cast("double"))
    )
    return F.when((lb > 0) & (n > 0), value)


def spell_number(x: Column | str) -> Column:
    """13.0 -> '13', 12.6 -> '12.6': a number without a fraction has none in its spelling."""
    v = _c(x).cast("double")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


# Geography -------------------------------------------------------------------------------------


def great_circle_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Spherical law of cosines; the cosine is clamped so equal points give 0."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    d = F.radians(_c(lon2)) - F.radians(_c(lon1))
    cos = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)
    return F.lit(EARTH_KM) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


# Dates -----------------------------------------------------------------------------------------


def transit_days(pickup: Column | str, delivery: Column | str) -> Column:
    return F.datediff(F.to_date(_c(delivery)), F.to_date(_c(pickup)))


def month_key(day: Column | str) -> Column:
    return F.date_format(_c(day), "yyyy-MM")


def relative_day(day: Column | str, today: Column | str, language: str = "en") -> Column:
    """'today', 'tomorrow', 'the day after tomorrow' (or in Russian) within two days, else the ISO date."""
    names = ("сегодня", "завтра", "послезавтра") if language == "ru" else ("today", "tomorrow", "the day after tomorrow")
    gap = F.datediff(_c(day), _c(today))
    return F.when(gap == 0, names[0]).when(gap == 1, names[1]).when(gap == 2, names[2]).otherwise(F.date_format(_c(day), "yyyy-MM-dd"))


def written_date(day: Column | str, language: str = "en") -> Column:
    """'5 мая 2024' or 'May 5, 2024'."""
    d, names = _c(day), F.array(*[F.lit(m) for m in (MONTHS_RU if language == "ru" else MONTHS_EN)])
    name, n, y = F.element_at(names, F.month(d)), F.dayofmonth(d).cast("string"), F.year(d).cast("string")
    return F.concat_ws(" ", n, name, y) if language == "ru" else F.concat(name, F.lit(" "), n, F.lit(", "), y)


# Numbers and words -----------------------------------------------------------------------------


def group_number(x: Column | str, decimals: int = 0, language: str = "en", space: str = " ") -> Column:
    """'12,345.6' in English, '12 345,6' in Russian (``space`` may be a no-break space)."""
    s = F.format_number(_c(x), decimals)
    return F.replace(F.replace(F.replace(s, F.lit(","), F.lit("\u0001")), F.lit("."), F.lit(",")), F.lit("\u0001"), F.lit(space)) if language == "ru" else s


def plural_ru(n: Column | str, one: str, few: str, many: str) -> Column:
    """Form of a Russian noun after a number: 1, 2-4, others, and 11-14 as others."""
    v = F.abs(_c(n))
    last, two = F.pmod(v, F.lit(10)), F.pmod(v, F.lit(100))
    return F.when(two.between(11, 14), many).when(last == 1, one).when(last.between(2, 4), few).otherwise(many)


def join_words(items: Column | str, language: str = "en") -> Column:
    """'a, b and c'; one item as it is; null and empty arrays give ''."""
    a = F.coalesce(_c(items), F.array().cast("array<string>"))
    word = " и " if language == "ru" else " and "
    head = F.array_join(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), ", ")
    return F.when(F.size(a) == 0, "").when(F.size(a) == 1, F.try_element_at(a, F.lit(1))).otherwise(F.concat(head, F.lit(word), F.try_element_at(a, F.lit(-1))))


def temperature_text(low: Column | str, high: Column | str) -> Column:
    """Signed degrees: '+2..+8', 'from +2', 'up to -18', '+5' where both are equal; null without either."""
    a, b = _c(low), _c(high)
    sign = lambda x: F.concat(F.when(x > 0, "+").otherwise(""), spell_number(x))
    return (
        F.when(a.isNull() & b.isNull(), None).when(b.isNull(), F.concat(F.lit("from "), sign(a))).when(a.isNull(), F.concat(F.lit("up to "), sign(b)))
        .when(a == b, sign(a)).otherwise(F.concat(sign(a), F.lit(".."), sign(b)))
    )


def dimensions_text(length: Column | str, width: Column | str, height: Column | str, unit: str = "m") -> Column:
    """'6.1 x 2.4 x 2.9 m' of metres, or whole centimetres; missing sides are left out."""
    side = lambda x: F.when(_c(x).isNotNull(), spell_number(F.round(_c(x) * 100) if unit == "cm" else F.round(_c(x), 2)))
    return F.concat_ws(" ", F.concat_ws(" x ", side(length), side(width), side(height)), F.lit(unit))


# Text ------------------------------------------------------------------------------------------


def request_header(text: Column | str) -> Column:
    """What stands before the first empty line, '' where there is none."""
    return F.regexp_extract(_c(text), r"(?s)\A(.*?)\n\n", 1)


def request_body(text: Column | str) -> Column:
    """What stands after the first empty line; the whole text where there is none."""
    return F.regexp_replace(_c(text), r"(?s)\A.*?\n\n", "")


def squeeze(text: Column | str) -> Column:
    """Lower case, every run of Unicode white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"(?U)\s+", " "))


def normal_request(text: Column | str) -> Column:
    """Body of a request (a date header is left out) in squeezed form: equal where two requests say the same."""
    t = _c(text)
    dated = request_header(t).rlike(r"(?iuU)^(?:request date|дата запроса)\b[^\n]*$")
    return squeeze(F.when(dated, request_body(t)).otherwise(t))


def language_of(text: Column | str) -> Column:
    """'ru' where there is any Cyrillic letter of Russian, else 'en'; null for null."""
    return F.when(_c(text).isNull(), None).when(_c(text).rlike("[а-яёА-ЯЁ]"), "ru").otherwise("en")


def excerpt(text: Column | str, n: int = 140) -> Column:
    """First ``n`` characters of the body with white space collapsed: a summary for listings, not for analysis."""
    return F.substring(F.trim(F.regexp_replace(request_body(text), r"(?U)\s+", " ")), 1, n)


# Hashing ---------------------------------------------------------------------------------------


def hash_uniform(seed: int, *keys: Column | str) -> Column:
    """Number in [0, 1) drawn from sha256('seed:key[:key...]'): the first 8 bytes over 2^64. Same rows, same draw, any plan."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(k) for k in keys])
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def text_hash(text: Column | str) -> Column:
    return F.sha2(_c(text), 256)


def canonical_json(value: Column | str) -> Column:
    """Compact JSON of a struct, nulls kept, in declared order; whole doubles without a fraction."""
    return F.regexp_replace(F.to_json(_c(value), {"ignoreNullFields": "false"}), r"(?<=[:\[,])(-?\d+)\.0(?=[,}\]])", "$1")


# Arrays ----------------------------------------------------------------------------------------


def in_order(values: Column | str, order: Sequence[str]) -> Column:
    """Distinct known values in the order of an enumeration."""
    return F.filter(F.array(*[F.lit(x) for x in order]), lambda x: F.array_contains(_c(values), x))


def same_set(a: Column | str, b: Column | str) -> Column:
    return F.array_sort(F.array_distinct(_c(a))) == F.array_sort(F.array_distinct(_c(b)))


def joined_or(values: Column | str, default: str = "clean") -> Column:
    return F.coalesce(F.nullif(F.array_join(_c(values), ","), F.lit("")), F.lit(default))


def first_divergence(a: Column | str, b: Column | str) -> Column:
    """0-based position at which two arrays first differ, -1 where neither does; a missing element differs."""
    return F.array_position(F.zip_with(_c(a), _c(b), lambda x, y: ~x.eqNullSafe(y)), True).cast("int") - 1


def padded_width(longest: Column | str, multiple: int = 8) -> Column:
    return (F.ceil(_c(longest) / multiple) * multiple).cast("int")


def pad_right(ids: Column | str, width: Column | str | int, pad: int) -> Column:
    w = F.lit(width) if isinstance(width, int) else _c(width)
    return F.concat(_c(ids), F.array_repeat(F.lit(pad).cast("int"), F.greatest(w - F.size(_c(ids)), F.lit(0)).cast("int")))


def attention_mask(ids: Column | str, width: Column | str | int) -> Column:
    return pad_right(F.transform(_c(ids), lambda _: F.lit(1)), width, 0)


def prompt_masked(prompt_len: Column | str, answer: Column | str, ignore: int = -100) -> Column:
    """Labels of a training example: the prompt ignored, the answer kept."""
    return F.concat(F.array_repeat(F.lit(ignore), _c(prompt_len).cast("int")), _c(answer))
