"""Answers as JSON: shapes of the answer cards, strict and lenient reading, canonical spelling, rules on their fields.

A shape says what a JSON value may be, how it is spelled and which Spark type
holds it; the versions of the answer are shapes, so reading, spelling, type and
JSON schema of each come from one declaration. The strict reading refuses what
a lax parser lets through (outer white space, code fences, repeated keys, NaN,
unknown keys, numbers as strings), which no SQL reader can, so it runs over
Arrow batches; everything after it is typed columns.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from datetime import date
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes ----------------------------------------------------------------------------------------


class Misfit(ValueError):
    """The value is not of the shape; the message is the path and what was expected."""


class Members(list):
    """An object as its (key, value) pairs, repeated keys included."""


class NotANumber:
    """NaN or an infinity, which JSON does not have."""


class Shape:
    """What a value may be. ``fit`` gives the value or raises Misfit, ``spell`` its canonical text."""

    ddl = "string"

    def fit(self, v: Any, at: str) -> Any:
        raise NotImplementedError

    def spell(self, v: Any) -> str:
        return json.dumps(v, ensure_ascii=False, separators=(",", ":"))

    def schema(self) -> dict[str, Any]:
        return {}


def need(ok: bool, at: str, what: str) -> None:
    if not ok:
        raise Misfit(f"{at}: {what}")


def spell_number(v: float) -> str:
    return str(int(v)) if isinstance(v, float) and v.is_integer() else json.dumps(v)


class Text(Shape):
    def fit(self, v, at):
        need(isinstance(v, str) and v.strip() != "", at, "a text")
        return v

    def schema(self):
        return {"type": "string", "minLength": 1}


@dataclass(frozen=True)
class Choice(Shape):
    names: tuple[str, ...]

    def fit(self, v, at):
        need(isinstance(v, str) and v in self.names, at, "one of " + ", ".join(self.names))
        return v

    def schema(self):
        return {"enum": list(self.names)}


class Whole(Shape):
    ddl = "bigint"

    def fit(self, v, at):
        need(type(v) is int and v >= 1, at, "a whole number from 1")
        return v

    def schema(self):
        return {"type": "integer", "minimum": 1}


@dataclass(frozen=True)
class Number(Shape):
    positive: bool = False
    ddl = "double"

    def fit(self, v, at):
        need(type(v) in (int, float) and math.isfinite(v) and (v > 0 or not self.positive), at, "a positive number" if self.positive else "a number")
        return v

    def spell(self, v):
        return spell_number(v)

    def schema(self):
        return {"type": "number"} | ({"exclusiveMinimum": 0} if self.positive else {})


class Day(Shape):
    def fit(self, v, at):
        need(isinstance(v, str) and len(v) == 10 and v.isascii() and v[4] == v[7] == "-", at, "a day as yyyy-mm-dd")
        try:
            date(*map(int, v.split("-")))
        except (ValueError, TypeError):
            raise Misfit(f"{at}: no such day") from None
        return v

    def schema(self):
        return {"type": "string", "format": "date"}


@dataclass(frozen=True)
class Maybe(Shape):
    of: Shape

    @property
    def ddl(self):
        return self.of.ddl

    def fit(self, v, at):
        return None if v is None else self.of.fit(v, at)

    def spell(self, v):
        return "null" if v is None else self.of.spell(v)

    def schema(self):
        return {"anyOf": [self.of.schema(), {"type": "null"}]}


@dataclass(frozen=True)
class Object(Shape):
    """All fields of ``fields`` and no other; ``rule`` (message, check) is asked of the whole."""

    fields: tuple[tuple[str, Shape], ...]
    rule: tuple[str, Any] | None = None

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.fields)

    @property
    def ddl(self):
        return f"struct<{', '.join(f'{n}: {s.ddl}' for n, s in self.fields)}>"

    def fit(self, v, at):
        need(isinstance(v, Members), at, "an object")
        have = dict(v)
        need(have.keys() == set(self.names), at, "the keys " + ", ".join(self.names))
        out = {n: s.fit(have[n], f"{at}.{n}") for n, s in self.fields}
        if self.rule:
            need(self.rule[1](out), at, self.rule[0])
        return out

    def spell(self, v):
        return "{" + ",".join(f'"{n}":{s.spell(v[n])}' for n, s in self.fields) + "}"

    def schema(self):
        return {"type": "object", "properties": {n: s.schema() for n, s in self.fields}, "required": list(self.names), "additionalProperties": False}


@dataclass(frozen=True)
class Many(Shape):
    """A list; ``key`` of its items must differ."""

    of: Shape
    key: Any = None
    least: int = 0

    @property
    def ddl(self):
        return f"array<{self.of.ddl}>"

    def fit(self, v, at):
        need(type(v) is list and len(v) >= self.least, at, f"a list of {self.least} or more")
        out = [self.of.fit(x, f"{at}[{i}]") for i, x in enumerate(v)]
        need(self.key is None or len({self.key(x) for x in out}) == len(out), at, "different items")
        return out

    def spell(self, v):
        return "[" + ",".join(map(self.of.spell, v)) + "]"

    def schema(self):
        return {"type": "array", "items": self.of.schema()} | ({"minItems": self.least} if self.least else {})


@dataclass(frozen=True)
class Free(Shape):
    """Any JSON value; held as its text."""

    sort: bool = False

    def fit(self, v, at):
        return {k: self.fit(x, at) for k, x in v} if isinstance(v, Members) else [self.fit(x, at) for x in v] if type(v) is list else v

    def spell(self, v):
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{self.spell(x)}" for k, x in (sorted(v.items()) if self.sort else v.items())) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(self.spell, v)) + "]"
        return spell_number(v) if type(v) is float else json.dumps(v, ensure_ascii=False)


@dataclass(frozen=True)
class Tagged(Shape):
    """An object whose first field, ``tag``, names which of ``cases`` it is."""

    tag: str
    cases: tuple[tuple[str, Object], ...]

    @property
    def ddl(self):
        every: dict[str, str] = {self.tag: "string"}
        for _, case in self.cases:
            every |= {n: s.ddl for n, s in case.fields}
        return f"struct<{', '.join(f'{n}: {t}' for n, t in every.items())}>"

    def _case(self, name: Any, at: str) -> Object:
        found = dict(self.cases).get(name) if isinstance(name, str) else None
        need(found is not None, at, f"a known {self.tag}")
        return found

    def fit(self, v, at):
        need(isinstance(v, Members), at, "an object")
        name = dict(v).get(self.tag)
        rest = Members((k, x) for k, x in v if k != self.tag)
        return {self.tag: name} | self._case(name, at).fit(rest, at)

    def spell(self, v):
        body = self._case(v[self.tag], self.tag).spell(v)
        return "{" + f'"{self.tag}":"{v[self.tag]}"' + ("," if len(body) > 2 else "") + body[1:]

    def schema(self):
        out = []
        for name, case in self.cases:
            s = case.schema()
            out.append(s | {"properties": {self.tag: {"const": name}, **s["properties"]}, "required": [self.tag, *s["required"]]})
        return {"oneOf": out}


# Versions --------------------------------------------------------------------------------------

# Names of fields and values of the answer cards, in declared order.
CATEGORIES = ("general", "retail", "consumer_goods", "food_beverage", "automotive", "electronics")
EQUIPMENT = ("dry_van", "reefer")
EQUIPMENT_V2 = ("tent", "van", "reefer", "isotherm", "container", "lowbed", "mega", "flatbed")
UNITS = ("kg", "t", "lb")
KINDS = ("temperature", "securing", "packaging", "oversize", "sensors")
LISTS = {
    "methods": ("straps", "chains", "wheel_chocks", "anti_slip_mats", "load_bars"),
    "types": ("crate", "stretch_film", "moisture_protection", "shock_protection"),
    "parameters": ("temperature", "humidity", "pressure", "tilt", "shock", "door_opening"),
}
SIDES = ("length", "width", "height")
REQUIRED = ("origin", "destination", "pickup_date", "equipment_type", "pieces", "weight_total")

_QUANTITY = Object((("value", Number(True)), ("unit", Choice(UNITS))))
_LENGTH = Object((("value", Number(True)), ("unit", Choice(("m", "cm")))))
_PLACE = Object((("city", Text()), ("region", Text())))
_same = Free(sort=True).spell


def _list_of(name: str) -> Object:
    return Object(((name, Many(Choice(LISTS[name]), key=str)),))


_CONDITION = Tagged("kind", (
    ("temperature", Object((("min_c", Maybe(Number())), ("max_c", Maybe(Number()))), ("min_c up to max_c", lambda o: o["min_c"] is None or o["max_c"] is None or o["min_c"] <= o["max_c"]))),
    ("securing", _list_of("methods")), ("packaging", _list_of("types")),
    ("oversize", Object(tuple((s, Maybe(_LENGTH)) for s in SIDES))), ("sensors", _list_of("parameters")),
))


@dataclass(frozen=True)
class Version:
    """One version of the answer: its card, the names its lists may hold, and which conditions a type of equipment needs."""

    name: str
    card: Object
    missing: tuple[str, ...]
    conflicts: tuple[str, ...]

    @property
    def fields(self) -> tuple[str, ...]:
        return self.card.names

    @property
    def target(self) -> Object:
        conflict = Object((("field", Choice(self.conflicts)), ("values", Many(Free(), key=_same, least=2))))
        return Object((("card", self.card), ("missing_fields", Many(Choice(self.missing))), ("conflicts", Many(conflict))))


def _card(equipment, categories, place, weights, last) -> Object:
    head = [("shipper_name", Text()), ("cargo_category", Choice(categories)), ("equipment_type", Choice(equipment)), ("pieces", Whole())]
    fields = [*head, *[(w, _QUANTITY) for w in weights], ("origin", place), ("destination", place), ("pickup_date", Day())]
    return Object((*[(n, Maybe(s)) for n, s in fields], *last))


_WEIGHTS = ("weight_total", "weight_per_piece")
_V1 = _card(EQUIPMENT, CATEGORIES, _PLACE, _WEIGHTS, (("delivery_date", Maybe(Day())), ("temperature_c", Maybe(Number()))))
_V2 = _card(EQUIPMENT_V2, (*CATEGORIES, "machinery"), _PLACE, _WEIGHTS, (("delivery_date", Maybe(Day())), ("special_conditions", Many(_CONDITION, key=lambda c: c["kind"]))))
#: The card of the test tables: no delivery, weight per piece or temperature, and cities without a region.
_SHORT = _card(EQUIPMENT, CATEGORIES, Object((("city", Text()),)), _WEIGHTS[:1], ())

VERSIONS = {
    "card_v1": Version("card_v1", _V1, _V1.names, _V1.names),
    "card_v2": Version("card_v2", _V2, (*REQUIRED, *[f"special_conditions.{k}" for k in KINDS]), _V2.names[:-1]),
    "card_short": Version("card_short", _SHORT, _SHORT.names, _SHORT.names),
}
#: Every field of any version, and the type that holds a card of each: fields a version lacks are null.
FIELDS = (*_V1.names, "special_conditions")
_PLACE_DDL = _PLACE.ddl
CARD = "struct<" + ", ".join(f"{n}: {s.ddl}" for n, s in (*_V1.fields, _V2.fields[-1])) + ">"
TARGET = f"card {CARD}, missing_fields array<string>, conflicts array<struct<field: string, values: array<string>>>"


def version_of(name: str) -> Version:
    if name not in VERSIONS:
        raise ValueError(f"unknown answer version {name!r}; known: {', '.join(VERSIONS)}")
    return VERSIONS[name]


def json_schema(name: str) -> dict[str, Any]:
    """JSON schema of a version's answer, for constrained decoding."""
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": name, **version_of(name).target.schema()}


# Reading ---------------------------------------------------------------------------------------

FLAGS = "json_parsed boolean, schema_valid boolean, json_parsed_lenient boolean, stage string, body string"


def malformed(v: Any) -> bool:
    """Whether a decoded value holds a repeated key or something that is no JSON number, at any depth."""
    todo = [v]
    while todo:
        x = todo.pop()
        if isinstance(x, NotANumber):
            return True
        if isinstance(x, Members):
            if len({k for k, _ in x}) < len(x):
                return True
            todo += [y for _, y in x]
        elif isinstance(x, list):
            todo += x
    return False


def read(text: str, version: Version) -> tuple[str | None, Any]:
    """(stage at which ``text`` is refused or None, the answer): 'format' where it is not one bare JSON document, 'schema' where it has another shape."""
    if text[:1].isspace() or text[-1:].isspace() or text.startswith("```"):
        return "format", None
    try:
        v = json.loads(text, object_pairs_hook=Members, parse_constant=lambda _: NotANumber())
    except (ValueError, RecursionError):
        return "format", None
    if malformed(v):
        return "format", None
    try:
        return None, version.target.fit(v, "answer")
    except Misfit:
        return "schema", None


_FENCED = re.compile(r"```[A-Za-z]*\s*(.*?)\s*```", re.DOTALL)


def unwrap(text: str) -> str:
    """Without outer white space and one code fence."""
    bare = text.strip()
    found = _FENCED.fullmatch(bare)
    return found.group(1) if found else bare


def flags_of(text: str | None, version: Version) -> tuple[bool, bool, bool, str | None, str | None]:
    """(JSON at all, valid, valid once unwrapped, stage of refusal, canonical spelling of the unwrapped answer)."""
    if text is None:
        return False, False, False, "format", None
    stage, answer = read(text, version)
    if stage is not None:
        inner = unwrap(text)
        answer = read(inner, version)[1] if inner != text else None
    body = version.target.spell(answer) if answer is not None else None
    return stage != "format", stage is None, answer is not None, stage, body


def answer_flags(text: Column, version: str = "card_short") -> Column:
    """struct(json_parsed, schema_valid, json_parsed_lenient, stage, body): body is the canonical spelling of the lenient reading."""
    shape = version_of(version)

    @F.pandas_udf(FLAGS)
    def judge(texts: pd.Series) -> pd.DataFrame:
        known: dict[str | None, tuple] = {}
        out = [known[t] if t in known else known.setdefault(t, flags_of(t, shape)) for t in texts]
        return pd.DataFrame(out, columns=["json_parsed", "schema_valid", "json_parsed_lenient", "stage", "body"])

    return judge(text)


def target(body: Column) -> Column:
    """The typed answer of a canonical spelling, of any version."""
    return F.from_json(body, TARGET)


def canonical_answer(card: Column, missing: Column, version: str = "card_v1") -> Column:
    """Canonical text of an answer without conflicts from typed columns; null numbers and lists as the version spells them."""
    shape = version_of(version)
    raw = F.to_json(F.struct(card.alias("card"), missing.alias("missing_fields")), {"ignoreNullFields": "false"})

    @F.pandas_udf("string")
    def write(texts: pd.Series) -> pd.Series:
        return pd.Series([spell_card(json.loads(t), shape) if t is not None else None for t in texts], dtype=object)

    return write(raw)


def spell_card(answer: dict[str, Any], version: Version) -> str | None:
    """Canonical text of a plain answer; a card that the version refuses loses its conditions, then everything."""
    card = {f: (answer.get("card") or {}).get(f) for f in version.fields}
    empty: dict[str, Any] = dict.fromkeys(version.fields)
    if "special_conditions" in empty:
        empty["special_conditions"] = []
        given = [{k: v for k, v in c.items() if k in ("kind", *dict(_CONDITION.cases)[c["kind"]].names)} if c.get("kind") in KINDS else c for c in card["special_conditions"] or []]
        given.sort(key=lambda c: KINDS.index(c["kind"]) if c.get("kind") in KINDS else len(KINDS))
        card["special_conditions"] = [{k: sorted(v, key=LISTS[k].index) if k in LISTS and isinstance(v, list) and set(v) <= set(LISTS[k]) else v for k, v in c.items()} for c in given]
    missing = answer.get("missing_fields") or []
    for attempt in (card, card | {k: v for k, v in empty.items() if k == "special_conditions"}, empty):
        text = json.dumps({"card": attempt, "missing_fields": missing if attempt is card else missing_of(attempt, version), "conflicts": answer.get("conflicts") or []})
        fitted = read(text, version)[1]
        if fitted is not None:
            return version.target.spell(fitted)
    return None


def missing_of(card: dict[str, Any], version: Version) -> list[str]:
    """The required fields a plain card lacks: the rule of ``missing_fields`` for one card."""
    lost = [f for f in REQUIRED if card.get(f) is None and not (f == "weight_total" and card.get("weight_per_piece") is not None)]
    kind, have = card.get("equipment_type"), {c["kind"]: c for c in card.get("special_conditions") or []}
    if "temperature_c" in version.fields and kind == "reefer" and card["temperature_c"] is None:
        lost.append("temperature_c")
    if "special_conditions" in version.fields:
        for k in KINDS:
            must = (kind, k) in (("reefer", "temperature"), ("lowbed", "oversize"))
            values = [v for n, v in have.get(k, {}).items() if n != "kind"]
            bare = any(v is None for v in values) if must and k == "oversize" else not any(v is not None and v != [] for v in values)
            if (k in have and bare) or (must and k not in have):
                lost.append(f"special_conditions.{k}")
    return lost


# Rules as columns ------------------------------------------------------------------------------


def of_kind(conditions: Column, kind: str) -> Column:
    """The condition of a kind, null without one; a kind occurs once at most."""
    return F.try_element_at(F.filter(conditions, lambda c: c["kind"] == F.lit(kind)), F.lit(1))


def lacks_values(c: Column, kind: str, required: Column | None = None) -> Column:
    """Whether a condition has nothing to act on: no bound, no item, no side (a required oversize needs all three)."""
    if kind == "temperature":
        return c["min_c"].isNull() & c["max_c"].isNull()
    if kind == "oversize":
        sides = [c[s].isNull() for s in SIDES]
        none, some = reduce(Column.__and__, sides), reduce(Column.__or__, sides)
        return none if required is None else F.when(required, some).otherwise(none)
    name = {"securing": "methods", "packaging": "types", "sensors": "parameters"}[kind]
    return F.coalesce(F.size(c[name]) <= 0, F.lit(True))


def missing_fields(card: Column, version: str = "card_short") -> Column:
    """Required fields that are null, then needed or named conditions without values, in fixed order."""
    v = version_of(version)
    out = []
    for f in REQUIRED:
        gone = card[f].isNull()
        if f == "weight_total" and "weight_per_piece" in v.fields:
            gone = gone & card["weight_per_piece"].isNull()
        out.append(F.when(gone, F.lit(f)))
    cold = F.coalesce(card["equipment_type"] == "reefer", F.lit(False))
    if "temperature_c" in v.fields:
        out.append(F.when(cold & card["temperature_c"].isNull(), F.lit("temperature_c")))
    if "special_conditions" in v.fields:
        needs = {"temperature": cold, "oversize": F.coalesce(card["equipment_type"] == "lowbed", F.lit(False))}
        for k in KINDS:
            c, must = of_kind(card["special_conditions"], k), needs.get(k, F.lit(False))
            out.append(F.when((c.isNull() & must) | (c.isNotNull() & lacks_values(c, k, must)), F.lit(f"special_conditions.{k}")))
    return F.array_compact(F.array(*out))


def consistency(t: Column, version: str = "card_short") -> Column:
    """Array of what is wrong: missing_fields against the rule, a conflict twice or not null, both weights, conditions or their lists out of order."""
    v = version_of(version)
    fields = F.transform(t["conflicts"], lambda c: c["field"])
    filled = F.array_compact(F.array(*[F.when(t["card"][f].isNotNull(), F.lit(f)) for f in v.conflicts]))
    checks = [
        F.when(t["missing_fields"] != missing_fields(t["card"], version), F.lit("missing_fields")),
        F.when(F.size(F.array_distinct(fields)) != F.size(fields), F.lit("conflict_twice")),
        F.when(F.size(F.array_intersect(fields, filled)) > 0, F.lit("conflict_not_null")),
    ]
    if "weight_per_piece" in v.fields:
        checks.append(F.when(t["card"]["weight_total"].isNotNull() & t["card"]["weight_per_piece"].isNotNull(), F.lit("both_weights")))
    if "special_conditions" in v.fields:
        given = t["card"]["special_conditions"]
        place = lambda x, order: F.array_position(F.array(*[F.lit(o) for o in order]), x)
        rising = lambda a: F.forall(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: F.coalesce(F.get(a, i - 1) <= F.get(a, i), F.lit(True)))
        checks.append(F.when(~rising(F.transform(given, lambda c: place(c["kind"], KINDS))), F.lit("condition_order")))
        def jumbled(n: str) -> Column:
            return F.exists(given, lambda c: F.coalesce(~rising(F.transform(c[n], lambda x: place(x, LISTS[n]))), F.lit(False)))

        checks.append(F.when(reduce(Column.__or__, map(jumbled, LISTS)), F.lit("list_order")))
    return F.array_compact(F.array(*checks))
