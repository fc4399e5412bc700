"""Structured cards from request texts: a lexicon automaton, scored roles, a grammar of dates, conditions with their values.

1. One automaton over all stems of the lexicon runs once through a text; what it
   finds are marks: cues of a role, names of a class, months, list values.
2. Places and dates are candidates. Every role of a candidate is scored by the
   cues around it in its clause, near ones more, those before it more than
   those after; the best pair of roles over all candidates holds.
3. Dates are read by a grammar over tokens, so no two readings can overlap.
4. A class (equipment, cargo) is the one with the largest weight of marks.

It runs over Arrow batches; classes that need no places are plain columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.json_answers import KINDS, LISTS, SIDES, missing_of, spell_card, version_of
from millrace.functions.unit_text import find_weights

CARD = (
    "shipper_name string, cargo_category string, equipment_type string, pieces bigint, weight_value double, weight_unit string, weight_per_piece boolean, weight_kg double, "
    "origin string, destination string, pickup_date date, delivery_date date, min_c double, max_c double, conditions array<string>, missing_fields array<string>, answer string"
)

# The vocabulary of the requests, by what a word speaks of. A stem counts where a word begins with it.
CLASSES: dict[str, dict[str, str]] = {
    "equipment_type": {
        "tent": "тент шторн curtain tautliner", "van": "цельномет фургон dry_van box_van box_trailer", "reefer": "реф reefer refrigerat", "isotherm": "изотерм insulated isotherm",
        "container": "контейнер container", "lowbed": "трал низкорам lowbed lowboy low_loader", "mega": "мега mega", "flatbed": "бортов площадк платформ flatbed",
    },
    "cargo_category": {
        "food_beverage": "сок молок ягод овощн корм напитк продукт juice dairy berries vegetable pet_food beverage food_stuff", "electronics": "светодиод панел электрон led_panel electronic",
        "automotive": "шин двигател автозапчаст запчаст tyre engine auto_part", "consumer_goods": "подгузник велосипед стиральн мебел diaper bicycle washing furniture",
        "general": "плитк рулон провод гранул кронштейн инструмент tile paper_roll copper_wire pellet bracket garden_tool", "machinery": "экскаватор спецтехник бульдозер станок excavator machinery bulldozer",
    },
}
ROLES: dict[str, str] = {
    "origin": "from origin loading load_at pick_up pickup collect из откуда от погруз загруз забрать забор берём берем",
    "destination": "to destination unloading unload deliver drop receiver в куда до выгруз разгруз отвезти сдать доставить доставк",
    "pickup": "забрать забор погруз загруз готовност поставить ждём ждем ready pickup pick_up collect loading load_at truck_at",
    "delivery": "выгруз разгруз достав прибыт сдать примет принима deliver unload arriv drop accept receive",
    "per_piece": "кажд each apiece", "shipper": "отправител грузоотправител shipper sender",
}
#: Values of the lists of conditions; ``not_above`` and ``not_below`` open a range on one side.
VALUES: dict[str, dict[str, str]] = {
    "methods": {"straps": "ремн ремен strap", "chains": "цеп chain", "wheel_chocks": "башмак упор chock", "anti_slip_mats": "коврик противоскольз anti-slip", "load_bars": "штанг load_bar"},
    "types": {"crate": "обреш ящик_дерев crating", "stretch_film": "стрейч плёнк пленк stretch shrink_wrap", "moisture_protection": "влагозащит moisture", "shock_protection": "амортиз shock_protect"},
    "parameters": {"temperature": "логгер термопис termograph temperature_logger logger temperature_recorder", "humidity": "влажност humidity", "pressure": "датчик_давлен pressure_sensor", "tilt": "наклон tilt", "shock": "датчик_удар shock_sensor", "door_opening": "открыти_двер door_open"},
    "bound": {"below": "не_выше не_более up_to not_above no_warmer below", "above": "не_ниже не_менее not_below no_colder above"},
    "side": {"length": "длин length", "width": "шир width", "height": "высот height"},
}
ASKS = {"temperature": "температур режим градус держать temperature degrees keep", "securing": "крепл крепит закреп secur lashing", "packaging": "упаков packaging packed", "oversize": "негабарит габарит oversize dimension wide_load", "sensors": "датчик сенсор sensor monitoring"}
MONTH_STEMS = "январ феврал март апрел ма июн июл август сентябр октябр ноябр декабр jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = {"сегодня": 0, "завтра": 1, "послезавтра": 2, "today": 0, "tomorrow": 1, "the_day_after_tomorrow": 2}
PIECE_NOUNS = "паллет палет поддон мест короб ящик грузомест единиц шт упаков бочк pallet piece pcs box carton unit crate package drum".split()
#: Cities of the requests: how English texts write them and their name in the cards.
CITY_NAMES = {
    "Ashgrove Bay": "Серебрянец", "Bexfield": "Верхнеямск", "Brandle Ridge": "Рябинополье", "Craywick": "Ключегорск", "Dunmarsh": "Каменодол", "Ferrisburg": "Дубоярск",
    "Ginmoor": "Сосногорье", "Harlow Creek": "Заречинск", "Humberlea": "Новокедрянск-Затон", "Kettleham": "Восточноборск", "Lintmoor": "Нижнеполянск", "Marrowby": "Тихоградск",
    "Norwhal": "Кремневск", "Oakmere": "Студёновск", "Orsington": "Ольхогорск", "Pellington": "Малосольск", "Quillport": "Приозёрово", "Saltreach": "Янтаревск",
    "Stonehythe": "Снеготорск", "Tannerton": "Лугодар", "Tolliver Junction": "Долгомостье", "Velden Falls": "Беловержск", "Wexcombe": "Пестроярск", "Yarrowgate": "Велижанск",
}
#: Endings of Russian names in genitive, dative, accusative, instrumental and prepositional; the longest that fits holds.
CASES = {
    "ец": "ца цу ец цем це", "ье": "ья ью ье ьем ье", "ый": "ого ому ый ым ом", "ий": "ого ому ий им ом", "ая": "ой ой ую ой ой", "ое": "ого ому ое ым ом", "ые": "ых ым ые ыми ых",
    "ь": "и и ь ью и", "а": "ы е у ой е", "ка": "ки ке ку кой ке", "га": "ги ге гу гой ге", "я": "и е ю ей е", "о": "а у о ом е", "е": "я ю е ем е", "й": "я ю й ем е", "ы": "ов ам ы ами ах", "и": "ов ам и ами ах",
    "": "а у  ом е",
}

# Columns ---------------------------------------------------------------------------------------


def stems(text: str) -> list[str]:
    return [w.replace("_", " ") for w in text.split()]


def stem_pattern(words: str) -> str:
    """A pattern that finds any of the stems at the beginning of a word of a text in lower case."""
    return r"(^|[^a-zа-яё])(" + "|".join(w.replace("-", "\\-") for w in stems(words)) + ")"


def named_class(text: Column, classes: dict[str, str]) -> Column:
    """The class whose stems a text names most often, the earlier one of equal ones; null without any."""
    low = F.lower(text)
    counts = F.array(*[F.regexp_count(low, F.lit(stem_pattern(words))) for words in classes.values()])
    names = F.array(*[F.lit(n) for n in classes])
    # The counts are bound to a variable, so that each text is searched once per class.
    return F.transform(F.array(counts), lambda n: F.when(F.array_max(n) > 0, F.get(names, (F.array_position(n, F.array_max(n)) - 1).cast("int"))))[0]


# Marks -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mark:
    """A stem of the lexicon in a text: what it speaks of (group, name) and where."""

    group: str
    name: str
    start: int
    end: int


def lexicon() -> dict[str, list[tuple[str, str]]]:
    """Stem -> what it speaks of. Short cues (from, to, в) hold as whole words only and end in a space."""
    out: dict[str, list[tuple[str, str]]] = {}

    def add(group: str, name: str, words: str) -> None:
        for w in stems(words):
            out.setdefault(w + " " if len(w) <= 4 and group in ("origin", "destination") and w in ("from", "to", "из", "от", "в", "до") else w, []).append((group, name))

    for group, classes in (*CLASSES.items(), *VALUES.items()):
        for name, words in classes.items():
            add(group, name, words)
    for role, words in ROLES.items():
        add(role, role, words)
    for kind, words in ASKS.items():
        add("asks", kind, words)
    for day, n in DAYS.items():
        add("day", str(n), day)
    return out


class Marks:
    """The automaton over the lexicon. Of stems from one place the longest holds, and a mark inside another of its group is none."""

    def __init__(self) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for stem, meanings in lexicon().items():
            self.machine.add_word(stem, (len(stem), meanings))
        self.machine.make_automaton()

    def find(self, low: str) -> dict[str, list[Mark]]:
        longest: dict[tuple[int, str], Mark] = {}
        for end, (length, meanings) in self.machine.iter(low):
            start = end - length + 1
            if start and (low[start - 1].isalnum() or low[start - 1] == "-"):
                continue
            for group, name in meanings:
                known = longest.get((start, group))
                if known is None or known.end < end + 1:
                    longest[start, group] = Mark(group, name, start, end + 1)
        out: dict[str, list[Mark]] = {}
        for mark in sorted(longest.values(), key=lambda m: (m.start, -m.end)):
            found = out.setdefault(mark.group, [])
            if not found or found[-1].end <= mark.start:
                found.append(mark)
        return out


def clause_bounds(low: str) -> list[int]:
    """Where clauses begin: after a line, a semicolon, or a full stop before white space."""
    return [0, *[m.end() for m in re.finditer(r"\n|;|[.!?](?=\s)", low)], len(low) + 1]


def affinity(at: int, cues: Sequence[Mark], bounds: Sequence[int]) -> float:
    """How strongly cues speak of what stands at ``at``: by distance, in its clause fully, from the one before little, after it less."""
    total, first = 0.0, max(b for b in bounds if b <= at)
    for c in cues:
        gap = at - c.end
        if gap >= 0:
            total = max(total, (1.0 if c.start >= first else 0.25) / (1 + gap / 12))
        elif c.start >= at and not any(at < b <= c.start for b in bounds):
            total = max(total, 0.2 / (1 + (c.start - at) / 12))
    return total


def best_pair(candidates: Sequence[tuple[int, Any]], first: Sequence[Mark], second: Sequence[Mark], bounds: Sequence[int], alone: float = 0.05) -> tuple[Any, Any]:
    """The two different candidates (either may be none) whose affinities to the two roles are largest in all; earlier first on ties."""
    scored = [(value, affinity(at, first, bounds), affinity(at, second, bounds)) for at, value in candidates]
    best, out = 0.0, (None, None)
    options = [(None, 0.0, 0.0), *scored]
    for i, (a, pa, qa) in enumerate(options):
        for j, (b, pb, qb) in enumerate(options):
            if (i == j and i) or (a is not None and a == b and not (pa and qb)):  # the same value twice needs a cue for each role
                continue
            # A candidate without a cue of its own can still have a role, by its place in the order.
            total = (max(pa - 0.6 * qa, alone) if i else 0.0) + (max(qb - 0.6 * pb, alone) if j else 0.0) + (0.02 if i and j and i < j else 0.0)
            if total > best + 1e-12:
                best, out = total, (a, b)
    return out


# Places ----------------------------------------------------------------------------------------


def case_forms(name: str) -> list[str]:
    """A Russian name, then its cases: of the last word alone and of every word. Other names have one form."""
    if not re.search(r"[а-яё]", name, re.IGNORECASE):
        return [name]
    words = re.split(r"([\s-]+)", name)
    cases = []
    for w in words[::2]:
        end = max((e for e in CASES if w.endswith(e)), key=len)
        cases.append([w[: len(w) - len(end)] + e for e in CASES[end].split(" ")])
    out = [name]
    for n in range(5):
        every = [c[n] for c in cases]
        out += ["".join([*words[:-1], every[-1]]), "".join(x for pair in zip(every, [*words[1::2], ""], strict=True) for x in pair)]
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class Gazetteer:
    """Places by their spellings in lower case. A spelling is looked up by the words it begins with, so their number costs nothing."""

    forms: dict[str, str]
    lengths: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        forms = {k.lower(): v for k, v in self.forms.items() if k.strip()}
        lengths: dict[str, set[int]] = {}
        for k in forms:
            lengths.setdefault(re.split(r"[\s-]", k, maxsplit=1)[0], set()).add(len(k))
        object.__setattr__(self, "forms", forms)
        object.__setattr__(self, "lengths", {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()})

    @classmethod
    def of(cls, cities: Iterable[str]) -> Gazetteer:
        """Of CITY_NAMES and further cities, with their case forms and those with е for ё; a name holds before a form of another."""
        names = CITY_NAMES | {c: CITY_NAMES.get(c, c) for c in cities if c and c.strip()} | {c: c for c in CITY_NAMES.values()}
        forms = {k.lower(): v for k, v in names.items()}
        for k, v in sorted(names.items()):
            for f in case_forms(k):
                for spelled in (f.lower(), f.lower().replace("ё", "е")):
                    forms.setdefault(spelled, v)
        return cls(forms)

    def find(self, low: str) -> Iterator[tuple[int, str]]:
        """(start, city) of the longest spellings, from left to right without overlap, whole words only."""
        end = 0
        for m in re.finditer(r"(?<![\w-])\w+", low):
            if m.start() < end:
                continue
            for n in self.lengths.get(m.group(), ()):
                stop = m.start() + n
                if low[m.start() : stop] in self.forms and not (stop < len(low) and (low[stop].isalnum() or low[stop] in "-_")):
                    end = stop
                    yield m.start(), self.forms[low[m.start() : stop]]
                    break


# Dates -----------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\d+|[a-zа-яё]+|[./-]|,|\S")


def month_of(word: str) -> int | None:
    """1-12 of the name or stem of a month in either language."""
    for i, stem in enumerate(MONTH_STEMS):
        if word.startswith(stem) and (stem != "ма" or word in ("май", "мая", "мае")) and (i < 12 or len(word) <= 9):
            return i % 12 + 1
    return None


def calendar_day(year: int | None, month: int | None, day: int) -> date | None:
    try:
        return date(year, month, day) if year and month else None
    except ValueError:
        return None


def dates_in(low: str, marks: dict[str, list[Mark]], today: date | None) -> list[tuple[int, date]]:
    """(start, day) in order: number groups with one separator, day and month by name, words for near days. Impossible days are none."""
    tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(low)]
    out: list[tuple[int, date]] = [(m.start, today + timedelta(days=int(m.name))) for m in marks.get("day", []) if today]
    i = 0
    while i < len(tokens):
        word, start, _ = tokens[i]
        used, day = 1, None
        part = [t[0] for t in tokens[i : i + 5]]
        glued = all(tokens[k][2] == tokens[k + 1][1] for k in range(i, min(i + 4, len(tokens) - 1)))
        free = not (start and (low[start - 1].isalnum() or low[start - 1] in "-./"))
        if word.isdigit() and free and len(part) == 5 and glued and part[1] == part[3] and part[1] in "./-" and part[2].isdigit() and part[4].isdigit():
            a, b, c = int(part[0]), int(part[2]), int(part[4])
            if len(part[0]) == 4 and part[1] == "-":
                day = calendar_day(a, b, c)
            elif len(part[4]) == 4:
                day = calendar_day(c, a, b) if part[1] == "/" else calendar_day(c, b, a)
            used = 5
        elif word.isdigit() and len(word) <= 2 and len(part) > 1 and (month := month_of(part[1])):
            used, day = _with_year(tokens, i, 2, month, int(word), today)
        elif (month := month_of(word)) and len(part) > 1 and part[1].isdigit() and len(part[1]) <= 2:
            skip = 3 if len(part) > 2 and part[2] in ("st", "nd", "rd", "th") else 2
            used, day = _with_year(tokens, i, skip, month, int(part[1]), today)
        if day:
            out.append((start, day))
        i += used if day else 1
    return sorted(out)


def _with_year(tokens: Sequence[tuple[str, int, int]], i: int, used: int, month: int, day: int, today: date | None) -> tuple[int, date | None]:
    at = i + used
    if at < len(tokens) and tokens[at][0] == ",":
        at += 1
    if at < len(tokens) and tokens[at][0].isdigit() and len(tokens[at][0]) == 4:
        return at + 1 - i, calendar_day(int(tokens[at][0]), month, day)
    return used, calendar_day(today.year if today else None, month, day)


_HEADER = re.compile(r"^(?:дата запроса|request date)\s*:\s*(\d{4})-(\d\d)-(\d\d)", re.IGNORECASE)


def request_day(text: str) -> date | None:
    """The date of the request its first line states; an impossible one is none."""
    m = _HEADER.match(text)
    return calendar_day(*map(int, m.groups())) if m else None


# Conditions ------------------------------------------------------------------------------------

_SIGNED = r"(?:(?:плюс|минус|plus|minus)\s+|[+−–-]\s?)?\d+(?:[.,]\d+)?"
_RANGE = re.compile(rf"(?<![\w.,-])({_SIGNED})\s*(?:°\s?[cс]?)?\s*(?:\.\.\.?|…|—|–|-|до|to|and|и)\s*({_SIGNED})\s*(?=°|град|degr)")
_ONE = re.compile(rf"(?<![\w.,])({_SIGNED})\s*(?=°|град|degr)")
_LENGTH = re.compile(r"(\d+(?:[.,]\d+)?)\s*(см|cm|м|m)\b")
_SIDES = re.compile(r"(\d+(?:[.,]\d+)?)\s*[x×х]\s*(\d+(?:[.,]\d+)?)\s*[x×х]\s*(\d+(?:[.,]\d+)?)\s*(см|cm|м|m)\b")


def degrees(said: str) -> float:
    below = said.startswith(("минус", "minus", "-", "−", "–"))
    n = float(re.sub(r"[^\d.,]", "", said).replace(",", "."))
    return -n if below else n


def number_of(said: str) -> float | int:
    n = float(said.replace(",", "."))
    return int(n) if n.is_integer() else n


def conditions_in(low: str, marks: dict[str, list[Mark]]) -> list[dict[str, Any]]:
    """The special conditions a text states, with their values, in the order of the kinds; a kind named without values has none."""
    asks = {m.name for m in marks.get("asks", [])}
    out: dict[str, dict[str, Any]] = {}
    pair, one = _RANGE.search(low), _ONE.search(low)
    if pair:
        a, b = sorted((degrees(pair[1]), degrees(pair[2])))
        out["temperature"] = {"min_c": a, "max_c": b}
    elif one:
        near = [m.name for m in marks.get("bound", []) if 0 <= one.start() - m.end <= 12]
        n = degrees(one[1])
        out["temperature"] = {"min_c": None if "below" in near else n, "max_c": None if "above" in near else n}
    elif "temperature" in asks and not marks.get("parameters"):
        out["temperature"] = {"min_c": None, "max_c": None}
    for kind, name in (("securing", "methods"), ("packaging", "types"), ("sensors", "parameters")):
        found = {m.name for m in marks.get(name, [])}
        if found or kind in asks:
            out[kind] = {name: [v for v in LISTS[name] if v in found]}
    sides = {m.name: m.end for m in marks.get("side", [])}
    whole = _SIDES.search(low)
    if whole or sides or "oversize" in asks:
        unit = lambda u: "cm" if u in ("см", "cm") else "m"
        values: dict[str, Any] = dict.fromkeys(SIDES)
        if whole:
            values = {s: {"value": number_of(whole[i + 1]), "unit": unit(whole[4])} for i, s in enumerate(SIDES)}
        for s, at in sides.items():
            m = _LENGTH.search(low, at)
            if m and m.start() - at <= 12:
                values[s] = {"value": number_of(m[1]), "unit": unit(m[2])}
        out["oversize"] = values
    return [{"kind": k, **out[k]} for k in KINDS if k in out]


# Cards -----------------------------------------------------------------------------------------

_COMPANY = re.compile(r"(?:ООО|АО|ЗАО|ТК|ИП|склад)\s+(?:«[^»\n]+»|[А-ЯЁ][\w-]+)|[A-Z][a-z]+(?: [A-Z][a-z]+)* (?:Retail|Industries|Supply|Foods|Freight|Logistics)\b")
_GREETING = re.compile(r"^(?:(?:For|From|To|By|At|The|Hello|Hi|Dear|Enquiry|Request|Payer) )+")
_COUNT = re.compile(r"(?<![\d.,])(\d{1,4})\s*(?:[x×]\s|(" + "|".join(PIECE_NOUNS) + r")\w*)")


def top_class(marks: Sequence[Mark]) -> str | None:
    """The class of most marks, the one named first of equal ones."""
    votes: dict[str, int] = {}
    for m in marks:
        votes[m.name] = votes.get(m.name, 0) + 1
    return max(votes, key=lambda n: votes[n]) if votes else None


class Extractor:
    """Reads requests into cards; one per worker."""

    def __init__(self, gazetteer: Gazetteer):
        self.gazetteer, self.marks = gazetteer, Marks()

    def read(self, text: str | None) -> dict[str, Any]:
        """Fields of a card: what the text does not say is null. The first line may state the day from which relative days count."""
        text = text or ""
        head, gap, rest = text.partition("\n\n")
        body, today = (rest if gap else text), request_day(text)
        low = body.lower()
        marks, bounds = self.marks.find(low + " "), clause_bounds(low)
        cues = lambda role: marks.get(role, ())
        origin, destination = best_pair(list(self.gazetteer.find(low)), cues("origin"), cues("destination"), bounds)
        pickup, delivery = best_pair(dates_in(low, marks, today), cues("pickup"), cues("delivery"), bounds)
        weights = find_weights(body)
        total = next((w for w in weights if not w.per_piece), None)
        w = total or (weights[0] if weights else None)
        counts = [int(m[1]) for m in _COUNT.finditer(low) if int(m[1]) > 0]
        names = [(m.start(), _GREETING.sub("", m.group())) for m in _COMPANY.finditer(body)]
        told = [n for at, n in names if any(0 <= at - c.end <= 4 for c in cues("shipper"))]
        return {
            "shipper_name": (told or [n for _, n in names] or [None])[0], "cargo_category": top_class(cues("cargo_category")), "equipment_type": top_class(cues("equipment_type")),
            "pieces": counts[0] if counts else None, "weight": w, "origin": origin, "destination": destination, "pickup_date": pickup, "delivery_date": delivery, "special_conditions": conditions_in(low, marks),
        }

    def answer(self, text: str | None, region: dict[str, str]) -> str | None:
        """The canonical answer of the second version: missing fields by the rule, no conflicts; never one its version refuses."""
        return answer_of(self.read(text), region)


def answer_of(got: dict[str, Any], region: dict[str, str]) -> str | None:
    """Canonical answer of read fields. A card its version refuses loses its conditions, then everything."""
    v, w = version_of("card_v2"), got["weight"]
    quantity = {"value": int(w.value) if float(w.value).is_integer() else w.value, "unit": w.unit} if w and w.unit in ("kg", "t", "lb") else None
    place = lambda c: {"city": c, "region": region.get(c, c)} if c else None
    card: dict[str, Any] = {f: got.get(f) for f in v.fields} | {
        "weight_total": quantity if w and not w.per_piece else None, "weight_per_piece": quantity if w and w.per_piece else None, "origin": place(got["origin"]), "destination": place(got["destination"]),
        "pickup_date": got["pickup_date"].isoformat() if got["pickup_date"] else None, "delivery_date": got["delivery_date"].isoformat() if got["delivery_date"] else None,
    }
    return spell_card({"card": card, "missing_fields": missing_of(card, v)}, v)


def empty_answer(version: str) -> str:
    """The answer of a back end that knows nothing: every field null."""
    v = version_of(version)
    card = {f: [] if f == "special_conditions" else None for f in v.fields}
    return spell_card({"card": card, "missing_fields": missing_of(card, v)}, v) or ""


REQUIRED = ("origin", "destination", "pickup_date", "equipment_type", "pieces", "weight")


def extract_cards(texts: DataFrame, id_col: str, text_col: str, gazetteer: Gazetteer, regions: dict[str, str] | None = None) -> DataFrame:
    """(id, card): one card per row; null and empty texts give an empty card with all required fields missing.

    Weights in units that an answer can't hold (hundredweights, quintals, short
    tons, grams) stand in the card's columns and are left out of its ``answer``.
    """
    names = [c.split()[0] for c in CARD.split(", ")]
    regions = regions or {}

    @F.pandas_udf(CARD)
    def read(t: pd.Series) -> pd.DataFrame:
        extractor, rows = Extractor(gazetteer), []
        for x in t:
            got = extractor.read(x)
            w = got["weight"]
            warm = next((c for c in got["special_conditions"] if c["kind"] == "temperature"), {})
            rows.append((
                got["shipper_name"], got["cargo_category"], got["equipment_type"], got["pieces"], w.value if w else None, w.unit if w else None, w.per_piece if w else None,
                (w.total_kg if not w.per_piece or w.pieces else None) if w else None, got["origin"], got["destination"], got["pickup_date"], got["delivery_date"], warm.get("min_c"), warm.get("max_c"),
                [json.dumps(c, ensure_ascii=False) for c in got["special_conditions"]], [k for k in REQUIRED if got[k] is None], answer_of(got, regions),
            ))
        out = pd.DataFrame(rows, columns=names)
        out["pieces"] = out["pieces"].astype("Int64")
        for c in ("weight_value", "weight_kg", "min_c", "max_c"):
            out[c] = out[c].astype("float64")
        return out

    return texts.select(F.col(id_col).alias("id"), read(F.col(text_col)).alias("card"))
