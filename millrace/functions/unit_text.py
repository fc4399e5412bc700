"""Weights with units in free text: a multi-pattern automaton over unit aliases, longest match, and the context of the number."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Kilograms per unit, and the spellings of each unit.
KILOGRAMS = {"kg": 1.0, "t": 1000.0, "lb": 0.45359237, "cwt": 45.359237, "q": 100.0, "st": 907.18474, "g": 0.001}

ALIASES = {
    "kg": "kg kgs kilo kilos kilogram kilograms kilogramme kilogrammes кг кило килограмм килограмма килограммов килограммы килограммах",
    "t": "t mt ton tons tonne tonnes т тн тонн тонна тонны тонну тоннах|metric ton|metric tons|metric tonne|metric tonnes|метрических тонн|метрические тонны|метр. тонн|метр. т",
    "st": "short ton|short tons|us ton|us tons|u.s. tons|u.s. ton|american tons|sh. tons|sh. tn|коротких тонн|короткие тонны|короткая тонна|короткой тонны|кор. тонн|кор. т|амер. тонн|американских тонн|американские тонны",
    "lb": "lb lbs pound pounds фунт фунта фунтов фунты фунтах",
    "cwt": "cwt cwts hundredweight hundredweights|us cwt|us hundredweight|us hundredweights|u.s. hundredweight|short cwt|us quintal|us quintals|short hundredweight|short hundredweights|амер. квинталов|амер. квинтала|амер. квинтал|американских квинталов|американских центнеров|амер. центнеров|амер. ц|хандредвейт|хандредвейтов",
    "q": "quintal quintals ц цн центнер центнера центнеров центнеры квинтал квинтала квинталов квинталы|metric quintal|metric quintals|метрических центнеров",
    "g": "g gr gram grams gramme grammes г гр грамм грамма граммов граммы",
}

#: A clause with one of these speaks of what a vehicle or machine can carry.
_CAPACITY = re.compile(r"грузопод|прицеп на|прицеп (?:до|с )|погрузчик|вмеща|вместимост|кран\b|гидроборт|\bберёт\b|\bберет\b|поднима|тоннаж|payload|\brated\b|forklift|\blifts?\b|capacity|\bcrane\b|tail lift|can carry|\baxle|\btare\b|тара\b")
_WEIGHT = re.compile(r"\bвес(?:а|ом|ит|ят|у)?\b|брутто|нетто|масс\w*|\bвсего\b|weigh\w*|\bgross\b|\bnet\b|altogether|\btotal\b|in all")
_PER_PIECE = re.compile(r"кажд\w*|за (?:штуку|место|единицу)|на (?:место|штуку)|\bшт\b|per (?:piece|unit|item|pallet|crate|carton|package|box)|\beach\b|apiece|a piece")
_PIECES = re.compile(r"(\d+)\s*(?:[x×х*]\s*(?=\d)|(?:шт\w*|мест\w*|грузомест\w*|короб\w*|ящик\w*|поддон\w*|паллет\w*|упаков\w*|pieces?|pallets?|crates?|cartons?|packages?|boxes|units?)\b)")
_NUMBER = re.compile(r"\d{1,3}(?:[    '’]\d{3})+(?:[.,]\d{1,3})?(?!\d)|\d{1,3}(?:,\d{3})+(?:\.\d{1,3})?(?!\d)|\d{1,3}(?:\.\d{3})+(?:,\d{1,3})?(?!\d)|\d+(?:[.,]\d+)?")
#: Characters that a number with its group and decimal marks is made of.
_NUMERIC = frozenset("0123456789.,'’ \u00a0\u202f\u2009")
_CLAUSE = re.compile(r"\n|;|[.!?](?=\s)")

_UNITS_EN = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS_EN = {w: 20 + 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
_UNITS_RU = "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
_TENS_RU = {w: 20 + 10 * i for i, w in enumerate("двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split())}
_HUNDREDS_RU = {w: 100 * (i + 1) for i, w in enumerate("сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split())}
NUMBER_WORDS = {w: i for i, w in enumerate(_UNITS_EN)} | _TENS_EN | {w: i for i, w in enumerate(_UNITS_RU)} | _TENS_RU | _HUNDREDS_RU | {"одна": 1, "две": 2, "одну": 1, "полторы": 1.5}
_SCALES = {"hundred": 100, "thousand": 1000, "тысяча": 1000, "тысячи": 1000, "тысяч": 1000, "тыс": 1000}


@dataclass(frozen=True)
class Weight:
    """A stated weight: the number, its unit, whether it is per piece, the pieces named beside it, and its place."""

    value: float
    unit: str
    per_piece: bool
    pieces: int | None
    start: int

    @property
    def total_kg(self) -> float:
        kg = self.value * KILOGRAMS[self.unit]
        return kg * self.pieces if self.per_piece and self.pieces else kg


_MACHINES: dict[str, object] = {}


def _machine():
    """The automaton over all aliases, built once per process (a cached function could not travel by value)."""
    import ahocorasick

    if "units" in _MACHINES:
        return _MACHINES["units"]
    machine = ahocorasick.Automaton()
    for unit, names in ALIASES.items():
        for i, part in enumerate(names.split("|")):
            for alias in part.split() if i == 0 and unit not in ("st",) else [part]:
                machine.add_word(alias, (len(alias), unit))
    machine.make_automaton()
    _MACHINES["units"] = machine
    return machine


def parse_number(text: str, unit: str) -> float | None:
    """The number of a spelling with group or decimal marks; a mark before three digits groups where the unit is small."""
    t = re.sub(r"[\s   '’]", "", text)
    if "," in t and "." in t:
        t = t.replace(",", "") if t.rfind(".") > t.rfind(",") else t.replace(".", "").replace(",", ".")
    elif "," in t or "." in t:
        mark = "," if "," in t else "."
        head, *groups = t.split(mark)
        grouped = all(len(g) == 3 for g in groups) and 0 < len(head) <= 3 and head != "0"
        t = head + "".join(groups) if grouped and (len(groups) > 1 or unit in ("kg", "lb", "g")) else t.replace(mark, ".")
    try:
        return float(t)
    except ValueError:
        return None


def _words_before(text: str, at: int) -> tuple[float, int] | None:
    """(value, start) of a number in words that ends right before ``at``, however many words it has."""
    total, taken, end = [], None, at
    while True:
        while end and text[end - 1] in " -\u00a0\u202f\u2009":
            end -= 1
        begin = end
        while begin and text[begin - 1].isalpha():
            begin -= 1
        w = text[begin:end]
        if not w or (w not in NUMBER_WORDS and w not in _SCALES and w != "and") or (begin and text[begin - 1].isalnum()):
            break
        if w != "and":
            total.append(w)
        taken = end = begin
    if taken is None or not total:
        return None
    value: float = 0
    part: float = 0
    for w in reversed(total):
        if w in _SCALES:
            part = (part or 1) * _SCALES[w]
            if _SCALES[w] == 1000:
                value, part = value + part, 0
        else:
            part += NUMBER_WORDS[w]
    return value + part, taken


def find_weights(text: str | None) -> list[Weight]:
    """Cargo weights stated in ``text``, in order. Capacities of vehicles and machines, years and prices are none."""
    if not text:
        return []
    text = re.sub(r"[ \t]{2,}", " ", re.sub(r"(?<![.!?:\n])\r?\n(?!\n)", " ", text))  # a line break inside a sentence is a space
    low = text.lower()
    spans: dict[int, tuple[int, str]] = {}
    for end, (length, unit) in _machine().iter(low):
        start = end - length + 1
        if (end + 1 < len(low) and (low[end + 1].isalpha() or low[end + 1].isdigit())) or (start and low[start - 1].isalpha()):
            continue
        if start not in spans or spans[start][0] < length:  # longest match from a place
            spans[start] = (length, unit)
    bounds = [0, *[m.end() for m in _CLAUSE.finditer(text)], len(text) + 1]
    out: list[Weight] = []
    covered = -1
    for start in sorted(spans):
        length, unit = spans[start]
        if start < covered:
            continue
        head = low[:start].rstrip("    -")
        if len(low[:start]) - len(head) > 2:
            continue
        value = place = None
        if head and head[-1].isdigit():
            begin = len(head)
            while begin and head[begin - 1] in _NUMERIC:
                begin -= 1
            tail = [m for m in _NUMBER.finditer(head, begin) if m.end() == len(head)]
            if tail and not re.search(r"[\d./:-]$", head[: tail[0].start()][-1:]):
                value, place = parse_number(tail[0].group(), unit), tail[0].start()
        else:
            said = _words_before(low, start)
            if said:
                value, place = said
        if value is None or value <= 0 or (unit == "g" and low[start : start + length] in ("г", "g") and value < 10_000):
            continue
        a = max(b for b in bounds if b <= place)
        b = min(b for b in bounds if b > place)
        clause = low[a:b]
        covered = start + length
        if _CAPACITY.search(clause) and not _WEIGHT.search(low[a:place]):
            continue
        before, after = low[a:place], low[covered : covered + 40]
        if out and before.rstrip().endswith("(") and value in (100, 1000, 2000):  # the unit explained: cwt (100 lb)
            continue
        times = re.search(r"(\d+)\s*[x×х*]\s*$", before)
        each = bool(times or _PER_PIECE.search(before[-40:]) or _PER_PIECE.match(after.lstrip(" .,(")) or re.search(r"\bпо\s*$|\bat\s*$|@\s*$", before))
        named = _PIECES.findall(clause)
        pieces = int(times.group(1)) if times else int(named[0]) if named else None
        out.append(Weight(value, unit, each, pieces, place))
    return out
