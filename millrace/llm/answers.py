"""Defective prompt and response pairs: empty, copied, refused, truncated or in another language.

Copies are found with zstandard: the request is the dictionary with which the
answer is compressed, and the other way round. Refusals and languages come from
dictionaries. Truncation of prose is judged by a terminal-context model that is
counted over all answers: how often the last words, or the last letters of a
word, are followed by the end of a sentence (or word). JSON answers are
truncated where their brackets stay open.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import hot_keys, salted_join

# The dictionaries of the labels.

#: Answers that say nothing.
SHELLS = frozenset({"", "null", "none", "nil", "nan", "n/a", "na", "undefined", "empty", "json", "no answer", "нет", "нет ответа", "пусто", "н/д"})

REFUSALS = {
    "en": [
        r"\b(?:can ?not|can['’]t|could not|couldn['’]t|won['’]t|will not|unable to|not able to) (?:be able to )?(?:help|assist|comply|answer|respond|process|handle|provide|fulfil|fulfill|discuss|continue|complete|do (?:this|that|it)|work with|share|support|take (?:this|that)|fill|extract|engage)",
        r"\b(?:must|have to|need to|will|going to|i) (?:politely |respectfully )?(?:decline|refuse|pass on|abstain)",
        r"\bdecline to (?:answer|help|comment)", r"\brefuse to\b",
        r"\b(?:would|['’]d) (?:rather|prefer) not\b", r"\bprefer not to\b",
        r"\bagainst (?:the |my |our |company )?(?:policy|policies|rules|guidelines)",
        r"\b(?:guidelines|policy|policies|rules|instructions) (?:do not|don['’]t|does not|doesn['’]t|forbids?|prohibits?|prevents?)",
        r"\bbeyond (?:what i|my|the scope)", r"\boutside (?:of )?(?:what i|my|the scope)",
        r"\bno answer (?:will|can) be\b", r"\bnot (?:allowed|permitted|authori[sz]ed) to\b",
        r"\b(?:am|i['’]m) not (?:in a position|comfortable|going to)", r"\bnot (?:something )?(?:i can|i['’]m able)",
        r"\bas an ai\b", r"\bnot for me to\b", r"\bplease (?:ask|turn to|contact) (?:a |some)?(?:human|someone else)",
    ],
    "ru": [
        r"не (?:могу|смогу|можем|сможем) (?:вам |вас |здесь |тут |этим |с этим )*(?:помочь|ответить|отвечать|обработать|обрабатывать|выполнить|дать|предоставить|заниматься|работать|обсуждать|комментировать|заполнить|принять|продолжить|помогать)",
        r"не вправе", r"не имею права", r"не (?:стану|буду) (?:работать|отвечать|помогать|обрабатывать|заполнять|заниматься|комментировать|обсуждать)",
        r"(?:вынужден|вынуждена|придётся|придется|должен|хочу) (?:вам )?отказать", r"отказываюсь", r"отказываю\b", r"предпоч(?:ту|итаю|ёл бы|ел бы) (?:воздержаться|не )", r"воздержусь", r"воздержаться от ответа",
        r"запрещен[оаы]? (?:политик|правил|инструкц)", r"(?:правила|политика|инструкци\w|регламент) (?:мне )?(?:не позволя|запреща)", r"не позволя(?:ют|ет) мне", r"противоречит (?:политик|правил)",
        r"выходит за рамки", r"за пределами моих", r"ответа не будет", r"лучше не ко мне", r"не ко мне", r"как (?:ии|искусственный интеллект)", r"мне (?:нельзя|не разрешено|не положено|запрещено)",
        r"обратитесь к (?:живому|другому|человеку)",
    ],
    "other": [
        r"не можу (?:допомогти|відповісти|обробити)", r"відмовляюся", r"nie mogę (?:pomóc|odpowiedzieć)", r"muszę odmówić", r"no puedo (?:ayudar|responder|procesar)", r"lo siento, (?:pero )?no puedo",
        r"kann (?:ihnen |dir |dabei |hier )*nicht (?:helfen|antworten)", r"darf (?:ich )?(?:das |dazu )?nicht", r"je ne peux pas (?:vous )?(?:aider|répondre)",
    ],
}
#: Sentences that go with a refusal without being an answer.
COURTESY = r"sorry|apolog|unfortunately|regret|as an assistant|to be open|is there anything else|anything else you need|may be unsafe|human dispatcher|извин|прошу прощения|к сожалению|сожале|как ассистент|скажу прямо|чем ещ[её] могу|небезопасн|диспетчер|личные сведения|private details|хм|hm"

#: Frequent short words by language, for texts in Latin and Cyrillic script.
FUNCTION_WORDS = {
    "en": "the a an and of to is are was be for on in at by with from that this it we you not before after should will have has if but or as while your our order their its would can until please",
    "ru": "и в во на не что с со как из по до для за от это мы вы он она его но а или если к ко у же бы то так еще уже при после ваш наш раньше будет есть нужна нужен вами после перед",
    "uk": "і й та що з із зі як до для за від це ми ви він вона його але або якщо у на не по при після ваш наш буде є цей цьому має перед його її їх де тут кінця тижня наступного дня",
    "pl": "i w we na nie że z ze jak do dla za od to my wy on ona jego ale lub jeśli a u przy po przed jest są będzie ten tej się o oraz być tym przez pod nad już zaś powinien",
    "es": "el la los las un una y de del en que a al para por con no es son se su lo como más pero o si desde hasta esta este será debe hará antes después día está prevista",
    "de": "der die das den dem des ein eine einen einem und in im zu zum zur für von vom mit auf ist sind nicht auch bei nach vor bis soll wird werden oder wenn an am um als es sie wir bleibt",
    "fr": "le la les un une des et de du en que à au aux pour par avec ne pas est sont se son sa ses il elle nous vous mais ou si avant après doit sera cette ce dans sur jusqu",
    "it": "il lo la gli le un una e di del della in che a al alla per da con non è sono si suo ma o se prima dopo deve sarà questa questo fino nel",
    "pt": "o a os as um uma e de do da em que ao à para por com não é são se seu mas ou antes depois deve será esta este até no na dos das",
    "nl": "de het een en van in op te voor met niet is zijn dat die aan bij naar of als maar wordt worden moet voor na tot deze dit om uit ook",
    "tr": "ve bir bu da de için ile olarak olan daha çok en ne ama veya gibi kadar sonra önce değil var yok",
    "cs": "a v ve na že s se z do pro za od je jsou to ale nebo který jako při po před bude musí ten tato o k u",
}
LETTERS = {"uk": "іїєґ", "ru": "ыэъё", "pl": "łąęśżźćń", "es": "ñ¿¡", "de": "ßäöü", "fr": "çêèœ", "pt": "ãõ", "cs": "řěů", "tr": "ğış"}

_REFUSAL = re.compile("|".join(p for ps in REFUSALS.values() for p in ps))  # on text in lower case
_COURTESY = re.compile(COURTESY)
#: Every pattern of a refusal holds one of these; most texts hold none and are not searched further.
_STEMS = (
    "can't can’t cannot couldn won't won’t unable decline refuse abstain against guideline polic rules instructions beyond outside allowed permitted authori comfortable "
    "не_могу не_смо не_можем не_вправе не_имею не_стану не_буду отказ предпоч воздерж запрещ правила политик инструкц регламент не_позвол противореч рамки не_ко_мне нельзя обратитесь "
    "не_можу відмовл nie_mogę odmówić no_puedo nicht je_ne can_not could_not will_not not_able pass_on rather_not prefer_not no_answer not_going not_something not_i an_ai not_for_me please_ask please_turn please_contact "
    "за_пределами ответа_не как_ии искусственный мне_не_ in_a_position"
).replace("_", "\0").split()
_STEMS = tuple(x.replace("\0", " ") for x in _STEMS)
_LANGUAGES_OF: dict[str, tuple[str, ...]] = {}
for _lang, _ws in FUNCTION_WORDS.items():
    for _w in _ws.split():
        _LANGUAGES_OF[_w] = tuple(sorted({*_LANGUAGES_OF.get(_w, ()), _lang}))
_NOT_RUSSIAN = re.compile("[a-zA-ZіїєґІЇЄҐÀ-ɏ]{3}|[іїєґІЇЄҐ]|[^\\W\\d_Ѐ-ӿ]{2}")
_CYRILLIC, _LATIN = re.compile("[Ѐ-ӿ]"), re.compile("[a-zÀ-ɏ]")
_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+(?=\s|$)|\n|$|[.!?]+)")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d[\d.,:/\-]*\d|\d")
_END = re.compile(r"[\"»”’')\]]*[.!?…]")
_CLOSED = re.compile(r"[.!?…][\"»”’')\]*_`\s]*$|[)\]]\s*$")
_BRACKET = re.compile(r"[()\[\]]")
_QUOTATION = re.compile(r"\"[^\"]*\"|«[^»]*»|“[^”]*”|`[^`]*`")
_STRING = re.compile(r"\"((?:[^\"\\]|\\.)*)\"\s*(?=[,}\]]|$)")
_QUOTED = re.compile(r"\"[^\"]*\"|«[^»]*»|“[^”]*”|\([^()]*\)|`[^`]*`")
_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")
_HIDDEN = re.compile("[\\s ­​-‏⁠-⁯﻿]+")


def strip_fence(text: str) -> str:
    return _FENCE.sub("", _FENCE.sub("", text))


def is_empty(text: str | None) -> bool:
    """Nothing said: no letters or digits, a word for nothing, or only a shell (fence, brackets, quotes, keys without values)."""
    if text is None:
        return True
    if text[:1].isalpha() and len(text.split(None, 3)) > 3:  # more words than any shell has
        return False
    bare = _HIDDEN.sub(" ", strip_fence(text)).strip()
    if not re.search(r"[^\W_]", bare) or bare.strip(" \"'`.,:;!?-–—()[]{}<>*#").casefold() in SHELLS:
        return True
    if bare[0] == "{" and bare[-1] == "}":
        values = re.sub(r"\"[^\"]*\"\s*:", "", bare)  # without the keys
        return not re.search(r"[^\W_]", re.sub(r"\b(?:null|none)\b", "", values, flags=re.IGNORECASE))
    return False


def _squeeze(text: str) -> bytes:
    return " ".join(text.lower().replace("\\n", " ").split()).encode()


def copied_share(prompt: str, answer: str) -> tuple[float, float]:
    """(compressed size of the answer, of the prompt), each with the other as dictionary, against its size without one."""
    import zstandard

    a, p = _squeeze(answer), _squeeze(prompt)
    if len(a) < SHORT_BYTES or len(p) < SHORT_BYTES:
        return 1.0, 1.0

    def ratio(data: bytes, by: bytes) -> float:
        plain = zstandard.ZstdCompressor(level=3, write_content_size=False).compress(data)
        d = zstandard.ZstdCompressionDict(by, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False).compress(data)) / len(plain)

    r = ratio(a, p)
    return (r, ratio(p, a)) if r < 0.6 else (r, 1.0)


def is_copy(prompt: str | None, answer: str) -> bool:
    """The request itself, nearly whole: each compresses to a small part of its size with the other as dictionary.

    The header line (date of the request) may be left out. A quoted line or half of the request is no copy.
    """
    if not prompt:
        return False
    body = prompt.split("\n", 1)[1].strip() if "\n" in prompt else prompt
    strings = _STRING.findall(answer) if _json_text(answer) is not None else []
    short = [x for x in (_squeeze(prompt), _squeeze(body)) if x and len(x) < SHORT_BYTES]
    if short and (_squeeze(strip_fence(answer)) in short or (len(strings) == 1 and _squeeze(strings[0]) in short)):
        return True
    a, p = copied_share(prompt, answer)
    if a >= COPY_ANSWER or p < COPY_PROMPT:
        return a < COPY_ANSWER
    a, p = copied_share(body, answer)
    return a < COPY_ANSWER and p < COPY_PROMPT


#: Largest ratios of a copy: of the answer by the request, and of the request by the answer.
COPY_ANSWER, COPY_PROMPT = 0.5, 0.5
#: Texts too short to compress are compared by equality.
SHORT_BYTES = 24


_OBJECT = re.compile(r"\{\s*[\"}]|\{\s*$")


def _json_text(text: str) -> str | None:
    """The JSON part of an answer that is one, perhaps after a fence or a preamble: what never closes, or is at least half of the text."""
    bare = text.lstrip("\ufeff \n\t\r")
    if bare[:1] in ("{", "["):
        return bare
    found = _OBJECT.search(bare)
    if not found:
        return None
    part = bare[found.start() :]
    try:
        end = json.JSONDecoder().raw_decode(part)[1]
    except (ValueError, RecursionError):
        end = len(part)
    return part if 2 * end >= len(strip_fence(bare)) or bare.startswith("```") else None


def json_open(text: str) -> bool:
    """Whether the brackets of ``text`` never close."""
    depth, inside, skip = 0, False, False
    for c in text:
        if skip:
            skip = False
        elif inside:
            if c == "\\":
                skip = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return False
    return True


def _bracket_open(text: str) -> bool:
    """Whether a round or square bracket is open at the end; those in a whole quotation and closing ones without an opening one (a numbered item) don't count."""
    depth = 0
    for c in _BRACKET.findall(_QUOTATION.sub("", text)):
        depth = depth + 1 if c in "([" else max(0, depth - 1)
    return depth > 0


def is_refusal(text: str) -> bool:
    """At least half of the text are sentences that refuse or go with a refusal, and one refuses."""
    part = _json_text(text)
    if part is not None:
        text = "\n".join(_STRING.findall(part)) or part  # each string is a sentence of its own
    text = text.replace("\\n", " ").lower()
    if not any(x in text for x in _STEMS) or not _REFUSAL.search(text):
        return False
    no = total = 0
    for s in _SENTENCE.findall(text):
        n = len(s.strip())
        total += n
        if _REFUSAL.search(s) or _COURTESY.search(s):
            no += n
    return no * 2 >= total


def sentence_language(sentence: str) -> tuple[str | None, int]:
    """(language, letters) by dictionary and letters; for a sentence of unknown words the script alone; None without letters."""
    low = sentence.lower()
    words = re.findall(r"[^\W\d_]+", low)
    if not words:
        return None, 0
    letters = sum(map(len, words))
    cyrillic, latin = len(_CYRILLIC.findall(low)), len(_LATIN.findall(low))
    if cyrillic * 2 < letters and latin * 2 < letters:
        return "other", letters
    slavic = cyrillic >= latin
    count = Counter(lang for w in words for lang in _LANGUAGES_OF.get(w, ()) if (lang in ("ru", "uk")) == slavic)
    if not low.isascii():
        for lang, own in LETTERS.items():
            if (lang in ("ru", "uk")) == slavic:
                n = sum(low.count(c) for c in own)
                if n:
                    count[lang] += 2 * n
    first = "ru" if slavic else "en"
    if not count:
        return first, letters
    most = max(count.values())
    return (first if count[first] == most else min(lang for lang in count if count[lang] == most)), letters


#: Share of a language's records in which a word of its dictionary stands, and the fewest words with which a dictionary judges.
DICTIONARY_SHARE, DICTIONARY_LEAST = 1 / 4000, 300
_PLAIN_WORD = re.compile(r"[^\W\d_]+")


def language_dictionaries(records: DataFrame) -> dict[str, frozenset[str]]:
    """language -> words in lower case that stand in ``DICTIONARY_SHARE`` of its records (three at least), counted over the reference answers of all records.

    Reference answers in words are in the record's language; cards are left out. There are at most 1 / DICTIONARY_SHARE times the mean number of
    words of a record per language, so what comes to the driver is bounded.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counted: dict[str, Counter] = {}
            for lang, t in zip(pdf["language"], pdf["text"], strict=True):
                counted.setdefault(lang, Counter()).update(set(_PLAIN_WORD.findall(t.lower())))
            yield pd.DataFrame([(lang, w, n) for lang, c in counted.items() for w, n in c.items()], columns=["language", "word", "n"])

    said = F.array_join(F.transform(F.filter("messages", lambda m: (m["role"] == "assistant") & ~F.coalesce(F.startswith(F.ltrim(m["content"]), F.lit("{")), F.lit(False))), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    known = records.filter("language is not null and messages is not null").select(F.substring(F.lower(F.trim("language")), 1, 2).alias("language"), said.alias("text")).filter("text <> ''")
    total = {r["language"]: r["n"] for r in known.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total:
        return {}
    least = F.create_map(*[x for lang, n in total.items() for x in (F.lit(lang), F.lit(max(3, int(n * DICTIONARY_SHARE))))])[F.col("language")]
    counted = known.mapInPandas(read, "language string, word string, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n"))
    out: dict[str, set[str]] = {}
    for r in counted.filter(F.col("n") >= least).toLocalIterator():
        out.setdefault(r["language"], set()).add(r["word"])
    return {lang: frozenset(ws) for lang, ws in out.items()}


def known_share(sentence: str, dictionary: frozenset[str]) -> tuple[float, int]:
    """(share of the words that are in the dictionary, number of words); names, which begin with a capital inside a sentence, don't count."""
    words = [w for i, w in enumerate(_PLAIN_WORD.findall(sentence)) if not i or not w[0].isupper()]
    return (sum(w.lower() in dictionary for w in words) / len(words) if words else 0.0), len(words)


def is_foreign(text: str, language: str | None, prompt: str | None, dictionaries: dict[str, frozenset[str]] | None = None) -> bool:
    """More than half of the letters are in sentences of another language than the record's (or, without one, the request's).

    A sentence of four words or more is in the record's language if most of its
    words are in that language's dictionary, in another if few are; between, and
    for shorter ones, frequent words and letters decide. What is in quotes or
    brackets does not count. JSON answers have no language: their city names
    are Russian.
    """
    if _json_text(text) is not None:
        return False
    language = (language or "").strip().lower()[:2] or (sentence_language(prompt)[0] if prompt else None)
    if not language:
        return False
    if language == "ru" and not _NOT_RUSSIAN.search(text):
        return False
    own = (dictionaries or {}).get(language, frozenset())
    text = _QUOTED.sub(" ", text)
    mine = total = 0
    for s in _SENTENCE.findall(text):
        lang, n = sentence_language(s)
        total += n
        is_mine = lang == language
        if n and len(own) >= DICTIONARY_LEAST:
            share, words = known_share(s, own)
            if words >= 4 and share >= 0.75:
                is_mine = True
            elif words >= 4 and share < 0.4:
                is_mine = False
        mine += n * is_mine
    return total > 0 and mine * 2 < total


def _norm(token: str) -> str:
    return re.sub(r"\d+", "9", token.lower())


def _shape(token: str) -> str:
    return "9" if token[0].isdigit() else "Aa" if token[0].isupper() else "aa"


_PART = re.compile(r"([^\W\d_]+(?:['’-][^\W\d_]+)*|\d[\d.,:/\-]*\d|\d)((?:[\"»”’')\]]*[.!?…]+[\"»”’')\]]*(?=\s|$))?)")


def parts(text: str) -> list[tuple[str, bool]]:
    """(word, whether a sentence ends after it) of a text."""
    return [(w, bool(end)) for w, end in _PART.findall(text)]


def count_contexts(texts: Iterable[str]) -> Counter:
    """Counter of (key, terminal) over texts: a word with the one before it, the word's shape with it, and its last letters.

    The last word of a text counts only where a full stop follows: otherwise what comes next is unknown.
    """
    pairs: Counter = Counter()
    inner: Counter = Counter()
    for t in texts:
        found = parts(t)
        if found and not found[-1][1]:
            found.pop()
        before = "^"
        for w, end in found:
            pairs[before, w, end] += 1
            inner[w] += 1
            before = w
    out: Counter = Counter()
    for (before, w, end), n in pairs.items():
        b = _norm(before)
        out[f"2 {b} {_norm(w)}", end] += n
        out[f"1 {b} {_shape(w)}", end] += n
    for w, n in inner.items():
        if not w[0].isdigit():
            low = w.lower()
            for j in range(3, len(low) + 1):
                out[f"s {low[j - 3 : j]}", j == len(low)] += n
    return out


def last_tokens(text: str) -> list[re.Match]:
    """The last two words of a text (fewer if it has fewer): looked for in ever longer ends of it, so a token of any length is whole."""
    width = 200
    while True:
        begin = max(0, len(text) - width)
        found = list(_TOKEN.finditer(text, begin))
        # The first of a part of the text may be the end of a longer one.
        if begin == 0 or len(found) > 2 or (len(found) == 2 and found[0].start() > begin):
            return found[-2:]
        width *= 4


class TerminalModel:
    """P(end of sentence | last words) and P(end of word | last letters), from counts over all answers."""

    def __init__(self, counts: dict[str, tuple[int, int]], least: int = 3):
        self.counts, self.least = counts, least

    def _rate(self, key: str) -> float | None:
        n, ends = self.counts.get(key, (0, 0))
        return ends / n if n >= self.least else None

    def truncated(self, text: str) -> bool:
        """Whether the text ends before its end. A used-up token budget tells nothing: whole answers have it too."""
        part = _json_text(text)
        if part is not None:
            return json_open(part)
        bare = strip_fence(text).rstrip(" \n\t\r\u00a0\u200b*_")
        found = last_tokens(bare)
        if not found:
            return False
        if _bracket_open(bare):
            return True
        w, two = found[-1].group(), len(found) > 1
        before = _norm(found[-2].group()) if two else "^"
        key = f"2 {before} {_norm(w)}"
        rate = self._rate(key)
        if _CLOSED.search(bare):
            # A full stop inside a number or after an abbreviation: the last words never end a sentence elsewhere.
            return bare.endswith(".") and rate is not None and rate < 0.02 and self.counts[key][0] >= 30
        if bare[found[-1].end() :].strip("\"»”’' "):  # comma, dash, colon
            return True
        if _SIGNATURE.search(bare.rsplit("\n", 1)[-1].rsplit(". ", 1)[-1]):
            return False
        if rate is None:
            if not w[0].isdigit():
                inner = self._rate(f"s {w.lower()[-3:]}") if len(w) >= 3 else None
                if inner is None or inner < 0.05:
                    return True
            rate = self._rate(f"1 {before} {_shape(w)}")
        if two and not rate and _END.match(bare, found[-2].end()):
            return True  # a sentence of one word that never ends one
        return rate is None or rate < 0.1


def context_keys(text: str | None) -> list[str]:
    """The keys of the counts that ``TerminalModel.truncated`` may ask for: three at most."""
    if text is None or _json_text(text) is not None:
        return []
    bare = strip_fence(text).rstrip(" \n\t\r\u00a0\u200b*_")
    found = last_tokens(bare)
    if not found or (_CLOSED.search(bare) and not bare.endswith(".")):
        return []
    w = found[-1].group()
    before = _norm(found[-2].group()) if len(found) > 1 else "^"
    return [f"2 {before} {_norm(w)}", f"1 {before} {_shape(w)}", *([f"s {w.lower()[-3:]}"] if len(w) >= 3 and not w[0].isdigit() else [])]


_SIGNATURE = re.compile(r"^\W*(?:с уважением|best regards|kind regards|regards|sincerely|yours|спасибо|thanks|thank you|всего доброго|best)\b[^.]{0,40}$", re.IGNORECASE)


def terminal_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n, ends) over all prose texts: the counts of the terminal-context model."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counted = count_contexts(t for t in pdf["text"] if _json_text(t) is None)
            keys = sorted({k for k, _ in counted})
            yield pd.DataFrame({"key": keys, "n": [counted[k, True] + counted[k, False] for k in keys], "ends": [counted[k, True] for k in keys]})

    counted = texts.select(F.col(text_col).alias("text")).filter("text is not null").mapInPandas(count, "key string, n bigint, ends bigint")
    return counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def context_counts(answers: DataFrame, rows: int) -> DataFrame:
    """(result_id, counts): for each answer the counts of the keys it needs, of all there are; answers that need none are left out."""

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(rid, k) for rid, t in zip(pdf["result_id"], pdf["text"], strict=True) for k in context_keys(t)]
            yield pd.DataFrame(out, columns=["result_id", "key"])

    kind = answers.schema["result_id"].dataType.simpleString()
    keys = answers.filter("text is not null").select("result_id", "text").mapInPandas(needed, f"result_id {kind}, key string")
    found = salted_join(keys, terminal_counts(answers), ["key"], hot_keys(keys, ["key"], rows), "result_id", "inner")
    return found.groupBy("result_id").agg(F.collect_list(F.struct("key", "n", "ends")).alias("counts"))


def defective_answers(results: DataFrame, records: DataFrame) -> DataFrame:
    """(result_id, defect): the first that fits of empty, copied, refusal, truncated, wrong_language.

    ``results`` (result_id, record_id, text), ``records`` (id,
    language, messages). The model is counted over all answers; every answer is
    joined to the full counts of its own two or three keys, rare ones too.
    Results without a record are judged without request and language; of
    records of one id the smallest row holds, and so of results
    of one id. Null result_ids are left out. An error text alone is no defect.
    """
    answers = results.filter("result_id is not null").groupBy("result_id").agg(
        F.min(F.struct("record_id", "text")).alias("r")
    ).select("result_id", "r.*")
    n = answers.count()
    user = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    asked = records.filter("id is not null").groupBy(F.col("id").alias("record_id")).agg(F.min(F.struct("language", user.alias("prompt"))).alias("q")).select("record_id", "q.*")
    counted = answers.join(context_counts(answers, n), "result_id", "left")
    pairs = salted_join(counted, asked, ["record_id"], hot_keys(answers, ["record_id"], n), "result_id")
    kind = answers.schema["result_id"].dataType.simpleString()
    words = records.sparkSession.sparkContext.broadcast(language_dictionaries(records))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rid, text, lang, prompt, counts in zip(pdf["result_id"], pdf["text"], pdf["language"], pdf["prompt"], pdf["counts"], strict=True):
                model = TerminalModel({c["key"]: (c["n"], c["ends"]) for c in counts} if counts is not None else {})
                defect = defect_of(text, lang, prompt, model, words.value)
                if defect:
                    rows.append((rid, defect))
            yield pd.DataFrame(rows, columns=["result_id", "defect"])

    return pairs.select("result_id", "text", "language", "prompt", "counts").mapInPandas(judge, f"result_id {kind}, defect string")


def defect_of(text: str | None, language: str | None, prompt: str | None, model: TerminalModel, dictionaries: dict[str, frozenset[str]] | None = None) -> str | None:
    if is_empty(text):
        return "empty"
    if is_copy(prompt, text):
        return "copied"
    if is_refusal(text):
        return "refusal"
    if model.truncated(text):
        return "truncated"
    if is_foreign(text, language, prompt, dictionaries):
        return "wrong_language"
    return None
