import pytest

from millrace.llm.answers import TerminalModel, copied_share, count_contexts, defect_of, defective_answers, is_copy, is_empty, is_foreign, is_refusal, json_open

ASK = "Request date: 2024-01-05\n\nHello, this is Norbra of Vicmil Retail, order CB-75408. Pick up from Craywick and drop at Dunmarsh before 21:00. 6 pieces, total weight 12061 kgs. Keep plus 5 to plus 8 degrees."
GOOD = ["The sender wants 3 straps, a seal and a call before the gate. We cannot load before 14:00.", "Loading is set for June 24 and the delivery follows on Saturday. The slot is booked."] * 6
CARD = '{"card":{"shipper_name":"ООО «Рудтан»","pieces":3,"origin":{"city":"Лугодар"}},"missing_fields":[],"conflicts":[]}'


@pytest.fixture(scope="module")
def model():
    c = count_contexts(GOOD)
    return TerminalModel({k: (c[k, True] + c[k, False], c[k, True]) for k in {k for k, _ in c}})


@pytest.mark.parametrize("t", [None, "", " \n", "​", "```json\n```", "{}", "[]", '""', "null", "N/A", "-", "...", '{"card": null}', "```\nnone\n```"])
def test_empty_answers(t):
    assert is_empty(t)


@pytest.mark.parametrize("t", ["ok", "42", CARD, "No, thanks."])
def test_not_empty(t):
    assert not is_empty(t)


@pytest.mark.parametrize(
    ("text", "tokens", "want"),
    [
        (GOOD[0], 20, None), (GOOD[0][:-1], 20, None), (GOOD[0][:52], 20, "truncated"), (GOOD[1] + " The slo", 20, "truncated"), (GOOD[1] + ' (ref: "flatbed ok")', 256, None), (GOOD[1] + ' (ref: "fla', 9, "truncated"),
        (GOOD[1] + " Regards", 20, None), (CARD, 9, None), (CARD[:60], 9, "truncated"), ("```json\n" + CARD + "\n```", 9, None), (ASK, 9, "copied"), (ASK.split("\n\n")[1].upper(), 9, "copied"), ('{"request": "' + ASK.replace("\n", "\\n") + '"}', 9, "copied"),
        ("Hello, this is Norbra of Vicmil Retail: " + GOOD[0], 9, None), ("I'm sorry, but I can't help with this request.", 9, "refusal"), ('{"error": "I have to pass on this one"}', 9, "refusal"), ("Извините, правила не позволяют мне заниматься этим заказом.", 9, "refusal"),
        (GOOD[0] + " Sorry, no earlier slots.", 9, None), ("Firma wysyła 18 palet z magazynu do rampy. Nadawca prosi o telefon przed bramą i pasy.", 9, "wrong_language"),
        ("Sure: La empresa envía bultos desde el almacén hasta el muelle. El remitente pide una llamada antes de la puerta.", 9, "wrong_language"), ("The gate. Клиент просит ремней, пломбу и звонок до проходной. Рампа не открывается раньше и окно занято.", 9, "wrong_language"),
    ],
)
def test_defects(model, text, tokens, want):  # the tokens don't matter
    assert defect_of(text, "en", ASK, model) == want


def test_language_of_json_and_missing_language():
    assert not is_foreign(CARD, "en", ASK)
    assert is_foreign("Клиент просит звонок до проходной.", None, ASK) and not is_foreign("Client asks.", None, None)
    assert is_foreign("Клієнт просить 4 ременів і дзвінок перед прохідною.", "ru", "Привет")


def test_parts():
    assert json_open('{"a": "}') and not json_open('{"a": "}"}')
    assert copied_share("short", "short") == (1.0, 1.0) and not is_copy(None, "x" * 100)
    assert not is_refusal("We cannot load before 14:00, but the slot for June is confirmed.")


def test_operator_edges(spark):
    g = spark.createDataFrame(
        [(1, "a", "x" * 5, 1, "e", "d"), (1, "a", None, 1, "e", "d"), (2, "a", None, None, None, "d"), (3, None, "{}", 1, None, "d"), (4, "zz", CARD[:50], 1, None, "d"), (None, "a", "", 1, None, "d"), (5, "a", "Long. " * 50_000, 1, None, "d")],
        "result_id bigint, record_id string, text string, completion_tokens bigint, error string, defect string",
    )
    s = spark.createDataFrame([("a", "en", [("user", ASK)], "p"), ("a", None, None, "p"), (None, "en", [("user", ASK)], "p")], "id string, language string, messages array<struct<role: string, content: string>>, prompt string")
    got = {r["result_id"]: r["defect"] for r in defective_answers(g, s).collect()}
    assert got[2] == got[3] == "empty" and got[4] == "truncated" and 5 not in got and None not in got
    assert defective_answers(g.limit(0), s.limit(0)).count() == 0


def test_rare_contexts_count(spark):
    rows = spark.createDataFrame([(i, "a", "We ship blue parcels. Call first.") for i in range(1, 5)] + [(9, "a", "We ship blue parcels")], "result_id bigint, record_id string, text string")
    g = rows.unionByName(spark.range(100, 30_100).selectExpr("id AS result_id", "'a' AS record_id", "'All is well. Call first.' AS text"))
    s = spark.createDataFrame([("a", "en", [("user", ASK)])], "id string, language string, messages array<struct<role: string, content: string>>")
    assert defective_answers(g, s).filter("result_id < 100").collect() == []


def test_length_makes_no_difference(model):
    sorry = "I'm sorry, but I can't help with this request."
    assert is_empty("{" + ", ".join(f'"field_{i}": null' for i in range(300)) + "}") and not is_empty("{" + ", ".join(f'"field_{i}": null' for i in range(300)) + ', "a": 1}')
    assert is_refusal('{"error": "' + " ".join([sorry] * 20) + '"}') and is_refusal('{"card": null, "error": "' + sorry + '"}') and not is_refusal(CARD)
    assert is_copy("Need a van", " need a  VAN") and is_copy("Request date: 1\nNeed a van", '{"request": "Need a van"}') and not is_copy("Need a van", "Need a tent")
    assert model.truncated(GOOD[0] + " (" + "the slot is fine and the gate is open, " * 12 + GOOD[1]) and model.truncated(GOOD[1] + " (see (a) and " + GOOD[1])
    assert not model.truncated("1) " + GOOD[0]) and not model.truncated(GOOD[0] + " (" + GOOD[1] + ") " + GOOD[0])
    assert not model.truncated('"Origin (Bay" - ' + GOOD[0])


def test_labels_at_any_length():
    """What used to be decided by the first or last characters, or only below a length."""
    import json

    from millrace.llm import answers as a

    assert a.is_empty(json.dumps({f"key{i}": None for i in range(200)})) and a.is_empty("null" + " " * 500) and not a.is_empty("no answer was given to the customer")
    assert a.is_copy("Where is load 12?", "Where is load 12?") and not a.is_copy("Where is load 12?", "Where is load 13?")
    assert a.is_refusal(json.dumps({f"note{i}": "I cannot help with this request." for i in range(25)}))
    assert a.is_refusal("I cannot help with this request. " + "I am sorry that nothing more can be said about it, " * 6 + "really.")
    long = "Here is the card that you asked for, filled in from the request as far as it says anything about the shipment at all: "
    assert a._json_text(long + '{"card": {"pieces": 7, "shipper": "a company with a name", "origin": "a city", "destination": "another city", "more": "and so on and so on"}}')
    assert a._json_text('Use {"a": 1} for the first field and leave all others as they are, please.') is None
    model = a.TerminalModel({})
    assert model.truncated(long + '{"card": {"pieces": 7, "ship') and not model.truncated(long + json.dumps({f"k{i}": i for i in range(90)}))
    token = "x" * 900
    assert [m.group() for m in a.last_tokens("one " + token)] == ["one", token] and [m.group() for m in a.last_tokens("a b" + " " * 3000 + "c")] == ["b", "c"]
    assert a.last_tokens("") == [] and [m.group() for m in a.last_tokens(token)] == [token]
    assert model.truncated("(" + "word " * 300 + "end.")


def test_dictionaries_of_languages(spark):
    """Words counted over the records tell other languages apart, whatever they are; without a dictionary frequent words do."""
    from millrace.llm import answers as a

    words = [f"{w}{s}" for w in "load truck driver arrive deliver pallet window confirm ship gate week order street city price".split() for s in ("", "s", "ed", "ing", "er", "y", "al", "ful", "ly", "ness", "ment", "able", "ion", "ism", "ist", "ish", "ize", "en", "ward", "wise", "less", "like")]
    rows = [(f"r{i}", "EN" if i % 2 else "en ", [("user", "zzz"), ("assistant", '{"card": "zzz"}'), ("assistant", " ".join(words))]) for i in range(8)] + [("n", None, [("user", "nothing")]), ("m", "en", None)]
    got = a.language_dictionaries(spark.createDataFrame(rows, "id string, language string, messages array<struct<role: string, content: string>>"))
    assert set(got) == {"en"} and got["en"] >= set(words) and "zzz" not in got["en"] and len(got["en"]) > a.DICTIONARY_LEAST
    romanian = "Comanda este confirmata pentru livrare in data de martie si soferul ajunge la poarta"
    assert a.is_foreign(romanian, "en", None, got) and not a.is_foreign("loads trucked driver arrives delivering pallets gate", "en", None, got)
    assert not a.is_foreign("loads trucked", "en", None, got) and a.is_foreign("нужна машина до склада", "en", None, {})
    assert a.language_dictionaries(spark.createDataFrame([], "id string, language string, messages array<struct<role: string, content: string>>")) == {}
