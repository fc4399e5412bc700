import random

import pytest

from millrace.llm.leakage import find_leaks, myers_search, piece_words
from millrace.llm.text import words


def test_words():
    assert words("<p>Ёлка,<b>bo</b>ld­​x<br/>y_z") == ["елка", "boldx", "y", "z"]
    assert words(None) == [] and words("") == [] and words("a < b > c") == ["a", "b", "c"]


def semi_global(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(t, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return min(row)


def test_myers_as_dynamic_programming():
    rnd = random.Random(2)
    for _ in range(400):
        p = [rnd.choice("abcd") for _ in range(rnd.randrange(1, 10))]
        t = [rnd.choice("abcd") for _ in range(rnd.randrange(0, 14))]
        assert myers_search(p, t) == semi_global(p, t)


def test_piece_words():
    assert piece_words(12, 1) == 4 and piece_words(12, 0) == 6
    with pytest.raises(ValueError, match="small"):
        piece_words(2, 5)


def docs(spark, rows):
    return spark.createDataFrame([(*r, "e", 1) for r in rows], "doc_id bigint, text string, item_id string, edits int")


ITEM = [f"i{n}" for n in range(40)]


def corpus(seed):
    rnd = random.Random(seed)
    items = [[f"t{k}w{rnd.randrange(500)}" for _ in range(rnd.randrange(10, 50))] for k in range(6)]
    rows, texts = [], []
    for d in range(120):
        k = rnd.randrange(6)
        n = rnd.randrange(6, 20)
        at = rnd.randrange(max(1, len(items[k]) - n))
        part = items[k][at : at + n]
        if rnd.random() < 0.6:  # an edit: replaced, dropped or inserted
            x = rnd.randrange(len(part))
            part = rnd.choice([part[:x] + ["q"] + part[x + 1 :], part[:x] + part[x + 1 :], part[:x] + ["q"] + part[x:]])
        text = [f"z{rnd.randrange(50)}" for _ in range(rnd.randrange(30))] + part + [f"z{rnd.randrange(50)}" for _ in range(rnd.randrange(30))]
        texts.append(text)
        rows.append((d, ", ".join(text).upper()))
    return items, rows, texts


@pytest.mark.parametrize("routed", [False, True])
def test_windows_as_brute_force(spark, monkeypatch, routed):
    """Least distance of every window of every item by dynamic programming; with and without the items in one automaton."""
    import millrace.llm.leakage as m

    items, rows, texts = corpus(5)
    want = {}
    for d, text in enumerate(texts):
        for j, it in enumerate(items):
            least = min((semi_global(it[x : x + 12], text) for x in range(len(it) - 11)), default=9)
            if least <= 1:
                want[d, f"I{j}"] = least
    if routed:
        monkeypatch.setattr(m, "BLOCK_CHARS", 300)
        monkeypatch.setattr(m, "CELL_DOCS", 30)
    ii = spark.createDataFrame([(f"I{j}", " ".join(it)) for j, it in enumerate(items)], "item_id string, passage string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in find_leaks(docs(spark, rows), ii).collect()}
    assert got == want and {0, 1} == set(want.values())


def test_error_budget_and_edges(spark):
    edited = ITEM[:6] + ["other"] + ITEM[7:12]
    rows = [(1, " ".join(ITEM[:12])), (2, " ".join(edited)), (3, " ".join(ITEM[:8])), (4, None), (5, ""), (None, " ".join(ITEM)), (1, " ".join(ITEM)), (6, "x " * 200_000 + " ".join(ITEM[20:33]))]
    items = spark.createDataFrame([("a", " ".join(ITEM), 1), ("b", None, 1), ("c", "too short", 1), ("a", " ".join(ITEM), 1)], "item_id string, passage string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): (r["exact_words"], r["edits"]) for r in find_leaks(docs(spark, rows), items).collect()}
    assert got[1, "a"] == (40, 0) and got[2, "a"] == (0, 1) and got[None, "a"][0] == 40 and got[6, "a"][0] == 13 and (3, "a") not in got
    assert find_leaks(docs(spark, []), items).count() == 0 and find_leaks(docs(spark, rows), items.limit(0)).count() == 0
