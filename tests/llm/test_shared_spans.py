import random

import pytest

from millrace.llm.shared_spans import Cut, cut_window, shared_spans, shared_stretches


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id bigint, text string, digest bigint, h bigint, at string")


def positions(rows):
    """doc -> every position of its shared stretches."""
    out = {}
    for r in rows:
        runs = r["more"] or [r["at"], r["at"] + 1]
        out.setdefault(r["doc_id"], set()).update(x for a, b in zip(runs[::2], runs[1::2]) for x in range(a, b))
    return out


def brute(rows, n):
    where = {}
    for d, t in rows:
        if d is not None and t:
            for i in range(len(t) - n + 1):
                where.setdefault(t[i : i + n], {}).setdefault(d, set()).add(i)
    out = {}
    for ds in where.values():
        if len(ds) > 1:
            for d, at in ds.items():
                out.setdefault(d, set()).update(at)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_brute_force(spark, seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdefghij клмн.") for _ in range(n))
    spans = [text(rnd.randrange(90, 150)) for _ in range(6)] + ["a" * 130, "xy" * 70]
    rows = []
    for d in range(60):
        s = rnd.choice(spans)
        rows.append((d, text(rnd.randrange(80)) + s[rnd.randrange(20) : len(s) - rnd.randrange(20)] + text(rnd.randrange(80))))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, "q" * 500), (103, text(5))]
    want = brute(rows, 100)
    got = positions(shared_stretches(docs(spark, rows), min_chars=100).collect())
    assert got == want and want


def test_coverage_and_edges(spark):
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    s = text(450)
    twice = s + text(50) + s
    rows = [(1, text(100) + s + text(70)), (2, s), (3, twice), (4, None), (5, ""), (None, s), (6, text(500) * 2), (7, text(399)), (2, s), (8, "😀" * 10 + text(800))]
    got = {r["doc_id"]: (r["shared_chars"], r["n_chars"]) for r in shared_spans(docs(spark, [(d, t.encode("utf-16", "surrogatepass").decode("utf-16") if t else t) for d, t in rows])).collect()}
    assert got == {1: (450, 620), 2: (450, 450), 3: (900, 950)}
    assert shared_spans(docs(spark, [])).count() == 0


def test_hot_span(spark, monkeypatch):
    """A span that most documents have goes through the salted plan and gives the same rows."""
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    s = text(150)
    rows = [(d, text(60) + s + text(60)) for d in range(40)] + [(100 + d, text(300)) for d in range(20)]
    import millrace.llm.shared_spans as m

    rows += [(200 + d, text(60) + "-" * 400 + text(60) + "-=" * 120) for d in range(30)]
    monkeypatch.setattr(m, "HOT_FLOOR", 10)
    monkeypatch.setattr(m, "COMMON_FLOOR", 10)
    monkeypatch.setattr(m, "OUT_ROWS", 50)
    assert positions(shared_stretches(docs(spark, rows), min_chars=100).collect()) == brute(rows, 100)


def test_a_line_of_one_character_gives_one_row_a_document(spark):
    """Documents with the same long rule line: its one different stretch is one row each, not one row per position."""
    rnd = random.Random(6)
    rows = [(d, "".join(rnd.choice("abcdefgh") for _ in range(300)) + chr(0x4E00 + d) + "-" * 10_000) for d in range(60)]
    got = shared_stretches(docs(spark, rows)).collect()
    assert len(got) == 60 and all(r["more"] and r["more"][1] - r["more"][0] == 9601 for r in got)
    assert {r["shared_chars"] for r in shared_spans(docs(spark, rows)).collect()} == {10_000}


def test_window():
    with pytest.raises(ValueError, match="small"):
        cut_window(40)
    assert len(Cut("short", 184).cuts) == 0
