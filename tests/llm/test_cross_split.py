import random

import pytest

from millrace.llm.cross_split import cross_split_pairs, word_distance

SCHEMA = "id string, split string, group_id string, source_id string, messages array<struct<role: string, content: string>>, text_key string, symbols string"
PLAN = "load_id string, split string, ood_reason string"


def rec(i, split, load, text):
    return (i, split, load and f"load:{load}", load and f"d@1:{load}", [("system", "s"), ("user", text)], "k", "s")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_word_distance():
    rnd = random.Random(0)
    for _ in range(400):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(12)))
        b = "".join(rnd.choice("abc") for _ in range(rnd.randrange(12)))
        d = edit_distance(a, b)
        assert word_distance(a, b, 20) == d
        assert (word_distance(a, b, 3) <= 3) == (d <= 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_pairs_as_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows, texts = [], {}
    base = [[rnd.choice(vocab) for _ in range(rnd.randrange(1, 40))] for _ in range(25)]
    for n in range(90):
        ws = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 9)):
            at = rnd.randrange(len(ws) + 1)
            kind = rnd.randrange(3)
            if kind == 0:
                ws.insert(at, rnd.choice(vocab))
            elif ws and at < len(ws):
                ws[at : at + 1] = [] if kind == 1 else [rnd.choice(vocab)]
        i = f"r{n:03}"
        texts[i] = ("train" if n % 3 else rnd.choice(["val", "test", "bench"]), ws)
        rows.append(rec(i, texts[i][0], None, "Date: 1\n\n" + "  ".join(w.upper() if rnd.random() < 0.3 else w for w in ws)))
    got = {(r["id_a"], r["id_b"]) for r in cross_split_pairs(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], PLAN)).collect()}
    want = set()
    for a, (sa, wa) in texts.items():
        for b, (sb, wb) in texts.items():
            if a < b and (sa == "train") != (sb == "train") and wa and wb and edit_distance(wa, wb) <= max(len(wa), len(wb)) // 5:
                want.add((a, b))
    assert got == want and want


def test_loads_plan_nulls_and_copies(spark):
    rows = [rec("a", "train", "LOAD01", "x\none two three"), rec("b", "val", "Load-1", "x\nfour five six"), rec("c", None, "LOAD2", "x\nseven eight"), rec("d", "train", "LOAD2", "y\nnine ten"), rec("a", "train", "LOAD01", "x\none two three"),
            rec("e", None, None, "x\none two three"), rec(None, "val", "LOAD1", "x\nq"), rec("f", "val", None, "x\n"), rec("g", "train", None, "x\n"), rec("h", "test", None, "Z\n ONE two three "), ("i", "val", None, None, None, "k", "s")]
    plan = spark.createDataFrame([("LOAD0002", "test_ood", None), ("LOAD0002", "test_ood", None), (None, "val", None), ("LOAD3", None, None)], PLAN)
    out = cross_split_pairs(spark.createDataFrame(rows, SCHEMA), plan).collect()
    assert {(r["id_a"], r["id_b"]) for r in out} == {("a", "b"), ("c", "d"), ("a", "h")}
    assert {r["eval_split"] for r in out} == {"val", "test_ood", "test"}


def test_empty(spark):
    assert cross_split_pairs(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], PLAN)).count() == 0


def test_grid_blocks_and_coverage(spark, monkeypatch):
    """Many shards and cells, and texts cut in several blocks, give the same pairs; matched intervals of all partners merge."""
    import millrace.llm.cross_split as m

    monkeypatch.setattr(m, "SHARD_PIECES", 40)
    monkeypatch.setattr(m, "CELL_TEXTS", 5)
    monkeypatch.setattr(m, "BLOCK_WORDS", 24)
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randrange(30, 200))] for _ in range(12)]
    rows, texts = [], {}
    for n in range(80):
        ws = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, len(ws) // 4)):
            ws[rnd.randrange(len(ws))] = rnd.choice(vocab)
        texts[f"r{n:03}"] = ("val" if n % 4 == 0 else "train", ws)
        rows.append(rec(f"r{n:03}", texts[f"r{n:03}"][0], None, "Date: 1\n" + " ".join(ws)))
    table, plan = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], PLAN)
    want, covered = set(), {}
    for a, (sa, wa) in texts.items():
        for b, (sb, wb) in texts.items():
            if sa == "val" and sb == "train" and edit_distance(wa, wb) <= max(len(wa), len(wb)) // 5:
                want.add((min(a, b), max(a, b)))
                pairs = set(zip(wb, wb[1:]))
                covered.setdefault(a, set()).update(x for i in range(len(wa) - 1) if (wa[i], wa[i + 1]) in pairs for x in (i, i + 1))
    assert {(r["id_a"], r["id_b"]) for r in cross_split_pairs(table, plan).collect()} == want and want
    assert {r["eval_id"]: r["covered_words"] for r in m.evaluation_coverage(table, plan).collect()} == {a: len(c) for a, c in covered.items()}


def test_hot_texts_and_loads(spark, monkeypatch):
    """Copies of one text and records of one load are spread over tasks and give the same pairs."""
    import millrace.llm.cross_split as m

    monkeypatch.setattr(m, "HOT_ROWS", 5)
    rows = [rec(f"t{i:02}", "train", "LOAD1" if i < 12 else None, "x\nsame words in every text " + ("here" if i % 2 else "there")) for i in range(24)]
    rows += [rec(f"v{i}", "val", "LOAD1" if i < 2 else None, "x\nsame words in every text here") for i in range(8)]
    table, plan = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], PLAN)
    got = {(r["id_a"], r["id_b"]) for r in cross_split_pairs(table, plan).collect()}
    assert got == {(f"t{i:02}", f"v{j}") for i in range(24) for j in range(8)}


def shuffled_bytes(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_not_copied_to_every_shard(spark, monkeypatch):
    """With many shards and cells only the runs that may match are sent to each, so what is moved stays near the size of the texts."""
    import millrace.llm.cross_split as m

    monkeypatch.setattr(m, "SHARD_PIECES", 100)
    rnd = random.Random(5)
    base = [[f"{rnd.getrandbits(40):x}" for _ in range(400)] for _ in range(30)]
    rows = []
    for n in range(120):
        ws = list(base[n % 30])
        for _ in range(20):
            ws[rnd.randrange(len(ws))] = f"{rnd.getrandbits(40):x}"
        rows.append(rec(f"r{n:03}", "val" if n < 30 else "train", None, "Date: 1\n" + " ".join(ws)))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        before = shuffled_bytes(spark)
        got = {(r["id_a"], r["id_b"]) for r in cross_split_pairs(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], PLAN)).collect()}
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert got == {(f"r{n % 30:03}", f"r{n:03}") for n in range(30, 120)}
    size = sum(len(r[4][1][1]) for r in rows)
    assert moved < 4 * size
