import random

import pytest

from millrace.llm.components import assign_splits, hash_to_min, held_out_records

ENTITIES = {"customer": "c", "route": "r"}


def loads(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "load_id string, customer string, route string, component string, record string")


def union_find(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "pairs"])
def test_components_as_union_find(spark, kind):
    rnd = random.Random(3)
    edges = {
        "random": [(f"n{rnd.randrange(80):03}", f"n{rnd.randrange(80):03}") for _ in range(70)],
        "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)],
        "star": [("hub", f"n{i:03}") for i in range(60)],
        "pairs": [(f"n{2 * i:03}", f"n{2 * i + 1:03}") for i in range(20)],
    }[kind]
    got = {r["node"]: r["component"] for r in hash_to_min(spark.createDataFrame(edges, "a string, b string"), hot_floor=50).collect()}
    want = union_find(edges)
    assert set(got) == set(want)
    first = {}
    for n, c in want.items():
        first[c] = min(first.get(c, n), n)
    assert got == {n: first[c] for n, c in want.items()}


def test_held_out_chain_nulls_and_spelling(spark):
    rows = [("L1", "C1", "R1"), ("L2", "c-01", "R2"), ("L3", "C9", "r 02"), ("L4", None, "R7"), ("L5", "C9", "N/A"), ("L6", None, None), ("L7", "C5", "R5"), ("L1", "C1", "R1"), (None, "C9", None)]
    held = spark.createDataFrame([("R0001", "p"), (None, "p"), ("R88", "p")], "route_id string, plan string")
    got = sorted(str(r["record_id"]) for r in held_out_records(loads(spark, rows), "load_id", ENTITIES, held, "route_id", "r").collect())
    assert got == ["L1", "L2", "L3", "L5", "None"]


def test_empty(spark):
    held = spark.createDataFrame([], "route_id string")
    assert held_out_records(loads(spark, []), "load_id", ENTITIES, held, "route_id", "r").count() == 0
    targets = spark.createDataFrame([("train", 1.0)], "split string, share double")
    assert assign_splits(loads(spark, []), "load_id", ENTITIES, held, "route_id", "r", targets).count() == 0


def test_splits_keep_components_and_targets(spark):
    rnd = random.Random(1)
    rows = [(f"L{i}", f"C{0 if i < 900 else 1 + i % 400}", f"R{10_000 if i < 900 else 1 + i % 400}") for i in range(3000)]
    rnd.shuffle(rows)
    held = spark.createDataFrame([("R7",)], "route_id string")
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1), ("none", None)], "split string, share double")
    out = assign_splits(loads(spark, rows), "load_id", ENTITIES, held, "route_id", "r", targets).collect()
    assert len(out) == 3000
    where = {}
    for r in out:
        where.setdefault(r["component"], set()).add(r["split"])
    assert all(len(s) == 1 for s in where.values())
    share = {s: sum(r["split"] == s for r in out) / 3000 for s in ("train", "val", "test", "test_ood")}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["val"] - 0.1) < 0.03 and share["test_ood"] > 0


def test_no_targets(spark):
    with pytest.raises(ValueError, match="positive"):
        assign_splits(loads(spark, [("L1", "C1", "R1")]), "load_id", ENTITIES, spark.createDataFrame([], "route_id string"), "route_id", "r", spark.createDataFrame([], "split string, share double"))


def test_every_component_is_placed_by_its_hash(spark):
    import hashlib
    import math

    from millrace.llm.components import rendezvous_scores, winner

    names, splits, weights = [f"c{i}" for i in range(200)], ["test", "train", "val"], {"train": 0.8, "val": 0.1, "test": 0.1}
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "component string, n int").withColumn("scores", rendezvous_scores("component", splits, 7))
    got = {r["component"]: r["s"] for r in df.select("component", winner("scores", splits, weights).alias("s")).collect()}

    def score(s, c):
        u = (int(hashlib.sha256(f"7:{s}:{c}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return weights[s] * -1 / math.log(u)

    assert got == {c: max(splits, key=lambda s: score(s, c)) for c in names}
    room = {"train": 150.0, "val": 50.0, "test": 50.0}
    tight = {r["component"]: r["s"] for r in df.select("component", winner("scores", splits, weights, room, "n").alias("s")).collect()}
    assert all(tight[c] == "train" for i, c in enumerate(names) if i > 50) and tight["c3"] == got["c3"]


def test_a_long_chain_settles_without_a_limit_on_rounds(spark):
    edges = [(f"n{i:05}", f"n{i + 1:05}") for i in range(3000)]
    got = hash_to_min(spark.createDataFrame(edges, "a string, b string"))
    assert got.count() == 3001 and {r["component"] for r in got.select("component").distinct().collect()} == {"n00000"}
