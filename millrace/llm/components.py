"""Splits that keep related records together: Hash-to-Min components and rendezvous hashing.

Every record names some entities (here: customer and route). Entities named by
one record are linked; the components of that graph go whole into one split.
The clusters of Hash-to-Min are kept as (node, member) rows, never as one
collected set, so a component of any size is spread over tasks. Weighted
rendezvous hashing places every component; nothing is placed on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import canonical_key
from millrace.session import cut, hot_keys, salted_join


def record_entities(records: DataFrame, id_col: str, entity_cols: dict[str, str]) -> DataFrame:
    """(record, record_id, low, nodes): the distinct rows of each record with their entity nodes; ``low`` is the record's smallest node.

    ``entity_cols`` maps a column to the prefix of its nodes. Records without a
    usable id are one per distinct set of entities and have a null record_id.
    Null keys are no nodes; a record without any has a null ``low``. Written
    once, as everything else is computed from it.
    """
    nodes = F.array_compact(F.array(*[F.concat(F.lit(p + ":"), canonical_key(c)) for c, p in entity_cols.items()]))
    read = records.select(canonical_key(id_col).alias("_key"), F.col(id_col).alias("record_id"), nodes.alias("nodes"))
    record = F.coalesce("_key", F.concat(F.lit("?"), F.concat_ws("|", "record_id", "nodes")))
    rows = read.select(record.alias("record"), "record_id", "nodes").distinct()
    return cut(rows.withColumn("low", F.min(F.array_min("nodes")).over(Window.partitionBy("record"))))


def entity_edges(entities: DataFrame) -> DataFrame:
    """Distinct (a, b): each record's smallest entity with each of its entities; (a, a) for a lone one."""
    return entities.filter("low is not null").select(F.col("low").alias("a"), F.explode("nodes").alias("b")).distinct()


def hash_to_min(edges: DataFrame, hot_floor: int = 200_000) -> DataFrame:
    """(node, component) of the undirected graph ``edges`` (a, b); component is the smallest node.

    Each round, every node sends its cluster to the cluster's minimum and the
    minimum to every node of the cluster, until the clusters no longer change:
    every round but the last changes them, so it ends, however long the chains are.
    Hub nodes (the minimum of a large component) are salted in the join with
    the minima. Null ends are dropped; an empty graph has no rows.
    """
    edges = edges.filter("a is not null and b is not null")
    clusters = cut(
        edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("member")), F.struct(F.col("b").alias("node"), F.col("a").alias("member")), F.struct(F.col("a").alias("node"), F.col("a").alias("member")), F.struct(F.col("b").alias("node"), F.col("b").alias("member")))).alias("x")).select("x.*").distinct()
    )
    state = None
    while True:
        # Count and sum of the row hashes tell whether a round changed anything.
        now = clusters.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == now or not now["n"]:
            break
        state = now
        minima = clusters.groupBy("node").agg(F.min("member").alias("low"))
        if now["n"] >= hot_floor:
            hot = hot_keys(clusters, ["node"], now["n"], 0.005, hot_floor)
            joined = salted_join(clusters, minima, ["node"], hot, "member", "inner")
        else:
            joined = clusters.join(minima, "node")
        sent = F.array(
            F.struct(F.col("low").alias("node"), F.col("member").alias("member")),
            F.struct(F.col("member").alias("node"), F.col("low").alias("member")),
        )
        clusters = cut(joined.select(F.explode(sent).alias("x")).select("x.*").distinct())
    return clusters.groupBy("node").agg(F.min("member").alias("component"))


def record_components(records: DataFrame, id_col: str, entity_cols: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """((record_id, component) per record, (node, component) per entity). A record without entities is its own component."""
    entities = record_entities(records, id_col, entity_cols)
    parts = hash_to_min(entity_edges(entities))
    keyed = entities.groupBy("record").agg(F.min("record_id").alias("record_id"), F.min("low").alias("node"))
    hot = hot_keys(entities.filter("low is not null").select(F.col("low").alias("node")), ["node"], entities.count())
    joined = salted_join(keyed, parts, ["node"], hot, "record")
    return joined.select("record_id", F.coalesce("component", "record").alias("component")), parts


def held_out_components(parts: DataFrame, held: DataFrame, key_col: str, prefix: str) -> DataFrame:
    """Distinct components of the held-out entities ``held[key_col]``."""
    nodes = held.select(F.concat(F.lit(prefix + ":"), canonical_key(key_col)).alias("node")).filter("node is not null").distinct()
    return parts.join(nodes, "node", "left_semi").select("component").distinct()


def held_out_records(records: DataFrame, id_col: str, entity_cols: dict[str, str], held: DataFrame, key_col: str, prefix: str) -> DataFrame:
    """(record_id) of the records that use a held-out entity or hang together with one.

    Null and digitless keys link nothing; copies of a record give one row; a
    held-out key that no record uses does nothing.
    """
    comps, parts = record_components(records, id_col, entity_cols)
    out = held_out_components(parts, held, key_col, prefix)
    return comps.join(out, "component", "left_semi").select("record_id")


def rendezvous_scores(component: str, splits: list[str], seed: int) -> Column:
    """array<double>, one per split: -1 / ln(u), u being the first 13 hex digits of sha256(seed:split:component) as a fraction.

    Weighted rendezvous hashing gives a component to the split with the largest weight * score.
    """
    out = []
    for s in splits:
        h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(s), F.col(component)), 256), 1, 13), 16, 10)
        out.append(F.lit(-1.0) / F.log((h.cast("double") + 0.5) / float(16**13)))
    return F.array(*out)


def winner(scores: str, splits: list[str], weights: dict[str, float], room: dict[str, float] | None = None, size: str | None = None) -> Column:
    """The split with the largest weight * score, ties to the later name. With ``room``, only splits that can hold ``size`` compete, or else the largest."""
    widest = max(sorted(splits), key=lambda s: room[s]) if room else None
    offers = []
    for i, s in enumerate(splits):
        offer = F.struct((F.lit(float(weights[s])) * F.col(scores)[i]).alias("score"), F.lit(s).alias("split"))
        offers.append(offer if room is None or s == widest else F.when(F.col(size) <= room[s], offer))
    return F.array_max(F.array_compact(F.array(*offers)))["split"]


def calibrated_weights(sizes: DataFrame, splits: list[str], room: dict[str, float], rounds: int = 24) -> dict[str, float]:
    """Weights with which hashing of whole components comes nearest to ``room``, from ``sizes`` (n, scores).

    Starts at the shares and moves each weight by what its split lacks. Only one
    sum per split and round comes to the driver; every component is placed by
    its hash alone. The best weights seen hold.
    """
    total = sum(room.values())
    weights = {s: room[s] / total for s in splits}
    best, least, pace = dict(weights), math.inf, 1.0
    for _ in range(rounds):
        got = dict.fromkeys(splits, 0) | {r["split"]: r["n"] for r in sizes.groupBy(winner("scores", splits, weights, room, "n").alias("split")).agg(F.sum("n").alias("n")).collect()}
        off = max(abs(got[s] - room[s]) for s in splits)
        if off < least:
            best, least = dict(weights), off
        else:
            pace *= 0.7
        if off <= total * 1e-4:
            break
        weights = {s: weights[s] * ((room[s] + total * 1e-3) / (got[s] + total * 1e-3)) ** pace for s in splits}
        whole = sum(weights.values())
        weights = {s: w / whole for s, w in weights.items()}
    return best


def assign_splits(
    records: DataFrame, id_col: str, entity_cols: dict[str, str], held: DataFrame, key_col: str, prefix: str, targets: DataFrame, seed: int = 42
) -> DataFrame:
    """(record_id, component, split): whole components in one split, near the targets (split, share).

    Components with a held-out entity go to ``test_ood``. All others are placed
    by weighted rendezvous hashing: the largest weight * score holds. A
    component larger than a split's whole share can't go there (nor anywhere
    but to the largest split if it exceeds all). The weights are fitted to the
    sizes of the components, so shares are met as nearly as whole components
    let them. Targets with a null or non-positive share get nothing.
    """
    shares = {r["split"]: float(r["share"]) for r in targets.groupBy("split").agg(F.max("share").alias("share")).collect() if r["split"] and r["share"] and r["share"] > 0}
    if not shares:
        raise ValueError("no split has a positive share")
    splits, whole = sorted(shares), math.fsum(shares.values())
    comps, parts = record_components(records, id_col, entity_cols)
    comps = cut(comps)
    ood = held_out_components(parts, held, key_col, prefix).withColumn("_ood", F.lit(True))
    sizes = cut(
        comps.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(ood, "component", "left")
        .withColumn("scores", rendezvous_scores("component", splits, seed))
    )
    free = sizes.filter("_ood is null")
    total = free.agg(F.sum("n")).first()[0] or 0
    room = {s: total * w / whole for s, w in shares.items()}
    weights = calibrated_weights(free, splits, room) if total else shares
    split = sizes.select("component", F.when(F.col("_ood"), "test_ood").otherwise(winner("scores", splits, weights, room, "n")).alias("split"))
    hot = hot_keys(comps, ["component"], comps.count())
    return salted_join(comps, split, ["component"], hot, "record_id", "inner").select("record_id", "component", "split")
