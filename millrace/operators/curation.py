"""Curation of samples for people: covering selection, review verdicts, top-up of rare cases, warnings on values."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import text_hash


def cover(df: DataFrame, id_col: str, features: str, limit: int, seed: int = 42) -> list[str]:
    """At most ``limit`` ids that together show as many features as they can, again and again once all are shown.

    ``features`` is an array column. Rows of equal feature sets are
    interchangeable, so the choice is made among sets: the driver gets at most
    ``limit`` ids of each different set, in the order of sha256('seed:id'), and
    their number is bounded by the sets, not by the rows. Gains only shrink
    while features get covered, so a heap of old gains finds the best set
    without looking at all of them; ties go to the smaller hash.
    """
    fs = F.array_sort(F.array_distinct(F.coalesce(F.col(features), F.array().cast("array<string>"))))
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), fs.alias("fs")).withColumn("h", text_hash(F.concat_ws(":", F.lit(str(seed)), "id")))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("fs").orderBy("h", "id"))).filter(F.col("_r") <= limit)
    sets = first.groupBy("fs").agg(F.array_sort(F.collect_list(F.struct("h", "id"))).alias("ids")).collect()
    bit = {f: 1 << i for i, f in enumerate(sorted({f for r in sets for f in r["fs"]}))}
    queues = [(sum(bit[f] for f in r["fs"]), [(x["h"], x["id"]) for x in reversed(r["ids"])]) for r in sets]
    out: list[str] = []
    while len(out) < limit:
        shown, before = 0, len(out)
        heap = [(-mask.bit_count(), ids[-1], n) for n, (mask, ids) in enumerate(queues) if ids and mask]
        heapq.heapify(heap)
        while heap and len(out) < limit:
            gain, head, n = heap[0]
            mask, ids = queues[n]
            now = -(mask & ~shown).bit_count()
            if now == 0:
                heapq.heappop(heap)
            elif now != gain or ids[-1] != head:
                heapq.heapreplace(heap, (now, ids[-1], n))
            else:
                heapq.heappop(heap)  # whatever else has these features adds nothing in this pass
                out.append(ids.pop()[1])
                shown |= mask
        if len(out) == before:
            break
    return out


def apply_verdicts(candidates: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with their verdict, null where not yet reviewed; UNKNOWN_ID issues of verdicts on no candidate)."""
    one = verdicts.groupBy("id").agg(F.min("verdict").alias("verdict"))
    lost = verdicts.join(candidates.select("id"), "id", "left_anti").select(F.col("id").alias("record_id"), F.lit(None).cast("string").alias("split"), F.lit("UNKNOWN_ID").alias("code"), F.lit("no such candidate").alias("message"))
    return candidates.join(one, "id", "left"), lost


def top_up(df: DataFrame, key: str, case: str, eligible: dict[str, Column], floors: dict[str, int], seed: int, clean: str = "clean") -> DataFrame:
    """(key, case) of clean rows to be made over so that each case has at least its floor.

    Rows are taken in the order of sha256('seed:key'); a row is given to one
    case only, the first in order of the names that still lacks rows.
    """
    have = {r[0]: r[1] for r in df.groupBy(case).count().collect()}
    out, order = None, text_hash(F.concat_ws(":", F.lit(str(seed)), F.col(key)))
    free = df.filter(F.col(case) == clean)
    for name in sorted(floors):
        want = floors[name] - have.get(name, 0)
        if want > 0:
            chosen = free.filter(eligible[name]).orderBy(order, key).limit(want).select(key, F.lit(name).alias("case"))
            out = chosen if out is None else out.unionByName(chosen)
            free = free.join(chosen.select(key), key, "left_anti")
    return out if out is not None else df.select(key, F.lit(None).cast("string").alias("case")).limit(0)


def value_warnings(known_cities: Sequence[str], most_kg: float = 25_000) -> Column:
    """Array of warnings on a card row (origin, destination, pickup_date, delivery_date, request_date, weight_kg)."""
    unknown = ~F.col("origin").isin(*known_cities) | ~F.col("destination").isin(*known_cities)
    return F.array_compact(F.array(
        F.when(unknown, F.lit("unknown_city")), F.when(F.col("pickup_date") < F.col("request_date"), F.lit("pickup_before_request")),
        F.when(F.col("delivery_date") < F.col("pickup_date"), F.lit("delivery_before_pickup")), F.when(F.col("weight_kg") > most_kg, F.lit("weight_implausible")),
    ))
