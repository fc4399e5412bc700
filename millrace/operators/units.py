"""Weights recorded in different units: found in text, judged in numbers, converted to kilograms.

Text: an automaton over unit aliases (longest match) and the context of the
number. Numbers: compared with the weights stated in the requests of the same
record or load; where there is none, by a mixture of units fitted per feed and
month: what a number weighs in each unit is held against the weights that feed
is known to carry, and how often each unit is used there is estimated by
expectation-maximisation over all its numbers. No sizes are set by hand.
The conversion factors are a fixed table of seven rows that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import canonical_key
from millrace.functions.unit_text import KILOGRAMS, find_weights
from millrace.session import cut, hot_keys, salted_join

UNITS = tuple(KILOGRAMS)
#: Cells per e-fold of the distribution of weights and of the numbers that are judged alike.
CELLS, FINE = 10, 40
#: Before any load is judged: median and spread (of the logarithm) of a truck load in kilograms and as how many judged ones they count, and how often
#: a unit is used where another is usual; short tons and quintals hardly differ from tonnes and hundredweights in size, so numbers speak less for them.
PRIOR_KG, PRIOR_SPREAD, PRIOR_ROWS = 9_000.0, 0.7, 20.0
USUAL, SELDOM, DOUBTED = 1.0, 0.01, {"q": 0.1, "st": 0.1}
#: Judged loads that all feeds' weights count as in a feed, loads that a month takes from its feed and from its neighbours, and the share of numbers like none seen.
FROM_ALL, FROM_FEED, FROM_NEIGHBOURS, ODD = 200.0, 2.0, 4.0, 0.05
_LOW, _HIGH = -5.0, 25.0


def weight_cells(log_kg: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts per cell of the logarithm of kilograms, smoothed over neighbours."""
    at = np.clip(np.floor((log_kg - _LOW) * CELLS).astype(int), 0, int((_HIGH - _LOW) * CELLS) - 1)
    return np.convolve(np.bincount(at, weights=n, minlength=int((_HIGH - _LOW) * CELLS)), [0.25, 0.5, 0.25], "same")


def prior_cells() -> np.ndarray:
    """Share of each cell before any load is judged."""
    middle = _LOW + (np.arange(int((_HIGH - _LOW) * CELLS)) + 0.5) / CELLS
    p = np.exp(-0.5 * ((middle - np.log(PRIOR_KG)) / PRIOR_SPREAD) ** 2)
    return p / p.sum()


def likelihoods(log_value: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(numbers, units): how likely a number is in each unit, given the share of the cells of weight."""
    logs = log_value[:, None] + np.log([KILOGRAMS[u] for u in UNITS])[None, :]
    return share[np.clip(np.floor((logs - _LOW) * CELLS).astype(int), 0, len(share) - 1)]


def fit_feed(rows: pd.DataFrame, overall: np.ndarray, usual: str = "lb", rounds: int = 60) -> pd.DataFrame:
    """``rows`` (month, cell, seen, n) of one feed with the likeliest ``unit`` of each: expectation-maximisation of the share of units per month.

    Months borrow from their feed and their neighbours; judged rows keep their unit.
    """
    own = np.array([UNITS.index(u) if u in UNITS else -1 for u in rows["seen"]])
    log_value, n = (rows["cell"].to_numpy(np.float64) + 0.5) / FINE, rows["n"].to_numpy(np.float64)
    known = own >= 0
    judged = weight_cells(log_value[known] + np.log([KILOGRAMS[UNITS[u]] for u in own[known]]), n[known]) if known.any() else np.zeros_like(overall)
    share = (judged + FROM_ALL * overall) / (judged.sum() + FROM_ALL)
    # Numbers like none seen may be any weight, but hardly one above the heaviest.
    light = np.where(np.cumsum(overall) < 0.9999, 1.0, 1e-6)
    like = likelihoods(log_value, (1 - ODD) * share + ODD * (0.5 * overall + 0.5 * light / light.sum())) * np.array([DOUBTED.get(u, 1.0) for u in UNITS])
    months, at = np.unique(rows["month"].to_numpy(), return_inverse=True)
    weight = np.array([USUAL if u == usual else SELDOM for u in UNITS])
    of_month = np.tile(weight / weight.sum(), (len(months), 1))
    for _ in range(rounds):
        belief = like * of_month[at]
        belief /= belief.sum(axis=1, keepdims=True)
        belief[known] = np.eye(len(UNITS))[own[known]]
        belief *= n[:, None]
        counts = np.zeros((len(months), len(UNITS)))
        np.add.at(counts, at, belief)
        of_feed = (counts.sum(axis=0) + weight) / (counts.sum() + weight.sum())
        near = np.zeros_like(counts)
        near[1:] += counts[:-1]
        near[:-1] += counts[1:]
        counts += FROM_NEIGHBOURS * near / np.maximum(near.sum(axis=1, keepdims=True), 1e-9) + FROM_FEED * of_feed
        of_month = counts / counts.sum(axis=1, keepdims=True)
    return rows.assign(unit=np.array(UNITS, object)[(like * of_month[at]).argmax(axis=1)])


def judged_cells(judged: DataFrame) -> np.ndarray:
    """Share of each cell of weight over all judged rows (value, seen), with the prior as ``PRIOR_ROWS`` rows more. One row per cell, some hundreds, comes to the driver."""
    log_kg = F.log("value") + F.element_at(F.create_map(*[x for u, k in KILOGRAMS.items() for x in (F.lit(u), F.lit(float(np.log(k))))]), F.col("seen"))
    cells = judged.filter("seen is not null and value > 0").groupBy(F.greatest(F.lit(_LOW * CELLS), F.least(F.lit(_HIGH * CELLS), F.floor(log_kg * CELLS))).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = weight_cells(np.array([(r["c"] + 0.5) / CELLS for r in cells]), np.array([float(r["n"]) for r in cells])) if cells else 0.0
    total = counts + PRIOR_ROWS * prior_cells()
    return total / total.sum()


def factors(spark: SparkSession) -> DataFrame:
    """(unit, kg_per_unit): the conversion table."""
    return spark.createDataFrame(sorted(KILOGRAMS.items()), "unit string, kg_per_unit double")


def stated_weights(records: DataFrame) -> DataFrame:
    """(id, load, place, value, unit, per_piece, pieces, kg): the cargo weights in the user messages of each record.

    place is the order within the message; kg is the total, null where a weight
    per piece has no count of pieces beside it. Records of one id are one (the
    smallest message holds); null ids and messages give no rows.
    """
    user = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    load = F.coalesce(*[canonical_key(F.regexp_extract(F.col(c), r"([^:]*)$", 1)) for c in ("group_id", "source_id")])
    one = records.filter("id is not null").groupBy("id").agg(F.min(F.struct(user.alias("text"), load.alias("load"))).alias("r")).select("id", "r.*")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t, key in zip(pdf["id"], pdf["text"], pdf["load"], strict=True):
                for n, w in enumerate(find_weights(t)):
                    known = not (w.per_piece and not w.pieces)
                    rows.append((i, key, n, w.value, w.unit, w.per_piece, w.pieces, w.total_kg if known else None))
            out = pd.DataFrame(rows, columns=["id", "load", "place", "value", "unit", "per_piece", "pieces", "kg"])
            out["pieces"] = out["pieces"].astype("Int64")
            out["kg"] = out["kg"].astype("float64")
            yield out

    return one.select("id", "text", "load").mapInPandas(scan, "id string, load string, place int, value double, unit string, per_piece boolean, pieces bigint, kg double")


def matching_unit(value: Column, kg: Column, pieces: Column | None = None, rounding: float = 0.55, share: float = 0.03) -> Column:
    """struct(err, unit): the unit in which ``value`` is the weight ``kg``, null where none is.

    A number may be off by its rounding or by ``share``. Short tons, hardly
    apart from tonnes once rounded, need the closer match. With ``pieces``, the
    weight of one piece in kilograms counts as kilograms.
    """
    def offer(unit: str, want: Column) -> Column:
        err = F.abs(value - want) / want
        fits = (want > 0) & (F.abs(value - want) <= F.greatest(F.lit(rounding), want * share))
        return F.when(fits, F.struct((err + (0.04 if unit == "st" else 0.0)).alias("err"), F.lit(unit).alias("unit")))

    offers = [offer(u, kg / k) for u, k in KILOGRAMS.items()]
    if pieces is not None:
        offers.append(offer("kg", F.when(pieces > 1, kg / pieces)))
    return F.array_min(F.array_compact(F.array(*offers)))


def fine_cell(value: Column) -> Column:
    """Numbers of one cell (2.5 % wide) are judged alike; null for zero and negative ones."""
    return F.when(value > 0, F.floor(F.log(value) * FINE))


def load_units(loads: DataFrame, stated: DataFrame) -> DataFrame:
    """(load_id, value, unit, by): the unit of every load's weight_lbs; by is ``request`` or ``profile``.

    1. Where a request of the load states a weight, the unit in which the number
       is that weight.
    2. Else by the mixture of the load's feed and month (``fit_feed``). Its
       counts are aggregated first, so a feed of any size is one small group.

    Copies of a load are one row (the smallest of the earliest arrival holds).
    Null weights have no unit; zero and negative ones are kept as pounds. Null
    feeds and dates are a feed and a month of their own.
    """
    key = F.coalesce(canonical_key("load_id"), F.col("load_id"))
    one = (
        loads.filter(F.col("weight_lbs").isNotNull())
        .select(key.alias("load"), "load_id", F.col("weight_lbs").cast("double").alias("value"), F.coalesce("feed", F.lit("")).alias("feed"), F.coalesce(F.date_format("load_date", "yyyy-MM"), F.lit("")).alias("month"), "ingested_at")
        .groupBy("load")
        .agg(F.min("load_id").alias("load_id"), F.min(F.struct("ingested_at", "value", "feed", "month")).alias("r"))
        .select("load", "load_id", "r.value", "r.feed", "r.month")
    )
    one = cut(one)
    asked = stated.filter("kg is not null and load is not null").select("load", "kg", "id")
    hot = hot_keys(asked, ["load"], stated.count())
    seen = (
        salted_join(asked, one.select("load", "value"), ["load"], hot, "id", "inner")
        .groupBy("load")
        .agg(F.min(matching_unit(F.col("value"), F.col("kg"))).alias("m"))
        .select("load", F.col("m.unit").alias("seen"))
    )
    judged = cut(one.join(seen, "load", "left").withColumn("cell", fine_cell(F.col("value"))))
    overall = judged_cells(judged)
    counts = judged.filter("cell is not null").groupBy("feed", "month", "cell", "seen").agg(F.count(F.lit(1)).alias("n"))
    fitted = counts.groupBy("feed").applyInPandas(lambda pdf: fit_feed(pdf, overall), "feed string, month string, cell bigint, seen string, n bigint, unit string")
    usual = fitted.groupBy("feed", "month", "cell").agg(F.min("unit").alias("usual"))
    keys = ["feed", "month", "cell"]
    rows = judged.count()
    placed = salted_join(judged, usual, keys, hot_keys(judged.filter("cell is not null"), keys, rows, 0.005, 200_000), "load") if rows >= 200_000 else judged.join(usual, keys, "left")
    by = F.when(F.col("seen").isNotNull(), "request").otherwise("profile")
    return placed.select("load", "load_id", "value", F.coalesce("seen", "usual", F.lit("lb")).alias("unit"), by.alias("by"))


def extraction_units(extractions: DataFrame, stated: DataFrame) -> DataFrame:
    """(extraction_id, value, unit, by): the unit of derived.weight_total_kg, judged by the record's own request.

    A number that is the weight of one piece is a wrong value in kilograms, not
    another unit. Without a usable request the mixture of all extractions
    decides, in which kilograms are usual. Copies of an extraction are one row;
    null weights have no unit; zero and negative ones are kept as kilograms.
    """
    one = extractions.filter("extraction_id is not null").groupBy("extraction_id").agg(
        F.min(F.struct("record_id", F.col("derived.weight_total_kg").alias("value"), F.col("derived.pieces").alias("n"))).alias("r")
    ).select("extraction_id", "r.*").filter("value is not null")
    first = stated.filter("kg is not null").groupBy(F.col("id").alias("record_id")).agg(F.min(F.struct("place", "kg", "pieces")).alias("s")).select("record_id", "s.kg", "s.pieces")
    hot = hot_keys(one.filter("record_id is not null"), ["record_id"], extractions.count())
    joined = salted_join(one, first, ["record_id"], hot, "extraction_id")
    value = F.col("value")
    seen = F.when(F.col("kg").isNotNull(), F.coalesce(matching_unit(value, F.col("kg"), F.coalesce("n", "pieces"), rounding=0.0)["unit"], F.lit("kg")))
    judged = cut(joined.select("extraction_id", "value", seen.alias("seen"), fine_cell(value).alias("cell")))
    overall = judged_cells(stated.filter("kg is not null").select(F.col("kg").alias("value"), F.lit("kg").alias("seen")))
    # One row per cell and unit: some hundreds.
    counts = judged.filter("cell is not null").groupBy("cell", "seen").agg(F.count(F.lit(1)).alias("n")).withColumn("month", F.lit("")).withColumn("feed", F.lit(""))
    fitted = counts.groupBy("feed").applyInPandas(lambda pdf: fit_feed(pdf, overall, "kg"), "cell bigint, seen string, n bigint, month string, feed string, unit string")
    usual = F.broadcast(fitted.groupBy("cell").agg(F.min("unit").alias("usual")))
    by = F.when(F.col("seen").isNull(), "size").otherwise("request")
    return judged.join(usual, "cell", "left").select("extraction_id", "value", F.coalesce("seen", "usual", F.lit("kg")).alias("unit"), by.alias("by"))


def weights_in_kilograms(loads: DataFrame, extractions: DataFrame, records: DataFrame) -> DataFrame:
    """(table_name, row_id, place, value, unit, per_piece, weight_kg): every recorded weight with its unit, in kilograms.

    place numbers the weights of one message (0 elsewhere); weight_kg is what
    the number says, per piece where it is per piece. Empty tables give no
    rows; extra columns are not read.
    """
    stated = cut(stated_weights(records))
    no = F.lit(False).alias("per_piece")
    parts = [
        load_units(loads, stated).select(F.lit("loads").alias("table_name"), F.col("load_id").alias("row_id"), F.lit(0).alias("place"), "value", "unit", no),
        extraction_units(extractions, stated).select(F.lit("extractions").alias("table_name"), F.col("extraction_id").cast("string").alias("row_id"), F.lit(0).alias("place"), "value", "unit", no),
        stated.select(F.lit("sft_records").alias("table_name"), F.col("id").alias("row_id"), "place", "value", "unit", "per_piece"),
    ]
    every = reduce(DataFrame.unionByName, parts)
    return every.join(F.broadcast(factors(records.sparkSession)), "unit").select("table_name", "row_id", "place", "value", "unit", "per_piece", F.round(F.col("value") * F.col("kg_per_unit"), 6).alias("weight_kg"))


def foreign_units(weights: DataFrame) -> DataFrame:
    """(table_name, row_id, unit) of the rows not in the unit of their column: pounds in loads, kilograms elsewhere.

    A message with weights in several units gives the first that is not kilograms.
    """
    usual = F.when(F.col("table_name") == "loads", "lb").otherwise("kg")
    return weights.filter(F.col("unit") != usual).groupBy("table_name", "row_id").agg(F.min(F.struct("place", "unit")).alias("f")).select("table_name", "row_id", F.col("f.unit").alias("unit"))
