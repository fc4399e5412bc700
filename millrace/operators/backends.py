"""Answers for requests: batches through any function, answers by lookup, resumed runs, paired runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.exprs import to_kg
from millrace.functions.json_answers import answer_flags, target
from millrace.operators.extract import Extractor, Gazetteer, empty_answer


def answer_batches(requests: DataFrame, generate: Callable[[list[str]], list[str]], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, output, error): ``generate`` over Arrow batches; order is kept and no request is lost.

    An exception fails its batch with the exception's text; a wrong number of
    answers fails the batch too. A null request gets the error "no request".
    """
    kind = requests.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked = pdf[pdf["text"].notna()]
            try:
                got = list(generate(asked["text"].tolist())) if len(asked) else []
                error = None if len(got) == len(asked) else f"{len(got)} answers to {len(asked)} requests"
            except Exception as e:  # noqa: BLE001  (a failed batch is a result)
                got, error = [], f"{type(e).__name__}: {e}"
            out = pd.DataFrame({"id": pdf["id"], "output": None, "error": None}, dtype=object)
            out.loc[pdf["text"].isna(), "error"] = "no request"
            if error:
                out.loc[asked.index, "error"] = error
            else:
                out.loc[asked.index, "output"] = got
            yield out

    return requests.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, output string, error string")


def answers_by_text(requests: DataFrame, known: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, output, error) by the hash of the request: ``known`` (sha256, output), "__timeout__" being a failure; unknown requests are errors."""
    k = known.groupBy("sha256").agg(F.min("output").alias("_o"))
    j = requests.select(F.col(id_col).alias("id"), F.sha2(F.col(text_col), 256).alias("sha256")).join(k, "sha256", "left")
    late = F.col("_o") == "__timeout__"
    return j.select("id", F.when(~late, F.col("_o")).alias("output"), F.when(F.col("_o").isNull(), "unknown request").when(late, "timeout").alias("error"))


def pending(requests: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Requests without an answer that isn't an error."""
    return requests.join(predictions.filter("error is null and output is not null").select(key).distinct(), key, "left_anti")


def paired(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, gaps): rows both runs have, as structs a and b, and the keys only one of them has."""
    x, y = a.select(F.col(key), F.struct(*a.columns).alias("a")), b.select(F.col(key), F.struct(*b.columns).alias("b"))
    j = x.join(y, key, "full_outer")
    gaps = j.filter("a is null or b is null").select(key, F.when(F.col("a").isNull(), "b").otherwise("a").alias("only_in"))
    return j.filter("a is not null and b is not null"), gaps


def rules_backend(requests: DataFrame, gazetteer: Gazetteer, regions: dict[str, str] | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, output, error): the extractor as a back end; its answers are canonical cards of the second version, never refused ones."""
    def generate(texts: list[str]) -> list[str]:
        extractor = Extractor(gazetteer)
        return [extractor.answer(t, regions or {}) for t in texts]

    return answer_batches(requests, generate, id_col, text_col)


def empty_backend(requests: DataFrame, version: str, id_col: str = "id") -> DataFrame:
    """(id, output, error): the answer that knows nothing, to every request; the floor of any comparison."""
    return requests.select(F.col(id_col).alias("id"), F.lit(empty_answer(version)).alias("output"), F.lit(None).cast("string").alias("error"))


def assemble_results(answers: DataFrame, version: str, known_cities: Sequence[str] | None = None) -> DataFrame:
    """(id, status, weight_kg, pieces, assumptions, warnings, missing_fields) of (id, output, error) answers.

    status: ``backend_error`` where the back end failed or said nothing,
    ``invalid_output`` where the answer does not read even leniently, else
    ``ok``. weight_kg is the stated total, or weight per piece times the pieces,
    for which one is assumed where none are stated. warnings: unknown_city
    (with ``known_cities``), delivery_before_pickup, weight_implausible.
    """
    read = answers.withColumn("_f", answer_flags(F.col("output"), version)).withColumn("_t", target(F.col("_f.body")))
    failed = F.col("error").isNotNull() | F.col("output").isNull()
    status = F.when(failed, "backend_error").when(~F.col("_f.json_parsed_lenient"), "invalid_output").otherwise("ok")
    card = F.when(status == "ok", F.col("_t.card"))
    each = to_kg(card["weight_per_piece"]["value"], card["weight_per_piece"]["unit"])
    kg = F.coalesce(to_kg(card["weight_total"]["value"], card["weight_total"]["unit"]), each * F.coalesce(card["pieces"], F.lit(1)))
    here = status == "ok"
    assumed = F.array_compact(F.array(F.when(here & card["pieces"].isNull(), F.lit("pieces=1"))))
    foreign = F.lit(False)
    for side in ("origin", "destination"):
        if known_cities is not None:
            foreign = foreign | F.coalesce(~card[side]["city"].isin(*known_cities), F.lit(False))
    warnings = F.array_compact(F.array(
        F.when(foreign, F.lit("unknown_city")), F.when(card["delivery_date"] < card["pickup_date"], F.lit("delivery_before_pickup")), F.when(kg > 25_000, F.lit("weight_implausible"))
    ))
    return read.select("id", status.alias("status"), kg.alias("weight_kg"), card["pieces"].alias("pieces"), assumed.alias("assumptions"), warnings.alias("warnings"), F.when(here, F.col("_t.missing_fields")).alias("missing_fields"))


def state_changes(before: DataFrame, after: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, before, after) of what differs between two states: a run may be taken up again only where its identity keys are not among them."""
    a, b = before.select(F.col(key), F.col(value).alias("before")), after.select(F.col(key), F.col(value).alias("after"))
    return a.join(b, key, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
