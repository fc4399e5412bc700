"""Records as JSON lines: each line is read strictly, bad ones become issues and never stop the rest."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schemas import RECORD, columns, parse, schema_of

_READ = "ok boolean, id string, code string, message string"
_FIELDS = columns(RECORD)


def check_line(line: str) -> tuple[bool, str | None, str | None, str | None]:
    """(good, id if readable, code, message)."""
    try:
        value = json.loads(line)
    except ValueError as e:
        return False, None, "SCHEMA", f"no JSON: {e}"
    if not isinstance(value, dict):
        return False, None, "SCHEMA", "no object"
    rid = value.get("id") if isinstance(value.get("id"), str) else None
    extra, lost = sorted(set(value) - set(_FIELDS)), sorted(set(_FIELDS) - set(value))
    if extra or lost or rid is None:
        return False, rid, "SCHEMA", f"unexpected {extra}, missing {lost}" if extra or lost else "id"
    messages = value["messages"]
    if not isinstance(messages, list) or [m.get("role") if isinstance(m, dict) else None for m in messages] != ["system", "user", "assistant"]:
        return False, rid, "ROLE_ORDER", "roles must be system, user, assistant"
    return True, rid, None, None


def read_records(spark: SparkSession, path: str, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, issues) of JSON lines; ``split`` is the split the file stands for, in the issues."""

    @F.pandas_udf(_READ)
    def check(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([check_line(x) for x in lines], columns=["ok", "id", "code", "message"])

    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("c", check("value"))
    good = lines.filter("c.ok").select(F.from_json("value", parse(RECORD)).alias("r")).select("r.*")
    bad = lines.filter("not c.ok").select(F.col("c.id").alias("record_id"), F.lit(split).cast("string").alias("split"), "c.code", "c.message")
    return good, bad


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines ordered by id within files, nulls kept."""
    df.select(*_FIELDS).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON lines with ``_file`` and ``_bad``: a truncated last line is a bad row, not an error."""
    df = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    return df.withColumn("_file", F.input_file_name())


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def parse_gauges(lines: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Lines of comma-separated gauges as doubles; a bad cell is null, a line with another number of cells is dropped."""
    cells = F.split(F.col(column), ",")
    return lines.filter(F.size(cells) == len(names)).select(*[F.trim(cells[i]).try_cast("double").alias(n) for i, n in enumerate(names)])


def refuse(issues: DataFrame, what: str) -> None:
    """ValueError naming how many issues there are and the first three, where there are any: a batch is taken whole or not at all."""
    first = issues.orderBy("record_id", "code").limit(3).collect()
    if first:
        said = "; ".join(f"{r['record_id']}: {r['code']} {r['message']}" for r in first)
        raise ValueError(f"{what}: {issues.count()} issues, e.g. {said}")


def save_facts(facts: DataFrame, path: str) -> None:
    """JSON lines, nulls kept, ordered by load_id over all files."""
    facts.repartitionByRange("load_id").sortWithinPartitions("load_id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_facts(spark: SparkSession, path: str, version: str = "facts_v1") -> DataFrame:
    """Facts of JSON lines; ValueError naming a file and its line where one does not read."""
    schema = schema_of("facts", version)
    df = spark.read.schema(schema.add("_bad", "string")).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path).withColumn("_file", F.input_file_name())
    bad = df.select("_bad", "_file", "load_id").filter("_bad is not null or load_id is null").orderBy("_file").first()
    if bad:
        raise ValueError(f"{bad['_file']}: no fact of {version}: {(bad['_bad'] or 'load_id is missing')[:80]}")
    return df.drop("_bad", "_file")
