"""CSV tables with explicit types: header, type and date checks as issues, never a crash or a silent null."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schemas import DATES, ISSUE, KEYS, RAW, columns


def header_problems(spark: SparkSession, path: str, table: str) -> list[str]:
    """COLUMNS problems of the header: the set of names must be that of the schema, the order is free."""
    first = spark.read.text(path).first()
    have = [c.strip().strip('"').lstrip("\ufeff") for c in first[0].split(",")] if first else []
    want = columns(RAW[table])
    return [f"missing column {c}" for c in want if c not in have] + [f"unexpected column {c}" for c in have if c not in want]


def read_table(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of one CSV table.

    A value that is not of its column's type gives DTYPE, a date that does not
    parse DATE_FORMAT, one issue per value; the value is null in the rows. A
    wrong header raises ValueError.
    """
    wrong = header_problems(spark, path, table)
    if wrong:
        raise ValueError(f"{table}: " + "; ".join(wrong))
    raw = spark.read.option("header", True).csv(path)  # all text: what fails to convert can be reported
    ddl = [x.strip().split(" ", 1) for x in RAW[table].split(",")]
    key = KEYS[table]
    outs, checks = [], []
    for name, kind in ddl:
        text = F.nullif(F.trim(F.col(name)), F.lit(""))
        if name in DATES.get(table, {}):
            pattern, to = DATES[table][name]
            value, code = F.try_to_timestamp(text, F.lit(pattern)).cast(to), "DATE_FORMAT"
        elif kind == "string":
            outs.append(F.col(name))
            continue
        else:
            value, code = text.try_cast(kind), "DTYPE"
        outs.append(value.alias(name))
        checks.append(F.when(text.isNotNull() & value.isNull(), F.struct(F.lit(code).alias("code"), F.concat(F.lit(f"{name}: "), text).alias("message"))))
    rows = raw.select(*outs)
    if not checks:
        return rows, spark.createDataFrame([], ISSUE)
    found = raw.select(F.col(key).alias("record_id"), F.explode(F.array_compact(F.array(*checks))).alias("i"))
    return rows, found.select("record_id", F.lit(None).cast("string").alias("split"), "i.code", "i.message")


def read_tables(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The four tables of a folder and the union of their issues."""
    read = {t: read_table(spark, f"{folder}/{t}.csv", t) for t in RAW}
    return {t: r for t, (r, _) in read.items()}, reduce(DataFrame.unionByName, [i for _, i in read.values()])


def read_review(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(verdicts, issues) of a review CSV: ``,`` or ``;`` by its first line, a byte order mark allowed, verdicts trimmed and in lower case.

    A verdict other than ok, fix, drop gives BAD_VERDICT.
    """
    first = spark.read.text(path).first()
    line = first[0].lstrip("\ufeff") if first else ""
    sep = ";" if line.count(";") > line.count(",") else ","
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
    v = df.select(F.col("id"), F.lower(F.trim("verdict")).alias("verdict"))
    good = F.coalesce(F.col("verdict").isin("ok", "fix", "drop"), F.lit(False))
    bad = v.filter(~good).select(F.col("id").alias("record_id"), F.lit(None).cast("string").alias("split"), F.lit("BAD_VERDICT").alias("code"), F.coalesce("verdict", F.lit("")).alias("message"))
    return v.filter(good), bad


def write_text(path: str, text: str) -> None:
    """A small report on the driver's disk, replaced as a whole or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    part.write_text(text, encoding="utf-8")
    part.replace(target)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(limit).collect()
    cells = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
    return "\n".join([cells(df.columns), cells(["-"] * len(df.columns)), *map(cells, rows)])


def json_report(path: str, sections: dict[str, DataFrame], limit: int = 1000) -> None:
    """Small results as one JSON file, a list of rows per section; ValueError where a section has more than ``limit`` rows."""
    out = {}
    for name, df in sections.items():
        rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
        if len(rows) > limit:
            raise ValueError(f"{name} has more than {limit} rows: a table, not a report")
        out[name] = rows
    write_text(path, json.dumps(out, ensure_ascii=False, indent=1, default=str) + "\n")


def write_review(df: DataFrame, path: str) -> None:
    """Candidates (id, text) for people to judge: one CSV with an empty verdict and comment, ordered by id, quoted throughout."""
    sheet = df.select("id", "text", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("comment"))
    sheet.coalesce(1).sortWithinPartitions("id").write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
