"""Dataset validation: duplicates, leakage between splits, contamination of a benchmark, roles and prompts.

Every check gives rows of the one issue schema (record_id, split, code,
message); a report is their union. ``split`` is the record's own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import normal_request
from millrace.functions.json_answers import answer_flags, consistency, target
from millrace.functions.keys import canonical_key
from millrace.session import hot_keys, salted_join

WARNINGS = ("DUP_EXACT_IN_SPLIT",)


def message_of(role: str) -> Column:
    """Content of the first message of a role, null without one."""
    return F.try_element_at(F.filter("messages", lambda m: m["role"] == role), F.lit(1))["content"]


def issue(df: DataFrame, code: Column | str, message: Column | str) -> DataFrame:
    return df.select(
        F.col("id").cast("string").alias("record_id"), F.col("split").cast("string").alias("split"),
        (F.lit(code) if isinstance(code, str) else code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"),
    )


def role_order(records: DataFrame, roles: Sequence[str] = ("system", "user", "assistant")) -> DataFrame:
    """ROLE_ORDER: the messages are not exactly one of each role in order."""
    have = F.array_join(F.transform("messages", lambda m: F.coalesce(m["role"], F.lit("?"))), ",")
    return issue(records.withColumn("_r", F.coalesce(have, F.lit(""))).filter(F.col("_r") != ",".join(roles)), "ROLE_ORDER", F.concat(F.lit("roles: "), F.col("_r")))


def prompt_mismatch(records: DataFrame, prompts: dict[str, str]) -> DataFrame:
    """PROMPT_MISMATCH: the system message is not that of the record's task."""
    want = F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(prompts.items()) for x in kv]), F.col("task"))
    return issue(records.filter(~F.coalesce(message_of("system") == want, F.lit(False))), "PROMPT_MISMATCH", F.concat(F.lit("task "), F.coalesce("task", F.lit("?"))))


#: Order of the splits of a dataset: what an id is reported against is its first row in this order.
SPLIT_ORDER = ("train", "val", "test", "test_ood", "bench")


def split_rank(split: Column) -> Column:
    """0, 1, ... in ``SPLIT_ORDER``; other splits and null come last."""
    return reduce(lambda out, i: F.when(split == SPLIT_ORDER[i], i).otherwise(out), range(len(SPLIT_ORDER)), F.lit(len(SPLIT_ORDER)))


def duplicate_ids(records: DataFrame) -> DataFrame:
    """DUP_ID: one issue for every row of an id but its first, naming the first one's split; null ids are left out.

    Copies are counted per (id, split) first, so an id of many rows is never one group.
    """
    places = records.filter("id is not null").groupBy("id", "split").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(split_rank(F.col("split")).alias("r"), "split")).over(Window.partitionBy("id"))["split"]
    mine = places.withColumn("_first", first).withColumn("n", F.col("n") - F.when(F.col("split").eqNullSafe(F.col("_first")), 1).otherwise(0))
    every = mine.filter("n > 0").select("id", "split", "_first", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("_c"))
    return issue(every, "DUP_ID", F.concat(F.lit("id also in "), F.coalesce("_first", F.lit("?"))))


def duplicate_texts(records: DataFrame, text: Column | None = None) -> DataFrame:
    """DUP_EXACT (the text is in several splits) or DUP_EXACT_IN_SPLIT (in one) for every row whose normal text another row has, copies of one id included.

    Texts are grouped by their hash; a group is only counted and joined back
    (salted where it is hot), never collected. The message names how many rows
    and the smallest id. Null texts are left out.
    """
    t = text if text is not None else normal_request(message_of("user"))
    keyed = records.select("id", "split", F.sha2(t, 256).alias("k")).filter("k is not null")
    s = F.coalesce("split", F.lit(""))
    groups = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.min(s).alias("s"), F.max(s).alias("z")).filter("n > 1")
    dup = salted_join(keyed, groups, ["k"], hot_keys(keyed, ["k"], records.count()), "id", "inner")
    code = F.when(F.col("s") != F.col("z"), "DUP_EXACT").otherwise("DUP_EXACT_IN_SPLIT")
    return issue(dup, code, F.concat(F.lit("text of "), F.col("n").cast("string"), F.lit(" rows, first "), F.coalesce("a", F.lit("?"))))


def group_leaks(records: DataFrame, group: str = "group_id") -> DataFrame:
    """GROUP_LEAK: the record's group is in more than one split; null groups and splits are left out."""
    g = records.filter(F.col(group).isNotNull() & F.col("split").isNotNull()).groupBy(group).agg(F.min("split").alias("s"), F.max("split").alias("z")).filter("s <> z").select(group)
    return issue(records.filter("split is not null").join(g, group, "left_semi"), "GROUP_LEAK", F.concat(F.lit("group "), F.col(group)))


def split_mismatches(records: DataFrame, want: Column) -> DataFrame:
    """SPLIT_MISMATCH: the record's split is not the one it should be in (``want``); nulls are a mismatch."""
    return issue(records.withColumn("_w", want).filter(~F.coalesce(F.col("split") == F.col("_w"), F.lit(False))), "SPLIT_MISMATCH", F.concat(F.lit("should be "), F.coalesce("_w", F.lit("?"))))


def route_leaks(records: DataFrame, loads: DataFrame, held: DataFrame, group: str = "group_id") -> DataFrame:
    """UNKNOWN_LOAD (the record's load has no row) or OOD_ROUTE_LEAK (one of its routes is held out but the split is not test_ood).

    Keys that are only written differently are the same; a load without a digit has no row.
    """
    load = F.regexp_replace(F.col(group), r"^load:", "")
    out = held.select(canonical_key("route_id").alias("_route")).filter("_route is not null").distinct().withColumn("_held", F.lit(True))
    used = loads.select(canonical_key("load_id").alias("_key"), canonical_key("route_id").alias("_route")).filter("_key is not null").join(out, "_route", "left")
    known = used.groupBy("_key").agg(F.max("_held").alias("_held"), F.lit(True).alias("_known"))
    j = records.filter(F.col(group).isNotNull()).withColumn("_load", load).withColumn("_key", canonical_key(load)).join(known, "_key", "left")
    code = F.when(F.col("_known").isNull(), "UNKNOWN_LOAD").when(F.col("_held") & ~F.coalesce(F.col("split") == "test_ood", F.lit(False)), "OOD_ROUTE_LEAK")
    return issue(j.withColumn("_c", code).filter("_c is not null"), F.col("_c"), F.concat(F.lit("load "), F.col("_load")))


def family_leaks(records: DataFrame, families: DataFrame, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """OOD_FAMILY_LEAK: a record of a held-out template family (``families``: template_family) is in one of ``splits``."""
    out = families.select("template_family").filter("template_family is not null").distinct()
    return issue(records.filter(F.col("split").isin(*splits)).join(out, "template_family", "left_semi"), "OOD_FAMILY_LEAK", F.concat(F.lit("held-out family "), F.col("template_family")))


def holdout_mismatch(held: DataFrame, plan: str, value: str) -> DataFrame:
    """HOLDOUT_MISMATCH: one issue per value that some plans hold out and others don't; keys only written differently are the same."""
    rows = held.select(F.col(plan).alias("_p"), canonical_key(value).alias("_v")).filter("_p is not null and _v is not null").distinct()
    plans = rows.select("_p").distinct().count()
    odd = rows.groupBy("_v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < plans)
    return issue(odd.select(F.lit("<manifests>").alias("id"), F.lit(None).cast("string").alias("split"), "_v", "n"), "HOLDOUT_MISMATCH", F.concat(F.col("_v"), F.lit(" held out by "), F.col("n").cast("string"), F.lit(f" of {plans} plans")))


def record_checks(records: DataFrame, tasks: dict[str, dict[str, str]]) -> DataFrame:
    """Issues of records on their own: UNKNOWN_TASK, UNSUPPORTED_SCHEMA, EMPTY_ASSISTANT, TARGET_PARSE, NOT_CANONICAL, TARGET_INCONSISTENT.

    ``tasks``: task -> schema version of a record -> version of the answer
    shape to read it by ('' where the answer is free text). The first of the
    first four codes that fits holds; a readable answer can be both not
    canonical and inconsistent. Null answers are empty.
    """
    pairs = [F.lit(x) for t, vs in sorted(tasks.items()) for v, shape in sorted(vs.items()) for x in (f"{t}|{v}", shape)]
    shape_of = F.try_element_at(F.create_map(*pairs), F.concat_ws("|", F.coalesce("task", F.lit("")), F.coalesce("schema_version", F.lit(""))))
    r = records.select("id", "split", "task", "schema_version", message_of("assistant").alias("answer")).withColumn("shape", shape_of)
    empty = F.regexp_replace(F.coalesce("answer", F.lit("")), r"(?U)\s+", "") == ""
    early = F.when(~F.coalesce(F.col("task").isin(*tasks), F.lit(False)), "UNKNOWN_TASK").when(F.col("shape").isNull(), "UNSUPPORTED_SCHEMA").when(empty, "EMPTY_ASSISTANT")
    r = r.withColumn("early", early)
    why = F.when(F.col("early") == "UNKNOWN_TASK", F.concat(F.lit("task "), F.coalesce("task", F.lit("?")))).when(F.col("early") == "UNSUPPORTED_SCHEMA", F.concat(F.lit("schema "), F.coalesce("schema_version", F.lit("?")))).otherwise("no answer")
    out = [issue(r.filter("early is not null"), F.col("early"), why)]
    for shape in sorted({x for vs in tasks.values() for x in vs.values()} - {""}):
        read = r.filter(F.col("early").isNull() & (F.col("shape") == shape)).withColumn("f", answer_flags(F.col("answer"), shape))
        strict = F.col("f.schema_valid")
        codes = F.array_compact(F.array(
            F.when(~strict, F.struct(F.lit("TARGET_PARSE").alias("code"), F.concat(F.lit("refused as "), F.col("f.stage")).alias("message"))),
            F.when(strict & (F.col("f.body") != F.col("answer")), F.struct(F.lit("NOT_CANONICAL").alias("code"), F.lit("not in canonical spelling").alias("message"))),
        ))
        wrong = F.transform(F.when(strict, consistency(target(F.col("f.body")), shape)).otherwise(F.array().cast("array<string>")), lambda x: F.struct(F.lit("TARGET_INCONSISTENT").alias("code"), x.alias("message")))
        each = read.select("id", "split", F.explode(F.concat(codes, wrong)).alias("x"))
        out.append(issue(each, F.col("x.code"), F.col("x.message")))
    return reduce(DataFrame.unionByName, out)


def contamination(bench: DataFrame, splits: DataFrame, group: str = "group_id") -> DataFrame:
    """BENCH_LEAK: a benchmark record is in a training split too, by id, else by group, else by normal text: one issue per record.

    Both sides explode to (kind, key) rows; the first kind that matches, then the first split, is named.
    """
    def keys(df: DataFrame) -> DataFrame:
        text = F.sha2(normal_request(message_of("user")), 256)
        ks = F.array(F.struct(F.lit(1).alias("p"), F.col("id").alias("k")), F.struct(F.lit(2).alias("p"), F.col(group).alias("k")), F.struct(F.lit(3).alias("p"), text.alias("k")))
        return df.select("id", "split", F.explode(ks).alias("x")).select("id", "split", "x.p", "x.k").filter("k is not null").distinct()

    theirs = keys(splits).groupBy("p", "k").agg(F.min("split").alias("_where"))
    hit = keys(bench).join(theirs, ["p", "k"]).groupBy("id", "split").agg(F.min(F.struct("p", "_where")).alias("m"))
    by = F.element_at(F.array(F.lit("id"), F.lit("group"), F.lit("text")), F.col("m.p"))
    return issue(hit, "BENCH_LEAK", F.concat(by, F.lit(" in "), F.col("m._where")))


def not_in(part: DataFrame, whole: DataFrame, columns: Sequence[str], code: str = "SMOKE_NOT_IN_TRAIN") -> DataFrame:
    """``code`` for each row of ``part`` without an equal row (all ``columns``, nulls equal) of ``whole``."""
    h = F.xxhash64(*columns)
    there = whole.select(F.col("id").alias("_id"), h.alias("_h")).distinct()
    return issue(part.withColumn("_hh", h).join(there, (F.col("id") == F.col("_id")) & (F.col("_hh") == F.col("_h")), "left_anti"), code, "no equal row")


def report(checks: Sequence[DataFrame]) -> DataFrame:
    """All issues of several checks, with their severity."""
    every = reduce(DataFrame.unionByName, checks)
    return every.withColumn("severity", F.when(F.col("code").isin(*WARNINGS), "warning").otherwise("error"))


def code_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").agg(F.count(F.lit(1)).alias("n_issues"))


def first_rows(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """First row of each key in an order: what later duplicates are reported against."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
