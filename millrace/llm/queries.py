"""Queries of the operators on training data of language models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import canonical_key_sql
from millrace.llm.answers import defective_answers
from millrace.llm.components import assign_splits, held_out_records
from millrace.llm.cross_split import cross_split_pairs, evaluation_coverage
from millrace.llm.leakage import find_leaks
from millrace.llm.packing import container_use, pack
from millrace.llm.shared_spans import shared_spans, shared_stretches
from millrace.session import table

_ENTITIES = {"customer_id": "c", "route_id": "r"}


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return held_out_records(table(spark, sf, "loads"), "load_id", _ENTITIES, table(spark, sf, "holdout_routes"), "route_id", "r").select(
        F.col("record_id").alias("load_id")
    )


def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    """A split for every load."""
    held, targets = table(spark, sf, "holdout_routes"), table(spark, sf, "split_targets")
    return assign_splits(table(spark, sf, "loads"), "load_id", _ENTITIES, held, "route_id", "r", targets).select(F.col("record_id").alias("load_id"), "split")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return defective_answers(table(spark, sf, "generation_results"), table(spark, sf, "sft_records"))


def p3_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Defects per model."""
    found = p3_found(spark, sf)
    models = table(spark, sf, "generation_results").groupBy("result_id").agg(F.min("model_id").alias("model_id"))
    return found.join(models, "result_id").groupBy("model_id", "defect").agg(F.count(F.lit(1)).alias("n_results"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cross_split_pairs(table(spark, sf, "sft_records"), table(spark, sf, "sample_plan"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("id_a", "id_b").distinct()


def p4_by_split(spark: SparkSession, sf: str) -> DataFrame:
    """Overlaps with the training split, counted per evaluation split and source."""
    return _pairs(spark, sf).groupBy("eval_split", "source").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval_records"), F.count_if("by_load").alias("n_by_load"), F.count("distance").alias("n_by_text")
    )


def p4_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Per evaluation record, how much of it stands in training texts near to it."""
    return evaluation_coverage(table(spark, sf, "sft_records"), table(spark, sf, "sample_plan"))


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), table(spark, sf, "pack_targets"))


def p6_use(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each kind are."""
    return container_use(p6_packed(spark, sf), table(spark, sf, "pack_targets"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with a window of 12 words at distance 0."""
    return _leaks(spark, sf).filter("edits = 0").select("doc_id", "item_id")


def p7_edited(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with a window of 16 words within three word edits but none without: leaks that no exact search of such windows finds."""
    found = find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), min_words=16, max_edits=3)
    return found.filter("edits > 0").select("doc_id", "item_id", "edits", "covered_words")


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which items leaked, into how many documents, and how much of the item the worst of them holds."""
    return _leaks(spark, sf).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("exact_words").alias("max_exact_words"), F.max("covered_words").alias("max_covered_words"), F.count_if(F.col("edits") > 0).alias("n_edited_only")
    )


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_stretches(table(spark, sf, "documents")).select("doc_id").distinct()


def p8_shared(spark: SparkSession, sf: str) -> DataFrame:
    """Per document, how much of it other documents have too."""
    return shared_spans(table(spark, sf, "documents"))


QUERIES = {q.__name__: q for q in (p2_found, p2_splits, p3_found, p3_by_model, p4_found, p4_by_split, p4_coverage, p6_packed, p6_use, p7_found, p7_edited, p7_items, p8_found, p8_shared)}

_C, _R = canonical_key_sql("customer_id"), canonical_key_sql("route_id")

ORACLE = {
    "p2_found": f"""
WITH RECURSIVE l AS (SELECT load_id, 'c:' || {_C} c, 'r:' || {_R} r FROM loads),
edges AS (SELECT DISTINCT c a, r b FROM l WHERE c IS NOT NULL AND r IS NOT NULL),
reach AS (SELECT 'r:' || {_R} node FROM holdout_routes WHERE {_R} IS NOT NULL
  UNION SELECT CASE WHEN e.a = reach.node THEN e.b ELSE e.a END FROM reach JOIN edges e ON e.a = reach.node OR e.b = reach.node)
SELECT DISTINCT load_id FROM l WHERE c IN (SELECT node FROM reach) OR r IN (SELECT node FROM reach)
""",
    "p7_found": r"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '<(/?(br|p|div|li|ul|ol|tr|td|th|table|hr|pre))\b[^<>]*>', ' ', 'gi'),
    '</?[A-Za-z!][^<>]*>', '', 'g'), '[\x{00AD}\x{200B}-\x{200F}\x{2060}-\x{206F}\x{FEFF}]', '', 'g')), 'ё', 'е'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, string_split(trim(regexp_replace(replace(lower(passage), 'ё', 'е'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') w FROM eval_items),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) k FROM i)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 11], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) k FROM d))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
    "p8_found": """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 400),
g AS (SELECT DISTINCT doc_id, hash(substr(text, k, 400)) h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) k FROM d)),
s AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1)
SELECT DISTINCT doc_id FROM g JOIN s USING (h)
""",
    "p8_shared": """
WITH g AS (SELECT DISTINCT doc_id, k, hash(substr(text, k, 400)) h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) k FROM documents WHERE length(text) >= 400)),
s AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT DISTINCT doc_id, k FROM g JOIN s USING (h)),
n AS (SELECT doc_id, sum(least(400, coalesce(next - k, 400)))::BIGINT shared_chars FROM (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) next FROM c) GROUP BY 1)
SELECT doc_id, n_chars, shared_chars, round(shared_chars::DOUBLE / n_chars, 6) AS shared_share FROM n JOIN (SELECT doc_id, max(length(text)) n_chars FROM documents GROUP BY 1) USING (doc_id)
""",
}
