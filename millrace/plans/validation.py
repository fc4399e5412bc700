"""Dataset validation queries over the records of the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import exprs as E
from millrace.operators import conditions as co
from millrace.operators import extract as ex
from millrace.operators import validate as v
from millrace.functions import json_answers as ja
from millrace.functions.keys import canonical_key, canonical_key_sql
from millrace.operators.facts import assign_conditions, build_facts, completeness
from millrace.operators.render import lost_fields, render_conditioned, render_requests, self_check
from millrace.operators.sampling import group_split, sample_plan
from millrace.plans import profiling as pr
from millrace.plans import sqltext as S
from millrace.session import table

PROMPTS = {
    "shipment_extraction": "Fill in the load card from the request. Answer with one JSON object.",
    "dispatcher_reply": "Answer the sender as the dispatcher, in the language of the request.",
    "request_summary": "Sum up the request in a few sentences, in the language of the request.",
}
EVAL = ("val", "test", "test_ood", "bench")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sft_records")


def q_role_order(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose messages aren't system, user, assistant."""
    return v.role_order(_records(spark, sf)).select("record_id", "code")


def q_role_order_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The same of records read as question and answer alone: documents' check of a table that has a system message throughout."""
    return v.role_order(_records(spark, sf).withColumn("messages", F.slice("messages", 1, F.when(F.col("split") == "bench", 2).otherwise(3)))).select("record_id", "code")


def q_prompt_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose system prompt isn't the one of the replies' task: all of the two other tasks."""
    return v.prompt_mismatch(_records(spark, sf), dict.fromkeys(PROMPTS, PROMPTS["dispatcher_reply"])).select("record_id", "split", "code", "message")


#: The tasks of the records: their answers are cards of the short version or free text.
TASKS = {"shipment_extraction": {"card_v1": "card_short"}, "dispatcher_reply": {"card_v1": "", "card_v2": ""}}


def q_record_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of records on their own: summaries are no known task here, cards of the second version no supported schema."""
    return v.record_checks(_records(spark, sf), TASKS)


def q_answer_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The same checks over the answers of the models instead of the gold ones, counted: they have every kind of fault."""
    g = table(spark, sf, "generation_results").filter("record_id is not null")
    r = _records(spark, sf).filter("task = 'shipment_extraction'").select("id").distinct()
    answers = g.join(r, F.col("record_id") == F.col("id"), "left_semi").select(
        F.col("result_id").cast("string").alias("id"), F.lit(None).cast("string").alias("split"), F.lit("shipment_extraction").alias("task"), F.lit("card_v1").alias("schema_version"),
        F.array(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))).alias("messages"),
    ).distinct()
    return v.code_counts(v.record_checks(answers, TASKS))


def q_family_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the family T8, taken as held out, in the main splits."""
    return v.family_leaks(_records(spark, sf), spark.createDataFrame([("T8",)], "template_family string")).select("record_id", "split", "code", "message").distinct()


def q_holdout_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Routes held out by the plan but not by the sample, or the other way round: the sample's are those of its loads that are out of distribution by route."""
    plan = table(spark, sf, "sample_plan").filter("ood_reason in ('route', 'both')").select(canonical_key("load_id").alias("k")).filter("k is not null").distinct()
    used = table(spark, sf, "loads").select(canonical_key("load_id").alias("k"), "route_id").join(plan, "k", "left_semi")
    return v.holdout_mismatch(table(spark, sf, "holdout_routes").select("plan", "route_id").unionByName(used.select(F.lit("sample").alias("plan"), "route_id")), "plan", "route_id")


#: Profiles of the condition assignment, by category.
PROFILES = {
    "food_beverage": [
        {"name": "chilled", "share": 0.5, "equipment": "reefer", "temperature": (2, 6), "parameters": ["humidity", "temperature"]},
        {"name": "plain", "share": 0.5, "equipment": "tent", "methods": ["load_bars", "straps"]},
    ],
    "automotive": [
        {"name": "large", "share": 0.25, "equipment": "lowbed", "dimensions": {"length": (6, 12), "width": (2.6, 3.4), "height": (2.5, 3.2)}, "methods": ["chains"], "pieces": (1, 3)},
        {"name": "packed", "share": 0.75, "equipment": "van", "types": ["shock_protection", "crate"]},
    ],
}


def _conditioned(spark: SparkSession, sf: str) -> DataFrame:
    facts, _ = build_facts(pr._one(spark, sf, "loads", "load_id"), pr._one(spark, sf, "routes", "route_id"), pr._one(spark, sf, "customers", "customer_id"), table(spark, sf, "delivery_events"), pr.EQUIPMENT, pr.CARGO)
    return assign_conditions(facts, "load_id", "cargo_category", PROFILES, 7)


def q_conditions_assigned(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with drawn equipment, pieces and conditions."""
    side = lambda n: F.flatten(F.transform("special_conditions", lambda c: F.array(c[n]["value"])))
    most = lambda n: F.array_max(F.array_compact(side(n)))
    return _conditioned(spark, sf).select(
        "load_id", "profile", "equipment_type", "pieces", F.array_join(F.transform("special_conditions", lambda c: c["kind"]), ",").alias("kinds"),
        F.array_join(F.flatten(F.transform("special_conditions", lambda c: F.coalesce(c["methods"], c["types"], c["parameters"], F.array().cast("array<string>")))), ",").alias("listed"), most("length").alias("length"), most("width").alias("width"),
    )


def q_incomplete_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What the rules of the second version miss where dry vans are sent as reefers without a temperature."""
    facts = _conditioned(spark, sf).withColumn("equipment_type", F.when(F.col("profile") == "plain", "reefer").otherwise(F.col("equipment_type")))
    return completeness(facts, "load_id").select("record_id", "code", "message")


def q_sample_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Disjoint samples of loads for the four splits, with the reason of those out of distribution."""
    one = pr._one(spark, sf, "loads", "load_id").filter("route_id is not null")
    held = table(spark, sf, "holdout_routes").select(canonical_key("route_id").alias("route")).filter("route is not null").distinct()
    return sample_plan(one.select("load_id", "load_type", "route_id"), "load_id", canonical_key("route_id"), held, {"train": 120, "val": 12, "test": 16, "test_ood": 30}, ["load_type"], 42)


def q_sample_plan_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the plan, and how many of each of its parts are on held-out routes."""
    plan = q_sample_plan(spark, sf)
    on = pr._one(spark, sf, "loads", "load_id").select("load_id", canonical_key("route_id").alias("route"))
    held = table(spark, sf, "holdout_routes").select(canonical_key("route_id").alias("route"), F.lit(1).alias("held")).filter("route is not null").distinct()
    return plan.join(on, "load_id").join(held, "route", "left").groupBy("split", "ood_reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("load_id").alias("n_loads"), F.count("held").alias("n_held"))


def q_dup_ids(spark: SparkSession, sf: str) -> DataFrame:
    return v.duplicate_ids(_records(spark, sf))


def q_dup_texts(spark: SparkSession, sf: str) -> DataFrame:
    return v.duplicate_texts(_records(spark, sf)).select("record_id", "split", "code", "message")


def q_dup_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose squeezed text another document has, across or within sources."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("split"), "text")
    return v.duplicate_texts(docs, E.squeeze("text")).select("record_id", "code")


def q_group_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return v.group_leaks(_records(spark, sf)).distinct()


def q_split_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Records that are not where the hash of their group puts them."""
    r = _records(spark, sf).filter("group_id is not null").select("id", "split", "group_id").distinct()
    want = group_split(r, F.col("group_id"), {"train": 0.8, "val": 0.1, "test": 0.1}, 42).withColumnRenamed("split", "want").select("id", "group_id", "want")
    return v.split_mismatches(r.join(want, ["id", "group_id"]), F.col("want")).distinct()


def q_route_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return v.route_leaks(_records(spark, sf), table(spark, sf, "loads"), table(spark, sf, "holdout_routes")).distinct()


def q_contamination(spark: SparkSession, sf: str) -> DataFrame:
    r = _records(spark, sf)
    return v.contamination(r.filter("split = 'bench'"), r.filter("split in ('train', 'val')"))


def q_smoke_not_in_train(spark: SparkSession, sf: str) -> DataFrame:
    """Bench records without an equal row in train: all but planted ones."""
    r = _records(spark, sf)
    return v.not_in(r.filter("split = 'bench'"), r.filter("split = 'train'"), ["task", "language"]).select("record_id", "code").distinct()


def q_issue_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = _records(spark, sf)
    every = v.report([v.duplicate_ids(r), v.duplicate_texts(r), v.group_leaks(r).distinct(), v.record_checks(r, TASKS), v.route_leaks(r, table(spark, sf, "loads"), table(spark, sf, "holdout_routes")).distinct(), q_contamination(spark, sf)])
    return every.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n_issues"))


def q_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Records by split and each of family, language and hard cases (joined, or clean)."""
    r = _records(spark, sf).withColumn("hard", E.joined_or("variant.hard_cases"))
    cols = [F.struct(F.lit(n).alias("dimension"), F.col(c).alias("value")) for n, c in (("family", "template_family"), ("language", "language"), ("hard_case", "hard"))]
    return r.select("split", F.explode(F.array(*cols)).alias("x")).groupBy("split", "x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def q_dropped_fields(spark: SparkSession, sf: str) -> DataFrame:
    d = _records(spark, sf).select("id", F.explode("variant.dropped_fields").alias("field"))
    return d.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def q_record_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("id", "task", E.excerpt(v.message_of("user")).alias("excerpt"), E.language_of(v.message_of("user")).alias("written_in")).distinct()


def q_text_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("id", E.text_hash(v.message_of("user")).alias("sha256")).distinct()


def q_request_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """User message lengths by split: nearest-rank percentiles."""
    r = _records(spark, sf).select("split", F.length(v.message_of("user")).cast("bigint").alias("chars"))
    return pr.q.quantiles_nearest_rank(r, "split", "chars")


def q_equipment_words(spark: SparkSession, sf: str) -> DataFrame:
    """Equipment and cargo that requests name, by the lexicon."""
    t = _records(spark, sf).select("id", v.message_of("user").alias("text")).distinct()
    return t.select("id", *[ex.named_class(F.col("text"), ex.CLASSES[c]).alias(c) for c in ex.CLASSES]).distinct()


def q_condition_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Special conditions the requests speak of: how many, what share, the first record."""
    t = _records(spark, sf).select("id", co.kinds_in(v.message_of("user")).alias("kinds")).distinct()
    return co.conditions_report(t, "id", "kinds")


def q_extract_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards by rules from every request. The gazetteer is the name table, the cities of the routes and those of the gold cards, with their case forms; one spelling per city comes to the driver."""
    gold = _records(spark, sf).select(v.message_of("assistant").alias("gold"))
    named = [gold.select(F.get_json_object("gold", f"$.card.{c}.city").alias("city")) for c in ("origin", "destination")]
    cities = pr._places(spark, sf).select("city").union(named[0]).union(named[1]).filter("city is not null").distinct()
    g = ex.Gazetteer.of(r["city"] for r in cities.toLocalIterator())
    t = _records(spark, sf).select("id", v.message_of("user").alias("text")).distinct()
    cards = ex.extract_cards(t, "id", "text", g)
    plain = ("equipment_type", "cargo_category", "shipper_name", "pieces", "weight_value", "weight_unit", "weight_per_piece", "weight_kg", "origin", "destination", "min_c", "max_c", "answer")
    return cards.select("id", *[F.col(f"card.{c}").alias(c) for c in plain], F.array_join("card.conditions", ",").alias("conditions"), *[F.date_format(f"card.{c}", "yyyy-MM-dd").alias(c) for c in ("pickup_date", "delivery_date")])


def q_extracted_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces and temperatures the extractor reads from each request, which SQL patterns read as well."""
    t = _records(spark, sf).select("id", v.message_of("user").alias("text")).distinct()
    cards = ex.extract_cards(t, "id", "text", ex.Gazetteer({}))
    return cards.select("id", F.col("card.pieces").alias("pieces"), F.col("card.min_c").alias("min_c"), F.col("card.max_c").alias("max_c"))


def q_rules_score(spark: SparkSession, sf: str) -> DataFrame:
    """How the extractor's places and pieces compare with the gold cards."""
    gold = _records(spark, sf).filter("task = 'shipment_extraction'").select("id", v.message_of("assistant").alias("gold")).distinct()
    told = q_extract_cards(spark, sf).select("id", "origin", "destination", "pieces")
    one = lambda c: F.get_json_object("gold", f"$.card.{c}")
    pairs = [("origin", one("origin.city"), F.col("origin")), ("destination", one("destination.city"), F.col("destination")), ("pieces", one("pieces"), F.col("pieces").cast("string"))]
    each = gold.join(told, "id").select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), g.alias("g"), a.alias("a")) for n, g, a in pairs])).alias("x")).select("x.*")
    return each.filter("g is not null").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g") == F.col("a")).alias("n_right"))


def q_rendered(spark: SparkSession, sf: str) -> DataFrame:
    facts, _ = build_facts(pr._one(spark, sf, "loads", "load_id"), pr._one(spark, sf, "routes", "route_id"), pr._one(spark, sf, "customers", "customer_id"), table(spark, sf, "delivery_events"), pr.EQUIPMENT, pr.CARGO)
    return render_requests(facts).select("id", "language", "template_family", "hard_case", "text", F.col("gold.weight").alias("weight"), F.col("gold.unit").alias("unit"))


def _rendered_v2(spark: SparkSession, sf: str) -> DataFrame:
    return render_conditioned(_conditioned(spark, sf).filter("equipment_type <> 'dry_van'"))


def q_rendered_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with equipment and conditions in words, and their gold answers."""
    return _rendered_v2(spark, sf)


def q_lost_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that a request drops though its gold states them: its last sentence of dates is cut off here for every seventh load."""
    r = _rendered_v2(spark, sf)
    seventh = F.regexp_replace("load_id", "[^0-9]", "").cast("bigint") % 7 == 0
    return lost_fields(r.withColumn("text", F.when(seventh, F.regexp_replace("text", r"(Забрать|Pick up) [0-9-]+, (доставить|deliver) [0-9-]+\.", "")).otherwise(F.col("text")))).select("record_id", "code", "message")


def q_self_check(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered requests read back by the extractor: how many were checked, and in how many it reads a field otherwise than the gold."""
    r = _rendered_v2(spark, sf)
    cities = pr._places(spark, sf).select("city").filter("city is not null").distinct()
    g = ex.Gazetteer({r["city"]: r["city"] for r in cities.toLocalIterator()})
    wrong = self_check(r, g).groupBy("field").agg(F.count(F.lit(1)).alias("n_wrong"))
    fields = spark.createDataFrame([(f,) for f in ("pieces", "equipment_type", "weight", "origin", "destination", "pickup_date", "delivery_date", "conditions")], "field string")
    return fields.join(wrong, "field", "left").select("field", F.lit(r.count()).cast("bigint").alias("n_checked"), F.coalesce("n_wrong", F.lit(0)).cast("bigint").alias("n_wrong"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

_USER = S.user_text()
_N = S.normal_request(_USER)
_KEYS = f"(SELECT DISTINCT id, split, unnest([1, 2, 3]) p, unnest([id, group_id, sha256({_N})]) k FROM sft_records WHERE {{where}})"
_DUP_TEXT = f"""WITH k AS (SELECT id, split, sha256({_N}) k FROM sft_records WHERE {_USER} IS NOT NULL),
g AS (SELECT k, count(*) n, min(id) a, min(coalesce(split, '')) s, max(coalesce(split, '')) z FROM k GROUP BY k HAVING count(*) > 1)
SELECT id AS record_id, split, CASE WHEN s <> z THEN 'DUP_EXACT' ELSE 'DUP_EXACT_IN_SPLIT' END AS code, 'text of ' || n || ' rows, first ' || a AS message FROM k JOIN g USING (k)"""
_LEAK = "SELECT DISTINCT id AS record_id, split, 'GROUP_LEAK' AS code, 'group ' || group_id AS message FROM sft_records WHERE split IS NOT NULL AND group_id IN (SELECT group_id FROM sft_records WHERE split IS NOT NULL AND group_id IS NOT NULL GROUP BY 1 HAVING min(split) <> max(split))"
_K = canonical_key_sql
_ROUTE = f"""WITH used AS (SELECT {_K("load_id")} k, max(CASE WHEN {_K("route_id")} IN (SELECT {_K("route_id")} FROM holdout_routes WHERE {_K("route_id")} IS NOT NULL) THEN 1 ELSE 0 END) held FROM loads WHERE {_K("load_id")} IS NOT NULL GROUP BY 1),
s AS (SELECT DISTINCT id, split, regexp_replace(group_id, '^load:', '') load FROM sft_records WHERE group_id IS NOT NULL)
SELECT id AS record_id, split, CASE WHEN used.k IS NULL THEN 'UNKNOWN_LOAD' ELSE 'OOD_ROUTE_LEAK' END AS code, 'load ' || load AS message FROM s LEFT JOIN used ON used.k = {_K("load")} WHERE used.k IS NULL OR (held = 1 AND coalesce(split <> 'test_ood', true))"""
_BENCH = f"""WITH t AS (SELECT p, k, min(split) w FROM {_KEYS.replace("{where}", "split IN ('train', 'val')")} WHERE k IS NOT NULL GROUP BY ALL),
h AS (SELECT id, split, p, w FROM {_KEYS.replace("{where}", "split = 'bench'")} JOIN t USING (p, k)),
m AS (SELECT id, split, arg_min(p, (p, w)) p, arg_min(w, (p, w)) w FROM h GROUP BY ALL)
SELECT id AS record_id, split, 'BENCH_LEAK' AS code, ['id', 'group', 'text'][p] || ' in ' || w AS message FROM m"""
_DUP_ID = """SELECT id AS record_id, split, 'DUP_ID' AS code, 'id also in ' || coalesce(first, '?') AS message FROM (SELECT id, split, row_number() OVER w r, first_value(split) OVER w first FROM sft_records WHERE id IS NOT NULL
WINDOW w AS (PARTITION BY id ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 WHEN 'test_ood' THEN 3 WHEN 'bench' THEN 4 ELSE 5 END)) WHERE r > 1"""
_GOLD = "list_filter(messages, lambda m: m.role = 'assistant')[1].content"


def _checks(source: str) -> str:
    """Record checks of (id, split, task, schema_version, answer) rows by the strict reading in SQL."""
    from millrace.plans.evaluation import _BARE, _FITS

    known = ", ".join(f"'{t}'" for t in TASKS)
    supported = " OR ".join(f"(task = '{t}' AND schema_version = '{x}')" for t, vs in TASKS.items() for x in vs)
    need = "list_filter([" + ", ".join(f"CASE WHEN json_type(f, '$.card.{c}') = 'NULL' THEN '{c}' END" for c in ja.REQUIRED) + "], lambda e: e IS NOT NULL)"
    body = "'{\"card\":{' || " + " || ',' || ".join([
        *[f"'\"{c}\":' || CAST(json_extract(f, '$.card.{c}') AS VARCHAR)" for c in ("shipper_name", "cargo_category", "equipment_type", "pieces")],
        "'\"weight_total\":' || CASE WHEN json_type(f, '$.card.weight_total') = 'NULL' THEN 'null' ELSE '{\"value\":' || regexp_replace(CAST(json_extract(f, '$.card.weight_total.value') AS VARCHAR), '\\.0$', '') || ',\"unit\":' || CAST(json_extract(f, '$.card.weight_total.unit') AS VARCHAR) || '}' END",
        *[f"'\"{c}\":' || CAST(json_extract(f, '$.card.{c}') AS VARCHAR)" for c in ("origin", "destination", "pickup_date")],
    ]) + " || '},\"missing_fields\":' || CAST(json_extract(f, '$.missing_fields') AS VARCHAR) || ',\"conflicts\":' || CAST(json_extract(f, '$.conflicts') AS VARCHAR) || '}'"
    return f"""WITH r AS ({source}),
c AS (SELECT *, CASE WHEN NOT coalesce(task IN ({known}), false) THEN 'UNKNOWN_TASK' WHEN NOT coalesce({supported}, false) THEN 'UNSUPPORTED_SCHEMA' WHEN regexp_replace(coalesce(answer, ''), '{S.SPACE}', '', 'g') = '' THEN 'EMPTY_ASSISTANT' END early, answer x FROM r),
p AS (SELECT *, CASE WHEN early IS NULL AND task = 'shipment_extraction' AND json_valid(x) AND x = {_BARE} AND NOT starts_with(x, '```') THEN x END t FROM c),
q AS (SELECT *, CASE WHEN {_FITS} THEN t END f FROM p),
i AS (SELECT id, split, unnest(list_filter([CASE WHEN early IS NOT NULL THEN {{'code': early, 'message': CASE early WHEN 'UNKNOWN_TASK' THEN 'task ' || coalesce(task, '?') WHEN 'UNSUPPORTED_SCHEMA' THEN 'schema ' || coalesce(schema_version, '?') ELSE 'no answer' END}} END,
  CASE WHEN early IS NULL AND task = 'shipment_extraction' AND f IS NULL THEN {{'code': 'TARGET_PARSE', 'message': 'refused as ' || CASE WHEN t IS NULL THEN 'format' ELSE 'schema' END}} END,
  CASE WHEN f IS NOT NULL AND {body} <> answer THEN {{'code': 'NOT_CANONICAL', 'message': 'not in canonical spelling'}} END,
  CASE WHEN f IS NOT NULL AND coalesce(json_extract_string(f, '$.missing_fields[*]'), []) <> {need} THEN {{'code': 'TARGET_INCONSISTENT', 'message': 'missing_fields'}} END,
  CASE WHEN f IS NOT NULL AND len(list_filter(json_extract(f, '$.conflicts[*]'), lambda e: json_type(f, '$.card.' || json_extract_string(e, '$.field')) <> 'NULL')) > 0 THEN {{'code': 'TARGET_INCONSISTENT', 'message': 'conflict_not_null'}} END], lambda e: e IS NOT NULL)) z FROM q)
SELECT id AS record_id, split, z.code AS code, z.message AS message FROM i"""


_RECORD_CHECKS = _checks(f"SELECT id, split, task, schema_version, {_GOLD} answer FROM sft_records")


def _class(classes: dict[str, str]) -> str:
    """Class named most often, the earlier of equal ones."""
    votes = [f"len(regexp_extract_all(low, '{ex.stem_pattern(ws)}'))" for ws in classes.values()]
    names = ", ".join(f"'{n}'" for n in classes)
    return f"(SELECT CASE WHEN list_max(n) > 0 THEN [{names}][list_position(n, list_max(n))] END FROM (SELECT [{', '.join(votes)}] n))"


_FACTS_SQL = pr.ORACLE["q_facts"]
_D = lambda name, low, high: f"round({low} + {S.hash_uniform(7, repr(name), 'load_id')} * {high - low}, 1)"
_P = lambda c, p: f"cargo_category = '{c}' AND profile = '{p}'"
_CONDITIONED = f"""WITH f AS ({_FACTS_SQL}), u AS (SELECT *, {S.hash_uniform(7, "'profile'", "load_id")} u FROM f),
p AS (SELECT *, CASE cargo_category WHEN 'food_beverage' THEN CASE WHEN u < 0.5 THEN 'chilled' ELSE 'plain' END WHEN 'automotive' THEN CASE WHEN u < 0.25 THEN 'large' ELSE 'packed' END ELSE 'none' END profile FROM u),
d AS (SELECT load_id, profile, CASE profile WHEN 'chilled' THEN 'reefer' WHEN 'plain' THEN 'tent' WHEN 'large' THEN 'lowbed' WHEN 'packed' THEN 'van' ELSE equipment_type END equipment_type,
  CASE WHEN profile = 'large' THEN 1 + CAST(floor({S.hash_uniform(7, "'pieces'", "load_id")} * 3) AS BIGINT) ELSE pieces END pieces,
  CASE profile WHEN 'chilled' THEN 'temperature,sensors' WHEN 'plain' THEN 'securing' WHEN 'large' THEN 'securing,oversize' WHEN 'packed' THEN 'packaging' ELSE '' END kinds,
  CASE profile WHEN 'chilled' THEN 'temperature,humidity' WHEN 'plain' THEN 'straps,load_bars' WHEN 'large' THEN 'chains' WHEN 'packed' THEN 'crate,shock_protection' ELSE '' END listed,
  CASE WHEN profile = 'large' THEN {_D("length", 6, 12)} END length, CASE WHEN profile = 'large' THEN {_D("width", 2.6, 3.4)} END width FROM p)
"""
_SP = S.SPACE.rstrip("+")
_NOUNS = "|".join(ex.PIECE_NOUNS)
ORACLE = {
    "q_role_order": "SELECT id AS record_id, 'ROLE_ORDER' AS code FROM sft_records WHERE coalesce(array_to_string(list_transform(messages, lambda m: coalesce(m.role, '?')), ','), '') <> 'system,user,assistant'",
    "q_role_order_pairs": "SELECT id AS record_id, 'ROLE_ORDER' AS code FROM sft_records WHERE coalesce(array_to_string(list_transform(messages[1 : CASE WHEN split = 'bench' THEN 2 ELSE 3 END], lambda m: coalesce(m.role, '?')), ','), '') <> 'system,user,assistant'",
    "q_record_checks": _RECORD_CHECKS,
    "q_answer_checks": "SELECT code, count(*) AS n_issues FROM (" + _checks("SELECT DISTINCT CAST(result_id AS VARCHAR) id, NULL::VARCHAR split, 'shipment_extraction' task, 'card_v1' schema_version, text answer FROM generation_results WHERE record_id IN (SELECT id FROM sft_records WHERE task = 'shipment_extraction')") + ") GROUP BY 1",
    "q_family_leaks": "SELECT DISTINCT id AS record_id, split, 'OOD_FAMILY_LEAK' AS code, 'held-out family T8' AS message FROM sft_records WHERE template_family = 'T8' AND split IN ('train', 'val', 'test')",
    "q_holdout_mismatch": f"""WITH h AS (SELECT DISTINCT plan, {_K("route_id")} v FROM (SELECT plan, route_id FROM holdout_routes UNION ALL
  SELECT 'sample', route_id FROM loads WHERE {_K("load_id")} IN (SELECT {_K("load_id")} FROM sample_plan WHERE ood_reason IN ('route', 'both') AND {_K("load_id")} IS NOT NULL)) WHERE plan IS NOT NULL AND {_K("route_id")} IS NOT NULL), n AS (SELECT count(DISTINCT plan) n FROM h)
SELECT '<manifests>' AS record_id, NULL::VARCHAR AS split, 'HOLDOUT_MISMATCH' AS code, v || ' held out by ' || count(*) || ' of ' || n || ' plans' AS message FROM h, n GROUP BY v, n HAVING count(*) < n""",
    "q_conditions_assigned": _CONDITIONED + "SELECT load_id, profile, equipment_type, pieces, kinds, listed, length, width FROM d",
    "q_lost_fields": _CONDITIONED + """SELECT 'rv-' || d.load_id AS record_id, 'LOST_FIELD' AS code, unnest(CASE WHEN f.pickup_date IS NULL THEN [] ELSE ['pickup_date', 'delivery_date'] END) AS message FROM d JOIN f USING (load_id) WHERE d.equipment_type <> 'dry_van' AND CAST(regexp_replace(d.load_id, '[^0-9]', '', 'g') AS BIGINT) % 7 = 0""",
    "q_self_check": _CONDITIONED + "SELECT unnest(['pieces', 'equipment_type', 'weight', 'origin', 'destination', 'pickup_date', 'delivery_date', 'conditions']) AS field, n AS n_checked, 0::BIGINT AS n_wrong FROM (SELECT count(*) n FROM d WHERE equipment_type <> 'dry_van')",
    "q_incomplete_facts": _CONDITIONED + "SELECT load_id AS record_id, 'MISSING' AS code, 'missing special_conditions.temperature' AS message FROM d WHERE profile = 'plain' OR (profile = 'none' AND equipment_type = 'reefer')",
    "q_sample_plan_sizes": f"""WITH l AS (SELECT {_K("route_id")} IN (SELECT {_K("route_id")} FROM holdout_routes WHERE {_K("route_id")} IS NOT NULL) held FROM {pr._L} WHERE route_id IS NOT NULL), n AS (SELECT count(*) FILTER (coalesce(held, false)) h FROM l)
SELECT * FROM (SELECT unnest(['train', 'val', 'test', 'test_ood', 'test_ood', 'test_ood']) AS split, unnest([NULL, NULL, NULL, 'family', 'route', 'both']) AS ood_reason, unnest([120, 12, 16, 10, (least(h, 20) + 1) // 2, least(h, 20) // 2])::BIGINT AS n, unnest([120, 12, 16, 10, (least(h, 20) + 1) // 2, least(h, 20) // 2])::BIGINT AS n_loads,
  unnest([0, 0, 0, 0, (least(h, 20) + 1) // 2, least(h, 20) // 2])::BIGINT AS n_held FROM n) WHERE n > 0""",
    "q_prompt_mismatch": "SELECT id AS record_id, split, 'PROMPT_MISMATCH' AS code, 'task ' || coalesce(task, '?') AS message FROM sft_records WHERE NOT coalesce(list_filter(messages, lambda m: m.role = 'system')[1].content = CASE WHEN task IN (" + ", ".join(f"'{k}'" for k in PROMPTS) + f") THEN '{PROMPTS['dispatcher_reply']}' END, false)",
    "q_dup_ids": _DUP_ID,
    "q_dup_texts": _DUP_TEXT,
    "q_dup_documents": f"""WITH k AS (SELECT CAST(doc_id AS VARCHAR) id, source s0, sha256({S.squeeze("text")}) k FROM documents WHERE text IS NOT NULL),
g AS (SELECT k, min(coalesce(s0, '')) s, max(coalesce(s0, '')) z FROM k GROUP BY k HAVING count(*) > 1) SELECT id AS record_id, CASE WHEN s <> z THEN 'DUP_EXACT' ELSE 'DUP_EXACT_IN_SPLIT' END AS code FROM k JOIN g USING (k)""",
    "q_group_leaks": _LEAK,
    "q_split_mismatch": f"SELECT DISTINCT s.id AS record_id, s.split, 'SPLIT_MISMATCH' AS code, 'should be ' || w.split AS message FROM sft_records s JOIN ({pr._SPLIT_SQL}) w USING (id) WHERE group_id IS NOT NULL AND NOT coalesce(s.split = w.split, false)",
    "q_route_leaks": _ROUTE,
    "q_contamination": _BENCH,
    "q_smoke_not_in_train": "SELECT DISTINCT id AS record_id, 'SMOKE_NOT_IN_TRAIN' AS code FROM sft_records b WHERE split = 'bench' AND NOT EXISTS (SELECT 1 FROM sft_records t WHERE t.split = 'train' AND t.id = b.id AND t.task IS NOT DISTINCT FROM b.task AND t.language IS NOT DISTINCT FROM b.language)",
    "q_issue_counts": f"SELECT code, CASE code WHEN 'DUP_EXACT_IN_SPLIT' THEN 'warning' ELSE 'error' END AS severity, count(*) AS n_issues FROM (({_DUP_ID}) UNION ALL ({_DUP_TEXT}) UNION ALL ({_LEAK}) UNION ALL ({_RECORD_CHECKS}) UNION ALL ({_ROUTE}) UNION ALL ({_BENCH})) GROUP BY 1",
    "q_composition": "SELECT split, dimension, value, count(*) AS n FROM (SELECT split, unnest(['family', 'language', 'hard_case']) AS dimension, unnest([template_family, language, coalesce(nullif(array_to_string(variant.hard_cases, ','), ''), 'clean')]) AS value FROM sft_records) GROUP BY ALL",
    "q_dropped_fields": "SELECT field, count(*) AS n, min(id) AS first_id FROM (SELECT id, unnest(variant.dropped_fields) AS field FROM sft_records) GROUP BY 1",
    "q_record_summary": rf"SELECT DISTINCT id, task, substr(trim(regexp_replace(regexp_replace({_USER}, '(?s)\A.*?\n\n', ''), '{S.SPACE}', ' ', 'g')), 1, 140) AS excerpt, CASE WHEN regexp_matches({_USER}, '[а-яёА-ЯЁ]') THEN 'ru' ELSE 'en' END AS written_in FROM sft_records",
    "q_text_hashes": f"SELECT DISTINCT id, sha256({_USER}) AS sha256 FROM sft_records",
    "q_request_lengths": f"SELECT split, count(c) AS n, min(c) AS min_value, quantile_disc(c, 0.5)::DOUBLE AS p50, quantile_disc(c, 0.95)::DOUBLE AS p95, max(c) AS max_value FROM (SELECT split, length({_USER}) c FROM sft_records) GROUP BY 1",
    "q_condition_kinds": f"""WITH t AS (SELECT DISTINCT id, list_filter([{", ".join(f"CASE WHEN regexp_matches(lower({_USER}), '{p}') THEN '{k}' END" for k, p in co.WORDS.items())}], lambda x: x IS NOT NULL) k FROM sft_records),
e AS (SELECT id, unnest(CASE WHEN len(k) = 0 THEN ['none'] ELSE k END) kind FROM t) SELECT kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 4) AS share, min(id) AS first_id FROM e GROUP BY 1""",
    "q_equipment_words": f"SELECT DISTINCT id, " + ", ".join(f"{_class(cs)} AS {c}" for c, cs in ex.CLASSES.items()) + f" FROM (SELECT id, lower({_USER}) low FROM sft_records)",
    "q_extracted_pieces": rf"""WITH t AS (SELECT DISTINCT id, lower(CASE WHEN contains(x, chr(10) || chr(10)) THEN regexp_replace(x, '(?s)\A.*?\n\n', '') ELSE x END) low FROM (SELECT id, coalesce({_USER}, '') x FROM sft_records)),
c AS (SELECT id, nullif(regexp_extract(' ' || low, '(?:^|[^0-9.,])([0-9]{{1,4}}){_SP}*(?:[x×]{_SP}|(?:{_NOUNS}))', 1), '') n,
  regexp_extract(low, '((?:плюс|минус|plus|minus){_SP}+[0-9]+){_SP}*(?:°{_SP}?[cс]?)?{_SP}*(?:\.\.\.?|…|—|–|-|до|to|and|и){_SP}*((?:плюс|минус|plus|minus){_SP}+[0-9]+){_SP}*(?:°|град|degr)', ['a', 'b']) r FROM t),
d AS (SELECT id, CAST(n AS BIGINT) n, CASE WHEN r.a <> '' THEN CAST(regexp_extract(r.a, '[0-9]+') AS DOUBLE) * CASE WHEN r.a SIMILAR TO '(минус|minus).*' THEN -1 ELSE 1 END END a, CASE WHEN r.b <> '' THEN CAST(regexp_extract(r.b, '[0-9]+') AS DOUBLE) * CASE WHEN r.b SIMILAR TO '(минус|minus).*' THEN -1 ELSE 1 END END b FROM c)
SELECT id, n AS pieces, least(a, b) AS min_c, greatest(a, b) AS max_c FROM d""",
}
