"""Evaluation, statistics, logs, streams-as-batches and scalar queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import exprs as E
from millrace.functions import json_answers as ja
from millrace.operators import metrics as m
from millrace.operators import stats as st
from millrace.operators import logs as lg
from millrace.operators.backends import assemble_results, state_changes
from millrace.operators.logs import area_under
from millrace.operators.scoring import last_predictions, score_cases
from millrace.operators.validate import first_rows, message_of
from millrace.plans import profiling as pr
from millrace.plans import sqltext as S
from millrace.session import cut, table
from millrace.sources.artifacts import lineage
from millrace.streaming.logs import sessions, windowed_counts


def _last(spark: SparkSession, sf: str) -> DataFrame:
    return last_predictions(table(spark, sf, "generation_results"), "record_id", ["attempt", "created_at", "result_id"])


def q_last_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _last(spark, sf).select("record_id", "result_id", "model_id", "attempt")


def q_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Records without an answer that isn't an error: what a resumed run still has to ask."""
    done = table(spark, sf, "generation_results").filter("error is null and text is not null").select(F.col("record_id").alias("id"))
    return table(spark, sf, "sft_records").select("id").distinct().join(done, "id", "left_anti")


SLICES = ("task", "language", "template_family", "distribution", "ood_reason", "kind", "hard_case", "source")


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    r = first_rows(table(spark, sf, "sft_records").filter("task = 'shipment_extraction' and id is not null"), "id", [F.col("group_id"), F.col("split")])
    return r.select(F.col("id").alias("record_id"), message_of("assistant").alias("gold_text"), *[c.alias(n) for n, c in m.slice_columns().items()])


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """The last answer to every extraction record, scored: all records, those without an answer as failed."""
    answers = _last(spark, sf).select("record_id", F.col("text").alias("output"), F.when(F.col("text").isNull(), F.coalesce("error", F.lit("no text"))).alias("error"))
    return score_cases(_gold(spark, sf), answers)


def _flat_scores(scores: DataFrame, *more) -> DataFrame:
    return scores.select(
        "record_id", "json_parsed", "schema_valid", "failed", F.col("key_fields_correct").cast("string").alias("key_fields_correct"), "missing_tp", "missing_fp", "missing_fn", "missing_exact",
        F.array_join("critical_errors", ",").alias("critical_errors"), F.array_join("hallucinated_fields", ",").alias("hallucinated_fields"), *more,
    )


def q_case_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_scores(_scores(spark, sf))


def q_field_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Right and wrong answers per field."""
    flags = _scores(spark, sf).select(F.explode("field_correct").alias("field", "right")).filter("right is not null")
    return flags.groupBy("field").agg(F.count_if("right").alias("n_right"), F.count_if(~F.col("right")).alias("n_wrong"))


def q_metrics_overall(spark: SparkSession, sf: str) -> DataFrame:
    return m.metrics_overall(_scores(spark, sf))


def q_metrics_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """All 47 metrics with intervals of 2,000 resamples."""
    return m.metrics_with_intervals(_scores(spark, sf), "record_id")


def q_metrics_by_slice(spark: SparkSession, sf: str) -> DataFrame:
    """All 47 metrics in each of the eight slices."""
    return m.metrics_by_slice(_scores(spark, sf), SLICES)


def q_worst_cases(spark: SparkSession, sf: str) -> DataFrame:
    return m.worst_cases(_scores(spark, sf))


def q_critical_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Critical errors by overlapping kinds of cases, on the made answers that have them."""
    hard = F.col("kind").isin("missing", "hard")
    return m.crosstab(cut(_made_scores(spark, sf).select("critical_errors", "kind")), m.CRITICAL, {"n_all": F.lit(True), "n_clean": F.col("kind") == "clean", "n_conditions": F.col("kind") == "conditions", "n_missing_or_hard": hard})


#: Ways in which the made answers differ from their gold; which one a load has follows from its number alone.
MUTATIONS = ("same", "tonnes", "pounds_as_kg", "turned", "pieces_as_weight", "no_pieces", "invented_delivery", "dropped_condition", "added_condition", "fenced", "cut", "spaced")


def _made(spark: SparkSession, sf: str) -> DataFrame:
    """(record_id, kind, gold_text, output, how): a card of the second version for each load with a usable row, and an answer that differs from it in a known way."""
    one = pr._one(spark, sf, "loads", "load_id").filter("weight_lbs > 0 and pieces between 1 and 99 and load_date is not null")
    number = F.regexp_replace("load_id", "[^0-9]", "").cast("bigint")
    # A fixed number of partitions: the cards are written in Python, and few bytes would end in one task.
    one = one.repartition(spark.sparkContext.defaultParallelism, "load_id")
    l = one.select("load_id", "pieces", "load_date", F.col("weight_lbs").cast("bigint").alias("w"), number.alias("x")).filter("x is not null")  # noqa: E741
    how = F.element_at(F.array(*[F.lit(h) for h in MUTATIONS]), (F.pmod("x", F.lit(len(MUTATIONS))) + 1).cast("int"))
    l = l.withColumn("how", how).withColumn("cold", F.pmod("x", F.lit(5)) < 2)  # noqa: E741
    is_ = lambda h: F.col("how") == h
    place = lambda n: F.struct(F.concat(F.lit(f"City {n}"), F.pmod("x", F.lit(7)).cast("string")).alias("city"), F.lit(f"Region {n}").alias("region"))
    none = F.lit(None)
    side = "struct<value: double, unit: string>"
    condition = F.struct(
        F.lit("temperature").alias("kind"), (F.pmod("x", F.lit(4)).cast("double") + 2).alias("min_c"), F.lit(8.0).alias("max_c"), none.cast("array<string>").alias("methods"),
        none.cast("array<string>").alias("types"), *[none.cast(side).alias(n) for n in ("length", "width", "height")], none.cast("array<string>").alias("parameters"),
    )
    fastening = condition.withField("kind", F.lit("securing")).withField("min_c", none.cast("double")).withField("max_c", none.cast("double")).withField("methods", F.array(F.lit("straps"), F.lit("load_bars")))
    empty = F.array_remove(F.array(condition), condition)

    def card(answer: bool) -> F.Column:
        h = lambda x: is_(x) if answer else F.lit(False)
        n = F.when(~h("no_pieces"), F.when(h("pieces_as_weight"), F.col("w")).otherwise(F.col("pieces")))
        unit = F.when(h("tonnes"), "t").when(h("pounds_as_kg"), "kg").otherwise("lb")
        value = F.when(h("tonnes"), F.col("w") * 0.45359237 / 1000).otherwise(F.col("w").cast("double"))
        cold = F.when(F.col("cold") & ~h("dropped_condition"), F.array(condition)).otherwise(empty)
        return F.struct(
            F.lit("Sender").alias("shipper_name"), F.lit("general").alias("cargo_category"), F.when(F.col("cold"), "isotherm").otherwise("tent").alias("equipment_type"), n.alias("pieces"),
            F.struct(value.alias("value"), unit.alias("unit")).alias("weight_total"), none.cast("struct<value: double, unit: string>").alias("weight_per_piece"),
            F.when(h("turned"), place("B")).otherwise(place("A")).alias("origin"), F.when(h("turned"), place("A")).otherwise(place("B")).alias("destination"),
            F.date_format("load_date", "yyyy-MM-dd").alias("pickup_date"), F.when(h("invented_delivery"), F.date_format("load_date", "yyyy-MM-dd")).alias("delivery_date"),
            F.when(h("added_condition"), F.concat(cold, F.array(fastening))).otherwise(cold).alias("special_conditions"),
        )

    l = l.withColumn("g", card(False)).withColumn("a", card(True))  # noqa: E741
    text = lambda c: ja.canonical_answer(F.col(c), ja.missing_fields(F.col(c), "card_v2"), "card_v2")
    l = l.select("load_id", "how", "cold", text("g").alias("gold_text"), text("a").alias("t"))  # noqa: E741
    output = F.when(is_("fenced"), F.concat(F.lit("```json\n"), F.col("t"), F.lit("\n```"))).when(is_("cut"), F.substring("t", 1, 40)).when(is_("spaced"), F.concat(F.lit(" "), F.col("t"))).otherwise(F.col("t"))
    return l.select(F.col("load_id").alias("record_id"), F.when(F.col("cold"), "conditions").otherwise("clean").alias("kind"), "gold_text", output.alias("output"), "how")


def _made_scores(spark: SparkSession, sf: str) -> DataFrame:
    made = cut(_made(spark, sf))
    return score_cases(made.drop("output"), made.select("record_id", "output", F.lit(None).cast("string").alias("error")), "card_v2")


def q_scores_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of cards with conditions whose answers differ from the gold in twelve known ways."""
    s = _made_scores(spark, sf)
    kinds = [F.col(f"condition_correct.{k}").cast("string").alias(k) for k in ("temperature", "securing")]
    return _flat_scores(s, "how", *kinds, F.col("field_correct.weight_total").cast("string").alias("weight"))


def q_metrics_v2(spark: SparkSession, sf: str) -> DataFrame:
    return m.metrics_by_slice(_made_scores(spark, sf), ["kind"])


_CITIES = ("origin", "destination")


def q_city_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Right cities by slice over all records, in one pass over grouping sets; a failed or missing answer is wrong in every city the gold has."""
    flags = _scores(spark, sf).select("language", "template_family", *[F.col("field_correct")[c].alias(c) for c in _CITIES])
    metrics = {c: m.rate(F.col(c)) for c in _CITIES} | {"micro": m.micro(F.array(*_CITIES))}
    return m.metrics_by_slice(flags, ["language", "template_family"], metrics)


def q_json_fields(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total_k"), F.max("k").alias("max_k"))


def q_missing_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled F1, precision and recall of missing_fields over all records; a failed or missing answer has found none of them."""
    tp, fp, fn = (F.col(f"missing_{n}") for n in ("tp", "fp", "fn"))
    return m.metrics_overall(_scores(spark, sf), {"f1": m.pooled_f1(tp, fp, fn), "precision": m.pooled_share(tp, fp), "recall": m.pooled_share(tp, fn)})


def _closed(spark: SparkSession, sf: str, model: str) -> DataFrame:
    g = table(spark, sf, "generation_results").filter((F.col("model_id") == model) & F.col("record_id").isNotNull())
    return g.groupBy("record_id").agg(F.max(F.coalesce(F.trim("text"), F.lit("")).rlike(r"[.!?}]$")).alias("ok"))


def q_mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    """Two models on the records both have answered: does the answer end?"""
    return st.mcnemar(_closed(spark, sf, "adapter_s1"), _closed(spark, sf, "adapter_s2"), "record_id", "ok")


def q_changed_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Records on which two models differ, with the direction."""
    return st.changed_pairs(_closed(spark, sf, "adapter_s1"), _closed(spark, sf, "adapter_s2"), "record_id", "ok")


def q_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf).select("record_id", "schema_valid", "key_fields_correct")
    return st.bootstrap_ci(s, "record_id", ["schema_valid", "key_fields_correct"])


def q_paired_difference(spark: SparkSession, sf: str) -> DataFrame:
    return st.paired_difference(_closed(spark, sf, "adapter_s1"), _closed(spark, sf, "adapter_s2"), "record_id", "ok")


def q_token_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Token budget by model: what fits 256 answer tokens, what is skipped."""
    g = table(spark, sf, "generation_results")
    fits = F.col("completion_tokens") <= 255
    return g.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fits).alias("n_fit"), F.count_if(~fits).alias("n_skipped"), F.sum(F.when(fits, F.col("completion_tokens"))).alias("tokens"),
        F.max("prompt_tokens").alias("max_prompt"), F.round(F.avg("prompt_tokens"), 6).alias("mean_prompt"), F.round(F.sum("completion_tokens") / F.sum(F.when(F.col("completion_tokens").isNotNull(), F.col("latency_s"))), 6).alias("tokens_per_s"),
    )


def q_token_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Token limit of 1,024 by model: what is too long, and the share of tokens that are answers."""
    return lg.token_audit(table(spark, sf, "generation_results"), "model_id", "prompt_tokens", "completion_tokens", 1024)


def q_training_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Steps and cost of three epochs over the records of each split."""
    n = table(spark, sf, "sft_records").groupBy("split").agg(F.countDistinct("id").alias("n"))
    steps = lg.training_steps(F.col("n"), 2, 8, 3)
    return n.select("split", "n", steps.alias("steps"), lg.training_cost(steps, 9.5, 368.18).alias("cost"))


def q_latest_values(spark: SparkSession, sf: str) -> DataFrame:
    """Last value of each user in the event log."""
    last = lg.latest_values(table(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))), "user_id", "at", "value")
    return last.select("user_id", "at", "value")


def q_state_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose model changed between their first and second answer."""
    g = table(spark, sf, "generation_results").filter("record_id is not null")
    state = lambda n: g.filter(F.col("attempt") == n).groupBy(F.col("record_id").alias("key")).agg(F.min("model_id").alias("value"))
    return state_changes(state(1), state(2))


def q_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every answer to an extraction record as a result: status, weight in kilograms, what was assumed."""
    g = table(spark, sf, "generation_results").filter("record_id is not null and result_id is not null")
    r = table(spark, sf, "sft_records").filter("task = 'shipment_extraction'").select(F.col("id").alias("record_id")).distinct()
    answers = g.join(r, "record_id", "left_semi").groupBy(F.col("result_id").alias("id")).agg(F.max("text").alias("output"), F.max("error").alias("error"))
    out = assemble_results(answers, "card_short")
    return out.select("id", "status", F.round("weight_kg", 6).alias("weight_kg"), "pieces", F.array_join("assumptions", ",").alias("assumptions"), F.array_join("warnings", ",").alias("warnings"))


def q_latency(spark: SparkSession, sf: str) -> DataFrame:
    return pr.q.quantiles_nearest_rank(table(spark, sf, "generation_results"), "model_id", "latency_s")


def q_extraction_status(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "extractions")
    return e.groupBy("model_id", "status").agg(F.count(F.lit(1)).alias("n"), F.count("derived.weight_total_kg").alias("n_weights"), F.round(F.avg("derived.pieces"), 6).alias("mean_pieces"))


def q_weight_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Every load's weight as it would be written: kg, t, lb and kg per piece; exact, half up."""
    one = pr._one(spark, sf, "loads", "load_id").filter("weight_lbs > 0 and pieces > 0")
    return one.select("load_id", *[E.render_weight("weight_lbs", F.lit(u), n).alias(f"{a}") for a, u, n in (("kg", "kg", 1), ("t", "t", 1), ("lb", "lb", 1), ("kg_each", "kg", "pieces"))])


def q_units(spark: SparkSession, sf: str) -> DataFrame:
    kg = E.to_kg("weight_lbs", F.lit("lb"))
    one = pr._one(spark, sf, "loads", "load_id").filter("weight_lbs is not null")
    return one.select("load_id", F.round(kg, 6).alias("kg"), F.round(E.from_kg(kg, F.lit("t")), 9).alias("t"), F.round(E.from_kg(kg, F.lit("lb")), 6).alias("lb"), F.round(E.to_m("pieces", F.lit("cm")), 6).alias("m"))


def q_great_circle(spark: SparkSession, sf: str) -> DataFrame:
    """Distances between invented coordinates of the routes' cities."""
    at = lambda c: (E.hash_uniform(1, c) * 180 - 90, E.hash_uniform(2, c) * 360 - 180)
    r = table(spark, sf, "routes").filter("origin_city is not null and destination_city is not null").select("origin_city", "destination_city").distinct()
    return r.select("origin_city", "destination_city", F.round(E.great_circle_km(*at("origin_city"), *at("destination_city")), 6).alias("km"))


def q_plurals(spark: SparkSession, sf: str) -> DataFrame:
    one = pr._one(spark, sf, "loads", "load_id").filter("pieces is not null")
    return one.select("load_id", E.plural_ru("pieces", "место", "места", "мест").alias("word"), E.relative_day("load_date", F.to_date(F.date_sub("load_date", F.pmod("pieces", F.lit(4)).cast("int")))).alias("said"))


def q_written_dates(spark: SparkSession, sf: str) -> DataFrame:
    one = pr._one(spark, sf, "loads", "load_id").filter("load_date is not null")
    return one.select("load_id", E.written_date("load_date").alias("en"), E.written_date("load_date", "ru").alias("ru"), E.group_number("revenue", 2).alias("revenue_en"))


def q_power_trapezoid(spark: SparkSession, sf: str) -> DataFrame:
    """Value over time per user as an area of trapezoids (value-hours)."""
    return area_under(table(spark, sf, "events"), "user_id", "ts", "value", ["event_id"]).select("user_id", F.round("area", 4).alias("area"), "peak")


def q_hourly_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = windowed_counts(table(spark, sf, "events"), "ts", ["event_type"], "value")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def q_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(table(spark, sf, "events"), "ts", "user_id", "6 hours")
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def q_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Ancestors of the customers of one segment: customer -> nation -> region."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = c.select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent")).union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    roots = c.filter("c_mktsegment = 'BUILDING'").select(name("c", "c_custkey").alias("node"))
    return lineage(edges, roots).withColumn("depth", F.col("depth").cast("bigint"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

_LAST = "(SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY attempt DESC NULLS LAST, created_at DESC NULLS LAST, result_id DESC NULLS LAST) _r FROM generation_results WHERE record_id IS NOT NULL) WHERE _r = 1)"
_ONE = pr._L
_ASSISTANT = "list_filter(messages, lambda m: m.role = 'assistant')[1].content"
# Strict reading in SQL: `t` is read where it is JSON without outer white space or a fence, and fits where every part has the shape of the card.
_FIELDS = ja.version_of("card_short").fields
_LISTED = lambda names: ", ".join(f"'{n}'" for n in names)
_KEYS = lambda at, names: f"(json_type(t, '{at}') = 'OBJECT' AND list_sort(json_keys(t, '{at}')) = list_sort([{_LISTED(names)}]))"
_NULL_OR = lambda at, rule: f"coalesce(json_type(t, '{at}') = 'NULL' OR ({rule}), false)"
_SAID = lambda at: f"json_type(t, '{at}') = 'VARCHAR' AND trim(json_extract_string(t, '{at}')) <> ''"
_NUMBER = "'UBIGINT', 'BIGINT', 'DOUBLE'"
_FITS = " AND ".join([
    _KEYS("$", ("card", "missing_fields", "conflicts")), _KEYS("$.card", _FIELDS), _NULL_OR("$.card.shipper_name", _SAID("$.card.shipper_name")),
    _NULL_OR("$.card.cargo_category", f"json_extract_string(t, '$.card.cargo_category') IN ({_LISTED(ja.CATEGORIES)})"), _NULL_OR("$.card.equipment_type", f"json_extract_string(t, '$.card.equipment_type') IN ({_LISTED(ja.EQUIPMENT)})"),
    _NULL_OR("$.card.pieces", "json_type(t, '$.card.pieces') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract(t, '$.card.pieces') AS BIGINT) >= 1"),
    _NULL_OR("$.card.weight_total", f"{_KEYS('$.card.weight_total', ('value', 'unit'))} AND json_type(t, '$.card.weight_total.value') IN ({_NUMBER}) AND CAST(json_extract(t, '$.card.weight_total.value') AS DOUBLE) > 0 AND json_extract_string(t, '$.card.weight_total.unit') IN ({_LISTED(ja.UNITS)})"),
    *[_NULL_OR(f"$.card.{c}", f"{_KEYS(f'$.card.{c}', ('city',))} AND {_SAID(f'$.card.{c}.city')}") for c in ("origin", "destination")],
    _NULL_OR("$.card.pickup_date", "json_type(t, '$.card.pickup_date') = 'VARCHAR' AND regexp_matches(json_extract_string(t, '$.card.pickup_date'), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND TRY_CAST(json_extract_string(t, '$.card.pickup_date') AS DATE) IS NOT NULL"),
    f"json_type(t, '$.missing_fields') = 'ARRAY' AND len(list_filter(json_extract_string(t, '$.missing_fields[*]'), lambda x: x NOT IN ({_LISTED(_FIELDS)}))) = 0",
    f"json_type(t, '$.conflicts') = 'ARRAY' AND len(list_filter(json_extract(t, '$.conflicts[*]'), lambda x: NOT coalesce(json_type(x) = 'OBJECT' AND list_sort(json_keys(x)) = ['field', 'values'] AND json_extract_string(x, '$.field') IN ({_LISTED(_FIELDS)}) AND json_array_length(x, '$.values') >= 2 AND len(list_distinct(json_extract(x, '$.values[*]'))) = json_array_length(x, '$.values'), false))) = 0",
])
_OUTER = r"[\s\x{1c}-\x{1f}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BARE = rf"regexp_replace(regexp_replace(x, '^{_OUTER}+', ''), '{_OUTER}+$', '')"
_UNWRAPPED = rf"CASE WHEN regexp_matches({_BARE}, '(?s)^```[A-Za-z]*\s*.*```$') AND length({_BARE}) >= 6 THEN regexp_replace(regexp_extract({_BARE}, '(?s)^```[A-Za-z]*\s*(.*)```$', 1), '\s+$', '') ELSE {_BARE} END"
_KG = lambda t: f"(CAST(json_extract({t}, '$.card.weight_total.value') AS DOUBLE) * CASE json_extract_string({t}, '$.card.weight_total.unit') WHEN 'kg' THEN 1::DOUBLE WHEN 't' THEN 1000::DOUBLE ELSE 0.45359237::DOUBLE END)"
_VALUE = {
    "shipper_name": lambda t: S.squeeze(f"json_extract_string({t}, '$.card.shipper_name')"), "weight_total": _KG, "pieces": lambda t: f"CAST(json_extract({t}, '$.card.pieces') AS BIGINT)",
    **{c: (lambda t, c=c: f"lower(trim(json_extract_string({t}, '$.card.{c}.city')))") for c in ("origin", "destination")},
    **{c: (lambda t, c=c: f"json_extract_string({t}, '$.card.{c}')") for c in ("cargo_category", "equipment_type", "pickup_date")},
}
_MISS = lambda t: f"list_distinct(coalesce(json_extract_string({t}, '$.missing_fields[*]'), []))"
_CONF = lambda t: f"coalesce(list_transform(json_extract({t}, '$.conflicts[*]'), lambda x: json_extract_string(x, '$.field')), [])"


def _right(f: str) -> str:
    same = f"abs(g_{f} - a_{f}) <= 0.5" if f == "weight_total" else f"g_{f} = a_{f}"
    return f"CASE WHEN failed THEN CASE WHEN g_{f} IS NOT NULL THEN false END WHEN g_{f} IS NULL AND a_{f} IS NULL THEN NULL ELSE coalesce({same}, false) END AS r_{f}"


_KEY = ("origin", "destination", "pickup_date", "equipment_type", "pieces")
_MANUAL = "template_family IN ('manual', 'manual_mock')"
_HARD = "array_to_string(variant.hard_cases, ',')"
SCORED = f"""WITH r AS (SELECT id AS record_id, {_ASSISTANT} gold, task, language, template_family, CASE WHEN variant.ood_reason IS NULL THEN 'in_dist' ELSE 'ood' END AS distribution, coalesce(variant.ood_reason, '—') AS ood_reason,
    CASE WHEN {_MANUAL} THEN 'manual' WHEN coalesce({_HARD}, '') = '' THEN 'clean' WHEN {_HARD} = 'dropped_fields' THEN 'missing' ELSE 'hard' END AS kind,
    CASE WHEN {_MANUAL} THEN 'manual' ELSE coalesce(nullif({_HARD}, ''), 'clean') END AS hard_case, CASE WHEN synthetic THEN 'synthetic' ELSE 'manual' END AS source
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY group_id NULLS FIRST, split NULLS FIRST) _r FROM sft_records WHERE task = 'shipment_extraction' AND id IS NOT NULL) WHERE _r = 1),
j AS (SELECT r.*, a.text AS output, a.record_id IS NULL OR a.text IS NULL AS no_text FROM r LEFT JOIN {_LAST} a USING (record_id)),
u AS (SELECT record_id, 'gold' k, {_UNWRAPPED.replace("(x,", "(gold,")} x FROM j UNION ALL SELECT record_id, 'raw', output FROM j UNION ALL SELECT record_id, 'inner', {_UNWRAPPED.replace("(x,", "(output,")} FROM j),
v AS (SELECT record_id, k, CASE WHEN json_valid(x) AND x = {_BARE} AND NOT starts_with(x, '```') THEN x END t FROM u),
f AS (SELECT record_id, k, t IS NOT NULL parsed, CASE WHEN {_FITS} THEN t END t FROM v),
w AS (SELECT record_id, bool_or(parsed) FILTER (k = 'raw') json_parsed, max(t) FILTER (k = 'gold') g, max(t) FILTER (k = 'inner') a, count(t) FILTER (k = 'raw') > 0 schema_valid FROM f GROUP BY 1),
x AS (SELECT j.*, json_parsed, schema_valid, no_text OR a IS NULL AS failed, {", ".join(f"{_VALUE[c]('g')} AS g_{c}, {_VALUE[c]('a')} AS a_{c}" for c in _FIELDS)},
    {_MISS("g")} gm, {_MISS("a")} am, {_CONF("g")} gc, {_CONF("a")} ac, CAST(json_extract(g, '$.card.weight_total.value') AS DOUBLE) gv, CAST(json_extract(a, '$.card.weight_total.value') AS DOUBLE) av FROM j JOIN w USING (record_id) WHERE g IS NOT NULL),
y AS (SELECT *, {", ".join(map(_right, _FIELDS))}, list_filter([{", ".join(f"CASE WHEN g_{c} IS NULL AND a_{c} IS NOT NULL THEN '{c}' END" for c in _FIELDS)}], lambda e: e IS NOT NULL) extra FROM x),
z AS (SELECT *, list_filter(extra, lambda e: NOT list_contains(gc, e)) invented FROM y),
scored AS (SELECT *, CASE WHEN {" AND ".join(f"g_{c} IS NOT NULL" for c in (*_KEY, "weight_total"))} THEN coalesce({" AND ".join(f"r_{c}" for c in _KEY)} AND abs(g_weight_total - a_weight_total) <= 0.5, false) AND NOT failed END key_fields_correct,
    CASE WHEN failed THEN 0 ELSE len(list_intersect(gm, am)) END::INT missing_tp, CASE WHEN failed THEN 0 ELSE len(list_filter(am, lambda e: NOT list_contains(gm, e))) END::INT missing_fp,
    CASE WHEN failed THEN len(gm) ELSE len(list_filter(gm, lambda e: NOT list_contains(am, e))) END::INT missing_fn, NOT failed AND list_sort(gm) = list_sort(am) missing_exact,
    CASE WHEN len(gc) > 0 THEN NOT failed AND len(list_filter(gc, lambda e: NOT list_contains(ac, e))) = 0 END conflict_detected,
    CASE WHEN failed THEN [] ELSE invented END hallucinated,
    CASE WHEN failed THEN [] ELSE list_sort(list_filter([CASE WHEN len(list_intersect(extra, gc)) > 0 THEN 'missed_conflict' END, CASE WHEN len(list_intersect(invented, gm)) > 0 THEN 'hallucinated_required_field' END,
      CASE WHEN coalesce(a_pieces <> coalesce(g_pieces, -1) AND a_pieces = gv, false) OR coalesce(g_pieces = av AND g_pieces <> coalesce(gv, -1), false) THEN 'pieces_weight_swap' END,
      CASE WHEN g_weight_total > 0 AND abs(g_weight_total - a_weight_total) > 0.5 AND len(list_filter([0.45359237::DOUBLE, 1 / 0.45359237::DOUBLE, 1000::DOUBLE, 0.001::DOUBLE], lambda e: abs(a_weight_total / g_weight_total / e - 1) <= 0.02)) > 0 THEN 'wrong_unit_magnitude' END,
      CASE WHEN g_origin <> g_destination AND a_origin = g_destination AND a_destination = g_origin THEN 'origin_destination_swap' END], lambda e: e IS NOT NULL)) END critical FROM z)
"""
_R = lambda flag: f"round(avg(CAST({flag} AS INT)), 9)"
_RATIO = lambda top, bottom: f"round(sum({top})::DOUBLE / nullif(sum({bottom}), 0), 9)"
_NONE = "CAST(NULL AS DOUBLE)"
_METRICS = {
    "json_valid_rate": _R("schema_valid"), "lenient_parse_rate": _R("NOT failed"), "failed_output_rate": _R("failed"), "key_field_accuracy": _R("key_fields_correct"), "missing_exact_rate": _R("missing_exact"), "conflict_recall": _R("conflict_detected"),
    "hallucination_rate": _R("CASE WHEN NOT failed THEN len(hallucinated) > 0 END"), "critical_error_count": "sum(CASE WHEN NOT failed THEN len(critical) END)::DOUBLE",
    "field_accuracy_micro": _RATIO(" + ".join(f"coalesce(CAST(r_{c} AS INT), 0)" for c in _FIELDS), " + ".join(f"CAST(r_{c} IS NOT NULL AS INT)" for c in _FIELDS)),
    "missing_f1": "round(CASE WHEN sum(missing_tp + missing_fp + missing_fn) = 0 THEN 1 ELSE 2 * sum(missing_tp)::DOUBLE / nullif(sum(2 * missing_tp + missing_fp + missing_fn), 0) END, 9)",
    **{f"field_accuracy.{c}": _R(f"r_{c}") if c in _FIELDS else _NONE for c in ja.FIELDS}, **{f"critical_error_count.{k}": f"sum(CASE WHEN NOT failed THEN CAST(list_contains(critical, '{k}') AS INT) END)::DOUBLE" for k in m.CRITICAL},
    "special_conditions_exact_rate": _NONE, **{f"field_accuracy.special_conditions.{k}": _NONE for k in ja.KINDS}, **{f"condition_{x}{k}": _NONE for x in ("precision", "recall") for k in ("", *[f".{k}" for k in ja.KINDS])},
}


def _by(slices: dict[str, str], metrics: dict[str, str], source: str = "scored") -> str:
    names, values = ", ".join(f"'{n}'" for n in metrics), ", ".join(metrics.values())
    rows = [f"SELECT '{s}' AS slice, CAST({v} AS VARCHAR) AS slice_value, count(*) AS n_cases, unnest([{names}]) AS metric, unnest([{values}]) AS value FROM {source} {'GROUP BY ' + v if v != 'NULL' else ''}" for s, v in slices.items()]
    return " UNION ALL ".join(rows)


# Scores of the made answers follow from how each differs from its gold.
_MADE = """WITH l AS (SELECT load_id AS record_id, CAST(regexp_replace(load_id, '[^0-9]', '', 'g') AS BIGINT) x, CAST(weight_lbs AS BIGINT) w, pieces FROM {one} WHERE weight_lbs > 0 AND pieces BETWEEN 1 AND 99 AND load_date IS NOT NULL AND regexp_matches(load_id, '[0-9]')),
h AS (SELECT *, [{how}][x % {n} + 1] how, x % 5 < 2 cold FROM l),
s AS (SELECT record_id, how, cold, CASE WHEN cold THEN 'conditions' ELSE 'clean' END kind, how = 'cut' AS failed, how NOT IN ('cut', 'fenced', 'spaced') AS json_parsed, how NOT IN ('cut', 'fenced', 'spaced') AS schema_valid,
  how NOT IN ('cut', 'turned', 'no_pieces', 'added_condition') AND NOT (how = 'pieces_as_weight' AND w <> pieces) AND NOT (how = 'dropped_condition' AND cold) AND NOT (how = 'pounds_as_kg' AND abs(w - w * 0.45359237::DOUBLE) > 0.5) AS key_fields_correct,
  0 AS missing_tp, CASE WHEN how = 'no_pieces' THEN 1 ELSE 0 END AS missing_fp, 0 AS missing_fn, how NOT IN ('no_pieces', 'cut') AS missing_exact,
  CASE how WHEN 'turned' THEN 'origin_destination_swap' WHEN 'pieces_as_weight' THEN CASE WHEN w <> pieces THEN 'pieces_weight_swap' ELSE '' END WHEN 'added_condition' THEN 'hallucinated_condition' WHEN 'dropped_condition' THEN CASE WHEN cold THEN 'missed_condition' ELSE '' END
    WHEN 'pounds_as_kg' THEN CASE WHEN abs(w - w * 0.45359237::DOUBLE) > 0.5 THEN 'wrong_unit_magnitude' ELSE '' END ELSE '' END AS critical_errors,
  CASE how WHEN 'invented_delivery' THEN 'delivery_date' WHEN 'added_condition' THEN 'special_conditions' ELSE '' END AS hallucinated_fields,
  CASE WHEN NOT cold THEN NULL ELSE how NOT IN ('cut', 'dropped_condition') END AS temperature, CASE WHEN how = 'added_condition' THEN false END AS securing,
  how <> 'cut' AND NOT (how = 'pounds_as_kg' AND abs(w - w * 0.45359237::DOUBLE) > 0.5) AS weight FROM h)
"""


def _made_sql() -> str:
    return _MADE.replace("{one}", _ONE).replace("{how}", ", ".join(f"'{h}'" for h in MUTATIONS)).replace("{n}", str(len(MUTATIONS)))


_OK = "(SELECT record_id, max(regexp_matches(trim(coalesce(text, '')), '[.!?}}]$')) ok FROM generation_results WHERE model_id = '{m}' AND record_id IS NOT NULL GROUP BY 1)"
_U = S.hash_uniform


ORACLE = {
    "q_last_predictions": f"SELECT record_id, result_id, model_id, attempt FROM {_LAST}",
    "q_pending": "SELECT DISTINCT id FROM sft_records WHERE id NOT IN (SELECT record_id FROM generation_results WHERE error IS NULL AND text IS NOT NULL AND record_id IS NOT NULL)",
    "q_city_accuracy": SCORED + _by({"all": "NULL", "language": "language", "template_family": "template_family"}, {**{c: _R(f"r_{c}") for c in _CITIES}, "micro": _RATIO(" + ".join(f"coalesce(CAST(r_{c} AS INT), 0)" for c in _CITIES), " + ".join(f"CAST(r_{c} IS NOT NULL AS INT)" for c in _CITIES))}),
    "q_case_scores": SCORED + "SELECT record_id, json_parsed, schema_valid, failed, CAST(key_fields_correct AS VARCHAR) AS key_fields_correct, missing_tp, missing_fp, missing_fn, missing_exact, array_to_string(critical, ',') AS critical_errors, array_to_string(hallucinated, ',') AS hallucinated_fields FROM scored",
    "q_field_flags": SCORED + "SELECT field, count(*) FILTER (ok) AS n_right, count(*) FILTER (NOT ok) AS n_wrong FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in _FIELDS) + "]) AS field, unnest([" + ", ".join(f"r_{c}" for c in _FIELDS) + "]) AS ok FROM scored) WHERE ok IS NOT NULL GROUP BY 1",
    "q_metrics_overall": SCORED + "SELECT metric, value FROM (" + _by({"all": "NULL"}, _METRICS) + ")",
    "q_metrics_by_slice": SCORED + _by({"all": "NULL", **{x: x for x in SLICES}}, _METRICS),
    "q_worst_cases": SCORED + "SELECT record_id, failed, CAST(len(critical) AS INT) AS n_critical, CAST(" + " + ".join(f"CAST(coalesce(NOT r_{c}, false) AS INT)" for c in _FIELDS) + " AS INT) AS n_wrong FROM scored ORDER BY failed DESC, n_critical DESC, n_wrong DESC, record_id LIMIT 20",
    "q_scores_v2": _made_sql() + "SELECT record_id, how, json_parsed, schema_valid, failed, CAST(key_fields_correct AS VARCHAR) AS key_fields_correct, missing_tp, missing_fp, missing_fn, missing_exact, critical_errors, hallucinated_fields, CAST(temperature AS VARCHAR) AS temperature, CAST(securing AS VARCHAR) AS securing, CAST(weight AS VARCHAR) AS weight FROM s",
    "q_critical_by_kind": _made_sql() + "SELECT critical_errors AS kind, count(*) AS n_all, count(*) FILTER (NOT cold) AS n_clean, count(*) FILTER (cold) AS n_conditions, count(*) FILTER (false) AS n_missing_or_hard FROM s WHERE critical_errors <> '' GROUP BY 1",
    "q_changed_cases": f"SELECT a.record_id, CASE WHEN b.ok THEN 'fixed' ELSE 'broken' END AS change FROM {_OK.format(m='adapter_s1')} a JOIN {_OK.format(m='adapter_s2')} b USING (record_id) WHERE a.ok <> b.ok",
    "q_json_fields": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total_k, max(k) AS max_k FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events) GROUP BY 1",
    "q_missing_f1": SCORED + "SELECT unnest(['f1', 'precision', 'recall']) AS metric, unnest([" + _METRICS["missing_f1"] + ", " + _RATIO("missing_tp", "missing_tp + missing_fp") + ", " + _RATIO("missing_tp", "missing_tp + missing_fn") + "]) AS value FROM scored",
    "q_mcnemar": f"""WITH j AS (SELECT a.ok x, b.ok y FROM {_OK.format(m="adapter_s1")} a JOIN {_OK.format(m="adapter_s2")} b USING (record_id)),
c AS (SELECT count(*) n_pairs, count(*) FILTER (NOT x AND y) fixed, count(*) FILTER (x AND NOT y) broken FROM j)
SELECT n_pairs, fixed, broken, round(CASE WHEN fixed + broken = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(fixed, broken) + 1), lambda i: exp(lgamma(fixed + broken + 1.0) - lgamma(i + 1.0) - lgamma(fixed + broken - i + 1.0) - (fixed + broken) * ln(2))))) END, 9) AS p_value FROM c""",
    "q_token_stats": "SELECT model_id, count(*) AS n, count(*) FILTER (completion_tokens <= 255) AS n_fit, count(*) FILTER (completion_tokens > 255) AS n_skipped, (sum(completion_tokens) FILTER (completion_tokens <= 255))::BIGINT AS tokens, max(prompt_tokens) AS max_prompt, round(avg(prompt_tokens), 6) AS mean_prompt, round(sum(completion_tokens) / sum(latency_s) FILTER (completion_tokens IS NOT NULL), 6) AS tokens_per_s FROM generation_results GROUP BY 1",
    "q_token_audit": "SELECT model_id, count(*) AS n, count(*) FILTER (w > 1024) AS n_too_long, round(avg(CAST(w > 1024 AS INT)), 6) AS too_long_rate, round((sum(completion_tokens) FILTER (w <= 1024))::DOUBLE / sum(w) FILTER (w <= 1024), 6) AS trainable_share FROM (SELECT *, prompt_tokens + completion_tokens w FROM generation_results) WHERE w IS NOT NULL GROUP BY 1",
    "q_training_plan": "SELECT split, n, steps, round(steps * 9.5 / 3600.0::DOUBLE * 368.18::DOUBLE, 2) AS cost FROM (SELECT split, count(DISTINCT id) n, CAST(ceil(count(DISTINCT id) / 16.0) * 3 AS BIGINT) steps FROM sft_records GROUP BY 1)",
    "q_latest_values": "SELECT user_id, epoch_us(ts) AS at, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) r FROM events WHERE value IS NOT NULL AND NOT isnan(value)) WHERE r = 1",
    "q_state_changes": "WITH s AS (SELECT record_id, attempt, min(model_id) m FROM generation_results WHERE record_id IS NOT NULL GROUP BY ALL) SELECT coalesce(a.record_id, b.record_id) AS key, a.m AS before, b.m AS after FROM (FROM s WHERE attempt = 1) a FULL JOIN (FROM s WHERE attempt = 2) b USING (record_id) WHERE a.m IS DISTINCT FROM b.m",
    "q_results": f"""WITH g AS (SELECT result_id id, max(text) x0, max(error) error FROM generation_results WHERE record_id IN (SELECT id FROM sft_records WHERE task = 'shipment_extraction') AND result_id IS NOT NULL GROUP BY 1),
u AS (SELECT id, x0, error, {_UNWRAPPED.replace("(x,", "(x0,")} x FROM g), v AS (SELECT *, CASE WHEN json_valid(x) AND x = {_BARE} AND NOT starts_with(x, '```') THEN x END t FROM u), w AS (SELECT *, CASE WHEN {_FITS} THEN t END f FROM v),
s AS (SELECT id, CASE WHEN error IS NOT NULL OR x0 IS NULL THEN 'backend_error' WHEN f IS NULL THEN 'invalid_output' ELSE 'ok' END status, f FROM w)
SELECT id, status, CASE WHEN status = 'ok' THEN round({_KG('f')}, 6) END AS weight_kg, CASE WHEN status = 'ok' THEN CAST(json_extract(f, '$.card.pieces') AS BIGINT) END AS pieces, CASE WHEN status = 'ok' AND json_type(f, '$.card.pieces') = 'NULL' THEN 'pieces=1' ELSE '' END AS assumptions,
  CASE WHEN status = 'ok' AND {_KG('f')} > 25000 THEN 'weight_implausible' ELSE '' END AS warnings FROM s""",
    "q_latency": "SELECT model_id, count(latency_s) AS n, min(latency_s) AS min_value, quantile_disc(latency_s, 0.5) AS p50, quantile_disc(latency_s, 0.95) AS p95, max(latency_s) AS max_value FROM generation_results GROUP BY 1",
    "q_extraction_status": "SELECT model_id, status, count(*) AS n, count(derived.weight_total_kg) AS n_weights, round(avg(derived.pieces), 6) AS mean_pieces FROM extractions GROUP BY 1, 2",
    "q_weight_spelling": f"""WITH l AS (SELECT load_id, weight_lbs::HUGEINT * 45359237 n, weight_lbs w, pieces FROM {_ONE} WHERE weight_lbs > 0 AND pieces > 0)
SELECT load_id, ((2 * n + 100000000) // 200000000)::DOUBLE AS kg, ((2 * n + 10000000000) // 20000000000)::DOUBLE / 10 AS t, w::DOUBLE AS lb, ((2 * n + 100000000 * pieces) // (200000000 * pieces))::DOUBLE AS kg_each FROM l""",
    "q_units": f"SELECT load_id, round(weight_lbs * 0.45359237::DOUBLE, 6) AS kg, round(weight_lbs * 0.45359237::DOUBLE / 1000, 9) AS t, round(weight_lbs::DOUBLE, 6) AS lb, round(pieces / 100, 6) AS m FROM {_ONE} WHERE weight_lbs IS NOT NULL",
    "q_great_circle": f"""WITH r AS (SELECT DISTINCT origin_city o, destination_city d FROM routes WHERE origin_city IS NOT NULL AND destination_city IS NOT NULL),
k AS (SELECT o, d, radians({_U(1, "o")} * 180 - 90) a, radians({_U(1, "d")} * 180 - 90) b, radians({_U(2, "d")} * 360 - 180) - radians({_U(2, "o")} * 360 - 180) l FROM r)
SELECT o AS origin_city, d AS destination_city, round(6371.0 * acos(greatest(-1.0, least(1.0, sin(a) * sin(b) + cos(a) * cos(b) * cos(l)))), 6) AS km FROM k""",
    "q_plurals": f"""SELECT load_id, CASE WHEN pieces % 100 BETWEEN 11 AND 14 THEN 'мест' WHEN pieces % 10 = 1 THEN 'место' WHEN pieces % 10 BETWEEN 2 AND 4 THEN 'места' ELSE 'мест' END AS word,
CASE WHEN load_date IS NULL THEN NULL WHEN pieces % 4 = 0 THEN 'today' WHEN pieces % 4 = 1 THEN 'tomorrow' WHEN pieces % 4 = 2 THEN 'the day after tomorrow' ELSE strftime(load_date, '%Y-%m-%d') END AS said FROM {_ONE} WHERE pieces IS NOT NULL""",
    "q_written_dates": f"""SELECT load_id, strftime(load_date, '%B ') || day(load_date) || ', ' || year(load_date) AS en, day(load_date) || ' ' || (['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', 'октября', 'ноября', 'декабря'])[month(load_date)] || ' ' || year(load_date) AS ru,
format('{{:,.2f}}', revenue) AS revenue_en FROM {_ONE} WHERE load_date IS NOT NULL""",
    "q_power_trapezoid": "WITH e AS (SELECT *, lag(value) OVER w lv, lag(ts) OVER w lt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(coalesce(sum((value + lv) / 2 * floor(epoch(ts - lt)) / 3600), 0.0), 4) AS area, max(value) AS peak FROM e GROUP BY 1",
    "q_hourly_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "q_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "q_lineage": """WITH RECURSIVE e AS (SELECT 'c' || c_custkey node, 'n' || c_nationkey parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
l AS (SELECT 'c' || c_custkey node, 0 depth FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT parent, depth + 1 FROM l JOIN e USING (node)) SELECT node, min(depth)::BIGINT AS depth FROM l GROUP BY 1""",
}
