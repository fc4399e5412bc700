"""Schemas of the data model: raw tables, records, facts, answers, scores and issues.

Schemas are fixed and versioned, never inferred. ``RAW`` holds the explicit
types with which the CSV tables are scanned; date columns are read as text and
parsed under a check.
"""

from __future__ import annotations

from pyspark.sql import types as T

ISSUE = "record_id string, split string, code string, message string"

RAW: dict[str, str] = {
    "loads": "load_id string, customer_id string, route_id string, load_date string, load_type string, weight_lbs bigint, pieces bigint, revenue double, fuel_surcharge double, accessorial_charges double, load_status string, booking_type string",
    "routes": "route_id string, origin_city string, origin_state string, destination_city string, destination_state string, typical_distance_miles bigint, base_rate_per_mile double, fuel_surcharge_rate double, typical_transit_days bigint",
    "customers": "customer_id string, customer_name string, customer_type string, credit_terms_days bigint, primary_freight_type string, account_status string, contract_start_date string, annual_revenue_potential bigint",
    "delivery_events": "event_id string, load_id string, trip_id string, event_type string, facility_id string, scheduled_datetime string, actual_datetime string, detention_minutes bigint, on_time_flag string, location_city string, location_state string",
}

#: Date columns by table: the pattern and the type they are parsed to.
DATES: dict[str, dict[str, tuple[str, str]]] = {
    "loads": {"load_date": ("yyyy-MM-dd", "date")},
    "delivery_events": {"scheduled_datetime": ("yyyy-MM-dd HH:mm:ss.SSSSSS", "timestamp_ntz")},
}
KEYS = {"loads": "load_id", "routes": "route_id", "customers": "customer_id", "delivery_events": "event_id"}

PLACE = "struct<city: string, region: string>"
DIMENSION = "struct<value: double, unit: string>"
CONDITION = f"struct<kind: string, min_c: double, max_c: double, methods: array<string>, types: array<string>, length: {DIMENSION}, width: {DIMENSION}, height: {DIMENSION}, parameters: array<string>>"
FACT_V1 = f"load_id string, route_id string, customer_id string, shipper_name string, cargo_category string, equipment_type string, pieces bigint, weight_lbs bigint, origin {PLACE}, destination {PLACE}, pickup_date date, delivery_date date, load_month string"
FACT_V2 = f"{FACT_V1}, special_conditions array<{CONDITION}>, profile string"
VARIANT = "struct<weight_unit: string, weight_mode: string, dropped_fields: array<string>, hard_cases: array<string>, request_date: date, date_style: string, city_lang: string, ood_reason: string>"
RECORD = f"id string, task string, group_id string, source_id string, language string, template_family string, schema_version string, split string, reviewed boolean, synthetic boolean, variant {VARIANT}, messages array<struct<role: string, content: string>>"
PREDICTION = "id string, output string, latency_s double, ttft_s double, prompt_tokens bigint, completion_tokens bigint, error string"
CASE_SCORE = "record_id string, json_parsed boolean, schema_valid boolean, json_parsed_lenient boolean, generation_error string, field_correct map<string, boolean>, key_fields_correct boolean, missing_tp int, missing_fp int, missing_fn int, missing_exact boolean, conflict_detected boolean, hallucinated_fields array<string>, critical_errors array<string>, notes array<string>"
MANIFEST = "kind string, path string, sha256 string, version string, parents array<string>"

#: Readable versions per kind of data; any other version is refused.
VERSIONS: dict[str, dict[str, str]] = {"facts": {"facts_v1": FACT_V1, "facts_v2": FACT_V2}, "records": {"card_v1": RECORD, "card_v2": RECORD}, "predictions": {"v1": PREDICTION}, "scores": {"v1": CASE_SCORE}}


def schema_of(kind: str, version: str) -> T.StructType:
    """Schema of a version; ValueError where the version is not readable."""
    known = VERSIONS.get(kind, {})
    if version not in known:
        raise ValueError(f"{kind} version {version!r} can't be read; known: {', '.join(sorted(known)) or 'none'}")
    return parse(known[version])


def parse(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def columns(ddl: str) -> list[str]:
    """Top-level column names of a DDL string, without a session."""
    names, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            names.append(ddl[start:i].split()[0])
            start = i + 1
    return names
