"""Pieces of oracle SQL that match the library's expressions."""

SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def hash_uniform(seed: int, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(CAST('0x' || substr(sha256({text}), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0)"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{SPACE}', ' ', 'g'))"


def user_text(messages: str = "messages") -> str:
    return f"list_filter({messages}, lambda m: m.role = 'user')[1].content"


def normal_request(text: str) -> str:
    """Body after a dated header, in squeezed form."""
    header = rf"regexp_extract({text}, '(?s)\A(.*?)\n\n', 1)"
    dated = rf"regexp_matches({header}, '(?i)^(?:request date|дата запроса)([^\p{{L}}\p{{N}}\n][^\n]*)?$')"
    return squeeze(rf"CASE WHEN {dated} THEN regexp_replace({text}, '(?s)\A.*?\n\n', '') ELSE {text} END")


def first_rows(table: str, key: str, order: str = "ingested_at") -> str:
    return f"(SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) _r FROM {table}) WHERE _r = 1)"
