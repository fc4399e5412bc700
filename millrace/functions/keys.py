"""One spelling for keys that are written differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_key(c: Column | str) -> Column:
    """Letters in upper case, then the number without leading zeros; null where there is no digit.

    ``' cust-0007 '`` and ``'CUST7'`` are the same key; ``'N/A'``, ``''`` and null are no key.
    """
    c = F.col(c) if isinstance(c, str) else c
    # Most keys are letters and then one number: one replacement drops what parts them and leading zeros, where the rest takes several.
    quick = F.regexp_replace(F.upper(c), r"[^\p{L}0-9]+|(?<![0-9])0+(?=[0-9])", "")
    letters = F.upper(F.regexp_replace(c, r"[^\p{L}]", ""))
    digits = F.regexp_replace(F.regexp_replace(c, r"[^0-9]", ""), r"^0+(?=[0-9])", "")
    return F.when(c.rlike(r"^[^0-9]*[0-9]+[^\p{L}0-9]*$"), quick).when(F.length(digits) > 0, F.concat(letters, digits))


#: The same rule in SQL of the oracle; ``{c}`` is the column.
CANONICAL_KEY_SQL = (
    "CASE WHEN regexp_matches({c}, '[0-9]') THEN upper(regexp_replace({c}, '[^\\p{{L}}]', '', 'g')) || "
    "regexp_replace(regexp_replace({c}, '[^0-9]', '', 'g'), '^0+([0-9])', '\\1') END"
)


def canonical_key_sql(column: str) -> str:
    return CANONICAL_KEY_SQL.format(c=column)
