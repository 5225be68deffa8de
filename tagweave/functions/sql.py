"""The row functions callable from Spark SQL.

Registered as SQL-bodied temporary functions (``CREATE TEMPORARY FUNCTION
... RETURN <expression>``): the body is inlined into the plan like any
built-in expression — no Python at run time — and uses the same pattern
constants as the Column functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tagweave.functions import text as T


def _raw(pattern: str) -> str:
    """A Spark SQL raw string literal of a regex (quotes spelled as \\x27 / \\x22)."""
    return "r'" + pattern.replace("'", "\\x27").replace('"', "\\x22") + "'"


def register_sql_functions(spark: SparkSession, prefix: str = "tw_") -> list[str]:
    defs = {
        "capitalization": ("t STRING", "DOUBLE",
                           "CAST(regexp_count(t, '[A-Z]') AS DOUBLE) / "
                           "greatest(regexp_count(t, '[A-Z]') + regexp_count(t, '[a-z]'), 1)"),
        "capital_count": ("t STRING", "DOUBLE", "CAST(regexp_count(t, '[A-Z]') AS DOUBLE)"),
        "punctuation_strict": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(t, {_raw(T.STRICT_PUNCTUATION)}, 0)"),
        "punctuation_noisy": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(t, {_raw(T.NOISY_PUNCTUATION)}, 0)"),
        "emoji": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(t, {_raw(T.EMOJI_RUN)}, 0)"),
        "url_hosts": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(t, {_raw(T.URL_PATTERN)}, 2)"),
        "strip_urls": ("t STRING", "STRING", f"regexp_replace(t, {_raw(T.URL_PATTERN)}, ' ')"),
        "whitespace_tokens": ("t STRING", "ARRAY<STRING>", f"filter(split(t, {_raw('[' + T.PY_SPACE + ']+')}), x -> x <> '')"),
        "trim80": ("t STRING", "STRING", "IF(char_length(t) > 80, concat(substring(t, 1, 77), '...'), t)"),
        "time_of_day": ("ts TIMESTAMP_NTZ, res INT", "INT",
                        "CAST(pmod(CAST(rint((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 60.0 / (60.0 / res)) "
                        "AS INT), 24 * res) AS INT)"),
    }
    names = []
    for name, (args, ret, body) in defs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {ret} RETURN {body}")
        names.append(prefix + name)
    return names
