"""The engine's functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cloakframe.functions.regex import SPACE

# SQL functions (CREATE FUNCTION ... RETURN) stay JVM expressions and are inlined by the optimizer.
_FUNCTIONS = {
    "pii_luhn": (
        "value STRING",
        "BOOLEAN",
        f"coalesce(regexp_replace(value, r'[{SPACE}-]', '') RLIKE '^[0-9]{{2,}}$' AND luhn_check(regexp_replace(value, r'[{SPACE}-]', '')), false)",
    ),
    "pii_levenshtein": ("a STRING, b STRING", "DOUBLE", "CASE WHEN a = b THEN 1.0D ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b), 1) END"),
    "pii_token_hash": ("canonical STRING, label STRING, digits INT", "STRING", "substring(sha2(concat_ws(':', canonical, label), 256), 1, digits)"),
    "pii_mask": ("value STRING", "STRING", "CASE WHEN length(value) <= 1 THEN value ELSE concat(substring(value, 1, 1), repeat('*', length(value) - 1)) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; returns their names."""
    for name, (arguments, kind, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(_FUNCTIONS)
