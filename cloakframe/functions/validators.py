"""Checksums as column expressions. All are false for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.regex import SPACE


def luhn(value: Column) -> Column:
    """Digits in groups separated by white space or dashes, two at least, with a sum of 0 modulo 10."""
    digits = F.regexp_replace(value, f"[{SPACE}-]", "")
    return F.coalesce(F.regexp_like(digits, F.lit("^[0-9]{2,}$")) & F.call_function("luhn_check", digits), F.lit(False))


def iban(value: Column) -> Column:
    """ISO 13616: 15 to 34 characters without white space, remainder 1 modulo 97 after moving four."""
    compact = F.upper(F.regexp_replace(value, f"[{SPACE}]", ""))
    moved = F.concat(F.substring(compact, 5, 34), F.substring(compact, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    remainder = F.aggregate(F.split(moved, ""), F.lit(0), add)
    shape = F.regexp_like(compact, F.lit("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")) & F.length(compact).between(15, 34)
    return F.coalesce(F.when(shape, remainder == 1).otherwise(False), F.lit(False))


def nir(value: Column) -> Column:
    """French social security number: key = 97 - body modulo 97, with 2A and 2B counted as 19 and 18."""
    compact = F.upper(F.regexp_replace(value, f"[{SPACE}.-]", ""))
    shape = F.regexp_like(compact, F.lit("^[12][0-9]{4}(2A|2B|[0-9]{2})[0-9]{8}$"))
    department = F.substring(compact, 6, 2)
    plain = F.concat(F.substring(compact, 1, 5), F.when(department == "2A", "19").when(department == "2B", "18").otherwise(department), F.substring(compact, 8, 6))
    key = F.substring(compact, 14, 2)
    return F.coalesce(F.when(shape, 97 - plain.try_cast("bigint") % 97 == key.try_cast("bigint")).otherwise(False), F.lit(False))


VALIDATORS = {"CREDIT_CARD": luhn, "IBAN": iban, "FR_IBAN": iban, "FR_NIR": nir}
