"""Candidate checks and the placeholder format.

Each is a SQL expression over a SQL operand: the detectors inline them, the
column functions wrap them, and ``register_sql_functions`` offers them to SQL
users as temporary SQL functions, which Catalyst inlines.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hushlake.functions.arrays import literal
from hushlake.functions.dialect import DIGIT, SPACE, SPACE_CHARS

# Decimal digits of every script, and the 0-9 they stand for.
_ALL_DIGITS = "".join(
    chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"
)
_ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in _ALL_DIGITS)


def ascii_digits_sql(v: str) -> str:
    """Decimal digits of any script as 0-9; other characters stay."""
    return (
        rf"CASE WHEN {v} RLIKE '^[\\x00-\\x7f]*$' THEN {v} "
        f"ELSE translate({v}, '{_ALL_DIGITS}', '{_ASCII_DIGITS}') END"
    )


def digits_only_sql(v: str) -> str:
    return ascii_digits_sql(rf"regexp_replace({v}, '\\P{{Nd}}', '')")


def luhn_sql(v: str) -> str:
    """13 to 19 digits with a correct mod-10 check digit."""
    digits = digits_only_sql(v)
    return f"(length({digits}) BETWEEN 13 AND 19 AND luhn_check({digits}))"


def iban_sql(v: str) -> str:
    """Shape of an IBAN after dropping spaces and hyphens, and mod-97 = 1.

    Letters stand for 10..35, so they shift the number by two digits.
    """
    spaces = literal(f"[{SPACE_CHARS}-]+")
    compact = f"upper(regexp_replace({v}, {spaces}, ''))"
    plain = ascii_digits_sql(compact)
    return rf"""(CASE WHEN {compact} RLIKE '^[A-Z]{{2}}\\p{{Nd}}{{2}}[A-Z0-9]{{11,30}}$' THEN
        aggregate(
            split(concat(substring({plain}, 5), substring({plain}, 1, 4)), ''), 0,
            (iacc, ich) -> CASE WHEN ascii(ich) >= 65
                THEN (iacc * 100 + ascii(ich) - 55) % 97
                ELSE (iacc * 10 + ascii(ich) - 48) % 97 END) = 1
        ELSE false END)"""


def mykad_sql(v: str) -> str:
    """Month 1-12, day 1-31 and place code 1-99 of a 6-2-4 number."""
    shape = literal(rf"^{SPACE}*{DIGIT}{{6}}-?{DIGIT}{{2}}-?{DIGIT}{{4}}{SPACE}*\z")
    digits = digits_only_sql(v)
    return f"""({v} RLIKE {shape}
        AND cast(substring({digits}, 3, 2) as int) BETWEEN 1 AND 12
        AND cast(substring({digits}, 5, 2) as int) BETWEEN 1 AND 31
        AND cast(substring({digits}, 7, 2) as int) BETWEEN 1 AND 99)"""


def placeholder_sql(category: str, number: str) -> str:
    """``[CATEGORY_001]``; grows past 999."""
    return f"format_string('[%s_%03d]', {category}, {number})"


def luhn_valid(column: str) -> Column:
    return F.expr(luhn_sql(column))


def iban_valid(column: str) -> Column:
    return F.expr(iban_sql(column))


def mykad_valid(column: str) -> Column:
    return F.expr(mykad_sql(column))


def placeholder(category: str, number: str) -> Column:
    return F.expr(placeholder_sql(category, number))


def register_sql_functions(spark: SparkSession) -> None:
    """Offer the checks as temporary SQL functions of this session."""
    bodies = {
        "luhn_valid(v STRING) RETURNS BOOLEAN": luhn_sql("v"),
        "iban_valid(v STRING) RETURNS BOOLEAN": iban_sql("v"),
        "mykad_valid(v STRING) RETURNS BOOLEAN": mykad_sql("v"),
        "placeholder_token(category STRING, number INT) RETURNS STRING": placeholder_sql(
            "category", "number"
        ),
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
