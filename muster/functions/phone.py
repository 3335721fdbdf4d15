"""Vietnamese phone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import number_text

# Fixed value: +84, 84 or 0 and nine digits with at most one separator before each, not inside other digits.
NUMBER = r"(?<!\d)(?:\+84|84|0)(?:[\s.\-()]?\d){9}(?!\d)"


def _ten_digits(signs: Column) -> Column:
    """Ten digits from 0 on, or null. signs: digits and plus signs."""
    whole = (
        F.when(signs.startswith("+84"), F.concat(F.lit("0"), F.substr(signs, F.lit(4))))
        .when(signs.startswith("84") & (F.length(signs) >= 10), F.concat(F.lit("0"), F.substr(signs, F.lit(3))))
        .when(~signs.startswith("0") & (F.length(signs) == 9), F.concat(F.lit("0"), signs))
        .otherwise(signs)
    )
    digits = F.regexp_replace(whole, r"\D", "")
    return F.when(digits.rlike(r"^0\d{9}$"), digits)


def normalize_phone(raw: Column) -> Column:
    """The first number in a cell as ten digits; '' if there is none."""
    text = number_text(F.coalesce(raw, F.lit("")))
    first = F.regexp_extract(text, NUMBER, 0)
    keep = r"[^\d+]"
    return F.coalesce(_ten_digits(F.regexp_replace(first, keep, "")), _ten_digits(F.regexp_replace(text, keep, "")), F.lit(""))


def holds_phone(c: Column) -> Column:
    """The cell holds a number from 0 or +84 on, or is one of nine digits that lost its 0."""
    tight = F.regexp_replace(number_text(c), r"(?U)[\s.\-]", "")
    return F.coalesce(tight.rlike(r"(?:\+?84|0)\d{8,10}") | tight.rlike(r"^\d{9}$"), F.lit(False))


def is_full_phone(c: Column) -> Column:
    """The cell is a phone number and nothing else."""
    return F.trim(c).rlike(r"^[\d\s.+\-()]{9,20}$") & (normalize_phone(c) != "")
