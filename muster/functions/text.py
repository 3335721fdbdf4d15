"""Unicode and string helpers: Column to Column, all inside whole-stage code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _fold_pairs() -> tuple[str, str]:
    """Every precomposed Latin letter with its base letter, from the Unicode data; and the barred d."""
    source, target = ["đ", "Đ"], ["d", "D"]
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        base = parts[0]
        if len(parts) > 1 and base.isascii() and all(unicodedata.combining(x) for x in parts[1:]):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


_FROM, _TO = _fold_pairs()


def deaccent_in_place(c: Column) -> Column:
    """Without the accents of composed letters; every character stays at its place."""
    return F.translate(c, _FROM, _TO)


def deaccent(c: Column) -> Column:
    """Without accents (composed or decomposed), case kept."""
    return F.regexp_replace(deaccent_in_place(c), r"\p{Mn}+", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """The search key of a text: no accents, lower case, squeezed."""
    return squeeze(F.lower(deaccent(c)))


def key(c: Column) -> Column:
    """Like fold, but inner white space stays as it is."""
    return F.trim(F.lower(deaccent(c)))


def capitalize_words(c: Column) -> Column:
    """The first letter of each word upper, the others as they are."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def number_text(c: Column) -> Column:
    """A number that a spreadsheet kept as a float, as people write it: 12.0 is 12."""
    return F.regexp_replace(F.trim(c), r"^(\+?\d+)\.0+$", "$1")


def display(c: Column) -> Column:
    """A cell as reports show it: '' for null, and numbers within 1e-6 of an integer as one."""
    text = F.trim(F.coalesce(c, F.lit("")))
    number = F.when(text.rlike(r"^-?\d+\.\d+$"), text.try_cast("double"))
    return F.when(F.abs(number - F.round(number)) < 1e-6, F.round(number).cast("long").cast("string")).otherwise(text)


def thousands(c: Column) -> Column:
    """1234567 as 1.234.567."""
    return F.translate(F.format_number(c, 0), ",", ".")


@F.pandas_udf(StringType())
def nfc(values):
    """Canonical composition; Spark has no function for it. Apply once, where text is read."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))
