"""Ordinals (the STT column) and header cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import NOISE_PATTERN
from .text import fold, key

# What headers contain, in order of precedence.
HEADERS = {
    "email": ("email", "e-mail", "mail", "thu dien tu", "hop thu dien tu", "dia chi email", "dia chi mail", "thu cong vu", "dia chi thu"),
    "phone": ("dien thoai", "sdt", "so dien thoai", "phone", "hotline", "tel", "di dong", "mobile", "so dt", "zalo", "dien loai"),
    "name": ("ho va ten", "ho ten", "ten tai khoan", "ten", "full name", "name", "hoten"),
    "password": ("mat khau", "password", "pass", "mk"),
}
NAMES_WITH_UNIT = ("ho va ten", "ho ten", "ten tai khoan", "full name", "hoten", "ten nguoi dung")
UNITS = ("don vi cong tac", "don vi", "phong ban", "bo phan", "co quan", "noi cong tac", "chuc vu", "chuc danh", "vi tri cong tac", "vi tri")
STT_HEADERS = ("stt", "tt", "so tt", "so thu tu", "thu tu")


def parse_stt(c: Column) -> Column:
    """The ordinal in a cell, 1 to 99999: '12', '12.', and floats within 1e-6 of an integer; else null."""
    text = F.trim(c)
    whole = F.regexp_extract(text, r"^(\d+)\.*$", 1)
    number = F.when(text.rlike(r"^\d+\.\d+$"), text.try_cast("double"))
    value = F.coalesce(F.when(whole != "", whole).try_cast("int"), F.when(F.abs(number - F.round(number)) < 1e-6, F.round(number)).cast("int"))
    return F.when(value.between(1, 99999), value)


def is_group_stt(c: Column) -> Column:
    """A blank or roman ordinal, as the title row of a group has."""
    return F.trim(F.coalesce(c, F.lit(""))).rlike(r"^([IVXLC]{1,6}\.?)?$")


def is_stt_header(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9 ]", "")).isin(*STT_HEADERS)


def header_field(c: Column) -> Column:
    """email, phone, name or password; null for other headers and for positions and units."""
    folded = fold(c)
    out = F.when(folded.rlike(NOISE_PATTERN), F.lit(None).cast("string"))
    for field, words in HEADERS.items():
        out = out.when(folded.rlike("|".join(words)), field)
    return out


def unit_rank(c: Column) -> Column:
    """Place of a unit header in the order of preference (0 is best), null if it isn't one."""
    folded = key(c)
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for k, word in enumerate(UNITS):
        out = out.when(F.contains(folded, F.lit(word)), k)
    return out


def stt_list(numbers: Column, limit: int = 15) -> Column:
    """'23, 40, 55', cut after limit with the total."""
    text = F.array_join(F.slice(F.array_sort(numbers), 1, limit), ", ")
    return F.when(F.size(numbers) > limit, F.concat(text, F.lit("... (tổng "), F.size(numbers).cast("string"), F.lit(")"))).otherwise(text)
