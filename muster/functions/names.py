"""Names of people, and how well they fit an address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import deaccent, deaccent_in_place, squeeze

# Words that start a position or unit inside a name cell, the longest first.
NOISE = (
    "vi tri cong tac", "don vi cong tac", "noi cong tac", "chuc danh", "phong ban", "chi nhanh",
    "chuc vu", "bo phan", "co quan", "vi tri", "don vi",
)
NOISE_PATTERN = "|".join(NOISE)
#: The same on text whose accents may still stand behind their letters.
_NOISE_IN_PLACE = "|".join("".join(f"{letter}\\p{{Mn}}*" for letter in word) for word in NOISE)
#: Titles before a name.
HONORIFICS = ("ông", "bà")


def cut_noise(c: Column) -> Column:
    """The part of a name cell before a position or unit word."""
    place = F.regexp_instr(F.lower(deaccent_in_place(c)), F.lit(_NOISE_IN_PLACE))
    return F.regexp_replace(F.when(place > 0, F.substr(c, F.lit(1), place - 1)).otherwise(c), r"^[ \t\-|/,;:]+|[ \t\-|/,;:]+$", "")


def normalize_name(raw: Column) -> Column:
    """Letters and blanks only, each word capitalised; '' for null."""
    letters = F.regexp_replace(cut_noise(F.trim(F.coalesce(raw, F.lit("")))), r"(?U)[^\p{L}\s]", "")
    return F.initcap(squeeze(letters))


def match_score(name: Column, email: Column) -> Column:
    """How well a name fits the local part: 2 if its initials and given name (in either order) or all of it
    open the address, 1 if the given name of three letters or more occurs in it, else 0."""
    words = F.filter(F.split(F.lower(deaccent(name)), "[^a-z0-9]+"), lambda w: w != "")
    compact = F.regexp_replace(F.lower(deaccent(F.substring_index(email, "@", 1))), r"[^a-z0-9]", "")
    given = F.element_at(words, -1)
    initials = F.array_join(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.substring(w, 1, 1)), "")
    full = F.exists(F.array(F.concat(initials, given), F.concat(given, initials), F.array_join(words, "")), lambda x: compact.startswith(x))
    known = (F.size(words) > 0) & F.contains(email, F.lit("@"))
    return F.when(~F.coalesce(known, F.lit(False)), 0).when(full, 2).when((F.length(given) >= 3) & F.contains(compact, given), 1).otherwise(0)


def strip_honorific(name: Column, email: Column) -> Column:
    """A name of four words or more without its title, if the rest fits the address strictly better."""
    words = F.split(name, " ")
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), " ")
    titled = F.lower(F.element_at(words, 1)).isin(*HONORIFICS) & (F.size(words) >= 4)
    return F.when(titled & (match_score(rest, email) > match_score(name, email)), rest).otherwise(name)
