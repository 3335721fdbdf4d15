"""E-mail addresses: validity, repair of plain typing errors, and parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of an address, the characters of a cell that holds only one, and mistyped Gmail domains.
ADDRESS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
CELL = r"^[A-Za-z0-9._%+\-@,\s]+$"
GMAIL_TYPOS = (
    "gmailcom", "gmai.com", "gmial.com", "gmal.com", "gamil.com", "gnail.com", "gmaill.com",
    "gmail.con", "gmail.cm", "gmail.om", "gmail.comm", "gmail.co", "gmail.vn",
)
_GMAIL = "(?i)@(?:" + "|".join(x.replace(".", r"\.") for x in GMAIL_TYPOS) + ")$"
_EMPTY_LABEL = r"\.\.|^\.|\.@|@\.|\.$"
_GAP = r"[A-Za-z0-9][ \t]+[A-Za-z0-9]"


def local_part(c: Column) -> Column:
    return F.substring_index(c, "@", 1)


def domain(c: Column) -> Column:
    return F.substring_index(c, "@", -1)


def fix_gmail(c: Column) -> Column:
    return F.regexp_replace(c, _GMAIL, "@gmail.com")


def repair(c: Column) -> Column:
    """Surplus or misplaced signs, in this order; content is never added."""
    c = fix_gmail(F.regexp_replace(F.translate(c, ",", "."), "@{2,}", "@"))
    for pattern, to in ((r"\.{2,}", "."), (r"@\.+", "@"), (r"\.+@", "@")):
        c = F.regexp_replace(c, pattern, to)
    return c


def is_ambiguous(raw: Column) -> Column:
    """A blank between two letters or digits, where joining could name someone else.

    In the domain always; in the local part unless the domain is Gmail's or all that follows are digits.
    """
    local = F.regexp_replace(F.substring_index(raw, "@", 1), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    rest = F.regexp_replace(F.substr(raw, F.instr(raw, "@") + 1), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    gmail = F.lower(F.regexp_replace(rest, r"\s+", "")).startswith("gmail")
    pieces = F.split(local, "[ \t]+")
    named = F.exists(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda p: ~p.rlike(r"^\d+$"))
    return F.contains(raw, F.lit("@")) & raw.rlike(CELL) & (rest.rlike(_GAP) | (local.rlike(_GAP) & ~gmail & named))


def _found(text: Column) -> Column:
    """The first address in text, null if it has an empty label or starts in the middle of a word."""
    got = F.regexp_extract(text, ADDRESS, 0)
    before = F.regexp_extract(text, "([^\\x00-\\x7F]?)" + ADDRESS, 1)
    return F.when((got != "") & ~got.rlike(_EMPTY_LABEL) & ~before.rlike(r"[\p{L}\p{N}]"), F.lower(got))


def normalize_email(raw: Column) -> Column:
    """The address in a cell, lower case; null if there is none that is certain."""
    text = F.regexp_replace(raw, r"(?U)\s+", "")
    return F.when(~is_ambiguous(raw), F.coalesce(fix_gmail(_found(text)), _found(repair(text))))


def all_addresses(text: Column) -> Column:
    """All addresses in a text, lower case, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0)), F.lower)


def squeeze_at(c: Column) -> Column:
    """Without white space around the @."""
    return F.trim(F.regexp_replace(c, r"(?U)\s*@\s*", "@"))


def is_email_like(c: Column) -> Column:
    """An @ and nothing that no address holds, blanks aside."""
    return F.contains(c, F.lit("@")) & c.rlike(r"(?U)^[\w.%+\-,@\s]+$")


def is_bare(c: Column) -> Column:
    """An address that lost its @: no @, two dots or more before a usual ending."""
    return ~F.contains(c, F.lit("@")) & F.trim(c).rlike(r"(?iU)^[\w%+\-]+(?:\.[\w%+\-]+){2,}\.(?:vn|com|net)$")


def holds_email(c: Column) -> Column:
    """The cell holds an address, a mistyped one, or one without its @."""
    tight = squeeze_at(c)
    return F.coalesce(tight.rlike(ADDRESS) | (F.contains(c, F.lit("@")) & (~F.contains(tight, F.lit(" ")) | is_email_like(c))) | is_bare(c), F.lit(False))
