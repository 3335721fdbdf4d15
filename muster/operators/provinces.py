"""Provinces: today's 34 and the older names that were merged into them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.email import ADDRESS, domain
from ..functions.text import deaccent, key

# The provinces of today, their kind, and the older names merged into them.
PROVINCES = {
    "Tuyên Quang": ("tỉnh", ("Hà Giang",)),
    "Lào Cai": ("tỉnh", ("Yên Bái",)),
    "Thái Nguyên": ("tỉnh", ("Bắc Kạn",)),
    "Phú Thọ": ("tỉnh", ("Vĩnh Phúc", "Hòa Bình")),
    "Bắc Ninh": ("tỉnh", ("Bắc Giang",)),
    "Hưng Yên": ("tỉnh", ("Thái Bình",)),
    "Hải Phòng": ("thành phố", ("Hải Dương",)),
    "Ninh Bình": ("tỉnh", ("Hà Nam", "Nam Định")),
    "Quảng Trị": ("tỉnh", ("Quảng Bình",)),
    "Đà Nẵng": ("thành phố", ("Quảng Nam",)),
    "Quảng Ngãi": ("tỉnh", ("Kon Tum",)),
    "Gia Lai": ("tỉnh", ("Bình Định",)),
    "Khánh Hòa": ("tỉnh", ("Ninh Thuận",)),
    "Lâm Đồng": ("tỉnh", ("Đắk Nông", "Bình Thuận")),
    "Đắk Lắk": ("tỉnh", ("Phú Yên",)),
    "Hồ Chí Minh": ("thành phố", ("Bà Rịa - Vũng Tàu", "Bà Rịa Vũng Tàu", "Bình Dương")),
    "Đồng Nai": ("tỉnh", ("Bình Phước",)),
    "Tây Ninh": ("tỉnh", ("Long An",)),
    "Cần Thơ": ("thành phố", ("Sóc Trăng", "Hậu Giang")),
    "Vĩnh Long": ("tỉnh", ("Bến Tre", "Trà Vinh")),
    "Đồng Tháp": ("tỉnh", ("Tiền Giang",)),
    "Cà Mau": ("tỉnh", ("Bạc Liêu",)),
    "An Giang": ("tỉnh", ("Kiên Giang",)),
    "Cao Bằng": ("tỉnh", ()),
    "Điện Biên": ("tỉnh", ()),
    "Hà Tĩnh": ("tỉnh", ()),
    "Lai Châu": ("tỉnh", ()),
    "Lạng Sơn": ("tỉnh", ()),
    "Nghệ An": ("tỉnh", ()),
    "Quảng Ninh": ("tỉnh", ()),
    "Thanh Hóa": ("tỉnh", ()),
    "Sơn La": ("tỉnh", ()),
    "Hà Nội": ("thành phố", ()),
    "Huế": ("thành phố", ()),
}
# The two usual placings of the tone in oa, oe and uy.
TONES = (
    ("òa", "oà"), ("óa", "oá"), ("ỏa", "oả"), ("õa", "oã"), ("ọa", "oạ"),
    ("òe", "oè"), ("óe", "oé"), ("ỏe", "oẻ"), ("õe", "oẽ"), ("ọe", "oẹ"),
    ("ùy", "uỳ"), ("úy", "uý"), ("ủy", "uỷ"), ("ũy", "uỹ"), ("ụy", "uỵ"),
)
#: Further first labels of e-mail domains.
SLUGS = {"tphcm": "Hồ Chí Minh", "hcm": "Hồ Chí Minh", "hochiminh": "Hồ Chí Minh", "tphochiminh": "Hồ Chí Minh"}


#: Every name as written, the province of today, and its kind.
NAMES = [(name, now, kind) for now, (kind, old) in PROVINCES.items() for name in (now, *old)]


def _swap_tone(name: str) -> set[str]:
    """The name with each tone at its other usual place."""
    return {name.replace(x, y) for a, b in TONES for x, y in ((a, b), (b, a)) if x in name}


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower().replace("đ", "d")) if not unicodedata.combining(c))


_ACCENTED = {x: now for name, now, _ in NAMES for x in (name.lower(), *_swap_tone(name.lower()))}
_PLAIN = {_fold(name): now for name, now, _ in NAMES}
_KIND = {now: kind for _, now, kind in NAMES}
_BY_SLUG = {x.replace(" ", "").replace("-", ""): now for x, now in _PLAIN.items()} | SLUGS


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _pattern(names: dict[str, str], letter: str, prefix: str) -> str:
    return f"(?<!{letter}){prefix}({'|'.join(sorted(names, key=lambda x: (-len(x), x)))})(?!{letter})"


def province_table(spark) -> DataFrame:
    """name, key, slug, current, kind, is_old: one row a name."""
    rows = [(name, _fold(name), _fold(name).replace(" ", "").replace("-", ""), now, kind, name != now) for name, now, kind in NAMES]
    return spark.createDataFrame(rows, "name string, key string, slug string, current string, kind string, is_old boolean")


def current_province(c: Column) -> Column:
    """The province of today that a cell names exactly, null if it names none."""
    return F.try_element_at(_map(_PLAIN), key(c))


def kind_of(current: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(_KIND), current), F.lit("tỉnh"))


def mentioned_province(text: Column, prefixed: bool = False) -> Column:
    """The province of today that a text mentions: the longest name first; with its accents if the text has
    any, else without. prefixed: only after tỉnh, thành phố or TP."""
    low = F.lower(text)
    plain = deaccent(low)
    ask = r"(?:tỉnh|thành\s*phố|tp\.?)\s*" if prefixed else "", r"(?:tinh|thanh\s*pho|tp\.?)\s*" if prefixed else ""
    out = []
    for subject, names, letter, prefix in ((low, _ACCENTED, r"[\p{L}\p{N}_]", ask[0]), (F.trim(plain), _PLAIN, "[a-z0-9]", ask[1])):
        found = F.regexp_extract_all(subject, F.lit(_pattern(names, letter, prefix)), F.lit(1))
        best = F.array_max(F.transform(found, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
        out.append(F.try_element_at(_map(names), best["x"]))
    return F.when(plain != low, out[0]).otherwise(out[1])


def province_of(text: Column, default: Column | str | None = None) -> Column:
    """The province that goes with a unit. A default that is no province stops the search; one that is gives
    way only to a prefixed mention. A column gives each row its own."""
    if isinstance(default, Column):
        chosen = current_province(default)
        given = F.when(chosen.isNotNull(), F.coalesce(mentioned_province(text, prefixed=True), chosen))
        return F.when(F.trim(F.coalesce(default, F.lit(""))) == "", mentioned_province(text)).otherwise(given)
    if not default:
        return mentioned_province(text)
    chosen = _PLAIN.get(_fold(default).strip())
    if not chosen:
        return F.lit(None).cast("string")
    return F.coalesce(mentioned_province(text, prefixed=True), F.lit(chosen))


def organisation(text: Column, default: Column | str | None = None) -> Column:
    """The organisation in capitals: kind and province, a default that is no province as it is, or ''."""
    if isinstance(default, Column):
        current = province_of(text, default)
        shown = F.when(current.isNull(), "").otherwise(F.upper(F.concat(kind_of(current), F.lit(" "), current)))
        other = (F.trim(F.coalesce(default, F.lit(""))) != "") & current_province(default).isNull()
        return F.when(other, F.upper(F.trim(default))).otherwise(shown)
    if default and not _PLAIN.get(_fold(default).strip()):
        return F.lit(default.strip().upper())
    current = province_of(text, default)
    return F.when(current.isNull(), "").otherwise(F.upper(F.concat(kind_of(current), F.lit(" "), current)))


def province_from_domains(emails: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """source, domain, province: from the most frequent <province>.gov.vn of each source, if it has
    ``least`` rows and ``share`` of all. emails: source, row_pos, email."""
    d = domain(F.col("email"))
    counted = emails.where("email is not null").groupBy("source", d.alias("domain")).agg(F.count("*").alias("n"), F.min("row_pos").alias("first_pos"))
    gov = F.col("domain").endswith(".gov.vn") & (F.size(F.split("domain", r"\.")) >= 3)
    top = counted.groupBy("source").agg(F.sum("n").alias("total"), F.max_by(F.when(gov, F.struct("domain", "n")), F.when(gov, F.struct("n", -F.col("first_pos")))).alias("best"))
    sure = top.where((F.col("best.n") >= least) & (F.col("best.n") >= share * F.col("total")))
    return sure.select("source", "best.domain", F.try_element_at(_map(_BY_SLUG), F.element_at(F.split("best.domain", r"\."), -3)).alias("province"))


def default_mismatch(emails: DataFrame) -> DataFrame:
    """A warning for each source whose domains suggest another province than its default (a column of emails)."""
    chosen = emails.groupBy("source").agg(current_province(F.first("default", ignorenulls=True)).alias("chosen"))
    guess = province_from_domains(emails).join(chosen, "source").where("province <> chosen")
    message = F.concat(F.lit("Email phổ biến @"), "domain", F.lit(" gợi ý "), "province", F.lit(", nhưng Tổ chức mặc định đang là "), "chosen")
    return guess.select("source", F.lit("province_mismatch").alias("code"), message.alias("message"))
