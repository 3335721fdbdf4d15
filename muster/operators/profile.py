"""Which column holds what: header search, and inference from contents.

cells: source, table_id, row_pos (from 0), col_idx, value. A table's map is one row a field, so the map joins
the cells by table; nothing but DataFrames passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinal import HEADERS, NAMES_WITH_UNIT, header_field, is_stt_header, parse_stt, unit_rank
from ..functions.phone import normalize_phone
from ..functions.text import key
from ..staging import staged
from .sequence import blank

TABLE = ["source", "table_id"]
FIELDS = ["stt", "name", "email", "email_alt", "phone", "unit", "unit2", "group"]
# Fixed value: what the name of a unit holds (without accents).
UNIT_VALUE = (
    r"(?<![a-z])(xa|phuong|thi tran|so|ubnd|hdnd|uy ban|tinh|thanh pho|trung tam|phong|ban|vien|truong|"
    r"benh vien|chi cuc|cuc|van phong|vp)(?![a-z])"
)


def header_cells(cells: DataFrame, scan: int = 15) -> DataFrame:
    """source, table_id, row_pos, col_idx, field: the header cells among the first rows; the first column of
    a row wins a field."""
    top = cells.where((F.col("row_pos") < scan) & ~blank(F.col("value")))
    named = top.withColumn("field", F.coalesce(header_field(F.col("value")), F.when(is_stt_header(F.col("value")), "stt"))).where("field is not null")
    return named.groupBy(*TABLE, "row_pos", "field").agg(F.min("col_idx").alias("col_idx"))


def header_map(cells: DataFrame) -> DataFrame:
    """source, table_id, header_pos, field, col_idx: from the first row that has an e-mail column."""
    fields = header_cells(cells)
    rows = fields.where("field = 'email'").groupBy(*TABLE).agg(F.min("row_pos").alias("header_pos"))
    return fields.join(rows, TABLE).where("row_pos = header_pos").select(*TABLE, "header_pos", "field", "col_idx")


def rich_header_map(cells: DataFrame, scan: int = 15) -> DataFrame:
    """Like header_map, with units: from the row with most fields among those with a name or e-mail. A cell may
    set several fields, a second e-mail column is email_alt, the best unit header wins, and a column to the right of it
    under the same header is unit2."""
    folded = key(F.col("value"))
    hit = lambda words: folded.rlike("|".join(words))
    best = unit_rank(F.col("value"))
    mark = lambda ok, field, rank: F.when(ok, F.struct(F.lit(field).alias("field"), rank.alias("rank")))
    marks = F.array(
        mark(hit(HEADERS["email"]), "email", F.lit(0)), mark(hit(HEADERS["phone"]), "phone", F.lit(0)), mark(hit(NAMES_WITH_UNIT) & best.isNull(), "name", F.lit(0)),
        mark(F.contains(folded, F.lit("tt")), "stt", F.lit(0)), mark(best.isNotNull(), "unit", best),
    )
    top = cells.where((F.col("row_pos") < scan) & ~blank(F.col("value")))
    order = Window.partitionBy(*TABLE, "row_pos", "m.field").orderBy("m.rank", "col_idx")
    ranked = top.select(*TABLE, "row_pos", "col_idx", folded.alias("header"), F.explode(F.array_compact(marks)).alias("m")).withColumn("nth", F.row_number().over(order))
    field = F.when((F.col("m.field") == "email") & (F.col("nth") == 2), "email_alt").when(F.col("nth") == 1, F.col("m.field"))
    fields = ranked.select(*TABLE, "row_pos", "col_idx", field.alias("field"), "header").where("field is not null")
    twin = fields.where("field = 'unit'").select(*TABLE, "row_pos", (F.col("col_idx") + 1).alias("col_idx"), "header")
    right = top.select(*TABLE, "row_pos", "col_idx", folded.alias("header")).join(twin, [*TABLE, "row_pos", "col_idx", "header"], "left_semi")
    fields = fields.drop("header").unionByName(right.select(*TABLE, "row_pos", "col_idx", F.lit("unit2").alias("field")))
    rich = fields.groupBy(*TABLE, "row_pos").agg(F.count("*").alias("n"), F.max(F.col("field").isin("name", "email")).alias("ok")).where("ok")
    best = rich.withColumn("_r", F.row_number().over(Window.partitionBy(*TABLE).orderBy(F.desc("n"), "row_pos"))).where("_r = 1").select(*TABLE, F.col("row_pos").alias("header_pos"))
    return fields.join(best, TABLE).where("row_pos = header_pos").select(*TABLE, "header_pos", "field", "col_idx")


def sparse_group(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """source, table_id, header_pos, field (group), col_idx: of each headed table of five rows or more the fullest column
    without a field that names units in four fifths of its cells, two at least, and is filled in less than 30 % of rows."""
    below = cells.join(fields.select(*TABLE, "header_pos").distinct(), TABLE).where((F.col("row_pos") > F.col("header_pos")) & ~blank(F.col("value")))
    rows = below.groupBy(*TABLE, "header_pos").agg(F.countDistinct("row_pos").alias("rows")).where("rows >= 5")
    text = below.where(~F.col("value").rlike(r"^[\d\s.,]*$")).join(fields.select(*TABLE, "col_idx"), [*TABLE, "col_idx"], "left_anti")
    counted = text.groupBy(*TABLE, "col_idx").agg(F.count("*").alias("filled"), F.count_if(key(F.col("value")).rlike(UNIT_VALUE)).alias("units"))
    good = counted.join(rows, TABLE).where("filled >= 2 and filled < 0.3 * rows and units >= 0.8 * filled")
    best = good.groupBy(*TABLE, "header_pos").agg(F.max_by("col_idx", F.struct("filled", -F.col("col_idx"))).alias("col_idx"))
    return best.select(*TABLE, "header_pos", F.lit("group").alias("field"), "col_idx")


def row_arrays(cells: DataFrame) -> DataFrame:
    """source, table_id, row_pos, cells: each row's values by column, null where there is none."""
    width = cells.groupBy(*TABLE).agg((F.max("col_idx") + 1).alias("width"))
    rows = cells.groupBy(*TABLE, "row_pos").agg(F.collect_list(F.struct("col_idx", "value")).alias("found")).join(width, TABLE)
    value = lambda i: F.try_element_at(F.filter("found", lambda x: x["col_idx"] == i), F.lit(1))["value"]
    return rows.select(*TABLE, "row_pos", F.transform(F.sequence(F.lit(0), F.col("width") - 1), value).alias("cells"))


def from_arrays(rows: DataFrame) -> DataFrame:
    """The cells of row_arrays() again."""
    return rows.select(*TABLE, "row_pos", F.posexplode("cells").alias("col_idx", "value")).where("value is not null")


def column_profile(cells: DataFrame, sample: int = 400) -> DataFrame:
    """Contents of each column over the first ``sample`` rows of a table (the schema scan; data rows are all read)."""
    value = F.trim(F.coalesce("value", F.lit("")))
    full = cells.where((F.col("row_pos") < sample) & ~blank(F.col("value")))
    rows = full.groupBy(*TABLE).agg(F.countDistinct("row_pos").alias("rows"))
    text = ~value.rlike(r"^[\d\s.,+\-()/]*$") & ~F.contains(value, F.lit("@"))
    like_name = text & value.rlike(r"^(?:\p{Lu}\p{L}*\s+){1,5}\p{Lu}\p{L}*$")
    profile = full.groupBy(*TABLE, "col_idx").agg(
        F.count("*").alias("filled"), F.count_if(F.contains(value, F.lit("@"))).alias("emails"), F.count_if(normalize_phone(value) != "").alias("phones"),
        F.count_if(parse_stt(value).isNotNull()).alias("ordinals"), F.count_if(text).alias("texts"), F.count_if(like_name).alias("names"), F.countDistinct(value).alias("distinct"),
    )
    return profile.join(rows, TABLE)


def infer_map(cells: DataFrame) -> DataFrame:
    """source, table_id, field, col_idx for tables without a header; nothing for a table without a name column.

    The e-mail column has most @ (half of the rows at least), phone 30 %, ordinals 80 % of a column filled by
    half, the name is the dense text column whose cells look most like different names, the unit the dense
    one with least variety, the group the fullest of the sparse ones.
    """
    p = staged(column_profile(cells).where("rows >= 3"))
    dense, variety = F.col("filled") >= 0.5 * F.col("rows"), F.col("distinct") / F.col("filled")
    text = F.col("texts") >= 0.5 * F.col("filled")
    likeness = F.col("names") / F.col("filled") * variety

    def pick(field: str, taken: DataFrame | None, ok: Column, score: Column) -> DataFrame:
        rest = p if taken is None else p.join(taken.select(*TABLE, "col_idx"), [*TABLE, "col_idx"], "left_anti")
        best = rest.where(ok).groupBy(*TABLE).agg(F.max_by("col_idx", F.struct(score, -F.col("col_idx"))).alias("col_idx"))
        got = best.select(*TABLE, F.lit(field).alias("field"), "col_idx")
        return got if taken is None else taken.unionByName(got)

    found = pick("email", None, F.col("emails") >= F.greatest(F.lit(3), 0.5 * F.col("rows")), F.col("emails").cast("double"))
    found = pick("phone", found, (F.col("phones") >= 0.3 * F.col("rows")) & (F.col("phones") >= 3), F.col("phones").cast("double"))
    found = pick("stt", found, dense & (F.col("ordinals") >= 0.8 * F.col("filled")), F.col("ordinals").cast("double"))
    found = pick("name", found, dense & text & (likeness >= 0.3), likeness)
    found = pick("unit", found, dense & text, -variety)
    found = pick("group", found, ~dense & text & (F.col("filled") < 0.3 * F.col("rows")), F.col("filled").cast("double"))
    return found.join(found.where("field = 'name'").select(*TABLE), TABLE, "left_semi")


def guess_phone(cells: DataFrame, known: DataFrame, share: float = 0.6) -> DataFrame:
    """source, table_id, col_idx: a column of numbers for tables whose map has no phone."""
    rest = column_profile(cells).join(known.select(*TABLE, "col_idx"), [*TABLE, "col_idx"], "left_anti").join(known.where("field = 'phone'").select(*TABLE), TABLE, "left_anti")
    good = rest.where((F.col("filled") >= 3) & (F.col("phones") >= share * F.col("filled")))
    return good.groupBy(*TABLE).agg(F.max_by("col_idx", F.struct(F.col("phones") / F.col("filled"), -F.col("col_idx"))).alias("col_idx"))


def to_rows(cells: DataFrame, fields: DataFrame, span: int = 3) -> DataFrame:
    """Rows below the header: cells, one column a field, and each field's column as <field>_col. A merged header covers up
    to ``span`` columns as far as the next header; the value is the first in them if the header's own cell is blank
    in two rows or more."""
    if "header_pos" in fields.columns:
        heads = cells.where(~blank(F.col("value"))).join(fields.select(*TABLE, "header_pos").distinct(), TABLE).where("row_pos = header_pos")
        heads = heads.select(*TABLE, "col_idx").union(fields.select(*TABLE, "col_idx")).distinct()
    else:
        heads = fields.select(*TABLE, "col_idx").distinct()
    following = heads.withColumn("next", F.coalesce(F.lead("col_idx").over(Window.partitionBy(*TABLE).orderBy("col_idx")), F.lit(1 << 20)))
    ordered = fields.join(following, [*TABLE, "col_idx"])
    wide = ordered.withColumn("last", F.least(F.col("next") - 1, F.col("col_idx") + span - 1))
    head = wide.select(*TABLE, "field", F.col("col_idx").alias("first_col"), "last", "header_pos") if "header_pos" in fields.columns else wide.select(*TABLE, "field", F.col("col_idx").alias("first_col"), "last", F.lit(-1).alias("header_pos"))
    c = cells.where(~blank(F.col("value")))
    hits = c.join(head, TABLE).where((F.col("row_pos") > F.col("header_pos")) & F.col("col_idx").between(F.col("first_col"), F.col("last")))
    per = hits.groupBy(*TABLE, "row_pos", "field", "first_col").agg(F.min_by(F.struct("col_idx", "value"), "col_idx").alias("v"))
    off = per.groupBy(*TABLE, "field").agg(F.count_if(F.col("v.col_idx") > F.col("first_col")).alias("off"))  # a row a field, not a window over a list
    moved = per.join(off, [*TABLE, "field"]).where((F.col("v.col_idx") == F.col("first_col")) | (F.col("off") >= 2))
    named = moved.groupBy(*TABLE, "row_pos").pivot("field", FIELDS).agg(F.first("v.value"))
    at = head.groupBy(*TABLE, "header_pos").pivot("field", FIELDS).agg(F.first("first_col"))
    at = at.select(*TABLE, "header_pos", *[F.col(f"`{f}`").alias(f"{f}_col") for f in FIELDS])
    return row_arrays(c).join(at, TABLE).where("row_pos > header_pos").join(named, [*TABLE, "row_pos"], "left")
