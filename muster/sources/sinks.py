"""Result layouts and writers."""

from __future__ import annotations

import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordinal import header_field
from ..operators.records import reason_label
from .readers import read_office

# The headers of the two layouts and of the issue report.
LAYOUT_1 = ("Email", "Mật khẩu", "Họ và tên", "Điện thoại")
LAYOUT_2 = ("Tên tài khoản", "Email", "SĐT", "Mật khẩu", "Giới tính", "Ngày sinh", "Đơn vị", "Tổ chức")
ISSUES = {
    "source": "Tệp nguồn", "stt": "STT", "raw_name": "Họ và tên (gốc)", "raw_email": "Email (gốc)", "raw_phone": "Điện thoại (gốc)",
    "raw_unit": "Đơn vị công tác (gốc)", "reason": "Lý do", "note": "Ghi chú",
}


def layout(records: DataFrame, password: str | None = None) -> DataFrame:
    """Records in the layout of mode 1, or of mode 2 if they have an organisation. No password is built in."""
    secret = F.lit(password).cast("string")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    empty = F.lit(None).cast("string")
    if "to_chuc" in records.columns:
        columns = [text("name"), text("email"), text("phone"), secret, empty, empty, text("don_vi"), text("to_chuc")]
        return records.select(*[c.alias(n) for c, n in zip(columns, LAYOUT_2, strict=True)])
    return records.select(*[c.alias(n) for c, n in zip([text("email"), secret, text("name"), text("phone")], LAYOUT_1, strict=True)])


#: The fields of mode 1 that a template must have a column for, and their names.
BOUND = {"email": "Email", "name": "Họ và tên", "phone": "Điện thoại"}


def bind_header(header: DataFrame) -> dict[str, int]:
    """The column (from 0) of each field in a header: col_idx, value. The first column that names a field has it. A header
    without one of email, name and phone is an error that says which."""
    named = header.withColumn("field", header_field(F.col("value"))).where("field is not null")
    columns = {r.field: r.col_idx for r in named.groupBy("field").agg(F.min("col_idx").alias("col_idx")).collect()}
    missing = [label for field, label in BOUND.items() if field not in columns]
    if missing:
        raise ValueError(f"Không tìm thấy cột phù hợp trong file mẫu cho: {', '.join(missing)}. Vui lòng kiểm tra lại tiêu đề cột của file mẫu.")
    return columns


def in_template(records: DataFrame, columns: dict[str, int], password: str | None = None) -> DataFrame:
    """The records of mode 1 in the order of a template's columns (``bind_header``): c0, c1, ...; other columns are null."""
    empty = F.lit(None).cast("string")
    value = {columns[f]: F.nullif(F.col(f), F.lit("")) for f in BOUND}
    if "password" in columns:
        value[columns["password"]] = F.lit(password).cast("string")
    return records.select(*[value.get(k, empty).alias(f"c{k}") for k in range(max(columns.values()) + 1)])


def write_template(records: DataFrame, path: str, template: str, password: str | None = None) -> int:
    """A workbook made from a template: mode 1 by its header, wherever its columns stand; mode 2 in the order of its
    layout, which templates of that mode keep."""
    if "to_chuc" in records.columns:
        return write_xlsx(layout(records, password), path, template=template)
    header = read_office(records.sparkSession, template).where("sheet_idx = 0 and row_pos = 0").select("col_idx", "value")
    return write_xlsx(in_template(records, bind_header(header), password), path, template=template)


def issue_columns(issues: DataFrame) -> list[str]:
    """The columns of a report: the source only if there are several, the unit if rows have one, the note if one is given."""
    seen = issues.agg(F.count_distinct("source").alias("sources"), F.count("note").alias("notes")).first()
    optional = {"source": seen["sources"] > 1, "raw_unit": "raw_unit" in issues.columns, "note": seen["notes"] > 0}
    return [c for c in ISSUES if optional.get(c, True)]


def issue_report(issues: DataFrame, columns: list[str] | None = None) -> DataFrame:
    value = {"reason": reason_label(F.col("reason"))}
    if "row_label" in issues.columns and "raw_unit" not in issues.columns:
        value["stt"] = F.coalesce("row_label", "stt")  # in mode 1 also for rows without an ordinal
    wanted = columns or [c for c in ISSUES if c in issues.columns]
    return issues.select(*[value.get(c, F.col(c)).alias(ISSUES[c]) for c in wanted])


def write_table(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV or Parquet, in parallel."""
    writer = rows.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def write_xlsx(rows: DataFrame, path: str, most: int = 1_000_000, template: str | None = None) -> int:
    """One workbook, written by the driver from a stream of rows; a sheet holds at most ``most`` of them, and
    more is an error, not a cut. Returns the number of rows. template: a workbook whose first sheet's header row, styles
    and other parts are kept; the rows go below its header in place of what is there."""

    def line(r: int, values) -> str:
        cells = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' if v is not None else "<c/>" for v in values)
        return f'<row r="{r}">{cells}</row>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"

    def below(f) -> int:
        n = 0
        for row in rows.toLocalIterator(prefetchPartitions=True):
            n += 1
            if n > most:
                raise ValueError(f"more than {most} rows: write CSV or Parquet instead")
            f.write(line(n + 1, row).encode())
        return n

    if template:
        with zipfile.ZipFile(template) as old, zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            sheet = next(n for n in sorted(old.namelist()) if re.match(r"xl/worksheets/[^/]+\.xml$", n))
            for name in old.namelist():
                if name != sheet:
                    z.writestr(old.getinfo(name), old.read(name))
            before, data, after = re.fullmatch(r"(.*?)(<sheetData\s*/>|<sheetData>.*</sheetData>)(.*)", old.read(sheet).decode(), re.S).groups()
            header = re.search(r"<row\b.*?</row>", data, re.S)
            with z.open(sheet, "w") as f:
                f.write(re.sub(r"<dimension[^>]*/>", "", before).encode() + b"<sheetData>" + (header.group() if header else line(1, rows.columns)).encode())
                n = below(f)
                f.write(("</sheetData>" + after).encode())
        return n
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{head}<worksheet xmlns="{main}"><sheetData>{line(1, rows.columns)}'.encode())
            n = below(f)
            f.write(b"</sheetData></worksheet>")
    return n
