"""Cells and lines of .xlsx and .docx files (zipped XML), one sheet or document at a time inside a task."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _tag(node) -> str:
    return node.tag.rpartition("}")[2]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _texts(node, name: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _tag(x) == name)


def xlsx_parts(data: bytes) -> Iterator[tuple[int, int, str, bytes, bytes]]:
    """Number of sheets, sheet, its name, its XML and that of the workbook's texts: what a task needs to read one sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = z.read("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in z.namelist() else b""
        targets = {x.get("Id"): x.get("Target").lstrip("/") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(x) == "sheet"]
        for s, sheet in enumerate(sheets):
            path = targets[sheet.get(_REL)]
            yield len(sheets), s, sheet.get("name"), z.read(path if path.startswith("xl/") else f"xl/{path}"), shared


def sheet_cells(sheet: bytes, texts: bytes) -> Iterator[tuple[int, int, str]]:
    """Row, column and value (not formula) of a sheet's cells; integral numbers without '.0'."""
    shared = [_texts(x) for x in ElementTree.fromstring(texts)] if texts else []
    row, at = -1, -1
    for event, node in ElementTree.iterparse(io.BytesIO(sheet), ("start", "end")):
        if event == "start" and _tag(node) == "row":
            row, at = int(node.get("r", row + 2)) - 1, -1
        elif event == "end" and _tag(node) == "c":
            at = _column(node.get("r")) if node.get("r") else at + 1
            kind, value = node.get("t"), next((x.text or "" for x in node if _tag(x) == "v"), "")
            if kind == "s":
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = _texts(node)
            elif kind in (None, "n") and re.fullmatch(r"-?\d+\.0+", value):
                value = value.split(".")[0]
            if value:
                yield row, at, value
        elif event == "end" and _tag(node) == "row":
            node.clear()


def docx_part(data: bytes) -> bytes:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read("word/document.xml")


def _property(node, name: str, what: str = "val") -> str | None:
    """An attribute of a property of a cell or row; '' for a property without it, None without the property."""
    for props in node:
        if _tag(props) in ("tcPr", "trPr"):
            for x in props:
                if _tag(x) == name:
                    return next((v for k, v in x.attrib.items() if k.rpartition("}")[2] == what), "")
    return None


def docx_cells(document: bytes) -> Iterator[tuple[int, int, int, str]]:
    """Table, row, column and value of the cells of all tables, and the paragraphs outside of them as table -1; links
    count as text.

    Columns are those of the table's grid. A cell merged over columns keeps its text in the first of them; one merged over
    rows has it in each row, as whoever reads a row wants its unit.
    """
    body = next(x for x in ElementTree.fromstring(document) if _tag(x) == "body")
    for r, text in enumerate(_texts(p) for p in body if _tag(p) == "p"):
        if text.strip():
            yield -1, r, 0, text
    for t, table in enumerate(x for x in body if _tag(x) == "tbl"):
        above: dict[int, str] = {}
        for r, row in enumerate(x for x in table if _tag(x) == "tr"):
            at, merged = int(_property(row, "gridBefore") or 0), {}
            for cell in (x for x in row if _tag(x) == "tc"):
                goes_on = _property(cell, "vMerge")
                value = "\n".join(_texts(p) for p in cell if _tag(p) == "p")
                if goes_on is not None:
                    value = merged[at] = value if goes_on == "restart" else above.get(at, value)
                if value.strip():
                    yield t, r, at, value
                at += int(_property(cell, "gridSpan") or 1)
            above = merged
