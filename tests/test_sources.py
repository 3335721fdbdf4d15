import zipfile

import pytest
from pyspark.sql import functions as F

from muster.plans import pipelines
from muster.sources import read_cells, read_errors, read_lines, read_office
from muster.sources.sinks import LAYOUT_1, LAYOUT_2, issue_report, layout, write_table, write_template, write_xlsx

TABLE = [
    ["STT", "Họ và tên", "Đơn vị công tác", "Email", "Số điện thoại"], ["1", "test văn một", "UBND phường Mẫu Một", "mot.tv@example.vn", "900000001"],
    ["2", "Test Thị Hai", "Sở Mẫu", "hai@example.vn", "0900000002"], ["3", "Test Văn Ba", "Sở Mẫu", "ba@gmail,com", "0900000003"],
    ["4", "Test Bốn", "Sở Mẫu", None, "0900000004"], ["5", "Test Bốn", "Sở Mẫu", "hai@example.vn", "0900000005"],
]


@pytest.fixture
def workbook(spark, tmp_path):
    path = str(tmp_path / "mau.xlsx")
    data = spark.createDataFrame([tuple(r) for r in TABLE[1:]], ", ".join(f"`{c}` string" for c in TABLE[0]))
    assert write_xlsx(data, path) == 5
    return path


def test_workbook_round_trip(spark, workbook):
    got = {(r.row_pos, r.col_idx): r.value for r in read_office(spark, workbook).collect()}
    assert got == {(i, j): v for i, row in enumerate(TABLE) for j, v in enumerate(row) if v}


def test_mode1_over_a_workbook(spark, workbook):
    result = pipelines.run_mode1(spark, [workbook])
    assert sorted((r.email, r.name, r.phone) for r in result.records.collect()) == [("ba@gmail.com", "Test Văn Ba", "0900000003"), ("hai@example.vn", "Test Thị Hai", "0900000002"), ("mot.tv@example.vn", "Test Văn Một", "0900000001")]
    assert sorted(r.reason for r in result.issues.collect()) == ["duplicate_email", "missing_email"]
    count = result.counts.first()
    assert (count.total_rows, count.valid_rows, count.missing_email, count.final_count, count.duplicates_removed) == (5, 4, 1, 3, 1)
    assert pipelines.run_mode1(spark, [workbook], dedupe=False).records.count() == 4


def test_mode2_over_a_workbook(spark, workbook):
    result = pipelines.run_mode2(spark, [workbook], default="Cần Thơ")
    got = {r.email: (r.don_vi, r.to_chuc) for r in result.records.collect()}
    assert got["mot.tv@example.vn"] == ("Phường Mẫu Một - Cần Thơ", "THÀNH PHỐ CẦN THƠ")
    assert {v[1] for v in got.values()} == {"THÀNH PHỐ CẦN THƠ"}
    assert result.records.count() + result.issues.count() == 5
    assert layout(result.records).columns == list(LAYOUT_2) and layout(result.records).where(F.col("Mật khẩu").isNotNull()).count() == 0


def test_csv_gives_the_same(spark, workbook, tmp_path):
    path = str(tmp_path / "mau.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("\n".join(",".join(f'"{v or ""}"' for v in row) for row in TABLE))
    one, two = pipelines.run_mode1(spark, [path]), pipelines.run_mode1(spark, [workbook])
    key = lambda r: sorted((x.email, x.name, x.phone) for x in r.records.collect())
    assert key(one) == key(two)
    out = str(tmp_path / "out")
    write_table(layout(one.records, password="x"), out)
    assert spark.read.csv(out, header=True).columns == list(LAYOUT_1) and spark.read.csv(out, header=True).count() == 3
    assert "Thiếu email" in {r["Lý do"] for r in issue_report(one.issues).collect()}


def test_same_file_twice_is_all_duplicates(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("Họ và tên,Email\nTest Một,mot@x.vn\nTest Hai,hai@x.vn\nTest Ba,ba@x.vn\n")
    result = pipelines.run_mode1(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert {r.source for r in result.records.collect()} == {"a.csv"}
    issues = result.issues.collect()
    assert len(issues) == 3 and all(r.source == "b.csv" and "(tệp a.csv)" in r.note for r in issues)


def test_word_tables(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, span="": f"<w:tc><w:tcPr>{span}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:p><w:r><w:t>lead</w:t></w:r></w:p><w:tbl><w:tr>{cell("Họ tên", "<w:gridSpan w:val=%s/>" % chr(34) .join(["", "2", ""]))}{cell("Email")}</w:tr><w:tr>{cell("Test")}{cell("x")}{cell("a@x.vn")}</w:tr></w:tbl>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    got = {(r.row_pos, r.col_idx): r.value for r in read_office(spark, str(tmp_path / "a.docx")).where("table_id >= 0").collect()}
    assert got == {(0, 0): "Họ tên", (0, 2): "Email", (1, 0): "Test", (1, 1): "x", (1, 2): "a@x.vn"}
    assert [r.value for r in read_office(spark, str(tmp_path / "a.docx")).where("table_id = -1").collect()] == ["lead"]


def test_cells_merged_over_rows(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    start, on = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    rows = [
        cell("STT") + cell("Họ tên") + cell("Đơn vị") + cell("Email"), cell("1") + cell("Test Một") + cell("Sở Mẫu", start) + cell("a@x.vn"), cell("2") + cell("Test Hai") + cell("", on) + cell("b@x.vn"),
        '<w:trPr><w:gridBefore w:val="1"/></w:trPr>' + cell("Test Ba") + cell("", on) + cell("c@x.vn"), cell("4") + cell("Test Bốn") + cell("") + cell("d@x.vn"), cell("5") + cell("Test Năm") + cell("", on) + cell("e@x.vn"),
    ]
    with zipfile.ZipFile(tmp_path / "m.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:tbl>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl></w:body></w:document>")
    got = {(r.row_pos, r.col_idx): r.value for r in read_office(spark, str(tmp_path / "m.docx")).collect()}
    assert [got.get((k, 2)) for k in range(6)] == ["Đơn vị", "Sở Mẫu", "Sở Mẫu", "Sở Mẫu", None, None]
    assert (3, 0) not in got and got[3, 1] == "Test Ba" and got[3, 3] == "c@x.vn"


def test_template_is_bound_by_its_header(spark, tmp_path):
    template = str(tmp_path / "mau.xlsx")
    write_xlsx(spark.createDataFrame([("x", "y", "z", "w", "v")], "`Họ và tên` string, `Ghi chú` string, Email string, `Điện thoại` string, `Mật khẩu` string"), template)
    people = spark.createDataFrame([("a", 1, "1", "mot@x.vn", "Test Một", "0900000001"), ("a", 2, "2", "hai@x.vn", "Test Hai", "")], "source string, row_pos long, stt string, email string, name string, phone string")
    out = str(tmp_path / "out.xlsx")
    assert write_template(people, out, template, "p") == 2
    got = {(r.row_pos, r.col_idx): r.value for r in read_office(spark, out).collect()}
    assert [got.get((1, c)) for c in range(5)] == ["Test Một", None, "mot@x.vn", "0900000001", "p"] and (2, 3) not in got
    bad = str(tmp_path / "bad.xlsx")
    write_xlsx(spark.createDataFrame([("x",)], "Email string"), bad)
    with pytest.raises(ValueError, match="Họ và tên, Điện thoại"):
        write_template(people, out, bad)


def test_broken_files_are_rows(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    assert read_office(spark, str(tmp_path / "bad.xlsx")).count() == 0
    assert read_errors(spark, str(tmp_path / "bad.xlsx")).first().code == "source_unreadable"
    (tmp_path / "x.pdf").write_bytes(b"")
    every = read_cells(spark, [str(tmp_path / "x.pdf"), str(tmp_path / "none.csv"), str(tmp_path / "bad.xlsx")])
    assert [r.file for r in every.where("error is not null").orderBy("source_no").collect()] == ["x.pdf", "none.csv", "bad.xlsx"]


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("một\r\nhai\nba")
    assert [r.text for r in read_lines(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()] == ["một", "hai", "ba"]


def test_too_many_rows_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        write_xlsx(spark.range(10), str(tmp_path / "x.xlsx"), most=5)
