"""Both pipelines from files to results, and the command line; all people are invented."""

import zipfile

import pytest
from pyspark.sql import functions as F

from muster.__main__ import main
from muster.operators import origins
from muster.plans import pipelines, reports
from muster.plans.pipelines import Source
from muster.sources import read_office
from muster.sources.sinks import issue_columns, issue_report

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
HEAD = ["STT", "Họ và tên", "Đơn vị công tác", "Email", "Số điện thoại"]


def csv(path, rows):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(",".join(f'"{c}"' for c in r) for r in rows), encoding="utf-8")
    return str(path)


def docx(path, *parts):
    """Parts: a text is a paragraph, a list of rows a table."""
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(p(x) if isinstance(x, str) else table(x) for x in parts)}</w:body></w:document>")
    return str(path)


def xlsx(path, sheets):
    main_ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    line = lambda r: "<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' if c else "<c/>" for c in r) + "</row>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main_ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main_ns}"><sheetData>{"".join(map(line, rows))}</sheetData></worksheet>')
    return str(path)


def test_mode1(spark, tmp_path):
    two = [HEAD, ["1", "Test Một", "", "mot@x.vn", "0900000001"], ["2", "Test Hai", "", "hai@x.vn", "0900000002"]]
    other = [["", ""], HEAD, ["1", "Test Ba", "", "ba@x.vn", "0900000003"], ["2", "Test Bốn", "", "bon@x.vn", ""]]
    shifted = [HEAD, ["I", "Phòng Mẫu", "", "", ""], ["1", "Test Năm", "x", "919.099.499", "nam@gmail.c", "om"], ["2", "Test Sáu", "x", "0900000006", "sau@x.vn"], ["3", "Test Bảy", "x", "", ""], ["5", "Test Tám", "", "tam@x.vn", ""]]
    pages = docx(
        tmp_path / "d.docx", "Danh sách mẫu", [HEAD, ["1", "Lê Test", "", "chin@tinh.", "0900000009"], ["", "", "", "gov.vn", ""], ["2", "Lê Văn", "", "muoi@x.vn", ""], ["", "Mười", "", "", ""]],
        [HEAD, ["3", "Test Kép", "", "kep@x.vn", "0900000010"]], "", "Họ tên: Test Lẻ", "Email: le@x.vn",
    )
    first = [HEAD, *[[str(k), f"Test A{chr(97 + k)}", "", f"a{k}@x.vn", ""] for k in range(1, 5)]]
    again = [HEAD, *[[str(k), f"Test A{chr(97 + k)}", "", f"a{k}@x.vn", ""] for k in range(2, 6)]]
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    (tmp_path / "no.pdf").write_bytes(b"")
    files = [csv(tmp_path / "a" / "l.csv", two), csv(tmp_path / "b" / "l.csv", other), csv(tmp_path / "s.csv", shifted), pages, xlsx(tmp_path / "w.xlsx", {"Một": first, "Hai": again}), str(tmp_path / "bad.xlsx"), str(tmp_path / "no.pdf"), str(tmp_path / "none.csv")]
    result = pipelines.run_mode1(spark, files)
    got = {r.email: (r.source, r.name, r.phone) for r in result.records.collect()}
    assert got == {
        "mot@x.vn": ("l.csv", "Test Một", "0900000001"), "hai@x.vn": ("l.csv", "Test Hai", "0900000002"), "ba@x.vn": ("l.csv", "Test Ba", "0900000003"), "bon@x.vn": ("l.csv", "Test Bốn", ""),
        "nam@gmail.com": ("s.csv", "Test Năm", "0919099499"), "sau@x.vn": ("s.csv", "Test Sáu", "0900000006"), "tam@x.vn": ("s.csv", "Test Tám", ""),
        "chin@tinh.gov.vn": ("d.docx", "Lê Test", "0900000009"), "muoi@x.vn": ("d.docx", "Lê Văn Mười", ""), "kep@x.vn": ("d.docx", "Test Kép", "0900000010"), "le@x.vn": ("d.docx", "Test Lẻ", ""),
        **{f"a{k}@x.vn": ("w.xlsx [Sheet: Một]", f"Test A{chr(97 + k)}", "") for k in range(1, 5)},
    }
    assert [(r.raw_name, r.reason, r.row_label) for r in result.issues.collect()] == [("Test Bảy", "missing_email", "3")]
    codes = sorted((r.source, r.code) for r in result.warnings.collect())
    assert codes == [("bad.xlsx", "source_unreadable"), ("no.pdf", "source_unreadable"), ("none.csv", "source_unreadable"), ("s.csv", "stt_gap"), ("w.xlsx", "sheet_skipped"), ("w.xlsx [Sheet: Một]", "no_phone")]
    count = result.counts.first()
    assert (count.total_rows, count.valid_rows, count.missing_email, count.invalid_email_format, count.final_count, count.duplicates_removed) == (16, 15, 1, 0, 15, 0)
    text = reports.report(result)
    assert text.startswith("Tổng số dòng đọc được: 16\n") and "CẢNH BÁO: s.csv: STT nhảy số: thiếu 4" in text
    assert {r.source: (r.total_read, r.final_count) for r in result.sources.collect()}["s.csv"] == (4, 3)


def test_mode2(spark, tmp_path):
    titled = [["", "Danh sách đăng ký"], HEAD, ["", "Phòng Nội Mẫu", "", "", ""], ["1", "Test Một", "Chuyên viên", "mot@x.vn", "0900000001"], ["2", "Test Hai", "", "hai@x.vn", ""], ["3", "Test Ba", "Văn phòng Mẫu Một", "ba@x.vn", ""]]
    blocks = [[*HEAD, "Ghi chú"], ["1", "Test A", "Trạm Y tế", "a@x.vn", "", "xã Mẫu Bốn"], *[[str(k), f"Test {chr(64 + k)}", u, f"{chr(96 + k)}@x.vn", "", g] for k, u, g in ((2, "Chuyên viên", ""), (3, "Trạm", ""), (4, "Kế toán", "Sở Mẫu Năm"), (5, "Giám đốc Trung tâm Mẫu Sáu", ""), (6, "", ""), (7, "Phòng Mẫu Bảy", ""))]]
    above = [["Danh sách đăng ký của Văn phòng Mẫu Tám"], ["STT", "Họ tên", "Email"], ["1", "Test Tám", "tam@x.vn"]]
    pages = docx(tmp_path / "d.docx", [["ỦY BAN NHÂN DÂN"], ["XÃ MẪU CHÍN"]], "Tên cơ quan, đơn vị: Phòng Kinh Mẫu", [["STT", "Họ tên", "Email", "Điện thoại"], ["1", "Test Chín", "chin@x.vn", "0900000009"]], [["2", "muoi@x.vn", "Test Mười", "0900000010"]])
    sheets = xlsx(tmp_path / "w.xlsx", {"Một": [HEAD, ["1", "Test Kép", "Sở Mẫu", "kep@x.vn", ""]], "Hai": [HEAD, ["1", "Test Lẻ", "Sở Mẫu", "le@x.vn", ""]]})
    files = [
        csv(tmp_path / "t.csv", titled), csv(tmp_path / "b.csv", blocks), Source(csv(tmp_path / "v.csv", above), "Viện Mẫu"), pages, Source(sheets, "Huế", "Hai"), Source(sheets, None, "Ba"),
    ]
    result = pipelines.run_mode2(spark, files, default="Cần Thơ")
    got = {r.email: (r.source, r.don_vi, r.to_chuc) for r in result.records.collect()}
    at = lambda source, unit: (source, f"{unit} - Cần Thơ", "THÀNH PHỐ CẦN THƠ")
    assert got == {
        "mot@x.vn": at("t.csv", "Phòng Nội Mẫu"), "hai@x.vn": at("t.csv", "Phòng Nội Mẫu"), "ba@x.vn": at("t.csv", "Văn phòng Mẫu Một"),
        "a@x.vn": at("b.csv", "Xã Mẫu Bốn"), "b@x.vn": at("b.csv", "Xã Mẫu Bốn"), "c@x.vn": at("b.csv", "Xã Mẫu Bốn"), "d@x.vn": at("b.csv", "Sở Mẫu Năm"), "e@x.vn": at("b.csv", "Trung tâm Mẫu Sáu"), "f@x.vn": at("b.csv", "Sở Mẫu Năm"), "g@x.vn": at("b.csv", "Phòng Mẫu Bảy"),
        "tam@x.vn": ("v.csv", "Văn phòng Mẫu Tám", "VIỆN MẪU"), "chin@x.vn": at("d.docx", "Xã Mẫu Chín"), "muoi@x.vn": at("d.docx", "Xã Mẫu Chín"), "le@x.vn": ("w.xlsx [Sheet: Hai]", "Sở Mẫu - Huế", "THÀNH PHỐ HUẾ"),
    }
    assert result.issues.count() == 0
    assert [(r.source.split("#")[0], r.code) for r in result.warnings.where("code = 'source_unreadable'").collect()] == [("w.xlsx", "source_unreadable")]


def test_sources_as_a_table(spark, tmp_path):
    people = lambda *ks: [HEAD, *[[str(k), f"Test {k}", "Sở Mẫu", f"u{k}@haiphong.gov.vn", ""] for k in ks]]
    book = xlsx(tmp_path / "w.xlsx", {"Một": people(1, 2, 3, 4), "Hai": people(2, 3, 4, 5), "Ba": people(7), "Trống": [["x"]]})
    plain = csv(tmp_path / "p.csv", people(8))
    broken = str(tmp_path / "none.xlsx")
    table = pipelines.list_sources(spark, [book, plain, broken])
    got = {(r.file, r.sheet): (r.emails, r.overlap, r.skip, r.default) for r in table.collect()}
    assert got == {
        ("w.xlsx", "Một"): (4, 0, False, "Hải Phòng"), ("w.xlsx", "Hai"): (4, 3, True, "Hải Phòng"), ("w.xlsx", "Ba"): (1, 0, False, "Hải Phòng"),
        ("p.csv", None): (None, 0, False, None), ("none.xlsx", None): (None, 0, False, None),
    }
    changed = origins.with_default(table, "Huế")
    assert {r.sheet: r.default for r in changed.where("file = 'w.xlsx'").collect()} == {"Một": "Huế", "Hai": "Hải Phòng", "Ba": "Huế"}
    chosen = table.where("sheet in ('Hai', 'Một') or file = 'none.xlsx'")
    turned = origins.toggled(changed, chosen)
    assert {(r.file, r.sheet) for r in origins.active(turned).collect()} == {("w.xlsx", "Hai"), ("w.xlsx", "Ba"), ("p.csv", None)}
    assert origins.added(turned, pipelines.list_sources(spark, [plain])).count() == turned.count()
    result = pipelines.run_mode2(spark, turned, default="Cần Thơ")
    assert {r.email.split("@")[0]: r.to_chuc for r in result.records.collect()} == {"u2": "THÀNH PHỐ HẢI PHÒNG", "u3": "THÀNH PHỐ HẢI PHÒNG", "u4": "THÀNH PHỐ HẢI PHÒNG", "u5": "THÀNH PHỐ HẢI PHÒNG", "u7": "THÀNH PHỐ HUẾ", "u8": "THÀNH PHỐ HUẾ"}


def rows(spark, data, columns):
    return spark.createDataFrame(data, columns)


def test_row_labels_are_numbers_that_people_see(spark, tmp_path):
    people = docx(tmp_path / "d.docx", [["Họ tên", "Email"], ["Test Một", "mot@x.vn"], ["Test Một", "mot@x.vn"]], "", [["STT", "Ghi chú", "Họ tên", "Email"], ["7", "", "Test Ba", "ba@x.vn"], ["", "x y z", "Test Bốn", "không có"]])
    result = pipelines.run_mode1(spark, [people])
    assert sorted((r.row_label, r.reason, r.note) for r in result.issues.collect()) == [
        ("2", "duplicate_email", "Trùng email với dòng 1 - Test Một (tệp d.docx)"), ("sau STT 7", "invalid_email_format", None),
    ]
    assert {r.STT for r in issue_report(result.issues).collect()} == {"2", "sau STT 7"}
    assert reports.segments(result)[0] == "4 dòng đọc được  →  -0 thiếu email  →  -1 sai định dạng  →  -1 trùng email  →  2 dòng kết quả"


def test_cut_addresses_come_back_from_the_words(spark, tmp_path):
    people = [HEAD, *[[str(k), f"Test {chr(64 + k)}", "", f"u{k}@x.vn", ""] for k in range(1, 4)], ["4", "Test Năm", "Sở Mẫu", "namtest", "0900000005"]]
    path = docx(tmp_path / "d.docx", people)
    words = spark.createDataFrame([(f"file:{path}", 0, "namtest", 50.0, 10.0), (f"file:{path}", 0, "@x.vn09000", 50.5, 22.0)], "source string, page int, text string, x0 double, top double")
    result = pipelines.run_mode1(spark, [path], words=words)
    assert {r.email for r in result.records.collect()} == {"u1@x.vn", "u2@x.vn", "u3@x.vn", "namtest@x.vn"}
    assert [r.message for r in result.warnings.where("code = 'cut_email_repaired'").collect()] == ["khôi phục 1 email bị cắt theo viền ô bảng (STT 4) - hãy đối chiếu email với tệp gốc"]


def test_cut_domains_count_as_invalid(spark):
    people = [("a", k, str(k), f"Test {chr(64 + k)}", f"u{k}@{'tinhmau.go' if k == 16 else 'tinhmau.gov.vn'}", "") for k in range(1, 17)]
    result = pipelines.extract(rows(spark, people, "source string, row_pos long, stt string, raw_name string, raw_email string, raw_phone string"))
    count = result.counts.first()
    assert (count.valid_rows, count.invalid_email_format, count.duplicates_removed, count.final_count) == (15, 1, 0, 15)


def test_lost_rows_come_back_from_the_text(spark):
    people = [("a", 10, "1", "Test Một", "Sở Mẫu", "mot@x.vn", "0900000001"), ("a", 20, "3", "Test Ba", "Phòng Mẫu", "ba@x.vn", "0900000003"), ("a", 30, "", "Test Hai", "", None, "0900000002")]
    lines = [("a", 1, "2 Test Hai hai@x.vn 0900000002"), ("a", 2, "3 Test Ba ba@x.vn")]
    frame = rows(spark, people, "source string, row_pos long, stt string, raw_name string, raw_unit string, raw_email string, raw_phone string")
    result = pipelines.extract(frame, with_unit=True, lines=rows(spark, lines, "source string, line_no int, text string"))
    assert [(r.stt, r.email, r.name, r.phone, r.don_vi) for r in result.records.orderBy("row_pos", "stt").collect()] == [
        ("1", "mot@x.vn", "Test Một", "0900000001", "Sở Mẫu"), ("2", "hai@x.vn", "Test Hai", "0900000002", "Sở Mẫu"), ("3", "ba@x.vn", "Test Ba", "0900000003", "Phòng Mẫu"),
    ]
    assert result.issues.count() == 0 and result.warnings.where("code = 'stt_gap'").count() == 0
    assert [(r.source, r.stt_no, r.name) for r in result.recovered.collect()] == [("a", 2, "Test Hai")]
    assert "Đã khôi phục STT 2 từ văn bản gốc (a)\n   2: Test Hai\n" in reports.report(result)
    assert reports.segments(result)[1] == "Đã khôi phục 1 dòng bị bỏ sót" and "thiếu/sai email" in reports.segments(result)[0]


def test_command_line(spark, tmp_path, capsys):
    path = csv(tmp_path / "l.csv", [HEAD, ["1", "Test Một", "Sở Mẫu", "mot@x.vn", "0900000001"], ["2", "Test Hai", "", "", ""]])
    out = str(tmp_path / "out.xlsx")
    assert main([path, "--mode", "1", "--output", out], spark) == 0
    assert "Số dòng thiếu email: 1" in capsys.readouterr().out
    cells = {(r.row_pos, r.col_idx): r.value for r in read_office(spark, out).collect()}
    assert cells[0, 0] == "Email" and cells[1, 0] == "mot@x.vn"
    lost = {(r.row_pos, r.col_idx): r.value for r in read_office(spark, str(tmp_path / "out_issues.xlsx")).collect()}
    assert (lost[0, 0], lost[1, 1], lost[1, 4]) == ("STT", "Test Hai", "Thiếu email")
    again = str(tmp_path / "again.xlsx")
    assert main([path, "--mode", "2", "--output", again, "--template", out, "--to-chuc", "Huế", "--password", "x"], spark) == 0
    kept = {(r.row_pos, r.col_idx): r.value for r in read_office(spark, again).collect()}
    assert kept[0, 0] == "Email" and kept[1, 0] == "Test Một" and kept[1, 7] == "THÀNH PHỐ HUẾ"
    assert main([str(tmp_path / "none.csv"), "--output", str(tmp_path / "x.xlsx")], spark) == 1


def test_issue_columns(spark):
    issues = rows(spark, [("a", "1", "A", None, "", "missing_email", None)], "source string, stt string, raw_name string, raw_email string, raw_phone string, reason string, note string")
    assert issue_columns(issues) == ["stt", "raw_name", "raw_email", "raw_phone", "reason"]
    assert issue_columns(issues.union(issues.withColumn("source", F.lit("b")).withColumn("note", F.lit("n")))) == ["source", "stt", "raw_name", "raw_email", "raw_phone", "reason", "note"]
    assert issue_report(issues).columns[0] == "Tệp nguồn"
    with pytest.raises(ValueError):
        from muster.sources.sinks import write_xlsx

        write_xlsx(issues, "/tmp/never.xlsx", most=0)
