from pyspark.sql import functions as F

from muster.operators import content, context, domains, freetext, origins, profile, provinces, recover, search, sequence, sheets, units
from muster.staging import staged

ROWS = "source string, row_pos long, stt string, raw_name string, raw_email string, raw_phone string"


def rows(spark, *data):
    return spark.createDataFrame([("a", k, *r) for k, r in enumerate(data)], ROWS)


def emails(spark, counts):
    data = [("a", k, f"u{k}@{d}") for k, d in enumerate(d for d, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(data, "source string, row_pos long, email string")


def fixes(spark, counts):
    return {r.old: r.new for r in domains.typo_fixes(domains.histogram(emails(spark, counts))).collect()}


def test_typo_domains(spark):
    assert fixes(spark, {"tinhmau.gov.vn": 30, "tinhmau.gov.com": 1}) == {"tinhmau.gov.com": "tinhmau.gov.vn"}
    assert fixes(spark, {"tinhmau.gov.vn": 20, "tinhmau.goc.vn": 1, "tinhmau.gov.vnv": 1, "khac.com": 1}) == {"tinhmau.goc.vn": "tinhmau.gov.vn", "tinhmau.gov.vnv": "tinhmau.gov.vn"}
    assert fixes(spark, {"ctu.vn": 40, "cmu.vn": 3}) == {}
    assert fixes(spark, {"mau.gov.vn": 60, "mau.edu.vn": 10}) == {}
    assert fixes(spark, {"donvimau.edu.vn": 100, "donvimmau.edu.vn": 15}) == {"donvimmau.edu.vn": "donvimau.edu.vn"}


def test_truncated_domains(spark):
    got = domains.truncated_domains(domains.histogram(emails(spark, {"tinhmau.gov.vn": 15, "tinhmau.go": 1, "gov.vn": 2, "tinhmau.gov": 4, "xa.tinhmau.gov.vn": 1}))).collect()
    assert {r.domain for r in got} == {"tinhmau.go", "gov.vn"}


def test_dominant_domain_ties_go_to_the_first(spark):
    assert domains.dominant_domain(emails(spark, {"b.vn": 3, "a.vn": 3})).first().domain == "b.vn"
    assert domains.dominant_domain(emails(spark, {"b.vn": 2})).count() == 0


def test_gaps_and_labels(spark):
    data = rows(spark, ("1", "A", "a@x.vn", ""), ("", "B", "b@x.vn", ""), ("4", "C", "c@x.vn", ""), (None, "D", "d@x.vn", ""))
    assert [r.stt_no for r in sequence.stt_gaps(data).orderBy("stt_no").collect()] == [2, 3]
    assert [r.row_label for r in sequence.ordinals(data).orderBy("row_pos").collect()] == ["1", "sau STT 1", "4", "sau STT 4"]
    warning = sequence.gap_warnings(data).first()
    assert (warning.code, warning.missing, warning.most) == ("stt_sparse", 2, 4)
    assert sequence.gap_warnings(data.limit(0)).count() == 0


def test_group_titles(spark):
    data = rows(spark, ("I", "Phòng Mẫu", None, None), ("1", "Test Ba", "b@x.vn", ""), ("", "Hội Mẫu", "", ""), ("2", "Test Hai", None, None), ("3", "Phan Ban", None, ""))
    got = sequence.mark_group_titles(data).orderBy("row_pos").collect()
    assert [r.is_group for r in got] == [True, False, True, False, False]
    assert [r.group for r in got] == ["Phòng Mẫu", "Phòng Mẫu", "Hội Mẫu", "Hội Mẫu", "Hội Mẫu"]


def test_continuations(spark):
    data = rows(spark, ("1", "Test Một", "abc@unit.", "0900000001"), (None, None, "gov.vn", None), ("2", "Test Hai", "b@x.vn", ""), (None, "", "c@x.vn", ""), (None, None, None, None))
    got = [(r.raw_name, r.raw_email, r.n_rows) for r in sequence.merge_continuations(data).orderBy("row_pos").collect()]
    assert got == [("Test Một", "abc@unit.gov.vn", 2), ("Test Hai", "b@x.vn", 1), ("", "c@x.vn", 1)]


def test_name_fragments(spark):
    data = rows(spark, ("1", "Nguyễn Test Văn", "a@x.vn", ""), (None, "Ba", None, None), ("2", "Test Hai", "b@x.vn", ""), (None, "Phòng", None, None))
    assert [r.raw_name for r in sequence.join_name_fragments(data).orderBy("row_pos").collect()] == ["Nguyễn Test Văn Ba", "Test Hai", "Phòng"]


def test_logical_tables(spark):
    head = ["STT", "Họ tên", "Email"]
    data = [("a", 0, 0, ["Mẫu", None, None]), ("a", 0, 1, head), ("a", 0, 2, ["1", "A", "a@x"]), ("a", 1, 0, head), ("a", 1, 1, ["2", "B", "b@x"]), ("a", 2, 0, ["x", "y"])]
    data = [(*r, 1 if r[1] == 0 else 0) for r in data]
    got = sequence.logical_tables(spark.createDataFrame(data, "source string, table_idx int, row_pos long, cells array<string>, header_pos long"))
    assert sorted((r.logical_id, r.row_pos, r.cells[0]) for r in got.collect()) == [(1, 0, "Mẫu"), (1, 1, "STT"), (1, 2, "1"), (1, 4, "2"), (2, 0, "x")]


def test_asof_unit(spark):
    known = spark.createDataFrame([("a", 1, "U1"), ("a", 5, "U5")], "source string, stt_no int, unit string")
    lost = spark.createDataFrame([("a", 3), ("a", 7), ("b", 1)], "source string, stt_no int")
    assert {(r.source, r.stt_no, r.unit) for r in sequence.asof_unit(lost, known).collect()} == {("a", 3, "U1"), ("a", 7, "U5"), ("b", 1, None)}


def cells(spark, table, source="a", sheet=0):
    data = [(source, source, "xlsx", sheet, f"s{sheet}", sheet, r, c, v) for r, row in enumerate(table) for c, v in enumerate(row) if v]
    return spark.createDataFrame(data, "source string, file string, kind string, sheet_idx int, sheet_name string, table_id int, row_pos long, col_idx int, value string")


TABLE = [["Danh sách mẫu"], ["STT", "Họ và tên", "Đơn vị công tác", "Email", "Số điện thoại"], ["1", "Test Văn Một", "Sở Mẫu", "mot@x.vn", "0900000001"], ["2", "Test Thị Hai", "Sở Mẫu", "hai@x.vn", "0900000002"]]


def test_headers(spark):
    got = {r.field: (r.header_pos, r.col_idx) for r in profile.header_map(cells(spark, TABLE)).collect()}
    assert got == {"stt": (1, 0), "name": (1, 1), "email": (1, 3), "phone": (1, 4)}
    rich = {r.field: r.col_idx for r in profile.rich_header_map(cells(spark, TABLE)).collect()}
    assert rich == {"stt": 0, "name": 1, "unit": 2, "email": 3, "phone": 4}
    data = profile.to_rows(cells(spark, TABLE), profile.rich_header_map(cells(spark, TABLE))).orderBy("row_pos").collect()
    assert [(r.name, r.email, r.unit) for r in data] == [("Test Văn Một", "mot@x.vn", "Sở Mẫu"), ("Test Thị Hai", "hai@x.vn", "Sở Mẫu")]


def test_inference_without_header(spark):
    table = [[str(k + 1), f"Test Văn {chr(65 + k)}n", "Sở Mẫu", f"u{k}@x.vn", f"090000000{k}"] for k in range(6)]
    got = {r.field: r.col_idx for r in profile.infer_map(cells(spark, table)).collect()}
    assert got == {"stt": 0, "name": 1, "unit": 2, "email": 3, "phone": 4}
    assert profile.infer_map(cells(spark, table[:2])).count() == 0


def test_merged_header(spark):
    table = [["Họ và tên", "", "Email"], ["", "Test Văn Một", "a@x.vn"], ["", "Test Văn Hai", "b@x.vn"], ["", "Test Văn Ba", "c@x.vn"]]
    data = profile.to_rows(cells(spark, table), profile.header_map(cells(spark, table))).orderBy("row_pos").collect()
    assert [r.name for r in data] == ["Test Văn Một", "Test Văn Hai", "Test Văn Ba"]


def test_sheets(spark):
    first, second, third = [[f"{k}@x.vn"] for k in "abcd"], [[f"{k}@x.vn"] for k in "bcde"], [[f"{k}@x.vn"] for k in "fgh"]
    book = cells(spark, first, sheet=0).union(cells(spark, second, sheet=1)).union(cells(spark, third, sheet=2))
    assert [(r.emails, r.overlap, r.skip) for r in sheets.sheet_stats(book).orderBy("sheet_idx").collect()] == [(4, 0, False), (4, 3, True), (3, 0, False)]
    assert {r.sheet_idx for r in sheets.pick_sheets(book).select("sheet_idx").distinct().collect()} == {0, 2}
    assert {r.sheet_idx for r in sheets.pick_sheets(book, "s1").collect()} == {1} and sheets.pick_sheets(book, "x").count() == 0
    assert [(r.sheet, r.suggest_skip) for r in sheets.list_sheets(book).collect()] == [("s0", False), ("s1", True), ("s2", False)]
    assert sheets.skip_warnings(sheets.sheet_stats(book), book).first().message == "a [Sheet: s1]: bỏ qua sheet này vì trùng 3/4 email với sheet trước; 1 email mới trong sheet không được đọc"
    people = cells(spark, [["Họ tên", "Email"], ["Test A", ""], ["Test B", ""], ["Test C", ""]], sheet=3)
    both = book.union(people)
    assert [r.code for r in sheets.people_warnings(sheets.sheet_stats(both), both, profile.rich_header_map(both)).collect()] == ["sheet_without_email"]
    assert {r.sheet_idx for r in sheets.pick_sheets(both, every=True).collect()} == {0, 2, 3}
    assert {r.sheet_idx for r in sheets.pick_sheets(cells(spark, [["x"]]).union(cells(spark, [["y"]], sheet=1))).collect()} == {0}


def test_provinces(spark):
    cases = [("Sở Mẫu tỉnh Vĩnh Phúc", "Phú Thọ"), ("Bà Rịa - Vũng Tàu", "Hồ Chí Minh"), ("Trường Hải Đường", None), ("UBND tinh Bac Giang", "Bắc Ninh"), ("TP. Hồ Chí Minh", "Hồ Chí Minh"), ("Khánh Hoà", "Khánh Hòa")]
    data = spark.createDataFrame(cases, "t string, want string")
    assert all(r.got == r.want for r in data.withColumn("got", provinces.mentioned_province(F.col("t"))).collect())
    default = data.select(provinces.organisation(F.col("t"), "Viện Mẫu").alias("a"), provinces.organisation(F.col("t"), "Cần Thơ").alias("b")).collect()
    assert {r.a for r in default} == {"VIỆN MẪU"}
    assert [r.b for r in default][:3] == ["TỈNH PHÚ THỌ", "THÀNH PHỐ CẦN THƠ", "THÀNH PHỐ CẦN THƠ"]
    assert provinces.province_table(spark).where("not is_old").select("current").distinct().count() == 34
    source = emails(spark, {"cantho.gov.vn": 5, "gmail.com": 2})
    assert provinces.province_from_domains(source).first().province == "Cần Thơ"
    given = lambda name: source.withColumn("default", F.lit(name))
    assert [provinces.default_mismatch(given(x)).count() for x in ("Huế", "Cần Thơ", "Viện Mẫu", None)] == [1, 0, 0, 0]
    cells = source.select("source", "row_pos", F.col("email").alias("value"), F.lit("docx").alias("kind"), F.lit(0).alias("sheet_idx"))
    assert origins.suggested(cells).first().province == "Cần Thơ"
    each = data.withColumn("d", F.when(F.col("t").startswith("Sở"), "Viện Mẫu").when(F.col("t").startswith("TP"), "Huế").when(F.col("t").startswith("Trường"), "Huế"))
    got = {r.t: r.o for r in each.withColumn("o", provinces.organisation(F.col("t"), F.col("d"))).collect()}
    assert (got["Sở Mẫu tỉnh Vĩnh Phúc"], got["Trường Hải Đường"], got["TP. Hồ Chí Minh"], got["Khánh Hoà"]) == ("VIỆN MẪU", "THÀNH PHỐ HUẾ", "THÀNH PHỐ HỒ CHÍ MINH", "TỈNH KHÁNH HÒA")


def test_units(spark):
    cases = {
        "Văn phòng Đảng ủy xã Mẫu Phìn": "Xã Mẫu Phìn - Cần Thơ", "phòng ct xã mẫu ninh": "Xã Mẫu Ninh - Cần Thơ", "UBND PHƯỜNG MẪU HƯNG": "Phường Mẫu Hưng - Cần Thơ", "Hải Dương": "Hải Dương",
        "Hợp tác xã Mẫu": "Hợp tác xã Mẫu - Cần Thơ", "TT Y tế": "Trung tâm Y tế - Cần Thơ", "Ngân hàng Chính sách Xã hội": "Ngân hàng Chính sách Xã hội - Cần Thơ", "": "", None: "",
        "Chi nhánh số 1 - Văn phòng Mẫu - Sở Mẫu Một thành phố Hồ Chí Minh": "Sở Mẫu Một - Hồ Chí Minh", "Phường 5": "Phường 5 - Cần Thơ",
    }
    data = spark.createDataFrame([(k,) for k in cases], "raw_unit string")
    assert {r.raw_unit: r.don_vi for r in units.normalize_units(data, "Cần Thơ").collect()} == cases
    known = spark.createDataFrame([("Văn phòng Đảng ủy", "Xã Mẫu Đô", None), ("Giám đốc", None, "Sở Mẫu Ba"), ("Bệnh viện Mẫu", "Xã Mẫu Đô", None)], "raw_unit string, doc_commune string, doc_issuer string")
    assert [r.don_vi for r in units.normalize_units(known).collect()] == ["Xã Mẫu Đô", "Sở Mẫu Ba", "Bệnh viện Mẫu"]
    header = spark.createDataFrame([("a", "ỦY BAN NHÂN DÂN\nXÃ MẪU ĐÔ CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\n")], "source string, header string")
    assert units.document_communes(header).first().doc_commune == "Xã Mẫu Đô"
    assert spark.sql("select 'SỞ MẪU MỘT CỘNG HÒA XÃ HỘI' h").select(units.document_issuer(F.col("h"))).first()[0] == "Sở Mẫu Một"


def test_job_titles(spark):
    cases = {"Chuyên viên": "", "Phó Giám đốc Trung tâm Mẫu": "Trung tâm Mẫu", "Trưởng phòng": "", "Trường Mẫu": None, "Giám đốc, Phòng Mẫu Hai": "Phòng Mẫu Hai", "P. Chi cục trưởng": ""}
    data = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r.u: (r.rest if r.job else None) for r in data.select("u", units.is_job_title(F.col("u")).alias("job"), units.without_job_titles(F.col("u")).alias("rest")).collect()}
    assert got == cases
    under = data.select("u", units.unit_under_group(F.col("u"), F.lit("Cơ quan Sở Mẫu")).alias("x")).collect()
    assert {r.u: r.x for r in under}["Trường Mẫu"] == "Trường Mẫu" and {r.x for r in under} == {"Sở Mẫu", "Trường Mẫu"}


def test_context(spark):
    lines = {"Tên cơ quan, đơn vị: Phòng Mẫu\nkhác": "Phòng Mẫu", "Danh sách đăng ký của Văn phòng Mẫu Một.": "Văn phòng Mẫu Một", "Danh sách": None}
    got = spark.createDataFrame([(k,) for k in lines], "t string").select("t", context.title_unit(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in got} == lines
    table = [["SỞ MẪU VÀ THỬ Độc lập", ""], ["Sở Mẫu và Thử báo cáo", ""], ["Họ tên", "Email"], ["A", "a@x.vn"]]
    frame = cells(spark, table)
    assert context.table_context(frame, profile.rich_header_map(frame)).first().doc_issuer == "Sở Mẫu và Thử"


def test_content_rows(spark):
    table = [
        ["I", "ĐẢNG ỦY MẪU"], ["1", "Nguyễn Test", "Chuyên viên", "mot@x.vn", "0900000001"], ["", "Ba", "", "", ""], ["", "2", "", "hai @x.vn", "Test Hai", "900000002"],
        ["3", "Test Bốn", "Phòng Mẫu Năm", "", ""], ["", "", "", "bon@x.vn", ""], ["", "", "", "", "0900000004"], ["4", "Test Sáu", "Sở Mẫu", "sau.tinh.gov.vn", ""],
    ]
    data = spark.createDataFrame([("a", k, r) for k, r in enumerate(table)], "source string, row_pos long, cells array<string>")
    got = content.assemble_rows(content.parse_rows(data)).orderBy("row_pos").collect()
    assert [(r.stt, r.raw_name, r.raw_unit, r.raw_email, r.raw_phone, r.group) for r in got] == [
        ("1", "Nguyễn Test Ba", "Chuyên viên", "mot@x.vn", "0900000001", "ĐẢNG ỦY MẪU"), ("2", "Test Hai", "", "hai @x.vn", "900000002", "ĐẢNG ỦY MẪU"),
        ("3", "Test Bốn", "Phòng Mẫu Năm", "bon@x.vn", "0900000004", "ĐẢNG ỦY MẪU"), ("4", "Test Sáu", "Sở Mẫu", "sau.tinh.gov.vn", None, "ĐẢNG ỦY MẪU"),
    ]


def test_freetext(spark):
    text = "Họ tên: Test Một\nEmail: mot@x.vn\nSĐT: 0900000001\n\nghi chú chung\n\nPhụ lục liên hệ\n0900000009\n\nTest Hai\nhai@x.vn"
    got = freetext.contacts(spark.createDataFrame([("a", text)], "source string, text string")).orderBy("row_pos").collect()
    assert [(r.raw_name, r.raw_email, r.raw_phone) for r in got] == [("Test Một", "mot@x.vn", "0900000001"), ("Test Hai", "hai@x.vn", "")]
    block = "Họ tên: Test Một\nEmail: mot@x.vn\nHọ tên: Test Hai\nEmail: hai@x.vn"
    assert freetext.contacts(spark.createDataFrame([("a", block)], "source string, text string")).count() == 2


def test_recovery(spark):
    lines = ["22 Test Hai Sở Mẫu hai@x.vn 0900000002", "23 Test Ba Chuyên viên Phòng Mẫu", "ba@x.vn", "24 Test Bốn bon@x.vn", "Test Năm 0900000005", "25 Trường Mẫu nam@x.vn"]
    doc = spark.createDataFrame([("a", k, t) for k, t in enumerate(lines)], "source string, line_no int, text string")
    gaps = spark.createDataFrame([("a", 22), ("a", 23), ("a", 25)], "source string, stt_no int")
    got = {r.stt_no: r for r in recover.split_line(recover.lost_lines(doc, gaps)).collect()}
    assert (got[22].raw_name, got[22].raw_email, got[22].raw_phone, got[22].raw_unit) == ("Test Hai", "hai@x.vn", "0900000002", "Sở Mẫu")
    assert (got[23].raw_name, got[23].raw_email) == ("Test Ba", "ba@x.vn")
    assert (got[25].raw_name, got[25].raw_phone, got[25].raw_unit) == ("Test Năm", "0900000005", "Trường Mẫu")


def test_cut_addresses(spark):
    whole = [(f"u{k}@tinhmau.gov.vn", k) for k in range(3)]
    cells = [("a", 0, k, [str(k), "Test", e, ""]) for e, k in whole] + [
        ("a", 1, 10, ["10", "Test", "motv", "0900000001"]), ("a", 1, 11, ["11", "Test", "motv", "0900000002"]), ("a", 1, 12, ["12", "Test", "khac", ""]),
        ("a", 1, 13, ["13", "Test", "12345", ""]), ("a", 1, 14, ["14", "Test", "ab", ""]), ("b", 1, 10, ["10", "Test", "motv", ""]),
    ]
    words = [
        ("motv.nam@tinhma", 10.0, 100.0), ("u.gov.vn0900000001", 11.0, 112.0), ("khac", 80.0, 112.0), ("x@khac.vn", 80.0, 120.0),
        ("motv", 10.0, 200.0), ("@tinhmau.", 9.0, 210.0), ("gov.vn", 10.0, 222.0), ("w@tinhmau.gov.vn", 10.0, 230.0),
    ]
    rows = spark.createDataFrame(cells, "source string, page int, row_pos long, cells array<string>")
    placed = spark.createDataFrame([("a", 1, *w) for w in words], "source string, page int, text string, x0 double, top double")
    got = recover.repair_cut_emails(rows, placed, staged)
    assert sorted((r.row_pos, r.col_idx, r.email) for r in got.collect()) == [(10, 2, "motv.nam@tinhmau.gov.vn"), (11, 2, "motv@tinhmau.gov.vn")]
    assert {r.row_pos: r.cells[2] for r in recover.with_repaired(rows, got).where("source = 'a' and page = 1").collect()}[11] == "motv@tinhmau.gov.vn"
    assert recover.repair_warnings(got).first().message == "khôi phục 2 email bị cắt theo viền ô bảng (STT 10, 11) - hãy đối chiếu email với tệp gốc"


def test_words_of_cut_addresses_stay_with_their_rows(spark):
    cells = [("a", 0, k, [str(k), "Test", f"u{k}@tinhmau.gov.vn", ""]) for k in range(3)] + [("a", 1, 10 + k, [str(10 + k), "Test", e, ""]) for k, e in enumerate(["hai", "motv", "motv", "haiv"])]
    words = [("hai", 10.0, 100.0), ("@khac.vn", 10.0, 112.0), ("motv", 10.0, 200.0), ("@khac.vn", 10.0, 212.0), ("motv", 10.0, 300.0), ("@tinhmau.gov.vn", 10.0, 312.0), ("haiv", 10.0, 400.0), ("@tinhmau.gov.vn", 10.0, 412.0)]
    rows = spark.createDataFrame(cells, "source string, page int, row_pos long, cells array<string>")
    placed = spark.createDataFrame([("a", 1, *w) for w in words], "source string, page int, text string, x0 double, top double")
    got = recover.repair_cut_emails(rows, placed, staged)
    assert sorted((r.row_pos, r.email) for r in got.collect()) == [(12, "motv@tinhmau.gov.vn"), (13, "haiv@tinhmau.gov.vn")]


def test_lost_rows_of_five_digits(spark):
    lines = ["9999 Test Hai hai@x.vn 0900000002", "10000 Test Ba ba@x.vn 0900000003"]
    doc = spark.createDataFrame([("a", k, t) for k, t in enumerate(lines)], "source string, line_no int, text string")
    gaps = spark.createDataFrame([("a", 9999), ("a", 10000)], "source string, stt_no int")
    got = {r.stt_no: r for r in recover.split_line(recover.lost_lines(doc, gaps)).collect()}
    assert {k: (r.raw_name, r.raw_email, r.raw_phone) for k, r in got.items()} == {9999: ("Test Hai", "hai@x.vn", "0900000002"), 10000: ("Test Ba", "ba@x.vn", "0900000003")}


def test_search_and_preview(spark):
    data = spark.createDataFrame([(1, "Đỗ Dũng"), (2, "Bình"), (3, None)], "k int, name string")
    assert [r.k for r in search.search(data, ["name"], "DUNG").collect()] == [1]
    assert [r.k for r in search.preview(data, "name", ["k"]).collect()] == [3, 2, 1]
    assert [r.k for r in search.preview(data, "name", ["k"], descending=True, limit=1).collect()] == [1]
