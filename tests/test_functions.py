"""Vectors of the scalar functions; all values are invented."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from muster.functions import email, names, ordinal, phone, text


def apply(spark, fn, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[1] for r in rows.select("k", fn(F.col("v")).alias("out")).orderBy("k").collect()]


VECTORS = {
    "email": (email.normalize_email, {
        "mau..y@gmail,com": "mau.y@gmail.com", "nvtest": None, "ab cd@unit.gov.vn": None, "ab 1 @unit.gov.vn": "ab1@unit.gov.vn", "ab cd@gmail.com": "abcd@gmail.com",
        "ab@un it.gov.vn": None, "ab@unit. gov.vn": "ab@unit.gov.vn", "tươngab@unit.gov.vn": None, "Email: ab@x.vn": "ab@x.vn", "(ab@x.vn)": "ab@x.vn", "ab@@gmai.com": "ab@gmail.com",
        "AB@X.VN": "ab@x.vn", "": None, None: None, "thu.ab@unit\n.gov.vn": "thu.ab@unit.gov.vn", "ab@.unit.vn": "ab@unit.vn", "ab.@unit.vn": "ab@unit.vn", "ab@gmailcom": "ab@gmail.com",
    }),
    "phone": (phone.normalize_phone, {
        "900000001.0": "0900000001", "+84 900 000 001": "0900000001", "0900 000 001": "0900000001", "0900000001 / 0900000002": "0900000001", "123456789012": "",
        "84900000001": "0900000001", "900000001": "0900000001", "": "", None: "", "(0900) 000-001": "0900000001", "abc": "",
    }),
    "name": (names.normalize_name, {
        "TEST văn ba - Trưởng phòng - Đơn vị X": "Test Văn Ba Trưởng Phòng", "test  văn một (2)": "Test Văn Một", "Chức vụ: X": "", None: "", "nguyễn Thị-Hai": "Nguyễn Thịhai",
    }),
    "stt": (ordinal.parse_stt, {"12": 12, "12.": 12, "12.0": 12, "1.0000000000000848": 1, "1.5": None, "0": None, "100000": None, "IV": None, "": None, None: None}),
    "header": (ordinal.header_field, {"Số điện\nthoại sử\ndụng": "phone", "Họ và tên": "name", "Hộp thư điện tử": "email", "Đơn vị công tác": None, "Mật khẩu": "password", "Ghi chú": None, "Số ĐT sử dụng Zalo": "phone"}),
    "fold": (text.fold, {"Đà  Nẵng\n": "da nang", "HOÀ": "hoa", unicodedata.normalize("NFD", "Đỗ Ước"): "do uoc", None: None}),
    "nfc": (text.nfc, {unicodedata.normalize("NFD", "Ước"): "Ước", None: None}),
    "bare": (email.is_bare, {"ab.unit.gov.vn": True, "ab@unit.vn": False, "a.vn": False}),
    "like": (email.is_email_like, {"MauB@tinh. gov.vn": True, "gửi a@b.vn: gấp": False, "abc": False}),
    "holds": (email.holds_email, {"mau @tinh.vn": True, "mau@tinh,vn": True, "mau b.tinh": False, "a.b.tinh.vn": True, "": False}),
    "number": (phone.holds_phone, {"0900 000 001": True, "900000001": True, "900000001.0": True, "12": False, None: False}),
    "display": (text.display, {"1.0": "1", "150.00000000000003": "150", " a ": "a", None: "", "1.5": "1.5"}),
    "group": (ordinal.is_group_stt, {"IV": True, "": True, None: True, "12": False, "IV.": True}),
    "capitals": (text.capitalize_words, {"mẫu một": "Mẫu Một", "aB c": "AB C"}),
}


@pytest.mark.parametrize("name", VECTORS)
def test_vectors(spark, name):
    fn, cases = VECTORS[name]
    assert dict(zip(cases, apply(spark, fn, list(cases)), strict=True)) == cases


def test_match_score(spark):
    cases = [("Test Văn Ba", "tvba@x.vn", 2), ("Test Văn Ba", "batv@x.vn", 2), ("Test Văn Ba", "testvanba9@x.vn", 2), ("Test Văn Ba", "xyz@x.vn", 0), ("Test Văn Bảo", "xbao@x.vn", 1), ("", "a@x.vn", 0), (None, None, 0)]
    rows = spark.createDataFrame(cases, "n string, e string, want int")
    assert all(r.got == r.want for r in rows.withColumn("got", names.match_score(F.col("n"), F.col("e"))).collect())


def test_honorific(spark):
    rows = spark.createDataFrame([("Bà Test Thị Mụi", "ttmui@x.vn", "Test Thị Mụi"), ("Ông Vinh Tây", "tayov@x.vn", "Ông Vinh Tây"), ("Ông Test Văn Ba", "xyz@x.vn", "Ông Test Văn Ba")], "n string, e string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", names.strip_honorific(F.col("n"), F.col("e"))).collect())


def test_nfd_input_gives_the_same(spark):
    values = ["Nguyễn Thị Hải", "Đơn vị", "Trần Dũng - Chức vụ"]
    for fn in (text.fold, lambda c: names.normalize_name(text.nfc(c))):
        assert apply(spark, fn, values) == apply(spark, fn, [unicodedata.normalize("NFD", v) for v in values])
    apart = unicodedata.normalize("NFD", "Trần Thị Dũng - Chức vụ: Mẫu")
    assert [unicodedata.normalize("NFC", x) for x in apply(spark, names.cut_noise, [apart])] == ["Trần Thị Dũng"]


def test_fixed_values():
    """Values that the SQL counterparts take from the code, held against vectors of their own."""
    from muster.operators import domains, provinces

    assert email.GMAIL_TYPOS[:3] == ("gmailcom", "gmai.com", "gmial.com") and len(email.GMAIL_TYPOS) == 13
    assert re.fullmatch(email.ADDRESS, "a.b+c%d@x-y.gov.vn") and not re.fullmatch(email.ADDRESS, "a@b") and not re.fullmatch(email.ADDRESS, "ă@b.vn")
    assert re.search(names.NOISE_PATTERN, "nguyen a chuc vu truong phong").group() == "chuc vu" and not re.search(names.NOISE_PATTERN, "nguyen van donvi")
    assert set(domains.CUT_TAILS) == {"g", "go", "gov", "gv", "e", "ed", "edu", "v"} and "goc" in domains.GOV_TYPOS and "gov.vn" in domains.BARE_ENDS
    assert len({now for _, now, _ in provinces.NAMES}) == 34 and sum(kind == "thành phố" for name, now, kind in provinces.NAMES if name == now) == 6
    assert dict((name, now) for name, now, _ in provinces.NAMES)["Bình Dương"] == "Hồ Chí Minh"


def test_lists(spark):
    rows = spark.createDataFrame([([3, 1, 2],), (list(range(1, 21)),)], "a array<int>")
    assert [r[0] for r in rows.select(ordinal.stt_list(F.col("a"))).collect()] == ["1, 2, 3", ", ".join(map(str, range(1, 16))) + "... (tổng 20)"]
