"""A deterministic dirty registration list, derived from customer and nation.

The test tables hold no contact lists. Each expression below is plain SQL that Spark and DuckDB read alike,
so the same list feeds the queries and their counterparts. All names and addresses are invented.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..staging import staged

_SURNAME = "CASE k % 5 WHEN 0 THEN 'Nguyễn' WHEN 1 THEN 'Trần' WHEN 2 THEN 'Lê' WHEN 3 THEN 'Phạm' ELSE 'Đỗ' END"
_MIDDLE = "CASE k % 3 WHEN 0 THEN 'Văn' WHEN 1 THEN 'Thị' ELSE 'Minh' END"
_GIVEN = "CASE k % 4 WHEN 0 THEN 'Bình' WHEN 1 THEN 'Khánh' WHEN 2 THEN 'Hải' ELSE 'Dũng' END"
_LOCAL = (
    "(CASE k % 4 WHEN 0 THEN 'binh' WHEN 1 THEN 'khanh' WHEN 2 THEN 'hai' ELSE 'dung' END)"
    " || (CASE k % 5 WHEN 0 THEN 'n' WHEN 1 THEN 't' WHEN 2 THEN 'l' WHEN 3 THEN 'p' ELSE 'd' END)"
    " || (CASE k % 3 WHEN 0 THEN 'v' WHEN 1 THEN 't' ELSE 'm' END)"
)
_DOMAIN = (
    "CASE k % 9 WHEN 0 THEN (CASE WHEN c_nationkey % 3 = 0 THEN 'haiphong.gov.vn' ELSE 'gmail.com' END) WHEN 1 THEN 'haiphong.gov.vn'"
    " WHEN 2 THEN (CASE WHEN c_nationkey % 3 = 0 THEN 'haiphong.gov.vn' ELSE 'cantho.gov.vn' END) WHEN 3 THEN 'haiphong.gov.vn'"
    " WHEN 4 THEN 'haiphong.gov.vn' WHEN 5 THEN 'donvimau.edu.vn' WHEN 6 THEN (CASE WHEN k % 4 = 0 THEN 'haiphong.goc.vn' WHEN k % 5 = 0 THEN 'haiphon.gov.vn' ELSE 'haiphong.gov.vn' END)"
    " WHEN 7 THEN (CASE WHEN k % 5 = 0 THEN 'haiphong.go' ELSE 'cantho.gov.vn' END)"
    " ELSE (CASE WHEN c_nationkey % 3 = 0 THEN 'haiphong.gov.vn' ELSE 'gmail.com' END) END"
)

COLUMNS = {
    "source": "n_name",
    "row_pos": "CAST(k AS BIGINT)",
    "stt": "CASE WHEN p % 17 = 0 THEN '' WHEN p % 43 = 0 THEN 'IV' WHEN p % 5 = 0 THEN CAST(p AS STRING) || '.' WHEN p % 7 = 0 THEN CAST(p AS STRING) || '.0' ELSE CAST(p AS STRING) END",
    "raw_name": (
        "CASE WHEN k % 13 = 0 THEN 'Ông ' ELSE '' END || "
        f"CASE WHEN k % 29 = 0 THEN lower({_SURNAME}) ELSE {_SURNAME} END || CASE WHEN k % 31 = 0 THEN '  ' ELSE ' ' END || {_MIDDLE} || ' ' || {_GIVEN}"
        " || CASE WHEN k % 23 = 0 THEN ' - Chức vụ: Trưởng phòng' WHEN k % 37 = 0 THEN ' (2)' ELSE '' END"
    ),
    "raw_unit": (
        "CASE WHEN k % 31 = 4 THEN 'Phòng Mẫu, Sở Mẫu Hai tỉnh Hà Nam' WHEN k % 37 = 5 THEN 'VĂN PHÒNG PHƯỜNG MẪU HAI' WHEN k % 41 = 6 THEN 'tổ mẫu xã mẫu ba'"
        " WHEN k % 43 = 7 THEN 'Giám đốc Trung tâm Mẫu Bốn' ELSE CASE k % 11 WHEN 0 THEN 'UBND xã Mẫu Một, tỉnh Cần Thơ' WHEN 1 THEN 'Sở Mẫu thành phố Hải Phòng' WHEN 2 THEN 'Phòng Mẫu' WHEN 3 THEN ''"
        " WHEN 4 THEN 'Trường Mẫu, tỉnh Vĩnh Phúc' WHEN 5 THEN 'Trung tâm Mẫu TP. Huế' WHEN 6 THEN 'Chuyên viên' WHEN 7 THEN 'Trạm Mẫu tinh Bac Giang'"
        " WHEN 8 THEN 'Hải Dương' WHEN 9 THEN 'Hội Mẫu' ELSE 'Ban Mẫu tỉnh Hà Nam' END END"
    ),
    "raw_email": (
        "CASE WHEN k % 19 = 0 THEN NULL WHEN k % 47 = 0 THEN '   ' WHEN k % 41 = 0 THEN 'khong co' WHEN k % 53 = 0 THEN 'ă' || local || '@gmail.com'"
        " WHEN k % 14 = 0 THEN local || '@gmai.com' WHEN k % 16 = 0 THEN local || '@@cantho.gov.vn' WHEN k % 21 = 0 THEN local || '..x@cantho,gov.vn'"
        " WHEN k % 22 = 0 THEN local || ' so@cantho.gov.vn' WHEN k % 25 = 0 THEN local || ' 1 @cantho.gov.vn' WHEN k % 26 = 0 THEN 'Email: ' || upper(local) || '@gmail.com'"
        " ELSE local || CASE WHEN k % 10 < 4 THEN CAST(k % 20 AS STRING) ELSE CAST(k AS STRING) END || '@' || domain END"
    ),
    "raw_phone": (
        "CASE WHEN k % 15 = 0 THEN '' WHEN k % 7 = 3 THEN '09' || CAST(10000000 + k % 50 AS STRING) WHEN k % 8 = 0 THEN '+84 9' || digits WHEN k % 9 = 0 THEN '9' || digits || '.0' WHEN k % 10 = 0 THEN '9' || digits"
        " WHEN k % 11 = 0 THEN '09' || digits || ' / 0900000001' WHEN k % 12 = 0 THEN '123456789012' ELSE '09' || digits END"
    ),
}

#: Helper columns under the names that COLUMNS uses.
_BASE = {
    "k": "c_custkey",
    "p": "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)",
    "n_name": "n_name",
    "c_nationkey": "c_nationkey",
}
_DERIVED = {"local": _LOCAL, "domain": _DOMAIN, "digits": "CAST(10000000 + k % 90000000 AS STRING)"}

SQL = (
    "registrations AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items())
    + " FROM (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in _DERIVED.items())
    + " FROM (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _BASE.items())
    + " FROM customer JOIN nation ON c_nationkey = n_nationkey) AS b) AS d)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, row_pos, stt, raw_name, raw_unit, raw_email, raw_phone.

    Staged, so that the operators see columns of a table, as they would in use, and not CASE expressions that
    the optimizer folds into theirs.
    """
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    base = customers.join(nations, customers.c_nationkey == nations.n_nationkey).selectExpr(*[f"{e} AS {c}" for c, e in _BASE.items()])
    derived = base.selectExpr("*", *[f"{e} AS {c}" for c, e in _DERIVED.items()])
    return staged(derived.selectExpr(*[f"{e} AS {c}" for c, e in COLUMNS.items()]))
