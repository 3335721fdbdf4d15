"""What a run tells people: the funnel, and warnings of what may be missing without a trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordinal import stt_list
from ..functions.text import thousands
from .pipelines import Result

# The lines of the funnel.
LINES = {
    "total_rows": "Tổng số dòng đọc được", "valid_rows": "Số dòng có email hợp lệ", "missing_email": "Số dòng thiếu email",
    "invalid_email_format": "Số dòng email sai định dạng", "duplicates_removed": "Số dòng trùng email", "final_count": "Còn lại sau cùng",
}


def funnel(counts: DataFrame) -> DataFrame:
    """line, n: the counts as shown, in order."""
    shown = F.array(*[F.struct(F.lit(k).alias("no"), F.lit(text).alias("line"), thousands(F.col(c)).alias("n")) for k, (c, text) in enumerate(LINES.items())])
    return counts.select(F.inline(shown)).orderBy("no").select("line", "n")


def warning_lines(warnings: DataFrame) -> DataFrame:
    """line: the warnings, source by source."""
    ordered = warnings.orderBy("source", "code", "message")
    return ordered.select(F.concat_ws(": ", F.nullif("source", F.lit("")), "message").alias("line"))


def recovered_lines(recovered: DataFrame, most: int = 15) -> DataFrame:
    """source, line, names: what the text of each source's pages gave back, and the first names of it."""
    each = recovered.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("stt_no", "name"))).alias("rows"))  # ordinals end at 99,999
    numbers = F.array_distinct(F.transform("rows", lambda x: x["stt_no"]))
    line = F.concat(F.lit("Đã khôi phục STT "), stt_list(numbers), F.lit(" từ văn bản gốc ("), F.coalesce("source", F.lit("")), F.lit(")"))
    named = F.transform(F.filter("rows", lambda x: x["name"] != ""), lambda x: F.concat(x["stt_no"].cast("string"), F.lit(": "), x["name"]))
    names = F.concat(F.array_join(F.slice(named, 1, most), "; "), F.when(F.size(named) > most, " ...").otherwise(""))
    return each.select("source", line.alias("line"), F.nullif(names, F.lit("")).alias("names")).orderBy("source")


def segments(result: Result) -> list[str]:
    """The funnel as one line of steps; mode 2 counts missing and malformed addresses together and says how many files
    there were. Then, if there are any, how many rows came back from the text, and how many warnings there are."""
    n = result.counts.first()
    number = lambda x: f"{x:,}".replace(",", ".")
    steps = [f"{number(n.total_rows)} dòng đọc được"]
    if "to_chuc" in result.records.columns:
        files = result.sources.count()
        steps[0] = (f"{files} tệp  ·  " if files > 1 else "") + steps[0]
        steps.append(f"-{number(n.missing_email + n.invalid_email_format)} thiếu/sai email")
    else:
        steps += [f"-{number(n.missing_email)} thiếu email", f"-{number(n.invalid_email_format)} sai định dạng"]
    steps += [f"-{number(n.duplicates_removed)} trùng email", f"{number(n.final_count)} dòng kết quả"]
    out = ["  →  ".join(steps)]
    if result.recovered is not None and (back := result.recovered.count()):
        out.append(f"Đã khôi phục {back} dòng bị bỏ sót")
    if warned := result.warnings.count():
        out.append(f"{warned} cảnh báo cần đối chiếu tệp gốc")
    return out


def report(result: Result) -> str:
    """The funnel, the recovered rows and all warnings; in mode 2 also the records without an organisation. Warnings are
    a few lines a source."""
    out = [f"{r.line}: {r.n}" for r in funnel(result.counts).collect()]
    if result.recovered is not None:
        for r in recovered_lines(result.recovered).toLocalIterator():
            out += [r.line] + ([f"   {r.names}"] if r.names else [])
    if "to_chuc" in result.records.columns and (blank := result.records.where("to_chuc = ''").count()):
        out.append(f"CẢNH BÁO: {blank} dòng không xác định được 'Tổ chức' (để trống)")
    return "\n".join(out + [f"CẢNH BÁO: {r.line}" for r in warning_lines(result.warnings).toLocalIterator()])
