"""python -m muster --mode 2 --output out.xlsx file.xlsx other.docx ..."""

from __future__ import annotations

import argparse
import sys

from .plans.pipelines import Source, run_mode1, run_mode2
from .plans.reports import report
from .sources.sinks import issue_columns, issue_report, layout, write_table, write_template, write_xlsx


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="muster", description="Registration lists to accounts")
    p.add_argument("files", nargs="+", help="CSV, .xlsx, .xlsm or .docx; file.xlsx#name reads one sheet")
    p.add_argument("--mode", type=int, choices=(1, 2), default=1)
    p.add_argument("--output", required=True, help=".xlsx, or a folder for CSV or Parquet parts (name ends in .csv or .parquet)")
    p.add_argument("--issues-output", help="default: <output>_issues.xlsx if there are any")
    p.add_argument("--template", help="a workbook whose header row and styles are kept")
    p.add_argument("--to-chuc", help="the organisation of rows that don't say")
    p.add_argument("--password", help="put into the password column; blank if left out")
    p.add_argument("--no-dedupe", action="store_true")
    return p


def _write(rows, path: str) -> None:
    if path.endswith(".xlsx"):
        write_xlsx(rows, path)
    else:
        write_table(rows, path, path.rsplit(".", 1)[-1])


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("muster").getOrCreate()
    sources = [Source(path, None, sheet or None) for path, _, sheet in (f.partition("#") for f in args.files)]
    result = run_mode1(spark, sources, not args.no_dedupe) if args.mode == 1 else run_mode2(spark, sources, args.to_chuc, not args.no_dedupe)
    if not result.sources.take(1):
        print(report(result), file=sys.stderr)
        return 1
    if args.template:
        write_template(result.records, args.output, args.template, args.password)
    else:
        _write(layout(result.records, args.password), args.output)
    if result.issues.take(1):
        _write(issue_report(result.issues, issue_columns(result.issues)), args.issues_output or args.output.removesuffix(".xlsx") + "_issues.xlsx")
    print(report(result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
