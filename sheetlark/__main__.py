"""Command line: python -m sheetlark PATH [--report FILE] [--limpar DIR] [--compare OLD NEW] ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators.findings import CAVEAT
from .plans import api


def show(df: DataFrame) -> None:
    """Print every row, a partition at a time."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v) for v in row))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sheetlark", description="Audit .xlsx and .xlsm workbooks.")
    parser.add_argument("path", nargs="*", help="workbooks or folders")
    parser.add_argument("--reveal", action="store_true", help="show real values")
    parser.add_argument("--report", metavar="FILE", help="write the HTML report")
    parser.add_argument("--limpar", metavar="DIR", help="write clean copies to another folder")
    parser.add_argument("--drop-hidden-sheets", action="store_true")
    parser.add_argument("--drop-macros", action="store_true")
    parser.add_argument("--compare", nargs=2, metavar=("OLD", "NEW"), help="show what changed between two versions")
    args = parser.parse_args(argv)
    if not args.path and not args.compare:
        parser.error("a path or --compare is needed")
    spark = spark or SparkSession.builder.appName("sheetlark").getOrCreate()
    if args.compare:
        pair = [tuple(args.compare)]
        show(api.compare(spark, pair, raw=args.reveal).orderBy("category", "sheet", "ref"))
        show(api.provenance(spark, pair))
    if args.path:
        if args.limpar:
            show(api.clean(spark, args.path, args.limpar, drop_hidden_sheets=args.drop_hidden_sheets, drop_macros=args.drop_macros))
        elif args.report:
            api.report(spark, args.path, args.report)
        else:
            show(api.scan(spark, args.path, raw=args.reveal).orderBy("path", "severity", "kind", "sheet", "ref"))
            show(api.risk(spark, args.path).orderBy("path"))
            print(CAVEAT)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
