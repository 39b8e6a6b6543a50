"""python -m indicant FILE... : extract indicators from files and write a report for each of them."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from .api import extract_files, warning_lines
from .config import persistence
from .operators import formats
from .operators.extract import counts_by_type
from .operators.sink import write_reports
from .operators.store import Options, Store
from .operators.warninglists import load_lists


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="indicant", description="Extract indicators of compromise from files.")
    p.add_argument("paths", nargs="+", help="files, folders or patterns of any store that Spark reaches")
    p.add_argument("--lists", help="warning lists: a pattern of list.json files")
    p.add_argument("--types", help="indicator types, separated by commas; all if absent")
    p.add_argument("--lax", action="store_true", help="files that cannot be read give no indicators instead of an error")
    p.add_argument("--no-defang", action="store_true")
    p.add_argument("--format", choices=("text", "json", "stix"), default="text")
    p.add_argument("--output", help="folder for the results; printed if absent")
    p.add_argument("--persist", action="store_true", default=None)
    p.add_argument("--store", help="folder of the relational store")
    p.add_argument("--config", help="INI file")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("indicant").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    lists = load_lists(spark, args.lists) if args.lists else None
    types = [t.strip() for t in args.types.split(",") if t.strip()] if args.types else None
    found = extract_files(spark, args.paths, lists, types, not args.no_defang, strict=not args.lax).persist()
    now = datetime.now(timezone.utc)
    moment = now.strftime("%Y-%m-%dT%H:%M:%SZ")
    if args.output:
        write_reports(found, args.output, args.format, moment)
    else:
        if args.format == "json":
            documents, column = formats.json_rows(found), "json"
        elif args.format == "stix":
            documents, column = formats.stix_bundles(found, moment), "bundle"
        else:
            documents, column = formats.text_reports(found), "report"
        for row in documents.select(column).toLocalIterator():
            print(formats.pretty(row[0], ascii_only=True) if column != "report" else row[0])
    for row in counts_by_type(found).orderBy("ioc_type").collect():
        print(f"{row.ioc_type}: {row.n}")
    for row in warning_lines(found).toLocalIterator():
        print(row.line)
    keep = persistence(args.persist, args.store, args.config)
    if keep.enabled and keep.path:
        options = Options(defang=not args.no_defang, check_warnings=lists is not None, output_format=args.format)
        Store(spark, keep.path).persist(found.withColumnRenamed("source_kind", "kind"), now.strftime("%Y-%m-%d %H:%M:%S.%f"), options=options)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
