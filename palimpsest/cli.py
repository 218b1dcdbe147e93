"""python -m palimpsest.cli PRODUCTION STAGING [-o OUT]: compares two editions and writes the report; 0 passed, 1 failed, 2 not found."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import issues as I
from palimpsest.plans import report
from palimpsest.sources import relations as R

FORMATS = ("json", "toc", "html", "rows")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="palimpsest", description="Compares the relations of a baseline and a candidate edition.")
    out.add_argument("production", help="folder of the baseline's relations, a Parquet table each")
    out.add_argument("staging", help="folder of the candidate's relations")
    out.add_argument("-o", "--output", default="output", help="where the report goes")
    out.add_argument("-f", "--formats", default="json,toc", help=f"of {', '.join(FORMATS)}; others are skipped")
    return out


def run(spark: SparkSession, production: str, staging: str, output: str, formats: tuple[str, ...] = ("json", "toc"), progress: Callable[[int, str], None] | None = None) -> bool:
    """Writes the chosen formats under `output`; whether all pairs passed. A progress call that fails stops nothing."""

    def tell(percent: int, what: str) -> None:
        if progress:
            try:
                progress(percent, what)
            except Exception as error:
                print(f"progress: {error}", file=sys.stderr)

    tell(5, "Reading the relations")
    found = report.compare(report.read_relations(spark, production, staging))
    tell(10, "Comparing")
    I.write_report(found["report"].withColumn("expected_path", F.lit(production)).withColumn("actual_path", F.lit(staging)), f"{output}/report.json")
    written = spark.read.json(f"{output}/report.json")
    tell(80, "Writing the report")
    if "toc" in formats:
        found["toc"].write.mode("overwrite").json(f"{output}/toc.json")
    if "rows" in formats:
        found["rows"].write.mode("overwrite").parquet(f"{output}/rows")
    if "html" in formats and "checks" in written.columns:
        I.html_of(written).write.mode("overwrite").json(f"{output}/pages")
    tell(100, "Done")
    return written.where("not passed").limit(1).count() == 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    for folder in (args.production, args.staging):
        if not R.exists(spark, folder):
            print(f"error: not found: {folder}", file=sys.stderr)
            return 2
    passed = run(spark, args.production, args.staging, args.output, tuple(args.formats.split(",")))
    print(f"Result: {'PASS' if passed else 'FAIL'}\nReport: {args.output}/report.json")
    return 0 if passed else 1


if __name__ == "__main__":
    raise SystemExit(main())
