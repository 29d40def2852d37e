"""python -m doctide lint PATH [--out TABLE] [--rules a,b] | jobs ROOT | cleanup CENTRAL OUTPUTS"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="doctide", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    lint = commands.add_parser("lint")
    lint.add_argument("path")
    lint.add_argument("--out")
    lint.add_argument("--rules", default="")
    commands.add_parser("jobs").add_argument("root")
    cleanup = commands.add_parser("cleanup")
    cleanup.add_argument("central")
    cleanup.add_argument("outputs")
    args = parser.parse_args(argv)

    from doctide.operators import jobs
    from doctide.operators.lint import lint_files
    from doctide.shipping import ship
    from doctide.sources import documents, event_log

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    if args.command == "lint":
        lint_files(spark, args.path, args.out, [r for r in args.rules.split(",") if r] or None).show(50, False)
    elif args.command == "jobs":
        events = event_log.as_rows(event_log.decode(event_log.by_directory(spark, args.root)))
        jobs.ranked(jobs.stalled(jobs.discover(events), F.current_timestamp())).show(50, False)
    else:
        logs = event_log.decode(event_log.central(spark, args.central))
        files = documents.list_files(spark, args.outputs).withColumn("output_dir", F.regexp_replace("output_dir", "^file:", ""))
        jobs.cleanup(logs, files).show(50, False)


if __name__ == "__main__":
    main()
