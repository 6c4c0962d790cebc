"""python -m braidspark.cli.count [--threads N] [--verbose] BAM [BAI]: prints the number of records."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from braidspark import api


def cores(text: str) -> int:
    return int(text) if text.isdecimal() else 0


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="count", description=__doc__)
    args.add_argument("--threads", "-t", type=cores, default=0, help="cores, 0 (or what is no number) for all")
    args.add_argument("--verbose", "-v", action="store_true")
    args.add_argument("bam")
    args.add_argument("bai", nargs="?")
    own = args.parse_args(argv)
    spark = SparkSession.builder.master(f"local[{own.threads or '*'}]").config("spark.ui.enabled", "false").getOrCreate()
    most = own.threads or spark.sparkContext.defaultParallelism
    if own.verbose:
        plan = api.splits(spark, own.bam, own.bai, most).collect()
        print(f"{len(plan)} splits from {plan[0].start_voffset} to {plan[-1].end_voffset}", file=sys.stderr)
        for row in api.count_by_split(spark, own.bam, own.bai, most).where("records = 0").collect():
            print(f"split {row.split_id} is empty", file=sys.stderr)
    print(api.count(spark, own.bam, own.bai, until_eof=True, splits=most))
    return 0


if __name__ == "__main__":
    sys.exit(main())
