"""python -m braidspark.cli.deidentify IN.bam IN.bai OUT.bam PATTERN REPLACEMENT: rewrites read names."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from braidspark.operators.rewrite import deidentify


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if len(argv) < 5:
        print(__doc__, file=sys.stderr)
        return 1
    bam, bai, out, pattern, replacement = argv[:5]
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    n = deidentify(spark, bam, out, pattern, replacement, bai)
    print(f"{n} records")
    return 0


if __name__ == "__main__":
    sys.exit(main())
