"""A stream of the records of BAM files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidspark.api import register


def read_arrivals(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Streaming DataFrame of the records of files ``*.bam`` in a folder, each file once, in order of name.

    Files must appear whole (move them in) and with ascending names.
    """
    register(spark)
    return spark.readStream.format("bam").options(**options).load(folder)
