"""Counts over record DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(records: DataFrame) -> DataFrame:
    """n_all, n_mapped, n_unmapped in one pass."""
    unmapped = F.count_if("is_unmapped")
    return records.agg(F.count("*").alias("n_all"), (F.count("*") - unmapped).alias("n_mapped"), unmapped.alias("n_unmapped"))


def reduce_offsets(offsets: DataFrame) -> DataFrame:
    """voffset: the least of every block, from a column voffset."""
    return offsets.groupBy(F.shiftright("voffset", 16).alias("block")).agg(F.min("voffset").alias("voffset")).select("voffset")


def intervals(offsets: DataFrame) -> DataFrame:
    """start_voffset, end_voffset of neighbouring offsets; an index's size, so one window is enough."""
    after = F.lead("voffset").over(Window.orderBy("voffset"))
    return offsets.select(F.col("voffset").alias("start_voffset"), after.alias("end_voffset")).where(F.col("end_voffset").isNotNull())
