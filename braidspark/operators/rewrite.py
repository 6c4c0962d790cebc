"""Filter and rewrite records into a new BAM file, in file order and without a shuffle."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from braidspark.api import read_bam, write_bam

T = Callable[[DataFrame], DataFrame]


def replace_in_name(pattern: str, replacement: str, name: Column | str = "query_name") -> Column:
    """Every occurrence of a literal, case-sensitive pattern replaced; an empty pattern is rejected."""
    if not pattern:
        raise ValueError("the pattern is empty")
    name = F.col(name) if isinstance(name, str) else name
    return F.replace(name, F.lit(pattern), F.lit(replacement))


def update_records(records: DataFrame, changes: dict[str, str], pattern: str) -> DataFrame:
    """Replace `pattern` in the field that each key of `changes` names. Only ``name`` is known; other keys warn.

    A record whose name is missing or not UTF-8 raises an error when it is reached.
    """
    for key in changes:
        if key != "name":
            print(f"field {key!r} is not known and is left alone", file=sys.stderr)
    if "name" not in changes:
        return records
    strict = F.when(F.col("query_name").isNull(), F.raise_error(F.lit("a record has no name, or one that is not UTF-8"))).otherwise(F.col("query_name"))
    return records.withColumn("query_name", replace_in_name(pattern, changes["name"], strict))


def filter_map(spark: SparkSession, path: str, out: str, transform: T | None = None, index: str | None = None, splits: int | None = None, shards: bool = False) -> int:
    """Write `transform` (rows in, 0..1 rows out each, any DataFrame code without a shuffle) of a BAM's records to a new BAM.

    All fields survive, tags and qualities byte by byte; the header is copied. shards: as in `write_bam`. Returns the number of records read.
    """
    seen = Observation()
    records = read_bam(spark, path, index, splits, full=True).observe(seen, F.count(F.lit(1)).alias("n"))
    write_bam(transform(records) if transform else records, out, header_from=path, shards=shards)
    return seen.get["n"]


def deidentify(spark: SparkSession, path: str, out: str, pattern: str, replacement: str, index: str | None = None) -> int:
    """Replace a literal in all read names. Header, tags and sequences keep what they hold."""
    if not pattern:
        raise ValueError("the pattern is empty")
    return filter_map(spark, path, out, lambda r: update_records(r, {"name": replacement}, pattern), index)


def timed(f: Callable):
    """Run f once, print its result's type and the seconds, and return the result."""
    began = time.perf_counter()
    out = f()
    print(f"{type(out).__name__}: {time.perf_counter() - began:.3f} s")
    return out
