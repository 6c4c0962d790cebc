"""BAM files made from the driver's tables: `lineitem` rows as alignments, `nation` as the reference dictionary."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidspark.api import build_index, write_bam
from braidspark.plans.splits import reduce_offsets
from braidspark.sources import bgzf
from braidspark.sources.bai import read_linear_index, write_linear_index
from braidspark.sources.bam import read_header
from braidspark.sources.files import create_file, file_size, open_file

REFERENCE_LENGTH = 400_000
_made: dict[tuple[str, str], str] = {}

#: Expressions that Spark and DuckDB both read; {days} is the days since 1992-01-01.
FLAG = """(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 0 END
 + CASE WHEN l_linenumber % 2 = 1 AND l_returnflag = 'A' THEN 2 ELSE 0 END
 + CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 4 ELSE 0 END
 + CASE WHEN l_linenumber % 2 = 1 AND l_linenumber % 3 = 0 THEN 8 ELSE 0 END
 + CASE WHEN l_suppkey % 2 = 1 THEN 16 ELSE 0 END
 + CASE WHEN l_partkey % 7 = 0 THEN 256 ELSE 0 END
 + CASE WHEN l_quantity < 3 THEN 512 ELSE 0 END
 + CASE WHEN l_partkey % 11 = 0 THEN 1024 ELSE 0 END
 + CASE WHEN l_suppkey % 13 = 0 THEN 2048 ELSE 0 END)"""
UNMAPPED = "(l_returnflag = 'R' AND l_linestatus = 'O')"
UNPLACED = f"({UNMAPPED} AND l_linenumber % 2 = 0)"
QUANTITY = "CAST(floor(l_quantity) AS INT)"
FIELDS = {
    "query_name": "concat('LI-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)",
    "flag": f"CAST({FLAG} AS INT)",
    "reference_id": f"CASE WHEN {UNPLACED} THEN NULL ELSE CAST(l_suppkey % 25 AS INT) END",
    "reference_start": f"CASE WHEN {UNPLACED} THEN NULL ELSE CAST(100 * {{days}} + l_linenumber AS BIGINT) END",
    "mapping_quality": f"CASE WHEN l_quantity = 50 THEN NULL ELSE {QUANTITY} END",
    "cigarstring": f"CASE WHEN {UNMAPPED} THEN '*' ELSE concat({QUANTITY}, 'M') END",
    "query_sequence": f"CASE WHEN NOT {UNMAPPED} AND l_linenumber = 7 THEN '*' ELSE substring(repeat('ACGT', 13), 1, {QUANTITY}) END",
    "template_length": "CAST(l_partkey % 1000 - 500 AS INT)",
}


def alignments_sql(days: str) -> str:
    """SELECT of the eight fields from lineitem. days: the engine's days since 1992-01-01."""
    return "SELECT " + ", ".join(f"{e.format(days=days)} AS {name}" for name, e in FIELDS.items()) + " FROM lineitem"


SPARK_DAYS = "datediff(l_shipdate, DATE '1992-01-01')"
DUCKDB_DAYS = "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))"


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lineitem.select(*[F.expr(e.format(days=SPARK_DAYS)).alias(name) for name, e in FIELDS.items()])


def folder(spark: SparkSession) -> str:
    """A folder that all of the session's processes see: spark.checkpoint.dir; where it is unset, a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = spark.conf.get("spark.braidspark.dir", None) or tempfile.mkdtemp(prefix="braidspark-bam-")
        spark.conf.set("spark.braidspark.dir", base)
    return base.removeprefix("file://")


def bam_of(spark: SparkSession, sf_dir: str) -> str:
    """Path of a coordinate-sorted, indexed BAM of a folder's lineitem, made once for each session."""
    key = sf_dir, spark.sparkContext.applicationId
    if key not in _made:
        path = f"{folder(spark)}/alignments-{uuid.uuid4().hex}.bam"
        names = [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_name").collect()]
        rows = alignments(spark, sf_dir).orderBy(F.col("reference_id").asc_nulls_last(), "reference_start", "query_name")
        write_bam(rows, path, header="@HD\tVN:1.6\tSO:coordinate\n", references=[[n, REFERENCE_LENGTH] for n in names])
        build_index(spark, path)
        _made[key] = path
    return _made[key]


#: Of the file of odd names: rows of a shard, where there are more than four; names that are missing, or not UTF-8.
SHARD_ROWS = 500_000
MISSING, BROKEN = "l_orderkey % 10 = 1", "l_orderkey % 10 = 2"


def odd_names_of(spark: SparkSession, sf_dir: str) -> str:
    """Path of a BAM without an index whose names are partly missing and partly not UTF-8, in a folder of shards; made once for each session."""
    key = sf_dir, "odd", spark.sparkContext.applicationId
    if key not in _made:
        lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        fields = {name: F.expr(e.format(days=SPARK_DAYS)) for name, e in FIELDS.items()}
        name = F.when(F.expr(f"{MISSING} or {BROKEN}"), F.lit(None)).otherwise(fields.pop("query_name"))
        raw = F.when(F.expr(BROKEN), F.unhex(F.lit("52FFFE")))
        rows = lineitem.select(name.alias("query_name"), raw.alias("raw_name"), *[e.alias(n) for n, e in fields.items()])
        path = f"{folder(spark)}/odd-{uuid.uuid4().hex}"
        shards = max(4, -(-lineitem.count() // SHARD_ROWS))
        write_bam(rows.repartition(shards), path, references=[[str(i), REFERENCE_LENGTH] for i in range(25)], shards=True)
        _made[key] = path
    return _made[key]


def repeated(path: str, out: str, times: int) -> str:
    """A BAM of so many copies of a BAM's records, block by block, with an index of its linear offsets."""
    with open_file(path) as f:
        _, first = read_header(f)
    if bgzf.uoffset_of(first):
        raise ValueError("the header shares a block with records")
    start, size = bgzf.coffset_of(first), file_size(path)
    with open_file(path) as f:
        head, body = f.read(start), f.read(size - start - len(bgzf.EOF_BLOCK))
    with create_file(out) as f:
        f.write(head)
        for _ in range(times):
            f.write(body)
        f.write(bgzf.EOF_BLOCK)
    offsets = [v for v in reduce_offsets(read_linear_index(f"{path}.bai")) if v >= first]
    write_linear_index(f"{out}.bai", [v + bgzf.voffset(i * len(body), 0) for i in range(times) for v in offsets])
    return out


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(folder(spark), f"{name}-{uuid.uuid4().hex}.bam")
