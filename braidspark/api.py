"""Reading, counting, rewriting and iterating over alignment files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from braidspark.functions.flags import FLAG_COLUMNS
from braidspark.sources import bai, bam, bgzf, files
from braidspark.sources.datasource import BamDataSource, arrow_schema, plan_file

__all__ = ["AlignmentFile", "BamRecord", "RecordIterator", "bam_header", "build_index", "count", "count_by_split", "in_file_order", "index_windows", "linear_index", "read_bam", "references", "register", "splits", "write_bam"]

#: Compressed bytes of a file whose records are put in order together.
PLACE_BYTES = 1 << 20


def register(spark: SparkSession) -> None:
    """Make ``format("bam")`` known, and let filters reach it."""
    spark.dataSource.register(BamDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _reader(spark: SparkSession, path, index, splits_, **options):
    register(spark)
    index = index if index is None or isinstance(index, str) else json.dumps(list(index))
    given = {"index": index, "splits": splits_, "parallelism": spark.sparkContext.defaultParallelism} | options
    if splits_ is not None and int(splits_) < 1:
        raise ValueError("at least one split is needed")
    many = json.dumps(list(path)) if not isinstance(path, str) else path
    reader = spark.read.format("bam").option("path", many)
    for name, value in given.items():
        if value is not None:
            reader = reader.option(name, str(value))
    return reader


def read_bam(spark: SparkSession, path: str | list[str], index: str | list[str] | None = None, splits: int | None = None, columns: list[str] | None = None, full: bool = False, voffset: bool = False) -> DataFrame:
    """Records of a BAM file, of several (with an index each, if any are given), or of a folder of shards.

    `columns` are the only ones that are decoded.
    """
    reader = _reader(spark, path, index, splits, full=full, voffset=voffset)
    if columns is not None:
        known = from_arrow_schema(arrow_schema(True, True))
        reader = reader.schema(StructType([known[c] for c in columns]))
    return reader.load()


def count_by_split(spark: SparkSession, path: str, index: str | None = None, splits: int | None = None) -> DataFrame:
    """split_id, records, mapped of every split, empty ones too; no field but the flag is decoded."""
    return _reader(spark, path, index, splits, mode="count").load()


def count(spark: SparkSession, path: str, index: str | None = None, until_eof: bool = False, splits: int | None = None) -> int:
    """Mapped records (flag without 0x4), or all with `until_eof`."""
    return count_by_split(spark, path, index, splits).agg(F.sum("records" if until_eof else "mapped")).first()[0]


def build_index(spark: SparkSession, path: str) -> str:
    """Index a coordinate-sorted BAM: its splits by the executors, what they found (runs of records in one bin) joined by the driver."""
    parts = _reader(spark, path, None, None, mode="index").load().collect()
    pieces = [bai.Piece.unpack(bytes(r.piece)) for r in sorted(parts, key=lambda r: r.split_id)]
    return bai.write_index(f"{path}.bai", len(bam_header(path).references), bai.join(pieces))


def bam_header(path: str) -> bam.Header:
    with files.open_file(path) as f:
        return bam.read_header(f)[0]


def references(spark: SparkSession, path: str) -> DataFrame:
    """reference_id, name, length of the header's reference dictionary."""
    rows = [(i, name, length) for i, (name, length) in enumerate(bam_header(path).references)]
    return spark.createDataFrame(rows, "reference_id int, name string, length int")


def linear_index(spark: SparkSession, index: str) -> DataFrame:
    """voffset, block, in_block of the index's entries."""
    return spark.createDataFrame(bai.debug_rows(index), "voffset long, block long, in_block long")


def index_windows(spark: SparkSession, index: str) -> DataFrame:
    """reference_id, window_id, voffset of the windows of an index that some record overlaps."""
    rows = [(i, w, v) for i, own in enumerate(bai.read_windows(index)) for w, v in enumerate(own) if v]
    return spark.createDataFrame(rows, "reference_id int, window_id int, voffset long")


def splits(spark: SparkSession, path: str, index: str | None = None, most: int | None = None) -> DataFrame:
    """split_id, start_voffset, end_voffset as a read of the file would plan them."""
    rows = [(i, a, b) for i, (a, b) in enumerate(plan_file(path, index, most))]
    return spark.createDataFrame(rows, "split_id int, start_voffset long, end_voffset long")


def in_file_order(records: DataFrame) -> DataFrame:
    """Adds position: of a record (with voffset and split_id) in its file, from 0. Stretches are counted first, then each ordered on its own.

    A stretch is what a split holds of PLACE_BYTES of the file, however large splits are.
    """
    records = records.withColumn("stretch", F.floor(block_of(F.col("voffset")) / PLACE_BYTES))
    counts = records.groupBy("split_id", "stretch").agg(F.count("*").alias("n"))
    before = Window.orderBy("split_id", "stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row for each stretch
    starts = counts.select("split_id", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    local = records.withColumn("place", F.row_number().over(Window.partitionBy("split_id", "stretch").orderBy("voffset")) - 1)
    return local.join(F.broadcast(starts), ["split_id", "stretch"]).withColumn("position", F.col("place") + F.col("start")).drop("place", "start", "stretch")


def stored(df: DataFrame) -> DataFrame:
    """What a file stores of records: not the predicates, which the flag holds."""
    return df.drop(*FLAG_COLUMNS)


def write_bam(df: DataFrame, path: str, header_from: str | None = None, header: str | None = None, references: list | None = None, overwrite: bool = True, shards: bool = False, **options: str) -> str:
    """Write records in the order of the DataFrame's partitions. Columns that are missing are absent values.

    shards: `path` becomes a folder of BAM files, one for each partition, which `read_bam` reads in order; nothing is copied
    when they are done. Otherwise the parts are joined to one file by one process.
    """
    register(df.sparkSession)
    given = {"shards": "true" if shards else None, "header_from": header_from, "header": header, "references": None if references is None else json.dumps(references)} | options
    writer = stored(df).write.format("bam").mode("overwrite" if overwrite else "append").options(**{k: v for k, v in given.items() if v is not None})
    writer.save(path)
    return path


@dataclass(frozen=True)
class BamRecord:
    """One record's eight fields; the flag's predicates are properties."""

    query_name: str | None
    flag: int
    reference_id: int | None
    reference_start: int | None
    mapping_quality: int | None
    cigarstring: str
    query_sequence: str
    template_length: int

    def __repr__(self) -> str:
        name = "None" if self.query_name is None else f'"{self.query_name}"'
        return f"BamRecord(query_name={name}, flag={self.flag}, ref_start={self.reference_start})"


for _name, _mask in FLAG_COLUMNS.items():
    setattr(BamRecord, _name, property(lambda self, mask=_mask: self.flag & mask != 0))


class RecordIterator:
    """Records in file order, from rows of their virtual offset and fields. Its length is what is left of it; asking for it counts the file once."""

    def __init__(self, rows: Iterator, total: Callable[[], int], records: Callable[[], DataFrame]):
        self._rows, self._given, self._last = rows, 0, None
        self._total, self._records = cache(total), records

    def __iter__(self) -> RecordIterator:
        return self

    def __next__(self) -> BamRecord:
        self._last, *row = next(self._rows)
        self._given += 1
        return BamRecord(*row)

    def __len__(self) -> int:
        return self._total() - self._given

    def rest(self) -> DataFrame:
        """The records that are left (with voffset); the iterator stays where it is."""
        records = self._records()
        return records if self._last is None else records.where(F.col("voffset") > self._last)

    def sum(self, field: str) -> int:
        """A field's sum over all records that are left, by the executors; then the iterator is at its end."""
        total = self.rest().agg(F.coalesce(F.sum(field), F.lit(0))).first()[0]
        self._rows, self._given = iter(()), self._total()
        return total


class AlignmentFile:
    """A BAM file with its index, as a handle: ``with AlignmentFile(spark, bam, bai) as f: for read in f: ...``"""

    def __init__(self, spark: SparkSession, path: str, index: str | None = None):
        self.spark, self.path, self.index = spark, path, index
        self.header = bam_header(path)

    def to_df(self, **options) -> DataFrame:
        return read_bam(self.spark, self.path, self.index, **options)

    def count(self, until_eof: bool = False) -> int:
        return count(self.spark, self.path, self.index, until_eof)

    def fetch(self) -> RecordIterator:
        """All records, read by the driver batch by batch."""
        columns = ["voffset", *(f.name for f in fields(BamRecord))]
        return RecordIterator(self._rows(columns), lambda: self.count(until_eof=True), lambda: self.to_df(columns=columns, voffset=True))

    def _rows(self, columns: list[str]) -> Iterator[tuple]:
        with files.open_file(self.path) as f:
            _, first = bam.read_header(f)
            for chunk in bam.scan(f, first, None):
                yield from zip(*[c.to_pylist() for c in bam.decode(chunk, columns).columns])

    def __iter__(self) -> RecordIterator:
        return self.fetch()

    def __enter__(self) -> AlignmentFile:
        return self

    def __exit__(self, *exc) -> bool:
        return False

    def __repr__(self) -> str:
        return f"AlignmentFile({self.path!r})"


def sequential_count(path: str, threads: int = 1) -> tuple[int, int]:
    """Records and mapped records by one pass over the file on the driver; `threads` of them inflate its blocks."""
    with files.open_file(path) as f:
        _, first = bam.read_header(f)
        return bam.count_records(f, first, None, max(1, threads))


def block_of(v):
    """Compressed part of a virtual offset column."""
    return F.shiftright(v, 16)


def in_block(v):
    """In-block part of a virtual offset column."""
    return v.bitwiseAND(F.lit(bgzf.voffset(0, 0xFFFF)))
