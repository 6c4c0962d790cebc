"""The Spark data source ``bam``: index-planned splits, Arrow batches, an ordered writer, and a stream of new files.

Read options: ``path`` (a file, a folder of shards, or a JSON list of such), ``index`` (default ``<path>.bai`` where it exists; of
several files a JSON list of one for each),
``splits`` (per file, of a file with an index by that alone; default: one for each SPLIT_BYTES, and ``parallelism`` of them where that leaves SMALL_BYTES each), ``full`` (adds mate, bin, qualities, tags
and raw names), ``voffset`` (adds voffset and split_id), ``mode`` = ``count`` (one row of counts for each split) or ``index`` (one of its part of a BAI).
A schema given by the user is the set of columns to decode: Spark does not prune columns of Python sources.

Write options: ``path`` (the BAM file, or with ``shards`` = ``true`` a folder of BAM files, one for each partition), ``header_from`` (a BAM whose header is kept) or ``header`` (SAM text) with
``references`` (JSON list of [name, length]).
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from braidspark.functions.flags import FLAG_COLUMNS
from braidspark.plans import splits
from braidspark.sources import bai, bam, bgzf, files

SPLIT_BYTES = 32 << 20
SMALL_BYTES = 256 << 10
SHARD = re.compile(r"part-\d{5,}\.bam")
INDEX = pa.schema([("split_id", pa.int32()), ("piece", pa.binary())])
COUNTS = pa.schema([("split_id", pa.int32()), ("records", pa.int64()), ("mapped", pa.int64())])


def arrow_schema(full: bool = False, place: bool = False) -> pa.Schema:
    required = {"flag", "cigarstring", "query_sequence", "template_length", *FLAG_COLUMNS, "voffset", "split_id"}
    fields = [*bam.CORE, *((name, pa.bool_()) for name in FLAG_COLUMNS), *(bam.REST if full else []), *(bam.PLACE if place else [])]
    return pa.schema([pa.field(name, kind, nullable=name not in required) for name, kind in fields])


@dataclass
class Split(InputPartition):
    path: str
    split_id: int
    start: int
    end: int | None

    def __init__(self, path: str, split_id: int, start: int, end: int | None):
        super().__init__((path, split_id, start, end))
        self.path, self.split_id, self.start, self.end = path, split_id, start, end


def plan_file(path: str, index: str | None = None, most: int | None = None, parallelism: int = 1, own: bool = False) -> list[tuple[int, int]]:
    """Splits of a file by its index, and by what its writer has noted unless `most` of the index are asked for; one split if there is neither. own: by the writer's notes alone."""
    with files.open_file(path) as f:
        _, first = bam.read_header(f)
    size = files.file_size(path)
    index = None if own else index or (f"{path}.bai" if files.exists(f"{path}.bai") else None)
    offsets = bai.read_linear_index(index) if index else []
    if most is None or not index:
        offsets += bai.read_splitting(path, size)
    wanted = max(-(-size // SPLIT_BYTES), min(parallelism, size // SMALL_BYTES), 1)
    return splits.plan(offsets, first, size, wanted if most is None else most)


_COMPARE = {
    EqualTo: lambda c, v: pa.compute.equal(c, v),
    GreaterThan: lambda c, v: pa.compute.greater(c, v),
    GreaterThanOrEqual: lambda c, v: pa.compute.greater_equal(c, v),
    LessThan: lambda c, v: pa.compute.less(c, v),
    LessThanOrEqual: lambda c, v: pa.compute.less_equal(c, v),
    In: lambda c, v: pa.compute.is_in(c, pa.array([x for x in v if x is not None], c.type)),
}


def _supported(f) -> bool:
    if isinstance(f, Not):
        return type(f.child) is EqualTo and _supported(f.child)
    return type(f) in _COMPARE or isinstance(f, (IsNull, IsNotNull))


def _mask(f, batch: pa.RecordBatch) -> pa.Array:
    """Rows that a filter keeps; where it is null it keeps none."""
    if isinstance(f, Not):
        return pa.compute.invert(pa.compute.equal(batch.column(f.child.attribute[0]), pa.scalar(f.child.value)))
    column = batch.column(f.attribute[0])
    if isinstance(f, IsNull):
        return column.is_null()
    if isinstance(f, IsNotNull):
        return column.is_valid()
    return _COMPARE[type(f)](column, f.value)


class _Decoder:
    """Decodes a split: first the columns that filters name, then the rest of the rows that pass."""

    def __init__(self, schema: StructType):
        self.columns, self.filters = [f.name for f in schema.fields], []

    def read(self, split: Split):
        import pyarrow.compute  # noqa: F401

        named = list(dict.fromkeys(f.child.attribute[0] if isinstance(f, Not) else f.attribute[0] for f in self.filters))
        with files.open_file(split.path) as f:
            for chunk in bam.scan(f, split.start, split.end):
                if named:
                    batch, keep = bam.decode(chunk, named, split.split_id), None
                    for own in self.filters:
                        m = _mask(own, batch)
                        keep = m if keep is None else pa.compute.and_kleene(keep, m)
                    rows = pa.compute.fill_null(keep, False).to_numpy(zero_copy_only=False)
                    chunk = chunk.of(rows)
                if len(chunk.at):
                    yield bam.decode(chunk, self.columns, split.split_id)


class BamReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.decoder = dict(options), _Decoder(schema)

    def pushFilters(self, filters):
        for f in filters:
            if _supported(f) and "mode" not in self.options:
                self.decoder.filters.append(f)
            yield f  # Spark checks them again

    def partitions(self):
        most = self.options.get("splits")
        paths, found = paths_of(self.options), []
        indexes = list_of(self.options["index"]) if "index" in self.options else [None] * len(paths)
        if len(indexes) != len(paths):
            raise ValueError(f"{len(indexes)} indexes for {len(paths)} files")
        for path, index in zip(paths, indexes):
            found += [(path, a, b) for a, b in plan_file(path, index, None if most is None else int(most), int(self.options.get("parallelism", 1)), self.options.get("mode") == "index")]
        return [Split(path, i, a, b) for i, (path, a, b) in enumerate(found)]

    def read(self, split: Split):
        if "mode" not in self.options:
            yield from self.decoder.read(split)
            return
        if self.options["mode"] == "index":
            with files.open_file(split.path) as f:
                piece = bai.index_range(f, split.start, split.end)
            if piece:
                yield pa.RecordBatch.from_arrays([pa.array([split.split_id], pa.int32()), pa.array([piece.pack()], pa.binary())], schema=INDEX)
            return
        with files.open_file(split.path) as f:
            total, mapped = bam.count_records(f, split.start, split.end)
        yield pa.RecordBatch.from_arrays([pa.array([split.split_id], pa.int32()), pa.array([total], pa.int64()), pa.array([mapped], pa.int64())], schema=COUNTS)


def list_of(text: str) -> list[str]:
    return json.loads(text) if text.startswith("[") else [text]


def paths_of(options: dict) -> list[str]:
    """The files that a path names, those of a folder of shards in their order."""
    if "path" not in options:
        raise ValueError("the option path is missing")
    found = []
    for path in list_of(options["path"]):
        found += [f"{path}/{x}" for x in files.names_in(path) if SHARD.fullmatch(x)] if files.is_folder(path) else [path]
    return found


def flag_of(options: dict, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    records: int
    size: int
    spots: list[int]


class BamWriter(DataSourceArrowWriter):
    """Tasks write header-less BGZF parts beside the target; the commit joins them in order of partitions.

    A part's name is unique to its attempt, only committed parts are joined, and the file appears under its name when it is
    whole. Parts and the target must be in one file system that driver and executors share. With ``shards`` the parts are
    whole BAM files, and the commit only names them: part-00000.bam and so on, in order of partitions. Beside files of
    over SPOT_BYTES a splitting index (``.sbi``) lets many tasks read them.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.target, self.shards = list_of(options["path"])[0].rstrip("/"), flag_of(options, "shards")
        if not overwrite and files.exists(self.target):
            raise FileExistsError(self.target)
        if "header_from" in options:
            with files.open_file(options["header_from"]) as f:
                self.header, _ = bam.read_header(f)
        else:
            references = [(str(n), int(size)) for n, size in json.loads(options.get("references", "[]"))]
            self.header = bam.Header(options.get("header", "@HD\tVN:1.6\n"), references)
        self.parts = f"{self.target}.parts-{uuid.uuid4().hex}"
        self.payload = int(options.get("block_payload", bgzf.PAYLOAD))

    def write(self, iterator):
        import pyarrow.compute  # noqa: F401

        partition, path, n = TaskContext.get().partitionId(), f"{self.parts}/{uuid.uuid4().hex}", 0
        limit = len(self.header.references)
        with files.create_file(path) as f:
            out = bgzf.BlockWriter(f, self.payload)
            if self.shards:
                out.write(self.header.encode())
                out.cut()
            for batch in iterator:
                for name in {"reference_id", "next_reference_id"} & set(batch.schema.names):
                    most = pa.compute.max(batch.column(name)).as_py()
                    if most is not None and most >= limit:
                        raise ValueError(f"{name} {most} is not in the header")
                out.write_records(*bam.encode_records(batch))
                n += batch.num_rows
            out.finish(eof=self.shards)
        return Part(partition, path, n, out.coffset, out.spots)

    def commit(self, messages):
        messages = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        if self.shards:
            files.remove(self.target)
            for i, part in enumerate(messages):
                path = f"{self.target}/part-{i:05d}.bam"
                files.rename(part.path, path)
                bai.write_splitting(path, part.size + len(bgzf.EOF_BLOCK), part.records, [bgzf.voffset(s, 0) for s in part.spots])
            files.remove(self.parts)
            return
        done, spots = f"{self.parts}-whole", []
        with files.create_file(done) as f:
            head = bgzf.BlockWriter(f, self.payload)
            head.write(self.header.encode())
            head.finish(eof=False)
            size = head.coffset
            for part in messages:
                # parts may be small: only spots that are far enough apart
                for at in (size + s for s in part.spots):
                    if not spots or at - spots[-1] >= bgzf.SPOT_BYTES:
                        spots.append(at)
                size += part.size
                with files.open_file(part.path) as own:
                    while data := own.read(bgzf.READ_BYTES):
                        f.write(data)
            f.write(bgzf.EOF_BLOCK)
        if files.is_folder(self.target):
            files.remove(self.target)
        files.remove(f"{self.target}.sbi")
        files.rename(done, self.target)
        bai.write_splitting(self.target, size + len(bgzf.EOF_BLOCK), sum(m.records for m in messages), [bgzf.voffset(s, 0) for s in spots])
        files.remove(self.parts)

    def abort(self, messages):
        files.remove(self.parts)


class BamStreamReader(DataSourceStreamReader):
    """Batches of BAM files that appear in a folder, each file once, in order of name."""

    def __init__(self, options: dict, schema: StructType):
        self.folder, self.decoder = list_of(options["path"])[0].rstrip("/"), _Decoder(schema)
        self.most = options.get("splits")

    def _names(self) -> list[str]:
        return [x for x in files.names_in(self.folder) if x.endswith(".bam")]

    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        return {"after": max(self._names(), default="")}

    def partitions(self, start, end):
        found = []
        for name in self._names():
            if start["after"] < name <= end["after"]:
                path = f"{self.folder}/{name}"
                found += [(path, a, b) for a, b in plan_file(path, None, None if self.most is None else int(self.most))]
        return [Split(path, i, a, b) for i, (path, a, b) in enumerate(found)]

    def read(self, split: Split):
        return self.decoder.read(split)


class BamDataSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        if self.options.get("mode") == "count":
            return from_arrow_schema(COUNTS)
        if self.options.get("mode") == "index":
            return from_arrow_schema(INDEX)
        return from_arrow_schema(arrow_schema(flag_of(self.options, "full"), flag_of(self.options, "voffset")))

    def reader(self, schema):
        return BamReader(self.options, schema)

    def streamReader(self, schema):
        return BamStreamReader(self.options, schema)

    def writer(self, schema, overwrite):
        return BamWriter(self.options, overwrite)
