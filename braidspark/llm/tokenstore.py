"""Token ids in Parquet list columns, with encodings, row groups and page indexes under control.

`write_tokens` encodes texts with a public tokenizer, appends an end id to each document and writes
`doc_id, part, local_start, n_tokens, ids` in ascending doc_id order, or in another one that columns of the table give.
File order is `part` order, so the files hold one long stream of ids. `layout` picks the encoding of the ids:

* ``dictionary``: a dictionary page per column chunk, ids bit-packed at the width the vocabulary needs;
* ``delta``: Parquet v2 pages, DELTA_BINARY_PACKED.

Row groups are of `row_group_bytes`, pages of `page_bytes`; Spark's Parquet writer adds column and
offset indexes, so a filter on doc_id reads only the pages it needs, and reading `n_tokens` alone
never touches the ids.

Edge cases: a null or empty text holds the end id only; rows with equal doc_id are ordered by a hash of the text
(equal rows are interchangeable, and shared out by the task that reads them); null doc_id sorts first; other columns are ignored; an empty table
gives an empty store.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidspark.llm.common import kept_for_own_tasks, small_batches

TOKENS = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
SLICE_BYTES = 1 << 22
DIGEST = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


#: A tokenizer file with these components (fixed values of the format) cuts texts at white space, drops it and looks at nothing
#: beyond a blank: a text's ids are those of its blank-separated chunks, one after another, whatever the case of A to Z.
CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


class _Pieces(dict):
    """Piece that the pre-tokenizer cuts -> its ids' bytes, by the library's BPE model.

    Of `limit` pieces one half are those met last; the other half go when that is full, but for those met again.
    """

    def __init__(self, model, limit: int):
        super().__init__()
        self.model, self.limit, self.before = model, limit, {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.byte_names = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.pop(piece, None)
        if ids is None:
            named = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.byte_names)
            ids = np.array([t.id for t in self.model.tokenize(named)], "<i4").tobytes()
        if 2 * len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """The library's ids of whole texts.

    Where the tokenizer's file has the components of CHUNKED, each distinct blank-separated chunk of a slice of texts is encoded once: chunks of
    characters below U+0300 are normalised and cut as those components do and their pieces go to the library's BPE model (and are remembered),
    all others go to the library whole. So do texts that hold an added token's string, and all texts of other files.
    """

    #: Chunks that the library encodes whole: other scripts and marks, control separators, dotted I.
    OTHER = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u02ff]")
    #: Contractions, letters, one digit (with the number signs below U+0300 that are no decimal digits), the rest.
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\d\u00b2\u00b3\u00b9\u00bc-\u00be]|(?:[^\w\s]|_)+")

    def __init__(self, path: str, pieces: int = 600_000):
        """pieces: how many are remembered, some 150 bytes each."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"].lower().encode() for t in parts.get("added_tokens") or ()]
        plain = all(t.split() == [t] for t in self.added) and not parts["model"].get("dropout")
        self.chunked = plain and all(parts.get(k) == v for k, v in CHUNKED.items())
        self.pieces = _Pieces(self.tokenizer.model, pieces)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, and where each one's begin, with the end."""
        other = [c for c in chunks if self.OTHER.search(c)]
        by_library = {c: np.array(x, "<i4").tobytes() for c, x in zip(other, self.whole(other))}
        of, cut = self.pieces.__getitem__, self.PIECE.findall
        found = [by_library[c] if c in by_library else b"".join(map(of, cut(c.lower()))) for c in chunks]
        return np.frombuffer(b"".join(found), "<i4"), np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])

    def _by_chunks(self, lowered: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(lowered)
        coded = lists.flatten().dictionary_encode()
        ids, starts = self._of_chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = coded.indices.to_numpy()
        lengths = (starts[1:] - starts[:-1])[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        places = np.repeat(starts[which] - ends[:-1], lengths) + np.arange(ends[-1])
        return ids[places], ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (int32), one after another, and where each text's begin, with the end. A null text is empty."""
        texts = pc.fill_null(texts, "")
        if self.chunked:
            lowered = pc.ascii_lower(texts)
            data = lowered.buffers()[2]
            if not any(t in (data.to_pybytes() if data else b"") for t in self.added):
                return self._by_chunks(lowered)
        found = self.whole(texts.to_pylist())
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        return np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1])), ends


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder: what it remembers lasts from task to task, until another operator's task comes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path)


kept_for_own_tasks(encoder_of.cache_clear)


def _gathered(batches):
    """Batches (doc_id, text) of about SLICE_BYTES of text, in order: the more texts at once, the fewer of their chunks are new."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // SLICE_BYTES, prepend=0)).tolist()
        for a, b in pairwise(sorted({0, *cuts, batch.num_rows})):
            held.append(batch.slice(a, b - a))
            size += int(lengths[a:b].sum())
            if size >= SLICE_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _encode(tokenizer_path: str, end_id: int):
    def run(batches):
        encoder, part, at = encoder_of(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in _gathered(batches):
            n = batch.num_rows
            ids, ends = encoder.encode(batch.column("text"))
            values = np.insert(ids, ends[1:], end_id)
            ends = ends + np.arange(n + 1)
            columns = [
                pa.array(np.full(n, part, np.int32)),
                batch.column("doc_id").cast(pa.int64()),
                pa.array(ends[:-1] + at),
                pa.array(np.diff(ends)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "local_start", "n_tokens", "ids"])
            at += int(ends[-1])

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 1,
    layout: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 64 << 10,
    page_rows: int = 1000,
    order: tuple[str, ...] = ("doc_id",),
) -> None:
    """Encode `docs` (doc_id, text) into a token store at `path`. One shuffle: the sort by `order` (columns of docs)."""
    if layout not in ("dictionary", "delta"):
        raise ValueError(f"layout is dictionary or delta, not {layout!r}")
    small_batches(docs.sparkSession)
    ordered = (
        docs.select("doc_id", "text", F.struct(*order).alias("place"))
        .withColumn("tie", F.xxhash64("text"))
        .withColumn("dealt", F.spark_partition_id())  # equal rows in great number are no single task's
        .repartitionByRange("place", "tie", "dealt")
        .sortWithinPartitions("place", "tie", "dealt", "text")
        .select("doc_id", "text")
    )
    (
        ordered.mapInArrow(_encode(tokenizer_path, end_id), TOKENS)
        .write.option("compression", "zstd")
        .option("parquet.enable.dictionary", str(layout == "dictionary").lower())
        .option("parquet.writer.version", "PARQUET_1_0" if layout == "dictionary" else "PARQUET_2_0")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, first_doc: int | None = None, last_doc: int | None = None) -> DataFrame:
    """The store's rows, of a range of doc_id if given: the filter reaches the row groups' and pages' indexes."""
    rows = spark.read.schema(TOKENS).parquet(path)
    if first_doc is not None:
        rows = rows.where(F.col("doc_id") >= first_doc)
    if last_doc is not None:
        rows = rows.where(F.col("doc_id") <= last_doc)
    return rows


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, part_start: ids before each part. Reads two narrow columns; one row per written part."""
    sums = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def _digest(batches):
    for batch in batches:
        ids = batch.column("ids")
        values = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4")
        ends = np.cumsum([0, *[len(x) if x.is_valid else 0 for x in ids]]) if ids.null_count else ids.offsets.to_numpy() - ids.offsets[0].as_py()
        view = memoryview(values.view(np.uint8))
        sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        columns = [batch.column("part"), batch.column("doc_id"), batch.column("local_start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def digest_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a store, from its files.

    The table of part starts is broadcast: it has one row of 12 bytes per written file.
    """
    small_batches(spark)
    rows = read_tokens(spark, path).select("part", "doc_id", "local_start", "ids").mapInArrow(_digest, DIGEST)
    starts = F.broadcast(part_starts(spark, path))
    return rows.join(starts, "part").select("doc_id", (F.col("local_start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
