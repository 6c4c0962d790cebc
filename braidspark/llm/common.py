"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the shingling operators see it, in lower-cased text.
WORD = re.compile(r"\w+")
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Rows in an Arrow batch to Python: bounds a worker's memory when texts are long.
ARROW_ROWS = 1000
#: Texts that a worker takes at once hold at most so many characters (one text may exceed it).
SLICE_CHARS = 1 << 20


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size if it is Spark's default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) >= 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where unset, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="braidspark-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/braidspark/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = session(df)
    path = scratch_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that `materialize` wrote and nothing reads any more."""
    for df in tables:
        if df is not None:
            spark = session(df)
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_KEPT: list = []


def kept_for_own_tasks(drop) -> None:
    """Register a call that drops what a worker keeps for later tasks of one operator."""
    _KEPT.append(drop)


def give_back(kept: bool = False) -> None:
    """Return freed memory to the system; with `kept`, first drop what other operators' tasks have left in this worker."""
    for drop in _KEPT if kept else ():
        drop()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def lean(run):
    """`run` over batches, in a worker that outlives its task: it begins and ends without memory that no task uses."""

    def task(batches):
        give_back(kept=True)
        yield from run(batches)
        give_back()

    return task


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key):
    """crc32 of the key as text, modulo 5; null keys fall in no fold."""
    return F.crc32(key.cast("string").cast("binary")) % 5


def held_out(key):
    """True where the fold is 0; false for null keys."""
    return F.coalesce(fold_of(key) == 0, F.lit(False))


def learned_from(key):
    """True where the fold is another one than 0; false for null keys, which have no fold."""
    return F.coalesce(fold_of(key) != 0, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for up to `limit` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text, in order."""
        words = WORD.findall(text.lower()) if text else ()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_POSITION = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of every run of k words. A text of 1 to k-1 words is one shingle; an empty one has none."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    acc = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        acc += words[i : n - k + 1 + i] * _POSITION[i]
    return mix64(acc)


def slices(texts: list, limit: int = SLICE_CHARS):
    """Ranges of a list of texts that hold about `limit` characters each."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if total + n > limit and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
