"""Mixing sources to target weights by a low-discrepancy schedule.

1. Every document gets its size in words; sources get targets (words) by weight, stopped at a
   multiple of their size, the excess reshared by weight (`source_targets`).
2. A source's documents, shuffled by a hash of doc_id and text, are laid end to end into one stream of words, which
   is read up to `most` times and cut into blocks of `block_words`.
3. Slot i of the schedule, of as many slots as the targets fill blocks, takes the golden-ratio point frac(i * phi), which
   the sources' cumulative targets map to a source. Slots are ranked per source, and the slot of rank r takes the source's
   block r (`schedule`, `mix`). What is taken of a source is what its slots take: any run of the schedule holds each
   source in its share, and the whole comes within a few blocks of the targets (the points' discrepancy grows with the logarithm
   of the slots). A slot whose rank is behind the end of its source's stream takes nothing.

Blocks have BLOCK_WORDS words, or fewer where the targets would not fill LEAST_SLOTS blocks, so that a few blocks are little
of any mix. Offsets come from two-level prefix sums: documents are dealt by hash to buckets whose number grows
with the table, bucket totals are accumulated per source, then each bucket on its own. A source with a
third of all rows is spread over its buckets. Sources are few (at most MAX_SOURCES); their targets are collected.

Edge cases: null or blank texts have size 0 and take no words; a null source is a source of its own,
last in order; rows with equal doc_id are told apart by their text (md5 of both: two different ones meet with odds of n^2 / 2^129
among n rows); equal rows are one entry of the stream with so many copies, and share what these take as evenly as whole words
allow; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidspark.llm.common import lean, materialize

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
MAX_SOURCES = 10_000
BLOCK_WORDS = 1024
BUCKET_DOCS = 4096
LEAST_SLOTS = 1 << 14
SLOT_CHUNK = 1 << 16
#: 2**32 / phi, the step of the golden-ratio points in 32-bit fractions.
GOLDEN = 2654435769


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> dict[str | None, Fraction]:
    """Words to take of each source. Sources in order of code points, null last, have the weights in turn; a
    target stops at `most` times the size, the excess goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if budget * weight[s] > most * sizes[s] * total}
        if not over:
            return out | {s: budget * weight[s] / total for s in open_}
        for s in over:
            out[s] = Fraction(most * sizes[s])
            budget -= out[s]
        open_ -= over
    return out


def document_key(doc_id: Column, text: Column) -> Column:
    """One string for a (doc_id, text), nulls included."""
    of_text = F.coalesce(F.md5(text.cast("binary")), F.lit(""))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), of_text).cast("binary"))


def _laid_out(entries: DataFrame, buckets: int) -> DataFrame:
    """The entries (key, source, size, copies) with their offset in their source's shuffled stream."""
    rows = entries.withColumn("bucket", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % buckets).withColumn("words", F.col("size") * F.col("copies"))
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("words").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("local", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    joined = local.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("key", "source", "size", "copies", "words", (F.col("local") + F.col("bucket_start")).alias("offset"))


def _slots(batches, bounds, indices):
    """Source index of each slot number, by its golden-ratio point."""
    for batch in batches:
        i = batch.column("slot").to_numpy()
        point = (i % (1 << 31)) * GOLDEN % (1 << 32)
        source = indices[np.searchsorted(bounds, point, side="right")]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(source, pa.int32())], ["slot", "source_index"])


def schedule(spark, goals: list[int], n_slots: int) -> DataFrame:
    """slot, source_index, rank: n_slots slots dealt to the sources in proportion to their goals, and each one's rank among its source's."""
    indices = np.array([i for i, t in enumerate(goals) if t], np.int32)
    if not len(indices) or not n_slots:
        return spark.createDataFrame([], "slot long, source_index int, rank long")
    total, held, bounds = sum(goals), 0, []
    for i in indices[:-1].tolist():
        held += goals[i]
        bounds.append((held << 32) // total)
    bounds = np.array(bounds, np.int64)
    parts = max(1, min(n_slots // SLOT_CHUNK + 1, 100_000))
    slots = spark.range(0, n_slots, 1, parts).withColumnRenamed("id", "slot").mapInArrow(lean(lambda b: _slots(b, bounds, indices)), "slot long, source_index int")
    slots = slots.withColumn("chunk", (F.col("slot") / SLOT_CHUNK).cast("long"))
    per_chunk = slots.groupBy("source_index", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_index").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_chunk.select("source_index", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source_index", "chunk").orderBy("slot")
    ranked = slots.withColumn("local", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["source_index", "chunk"]).select("slot", "source_index", (F.col("local") + F.col("start")).alias("rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, block_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Mix `docs` (doc_id, text, source).

    Returns (documents, pieces). documents: a row for each row of docs: key (of doc_id and text), doc_id, source, size, dealt, source_size,
    target, copies. pieces: position (slot of the mix), source, key, epoch (reading of the source's stream), first_word (in
    the entry of all its copies), n_words, begins (in the stream); the mixed stream is the pieces in order of position, begins.
    """
    spark = docs.sparkSession
    key = document_key(F.col("doc_id"), F.col("text"))
    # dealt: the task that reads a row; it splits the copies of one row
    sized = docs.select(key.alias("key"), "doc_id", "source", size_in_words(F.col("text")).alias("size"), F.spark_partition_id().alias("dealt"))
    sized = materialize(sized, "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: r["size"] for r in totals}
    targets = source_targets(sizes, weights, share, most)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = [int(targets[s] + Fraction(1, 2)) for s in order]
    words = block_words or max(1, min(BLOCK_WORDS, sum(goals) // LEAST_SLOTS))
    table = spark.createDataFrame([(i, s, sizes[s], float(targets[s])) for i, s in enumerate(order)], "source_index int, name string, source_size long, target double")
    buckets = sum(r["n"] for r in totals) // BUCKET_DOCS + 1
    entries = sized.groupBy("key", "source").agg(F.first("size").alias("size"), F.count("*").alias("copies"))
    # one row of four fields for each of at most MAX_SOURCES sources
    laid = _laid_out(entries, buckets).join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    laid = materialize(laid, "mix-layout")

    epochs = laid.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("stream_at", F.col("epoch") * F.col("source_size") + F.col("offset"))
    epochs = epochs.where("words > 0").withColumn("until", F.col("stream_at") + F.col("words"))
    first, last = F.floor(F.col("stream_at") / words), F.floor((F.col("until") - 1) / words)
    cut = epochs.withColumn("rank", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("stream_at"), F.col("rank") * words)
    end = F.least(F.col("until"), (F.col("rank") + 1) * words)
    blocks = cut.select("source_index", "rank", "source", "key", "epoch", "size", begin.alias("begins"), (begin - F.col("stream_at")).alias("first_word"), (end - begin).alias("n_words"))
    slots = schedule(spark, goals, -(-sum(goals) // words))
    pieces = blocks.join(slots, ["source_index", "rank"]).select(F.col("slot").alias("position"), "source", "key", "epoch", "size", "first_word", "n_words", "begins")
    named = laid.select(F.col("key").alias("_key"), F.col("source").alias("_source"), "source_size", "target", "copies")
    documents = sized.join(named, (F.col("key") == F.col("_key")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_key", "_source")
    return documents, pieces


def taken_by_document(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """key, doc_id, size, source, source_size, target, taken, first_slot of every row of `documents`.

    taken: words that the mix takes of it; equal rows (same doc_id and text) get equal parts of what their copies take together.
    first_slot: the first slot of the mix that takes a word of it (or of an equal row), null if none does.
    """
    sums = pieces.groupBy(F.col("key").alias("_key"), F.col("source").alias("_source")).agg(F.sum("n_words").alias("all_taken"), F.min("position").alias("first_slot"))
    joined = documents.join(sums, (F.col("key") == F.col("_key")) & F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("all_taken", F.coalesce("all_taken", F.lit(0)))
    # the place of a row among its copies, by the tasks that have read them; most rows are alone
    alone = joined.where("copies = 1").withColumn("copy", F.lit(1).cast("long"))
    again = joined.where("copies > 1")
    before = Window.partitionBy("key", "source").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    counts = again.groupBy("key", "source", "dealt").agg(F.count("*").alias("n"))
    starts = counts.select(F.col("key").alias("_k"), F.col("source").alias("_s"), F.col("dealt").alias("_d"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = again.withColumn("local", F.row_number().over(Window.partitionBy("key", "source", "dealt").orderBy("size")))
    placed = placed.join(starts, (F.col("key") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("dealt") == F.col("_d")))
    rows = alone.unionByName(placed.withColumn("copy", F.col("local") + F.col("start")).select(*alone.columns))
    share = F.floor(F.col("all_taken") / F.col("copies")) + (F.col("copy") <= F.col("all_taken") % F.col("copies")).cast("long")
    return rows.select("key", "doc_id", "size", "source", "source_size", "target", share.cast("long").alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, columns: list[str], block_words: int | None = None) -> DataFrame:
    """The mix as documents: `columns` (with doc_id, text, source, n_chars) of every reading of a document.

    Rows come sorted by their place in the mix, the slot that takes their first word. A reading whose last blocks the mix does not take is
    cut behind its last taken word, with n_chars to match. Readings that take no word give no row.
    """
    _, pieces = mix(docs, block_words=block_words)
    # equal rows are one entry: its words are its copies', one after another
    copy = F.explode(F.sequence(F.floor(F.col("first_word") / F.col("size")), F.floor((F.col("first_word") + F.col("n_words") - 1) / F.col("size"))))
    parts = pieces.withColumn("copy", copy)
    start, end = F.greatest("first_word", F.col("copy") * F.col("size")), F.least(F.col("first_word") + F.col("n_words"), (F.col("copy") + 1) * F.col("size"))
    place = F.min(F.struct("position", (F.col("begins") + start - F.col("first_word")).alias("at"))).alias("place")
    # keys without nulls: so texts are shuffled once for both the first of equal rows and the join
    source = [F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_s_null")]
    readings = parts.groupBy(F.col("key").alias("_k"), *source, "epoch", "copy").agg(F.sum(end - start).alias("words"), place).select("_k", "_s", "_s_null", "place", "words")
    rows = docs.select(*columns, document_key(F.col("doc_id"), F.col("text")).alias("_k"), *source).dropDuplicates(["_k", "_s", "_s_null"])
    joined = rows.join(readings, ["_k", "_s", "_s_null"])
    ordered = joined.select(*columns, "words", "place").repartitionByRange("place").sortWithinPartitions("place")
    # the first `words` words, with the blanks before and between them: at most one reading a source is cut
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD_PATTERN), F.lit(0)), 1, F.col("words").cast("int")), "")
    cut = F.when(F.col("words") < size_in_words(F.col("text")), head).otherwise(F.col("text"))
    return ordered.withColumn("text", cut).withColumn("n_chars", F.length("text").cast("long")).select(*columns)
