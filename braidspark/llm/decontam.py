"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by size (number of distinct word shingles, by powers of two). For the partition
of items of up to B shingles, a document is read as overlapping windows of two blocks of B shingles, so
that an item's passage lies inside one window whatever the document's length. An item contained to t
in its window has Jaccard similarity of at least t * |item| / (|window| + (1 - t) * |item|) with it, which the
partition's bounds keep above about 0.15 for t = 0.8. With one hash function a band, `N_HASHES`
functions miss such a pair with a probability below (1 - 0.15)**64 = 3e-5; a passage that spans few blocks or
repeats is met in several windows. Block minima of larger partitions are minima of the smaller ones', so
a document's shingles are hashed once per function. A window's minimum that equals an item's is a
candidate. Items of up to SHORT shingles are too small for the smallest partition's bound: every shingle of a document
is looked up among theirs, and one that is found makes a candidate. The share of the item's distinct shingles that the whole document holds is then counted, and
pairs at or above the threshold are returned.

Items are a query set: they are read in chunks of about CHUNK_ITEMS items, one after another: a chunk's signatures and
shingles are broadcast, and released when its pairs are written; documents are never shuffled, so hot sources, copies and passages only cost
their own scan.

Edge cases: words are runs of letters, digits and `_` in lower-cased text; a text of one to four words is one
shingle, which only an equally short text can hold; null or empty texts, and items without words, match
nothing. Repeated rows of documents each give their pairs; items with equal item_id and text give one
pair, items with equal item_id and other texts one pair for each text. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidspark.llm.common import SHINGLE_WORDS, SIMILARITY, WordHashes, lean, materialize, mix64, shingles, slices, small_batches

N_HASHES = 64
SMALLEST = 8
SHORT = SMALLEST // 2
CHUNK_ITEMS = 20_000
PAIRS = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"
_MULTIPLIERS = mix64(np.arange(101, 101 + N_HASHES, dtype=np.uint64)) | np.uint64(1)
_ADDED = mix64(np.arange(901, 901 + N_HASHES, dtype=np.uint64))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class Partition:
    block: int
    keys: list  # of each hash function: sorted minima of the partition's items
    items: list  # of each hash function: the items of those minima
    filters: list  # of each hash function: which low 16 bits occur among them


@dataclass
class ContainmentIndex:
    item_ids: list[int]
    shingles: list[np.ndarray]  # sorted and distinct
    partitions: list[Partition]
    short: Partition  # a single list each: all shingles of items of up to SHORT


def _hash(x: np.ndarray, j: int) -> np.ndarray:
    y = (x + _ADDED[j]) * _MULTIPLIERS[j]
    return y ^ (y >> np.uint64(32))


def _add_keys(part: Partition, keys: np.ndarray, items: np.ndarray) -> None:
    order = np.argsort(keys, kind="stable")
    part.keys.append(keys[order])
    part.items.append(items[order])
    part.filters.append(np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16) > 0)


def build_index(items: list[tuple[int, str | None]], k: int = SHINGLE_WORDS) -> ContainmentIndex:
    """Signatures of the items, by size partition."""
    words = WordHashes()
    found = {(i, s.tobytes()): (i, s) for i, t in items if len(s := np.unique(shingles(words.of(t), k)))}
    index = ContainmentIndex([i for i, _ in found.values()], [s for _, s in found.values()], [], Partition(1, [], [], []))
    short = [at for at, own in enumerate(index.shingles) if len(own) <= SHORT]
    if short:
        _add_keys(index.short, np.concatenate([index.shingles[at] for at in short]), np.repeat(short, [len(index.shingles[at]) for at in short]))
    by_block: dict[int, list[int]] = {}
    for at, own in enumerate(index.shingles):
        if len(own) <= SHORT:
            continue
        block = SMALLEST
        while block < len(own):
            block *= 2
        by_block.setdefault(block, []).append(at)
    for block, members in sorted(by_block.items()):
        part = Partition(block, [], [], [])
        for j in range(N_HASHES):
            minima = np.array([_hash(index.shingles[at], j).min() for at in members], np.uint64)
            _add_keys(part, minima, np.array(members))
        index.partitions.append(part)
    return index


def _halve(minima: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima of pairs of neighbouring blocks of each document; starts: first block of each, and the end."""
    counts = np.diff(starts)
    new_starts = np.concatenate([[0], np.cumsum((counts + 1) // 2)])
    at = np.repeat(starts[:-1] - 2 * new_starts[:-1], np.diff(new_starts)) + 2 * np.arange(new_starts[-1])
    return np.minimum.reduceat(minima, at), new_starts


def candidates(index: ContainmentIndex, grams: list[np.ndarray]) -> set[tuple[int, int]]:
    """(document, item) pairs of which some window's minimum equals the item's, or that share a shingle if the item is short.

    grams: shingles of each non-empty document.
    """
    if not grams or not index.shingles:
        return set()
    counts = np.array([len(g) for g in grams])
    flat, offsets = np.concatenate(grams), np.concatenate([[0], np.cumsum(counts)])
    found: set[tuple[int, int]] = set()
    for keys, items, seen in zip(index.short.keys, index.short.items, index.short.filters):
        likely = np.flatnonzero(seen[(flat & np.uint64(0xFFFF)).astype(np.int64)])
        low, high = np.searchsorted(keys, flat[likely]), np.searchsorted(keys, flat[likely], side="right")
        docs = np.searchsorted(offsets, likely[high > low], side="right") - 1
        for d, a, b in zip(docs.tolist(), low[high > low].tolist(), high[high > low].tolist()):
            found.update((d, int(i)) for i in items[a:b])
    if not index.partitions:
        return found
    blocks = (counts + SMALLEST - 1) // SMALLEST
    first = np.concatenate([[0], np.cumsum(blocks)])
    at = np.repeat(offsets[:-1] - SMALLEST * first[:-1], blocks) + SMALLEST * np.arange(first[-1])
    for j in range(N_HASHES):
        minima, starts, block = np.minimum.reduceat(_hash(flat, j), at), first, SMALLEST
        for part in index.partitions:
            while block < part.block:
                minima, starts = _halve(minima, starts)
                block *= 2
            # windows of two neighbouring blocks; those that reach into the next document only add candidates
            windows = np.minimum(minima, np.append(minima[1:], _NONE))
            likely = np.flatnonzero(part.filters[j][(windows & np.uint64(0xFFFF)).astype(np.int64)])
            if not len(likely):
                continue
            values = windows[likely]
            low, high = np.searchsorted(part.keys[j], values), np.searchsorted(part.keys[j], values, side="right")
            for w, a, b in zip(likely[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                doc = int(np.searchsorted(starts, w, side="right")) - 1
                own = {doc, doc + 1} if w + 1 == starts[doc + 1] and doc + 1 < len(grams) else {doc}
                found.update((d, int(i)) for d in own for i in part.items[j][a:b])
    return found


def _search(shared, k: int, threshold: float):
    def run(batches):
        index, words = shared.value, WordHashes()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            out = []
            for a, b in slices(texts):
                grams = [(i, s) for i in range(a, b) if len(s := shingles(words.of(texts[i]), k))]
                sorted_of: dict[int, np.ndarray] = {}
                for d, item in sorted(candidates(index, [s for _, s in grams])):
                    row, own = grams[d]
                    held = sorted_of[d] if d in sorted_of else sorted_of.setdefault(d, np.unique(own))
                    wanted = index.shingles[item]
                    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                    n = int((held[at] == wanted).sum())
                    if n >= threshold * len(wanted) - 1e-9:
                        out.append((ids[row], index.item_ids[item], n, len(wanted), n / len(wanted)))
            names = ["doc_id", "item_id", "n_shared", "n_shingles", "containment"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE_WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of every pair at or above the threshold.

    docs: doc_id, text. benchmark: item_id, text. Returns one row for each matching row of docs and item.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n_chunks = benchmark.count() // CHUNK_ITEMS + 1
    out = None
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    for c in range(n_chunks):
        chunk = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_chunks)) == c)
        items = [(r[0], r[1]) for r in chunk.select(F.col("item_id").cast("long"), "text").collect()]  # about CHUNK_ITEMS texts
        shared = spark.sparkContext.broadcast(build_index(items, k))
        found = materialize(narrow.mapInArrow(lean(_search(shared, k, threshold)), PAIRS), "contained")
        out = found if out is None else out.unionByName(found)
        shared.unpersist()
    return out
