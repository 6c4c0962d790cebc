"""Removal of repeated passages with sparse suffix arrays.

A byte goes if a window of `length` bytes that covers it also starts anywhere else in the corpus.

Anchors. The window's minimiser, the 64-byte gram with the smallest hash in it (the leftmost of equal
ones), depends on the window's bytes alone, so equal windows have it at the same offset d. The windows of a
document with one minimiser are a run; a run's anchor is that gram, its context the bytes
that its windows cover. About one byte in 170 is an anchor. Only runs whose anchor gram occurs twice or more can
hold repeated windows; equal contexts are collapsed to one with a count.

Shards. Contexts are dealt by anchor gram, so that all suffixes that could match meet in one shard. A
shard has two sparse suffix arrays, of the bytes from the anchors rightwards and of the bytes left of them
read backwards, as strings of 8-byte symbols. They are sorted by Larsson-Sadakane refinement: suffixes are ranked
by one symbol, then groups of equal rank are split by the rank `h` symbols on, h doubling, and groups of one are
left alone. Kasai's rule gives the common prefixes in text order, one symbol less than the suffix before at
least, for all contexts at once; the mismatching symbols give them to the byte. Where the common prefix falls
below x, the sorted suffixes split into classes that agree in x bytes. A window at offset d is repeated
if another context has the same left class at d and the same right class at length - d, found by sorted search.

Merging. Contexts of one gram beyond SHARD_CONTEXTS (a passage in a great many different surroundings) are
dealt to several shards by hash. A shard finds its own repeats, and gives each of its distinct windows once, by a 128-bit
fingerprint, so that a window comes at most once from a shard. The shards' windows are cut in ranges of fingerprints, not
shard against shard, and sorted; binary search in that order tells which are in two shards or more. A window that is alone in its
shard is repeated if it is.

Edge cases: texts are UTF-8 bytes; null and empty texts, and texts shorter than `length`, lose nothing;
repeated rows are documents of their own, so that a repeated long row is removed whole; matches overlap
freely, within a document too; null doc_id is a key like another; an empty table gives no rows; other
columns are ignored. Texts of over PART_BYTES are searched in parts that overlap; what is found does not depend on it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidspark.llm.common import materialize, mix64, release, small_batches

LENGTH = 400
GRAM = 64
SHARD_BYTES = 8 << 20
SHARD_CONTEXTS = 20_000
SLICE_BYTES = 1 << 20
#: Window starts of a text that are searched at once: places must fit in _PLACE.
PART_BYTES = 1 << 27
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_STEPS = mix64(np.arange(501, 509, dtype=np.uint64)) | np.uint64(1)
_PLACE = np.uint64((1 << 28) - 1)
RUNS = "doc_id long, text_hash long, anchor long, c1 long, c2 long, at int, low int, high int"
CONTEXTS = "anchor long, c1 long, c2 long, low int, high int, n long, context binary"
REPEATED = "c1 long, c2 long, spans array<int>"


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of every run of `gram` bytes (a power of two)."""
    h, m, step = _BYTES[data], 1, 0
    while m < gram:
        h = h[:-m] * _STEPS[step] + h[m:]
        m, step = 2 * m, step + 1
    return mix64(h)


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row: running minima of blocks, from both ends."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """first window, last window, anchor's place, anchor's hash of every run, of texts laid end to end.

    ends: the end of each text.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, np.empty(0, np.uint64)
    h = gram_hashes(data, gram)
    place = np.arange(len(h), dtype=np.uint64)
    least = (window_minima((h & ~_PLACE) | place, length - gram + 1) & _PLACE).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    fits = np.zeros(len(least) + 1, np.int64)
    long_enough = ends - starts >= length
    np.add.at(fits, starts[long_enough], 1)
    np.add.at(fits, ends[long_enough] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(fits)[:-1])
    if not len(windows):
        return none, none, none, np.empty(0, np.uint64)
    anchor = least[windows]
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(windows, prepend=-2) != 1))
    first, last, anchors = windows[new], windows[np.append(new[1:], len(windows)) - 1], anchor[new]
    return first, last, anchors, h[anchors]


def _slices(blobs: list[bytes]):
    start, total = 0, 0
    for i, b in enumerate(blobs):
        if total + len(b) > SLICE_BYTES and i > start:
            yield start, i
            start, total = i, 0
        total += len(b)
    if start < len(blobs):
        yield start, len(blobs)


def _parts(blobs: list[bytes], length: int):
    """(index of the first text, offset in it, texts) to be searched at once: several texts, or a part of a long one."""
    for a, b in _slices(blobs):
        if b > a + 1 or len(blobs[a]) < PART_BYTES + length:
            yield a, 0, blobs[a:b]
        else:
            for start in range(0, len(blobs[a]) - length + 1, PART_BYTES):
                yield a, start, [blobs[a][start : start + PART_BYTES + length - 1]]


def _find_runs(length: int, gram: int):
    def run(batches):
        for batch in batches:
            blobs = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")]
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            for a, offset, texts in _parts(blobs, length):
                joined = b"".join(texts)
                ends = np.cumsum([len(x) for x in texts])
                first, last, anchors, h = runs(np.frombuffer(joined, np.uint8), ends, length, gram)
                doc = np.searchsorted(ends, first, side="right")
                start = np.concatenate([[0], ends])[doc] - offset
                digest = b"".join(xxhash.xxh3_128_digest(joined[p : q + length], seed=c - p) for p, q, c in zip(first.tolist(), last.tolist(), anchors.tolist()))
                c12 = np.frombuffer(digest, "<i8").reshape(-1, 2)
                rows = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(rows).cast(pa.int64()),
                        hashes.take(rows),
                        pa.array(h.view(np.int64)),
                        pa.array(np.ascontiguousarray(c12[:, 0])),
                        pa.array(np.ascontiguousarray(c12[:, 1])),
                        pa.array((anchors - start).astype(np.int32)),
                        pa.array((anchors - last).astype(np.int32)),
                        pa.array((anchors - first).astype(np.int32)),
                    ],
                    ["doc_id", "text_hash", "anchor", "c1", "c2", "at", "low", "high"],
                )

    return run


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Rank of every suffix of every row (rows x places, uint64) among all suffixes of all rows, by
    Larsson-Sadakane refinement. A row's end is smaller than any symbol; equal suffixes have equal rank."""
    m, s = symbols.shape
    order = np.argsort(symbols.ravel(), kind="stable")
    flat = symbols.ravel()[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    # a group's rank is the place of its first suffix, plus one: 0 is the row's end
    rank = np.empty(m * s, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m * s), 0)) + 1
    single = new & np.append(new[1:], True)
    active, h = order[~single], 1
    place = np.arange(m * s) % s
    while len(active):
        inside = place[active] + h < s
        follow = np.where(inside, rank[np.minimum(active + h, m * s - 1)], 0)
        group = rank[active]
        order = np.lexsort((follow, group))
        active, group, follow = active[order], group[order], follow[order]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        new = first | np.concatenate([[True], follow[1:] != follow[:-1]])
        at = np.arange(len(active))
        offset = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        rank[active] = group + offset
        single = new & np.append(new[1:], True)
        # 2h symbols are compared; a suffix of fewer, its end included, is as sorted as it can be
        active = active[~single & (place[active] + 2 * h <= s)]
        h *= 2
    return rank.reshape(m, s)


def common_prefixes(symbols: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array (flat places, in order) and each suffix's common prefix with the one before it, in
    symbols, by Kasai's rule: a suffix shares at least one symbol less than the suffix one place before it."""
    m, s = symbols.shape
    flat = symbols.ravel()
    order = np.argsort(rank.ravel(), kind="stable")
    where = np.empty(m * s, np.int64)
    where[order] = np.arange(m * s)
    prefix, have, row = np.zeros(m * s, np.int64), np.zeros(m, np.int64), np.arange(m) * s
    for j in range(s):
        here = row + j
        r = where[here]
        before = order[np.maximum(r - 1, 0)]
        room = np.where(r > 0, np.minimum(s - j, s - before % s), 0)
        have = np.minimum(np.maximum(have - 1, 0), room)
        going = np.flatnonzero(have < room)
        while len(going):
            same = flat[here[going] + have[going]] == flat[before[going] + have[going]]
            going = going[same]
            have[going] += 1
            going = going[have[going] < room[going]]
        prefix[r] = have
    return order, prefix


def anchored_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows (rows x a multiple of 8), and each one's common prefix in bytes with the one before."""
    symbols = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    m, s = symbols.shape
    order, prefix = common_prefixes(symbols, suffix_ranks(symbols))
    whole = np.flatnonzero(order % s == 0)  # the suffixes that start at an anchor
    of = order[whole] // s
    # between two of them, the least of the common prefixes of all suffixes
    least = np.minimum.reduceat(prefix[: whole[-1] + 1], np.concatenate([[0], whole[:-1] + 1])) if m > 1 else np.zeros(1, np.int64)
    least[0] = 0
    bytes_ = 8 * least
    part = np.flatnonzero((least < s) & (np.arange(m) > 0))
    a, b = symbols[of[part], least[part]], symbols[of[part - 1], least[part]]
    diff = (a ^ b).astype(">u8").view(np.uint8).reshape(-1, 8)
    bytes_[part] += (diff != 0).argmax(axis=1)
    return of, bytes_


def repeated_offsets(contexts: list[bytes], low: np.ndarray, high: np.ndarray, n: np.ndarray, length: int = LENGTH) -> list[list[int]]:
    """Of each context, the spans [d, e, d, e, ...] of offsets of its windows that occur more than once in the shard."""
    m = len(contexts)
    right, left = np.zeros((m, -(-length // 8) * 8), np.uint8), np.zeros((m, max(8, -(-int(high.max()) // 8) * 8)), np.uint8)
    for i, (c, hi) in enumerate(zip(contexts, high.tolist())):
        own = np.frombuffer(c, np.uint8)
        right[i, : len(own) - hi] = own[hi:]
        left[i, :hi] = own[:hi][::-1]
    (right_order, right_prefix), (left_order, left_prefix) = anchored_order(right), anchored_order(left)
    bad = np.zeros((m, int(high.max()) + 1), bool)
    right_class, left_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= d) & (d <= high))
        if not len(own):
            continue
        right_class[right_order] = np.cumsum(right_prefix < length - d)
        left_class[left_order] = np.cumsum(left_prefix < d)
        key = right_class[own] * (m + 1) + left_class[own]
        ordered = np.sort(key)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        found = np.searchsorted(twice, key)
        hit = (found < len(twice)) & (twice[np.minimum(found, len(twice) - 1)] == key) if len(twice) else np.zeros(len(own), bool)
        bad[own, d] = hit | (n[own] > 1)
    edges = np.diff(np.pad(bad, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    return [np.stack([np.flatnonzero(e == 1), np.flatnonzero(e == -1) - 1], axis=1).ravel().tolist() for e in edges]


def _shards(length: int):
    """Spans of repeated windows, from contexts that come ordered by anchor."""

    def solve(rows):
        low, high, n = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5))
        spans = repeated_offsets([r[6] for r in rows], low, high, n, length)
        out = [(r[1], r[2], s) for r, s in zip(rows, spans) if s]
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int32()))], ["c1", "c2", "spans"])

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SHARD_BYTES and row[0] != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[6]), row[0]
        if rows:
            yield solve(rows)

    return run


def _cut_contexts(length: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column("text"), batch.column("cuts").to_pylist()):
                data = text.as_buffer()
                for c in cuts:
                    a, b = c["at"] - c["high"], c["at"] - c["low"] + length
                    out.append((c["anchor"], c["c1"], c["c2"], c["low"], c["high"], c["n"], data[a:b].to_pybytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            names = ["anchor", "c1", "c2", "low", "high", "n", "context"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return run


def _fingerprints(rows: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """Of every window of contexts (rows): the context's index, the offset, and the two halves of its fingerprint."""
    counts = np.array([r[4] - r[3] + 1 for r in rows])
    of = np.repeat(np.arange(len(rows)), counts)
    d = np.concatenate([np.arange(r[3], r[4] + 1) for r in rows])
    digest = b"".join(xxhash.xxh3_128_digest(r[6][r[4] - x : r[4] - x + length]) for r in rows for x in range(r[3], r[4] + 1))
    w = np.frombuffer(digest, "<i8").reshape(-1, 2)
    return of, d, np.ascontiguousarray(w[:, 0]), np.ascontiguousarray(w[:, 1])


def _shared_shards(length: int):
    """Of the shards of a gram that has several: the spans that repeat in the shard, and each distinct window once."""

    def solve(rows):
        low, high, n = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5))
        spans = repeated_offsets([r[6] for r in rows], low, high, n, length)
        known = [(r[1], r[2], s) for r, s in zip(rows, spans) if s]
        none = pa.nulls(len(known), pa.int64())
        yield [pa.array([k[0] for k in known], pa.int64()), pa.array([k[1] for k in known], pa.int64()), pa.array([k[2] for k in known], pa.list_(pa.int32())), none, none, pa.nulls(len(known), pa.bool_())]
        of, d, w1, w2 = _fingerprints(rows, length)
        order = np.lexsort((w2, w1))
        of, d, w1, w2 = of[order], d[order], w1[order], w2[order]
        new = np.flatnonzero(np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]))
        alone = (np.diff(np.append(new, len(w1))) == 1) & (n[of[new]] == 1)
        c1, c2 = (np.array([r[i] for r in rows], np.int64)[of[new]] for i in (1, 2))
        offsets = pa.array(np.arange(0, 2 * len(new) + 1, 2, dtype=np.int32))
        yield [pa.array(c1), pa.array(c2), pa.ListArray.from_arrays(offsets, pa.array(np.repeat(d[new], 2).astype(np.int32))), pa.array(w1[new]), pa.array(w2[new]), pa.array(alone)]

    def run(batches):
        rows, last = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = row[0], row[-1]
                if key != last and rows:
                    for columns in solve(rows):
                        yield pa.RecordBatch.from_arrays(columns, ["c1", "c2", "spans", "w1", "w2", "alone"])
                    rows = []
                rows.append(row)
                last = key
        for columns in solve(rows) if rows else ():
            yield pa.RecordBatch.from_arrays(columns, ["c1", "c2", "spans", "w1", "w2", "alone"])

    return run


def _merge_ranges(batches):
    """Of sorted windows of many shards: those alone in their shard, but in another one too. A key's rows are found by binary search."""
    held = None

    def found(rows):
        key = np.empty(rows.num_rows, [("w1", np.int64), ("w2", np.int64)])
        key["w1"], key["w2"] = rows.column("w1").to_numpy(), rows.column("w2").to_numpy()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        at = np.searchsorted(first, np.arange(len(key)), side="right") - 1
        many = np.diff(np.append(first, len(key)))[at] > 1
        return rows.filter(pa.array(many & rows.column("alone").to_numpy(zero_copy_only=False))).select(["c1", "c2", "spans"])

    for batch in batches:
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        # the last key's rows may go on in the next batch
        w1, w2 = rows.column("w1").to_numpy(), rows.column("w2").to_numpy()
        begin = int(np.searchsorted(w1, w1[-1])) if len(w1) else 0
        begin += int(np.searchsorted(w2[begin:], w2[-1])) if len(w1) else 0
        yield found(rows.slice(0, begin))
        held = rows.slice(begin)
    if held is not None:
        yield found(held)


def _merge_shards(contexts: DataFrame, length: int, shard_contexts: int) -> DataFrame:
    """c1, c2, spans of repeated windows of contexts (with k, the number of their gram's) that take several shards."""
    shard = F.pmod(F.xxhash64("c1", "c2"), F.ceil(F.col("k") / shard_contexts)).cast("int")
    names = [f.strip().split(" ")[0] for f in CONTEXTS.split(",")]
    dealt = contexts.select(*names, shard.alias("shard")).repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")
    solved = materialize(dealt.mapInArrow(_shared_shards(length), "c1 long, c2 long, spans array<int>, w1 long, w2 long, alone boolean"), "windows")
    windows = solved.where("w1 is not null").repartitionByRange("w1", "w2").sortWithinPartitions("w1", "w2")
    return solved.where("w1 is null").select("c1", "c2", "spans").unionByName(windows.mapInArrow(_merge_ranges, REPEATED))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """doc_id, text_hash, spans: the byte spans [start, end) that repeated windows cover, of the rows that have some.

    docs: doc_id, text, text_hash (xxhash64 of the text). Spans of one document are in any order and may overlap.
    """
    found = materialize(docs.mapInArrow(_find_runs(length, gram), RUNS), "runs")
    contexts_of = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("c1").alias("least"), F.max("c1").alias("most"))
    grams = contexts_of.where("n > 1").select(F.col("anchor").alias("g"), (F.col("least") == F.col("most")).alias("one"))
    # written, so that the join can split a gram of a third of all runs
    grams = materialize(grams, "grams")
    candidates = materialize(found.join(grams, F.col("anchor") == F.col("g")).drop("g"), "candidate-runs")
    release(found, grams)
    # of each context, one place to read it from and how often it occurs
    place = F.min(F.struct("doc_id", "text_hash", "at")).alias("place")
    distinct = candidates.where("not one").groupBy("anchor", "c1", "c2", "low", "high").agg(F.count("*").alias("n"), place)
    cuts = distinct.select("place.doc_id", "place.text_hash", F.struct("anchor", "c1", "c2", "low", "high", "n", "place.at").alias("cut"))
    cuts = cuts.groupBy("doc_id", "text_hash").agg(F.collect_list("cut").alias("cuts"))  # at most the runs of one document
    same = cuts["doc_id"].eqNullSafe(docs["doc_id"]) & (cuts["text_hash"] == docs["text_hash"])
    read = cuts.join(docs, same).select("cuts", "text")
    contexts = read.mapInArrow(_cut_contexts(length), CONTEXTS).dropDuplicates(["anchor", "c1", "c2"])
    contexts = materialize(contexts, "contexts")
    counted = contexts.groupBy("anchor").agg(F.count("*").alias("k"))
    large = materialize(counted.where(F.col("k") > shard_contexts).select(F.col("anchor").alias("g"), "k"), "large-grams")
    names = [f.strip().split(" ")[0] for f in CONTEXTS.split(",")]
    fit = contexts if large.isEmpty() else contexts.join(large, F.col("anchor") == F.col("g"), "left_anti")
    spans = fit.select(*names).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards(length), REPEATED)
    if not large.isEmpty():
        spans = spans.unionByName(_merge_shards(contexts.join(large, F.col("anchor") == F.col("g")), length, shard_contexts))
    spans = spans.groupBy(F.col("c1").alias("b1"), F.col("c2").alias("b2")).agg(F.flatten(F.collect_list("spans")).alias("spans"))  # at most a context's windows
    spans = materialize(spans, "repeated")
    release(contexts, large)
    many = candidates.where("not one").join(spans, (F.col("c1") == F.col("b1")) & (F.col("c2") == F.col("b2"))).select("doc_id", "text_hash", "at", "spans")
    # every run of a gram with one context repeats whole
    whole = candidates.where("one").select("doc_id", "text_hash", "at", F.array("low", "high").alias("spans"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct((F.col("at") - F.get("spans", i + 1)).alias("start"), (F.col("at") - F.get("spans", i) + length).alias("end")))
    return many.unionByName(whole).select("doc_id", "text_hash", pairs.alias("spans")).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, in order."""
    out: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def _remove(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            data, cut, at, kept = text.as_buffer().to_pybytes() if text.is_valid else b"", merged(spans), 0, []
            for a, b in cut:
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            out.append((len(data), len(data) - len(kept), cut, kept))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in o[2]] for o in out], span), pa.array([o[3] for o in out], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "removed", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (spans [start, end), merged), kept (the other bytes) of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"))
    spans = repeated_spans(rows, length, gram, shard_contexts).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "spans")
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, removed array<struct<start: long, end: long>>, kept binary"
    return joined.select("doc_id", "text", "spans").mapInArrow(_remove, schema)


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and text: what is left, a character that a cut has broken replaced."""
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each text, from all windows of all texts. For tests."""
    blobs = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in blobs:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in blobs:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes() if b else b""
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
