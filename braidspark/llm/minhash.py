"""Near-duplicate detection with DartMinHash signatures.

A text is a set of word shingles with weights. Darts are thrown at the plane of weight x rank above every
element: each unit cell holds a Poisson(1) number of them, all drawn from hashes of (element, cell,
dart), so that two texts see the same darts at the same element. A dart counts in a text if it
falls below the element's weight there; each dart has one of `K` coordinates, and a coordinate keeps its
dart of lowest rank. Two texts agree in a coordinate with a probability of their weighted Jaccard similarity.
Ranks up to (K ln K + 2K) / total weight almost always fill all coordinates, so a text costs about
one dart an element plus K ln K, not K hashes an element; the rank limit doubles until all are filled.

The near-duplicate operator:

1. Texts with equal words collapse to the smallest doc_id (an aggregation, combined map-side).
2. The others' signatures are cut in BANDS bands of ROWS; texts that agree in a band are in one bucket.
3. In every bucket all members are compared with its pivot, the one that meets most others over all its buckets (in
   buckets of up to SMALL, each with each); pairs are made distinct over all bands and verified exactly on their shingles
   (Jaccard similarity of the sets, or of counts, >= 0.8).
4. Verified pairs are edges of connected components. Buckets with members outside their pivot's component get a further
   pivot from among those, round by round, while that shrinks what is left; later rounds join components alone.
5. What is left is compared by an exact similarity join on what texts have otherwise than their pivot (`_left_pairs`):
   no pair of a bucket that could be similar enough stays uncompared, and no pair is made only since a bucket holds both.

Edge cases: null texts and texts without words have no duplicates; a text of one to four words is one
shingle. `document_classes` takes every distinct (doc_id, text) as a document, null doc_id included. `near_duplicates` itself takes
doc_id as a key: rows with equal doc_id are one document, for which one of their texts stands, and rows with null doc_id are
left out. Texts are equal if their words are, by a 128-bit hash; ties in rank are broken by the dart's hash; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidspark.llm.common import SHINGLE_WORDS, SIMILARITY, WordHashes, lean, materialize, mix64, release, shingles, slices, small_batches
from braidspark.llm.components import connected_components

BANDS, ROWS = 24, 5
K = BANDS * ROWS
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))
_COORD, _RANK, _HEIGHT, _CELL, _DART = (mix64(np.array([i], np.uint64))[0] | np.uint64(1) for i in range(11, 16))
#: Buckets of so many members have all their pairs compared at once.
SMALL = 8
SLICE_CHARS = 1 << 19
SIGNED = "doc_id long, text_hash long, key string, bands array<long>"


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_minhash_many(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = K) -> np.ndarray:
    """Signatures (sets x k, uint64) of sets of distinct elements (uint64, ascending), all thrown at once.

    weights: of each set's elements (default: 1 each). An empty set is an error.
    """
    counts = np.array([len(x) for x in sets])
    if not counts.all():
        raise ValueError("an empty set has no signature")
    elements = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    weight = np.ones(len(elements)) if weights is None else np.concatenate(weights)
    owner = np.repeat(np.arange(len(sets)), counts)
    total = np.bincount(owner, weight, len(sets))
    # the unit cells of weight above each element
    tall = np.ceil(weight).astype(np.int64)
    of = np.repeat(np.arange(len(elements)), tall)
    height = np.arange(len(of)) - np.repeat(np.cumsum(tall) - tall, tall)
    column, owner = mix64(elements[of] + height.astype(np.uint64) * _CELL), owner[of]
    room = weight[of] - height  # below 1: the part of the cell that is in the region
    sig = np.zeros((len(sets), k), np.uint64)
    done, limit = np.zeros(len(sets)), (k * np.log(k) + 2 * k) / np.maximum(total, 1e-12)
    best = np.full((len(sets), k), np.inf)
    pending = np.arange(len(owner))
    while len(pending):
        first, last = np.floor(done[owner[pending]]).astype(np.int64), np.ceil(limit[owner[pending]]).astype(np.int64)
        cells = last - first
        at = np.repeat(pending, cells)
        cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells) + np.repeat(first, cells)
        seeds = mix64(column[at] + (cell + 1).astype(np.uint64) * _DART)
        n = np.searchsorted(_POISSON, _unit(seeds))
        which = np.repeat(np.arange(len(at)), n)
        number = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix64(seeds[which] + (number + 1).astype(np.uint64) * _CELL)
        at, rank = at[which], cell[which] + _unit(mix64(dart ^ _RANK))
        hit = (rank < limit[owner[at]]) & (rank >= done[owner[at]])
        if weights is not None:
            hit &= _unit(mix64(dart ^ _HEIGHT)) < room[at]
        dart, rank, at = dart[hit], rank[hit], at[hit]
        slot = owner[at] * k + ((mix64(dart ^ _COORD) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((rank, slot))
        slot, rank, dart = slot[order], rank[order], dart[order]
        lead = np.flatnonzero(np.diff(slot, prepend=-1))
        free = np.isinf(best.ravel()[slot[lead]])  # lower ranks came before
        lead = lead[free]
        best.ravel()[slot[lead]], sig.ravel()[slot[lead]] = rank[lead], dart[lead]
        short = np.isinf(best).any(axis=1)
        done, limit = np.where(short, limit, done), np.where(short, 2 * limit, limit)
        pending = pending[short[owner[pending]]]
    return sig


def dart_minhash(elements: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """Signature of one set."""
    return dart_minhash_many([elements], None if weights is None else [weights], k)[0]


def _bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Band hashes (sets x bands) of signatures."""
    bands = sig.shape[1] // rows
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _CELL, (len(sig), bands))
    for r in range(rows):
        acc = mix64(acc ^ sig[:, r::rows][:, :bands]) + _DART
    return acc.view(np.int64)


def weighted(words: np.ndarray, k: int, weight: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Distinct shingles in order, and their weights: none for ``unit``, their counts for ``count``."""
    if weight == "unit":
        return np.unique(shingles(words, k)), None
    elements, counts = np.unique(shingles(words, k), return_counts=True)
    return elements, counts.astype(np.float64)


def elements_of(words: np.ndarray, k: int, weight: str) -> np.ndarray:
    """A text as a sorted set. With counts, the i-th time that a shingle occurs is an element of its own: the similarity of
    such sets is that of the counts, the sum of the lesser over the sum of the greater."""
    if weight == "unit":
        return np.unique(shingles(words, k))
    own, counts = np.unique(shingles(words, k), return_counts=True)
    turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(mix64(np.repeat(own, counts) + turn.astype(np.uint64) * _DART))


def _sign(k: int, weight: str):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows, keys, bands = [], [], [np.empty((0, BANDS), np.int64)]
            for a, b in slices(texts, SLICE_CHARS):
                sets, weights = [], []
                for i in range(a, b):
                    words = hashes.of(texts[i])
                    if len(words):
                        rows.append(i)
                        keys.append(xxhash.xxh3_128_hexdigest(words.tobytes()))
                        own, counts = weighted(words, k, weight)
                        sets.append(own)
                        weights.append(counts)
                if sets:
                    bands.append(_bands(dart_minhash_many(sets, None if weight == "unit" else weights)))
            at, flat = pa.array(rows, pa.int64()), np.concatenate(bands).ravel()
            offsets = np.arange(0, BANDS * (len(rows) + 1), BANDS, dtype=np.int32)
            columns = [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(keys, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "key", "bands"])

    return run


def _alike(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def similarity(a: str, b: str, words: WordHashes, k: int = SHINGLE_WORDS, weight: str = "unit") -> float:
    """Jaccard similarity of the texts' shingle sets, or of their counts."""
    return _alike(elements_of(words.of(a), k, weight), elements_of(words.of(b), k, weight))


class _Sets(dict):
    """Document -> its set; pairs come ordered by one side, so that few texts are read twice."""

    LIMIT = 4_000_000

    def __init__(self, k: int, weight: str):
        super().__init__()
        self.k, self.weight, self.words, self.held = k, weight, WordHashes(), 0

    def of(self, doc: int, text) -> np.ndarray:
        if doc not in self:
            self[doc] = own = elements_of(self.words.of(text.as_py()), self.k, self.weight)
            self.held += len(own)
            if self.held > self.LIMIT:
                self.clear()
                self[doc], self.held = own, len(own)
        return self[doc]


def _verify(k: int, weight: str, threshold: float):
    def run(batches):
        sets = _Sets(k, weight)
        for batch in batches:
            left, right = batch.column("src_text"), batch.column("dst_text")
            pairs = zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist())
            good = pa.array([i for i, (a, b) in enumerate(pairs) if _alike(sets.of(b, right[i]), sets.of(a, left[i])) >= threshold - 1e-9], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("src").take(good), batch.column("dst").take(good)], ["src", "dst"])

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    first = texts.select(F.col("rep").alias("src"), F.col("text").alias("src_text"))
    second = texts.select(F.col("rep").alias("dst"), F.col("text").alias("dst_text"))
    return pairs.join(first, "src").join(second, "dst").select("src", "dst", "src_text", "dst_text")


def _links(pairs: DataFrame, texts: DataFrame, k: int, weight: str, threshold: float) -> DataFrame:
    """Pairs (src, dst) that are similar enough by their texts."""
    return _with_texts(pairs, texts).mapInArrow(lean(_verify(k, weight, threshold)), "src long, dst long")


def _differences(k: int, weight: str):
    """Of every pair (a text, its pivot): the text's size and the elements that only one of the two has."""

    def run(batches):
        sets = _Sets(k, weight)
        for batch in batches:
            left, right = batch.column("src_text"), batch.column("dst_text")
            for i, (doc, pivot) in enumerate(zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist())):
                own = sets.of(doc, left[i])
                apart = np.setxor1d(own, sets.of(pivot, right[i]), assume_unique=True).view(np.int64)
                columns = [np.full(len(apart), pivot, np.int64), np.full(len(apart), doc, np.int64), np.full(len(apart), len(own), np.int64), apart]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pivot", "rep", "size", "element"])

    return run


def _left_pairs(left: DataFrame, texts: DataFrame, k: int, weight: str, threshold: float) -> DataFrame:
    """Pairs (src, dst), written, of members of one bucket, but of different components, that may be similar enough.

    left: pivot (the bucket's first), rep, component, main (the pivot's component); every rep was compared with the pivot. An exact
    similarity join on what texts have otherwise than their pivot: with D(x) the elements that only one of x and the pivot
    has, x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| elements, and they are similar enough only if these are at most
    (|x| + |y|) (1 - threshold) / (1 + threshold). So D(x) and D(y) share at least (u(x) + u(y)) / 2 elements, where
    u(x) = |D(x)| - |x| (1 - threshold) / (1 + threshold). That is above 0, since one of the two is not linked to the pivot.

    * An element that texts of one component alone have counts for no pair; a text with too few others drops out.
    * Of the rest a text shows its rarest elements alone, as many as must hold a shared one (prefix filter), and two
      texts meet where they show the same element, one of them from outside the pivot's component.

    What copies have in common with the pivot, however many they are, is in no D; edits that no two of them share drop out.
    """
    gamma = (1 - threshold) / (1 + threshold)
    left = left.select(F.col("pivot").alias("p"), F.col("rep").alias("r"), "component", (F.col("component") != F.col("main")).alias("outside"))
    pairs = left.select(F.col("r").alias("src"), F.col("p").alias("dst")).distinct()
    apart = materialize(_with_texts(pairs, texts).mapInArrow(lean(_differences(k, weight)), "pivot long, rep long, size long, element long"), "differences")
    grams = apart.join(left.distinct(), (F.col("pivot") == F.col("p")) & (F.col("rep") == F.col("r"))).drop("p", "r")
    spread = grams.groupBy("pivot", "element").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high"))
    spread = spread.where("low != high").select(F.col("pivot").alias("sp"), F.col("element").alias("se"), "df")
    counted = materialize(grams.join(spread, (F.col("pivot") == F.col("sp")) & (F.col("element") == F.col("se")), "left").drop("sp", "se"), "differences")
    docs = counted.groupBy("pivot", "rep").agg(F.first("component").alias("component"), F.first("outside").alias("outside"), F.first("size").alias("size"), F.count("*").alias("d"), F.count("df").alias("s"))
    old_docs = docs = materialize(docs.withColumn("u", F.col("d") - gamma * F.col("size")), "differing")
    for _ in range(3):  # every turn may raise the least that partners have, and so rule out more
        least = docs.groupBy("pivot").agg(F.min("u").alias("any"), F.min(F.when(F.col("outside"), F.col("u"))).alias("out")).select(F.col("pivot").alias("lp"), "any", "out")
        docs = docs.drop("need").join(least, F.col("pivot") == F.col("lp")).withColumn("need", F.ceil((F.col("u") + F.when(F.col("outside"), F.col("any")).otherwise(F.col("out"))) / 2 - 1e-9))
        old, docs = old_docs, materialize(docs.where(F.col("s") >= F.col("need")).drop("lp", "any", "out"), "differing")
        release(old)
        old_docs = docs
    by_text = Window.partitionBy("pivot", "rep").orderBy("df", "element")
    shown = counted.where("df is not null").join(docs.select(F.col("pivot").alias("dp"), F.col("rep").alias("dr"), "d", "s", "u", "need"), (F.col("pivot") == F.col("dp")) & (F.col("rep") == F.col("dr"))).drop("dp", "dr")
    # elements that count for no pair are the rarest of all
    shown = shown.withColumn("place", F.row_number().over(by_text) + F.col("d") - F.col("s")).where(F.col("place") <= F.col("d") - F.col("need") + 1)
    shown = materialize(shown.select("pivot", "element", "rep", "component", "outside", "d", "s", "u", "place"), "shown")
    names = ["element", "rep", "component", "outside", "d", "s", "u", "place"]
    other = shown.where("outside").select(F.col("pivot").alias("op"), *[F.col(c).alias(f"o_{c}") for c in names])
    # two texts from outside meet once; behind the first element that two texts share there must be room for the rest
    once = ~F.col("outside") | (F.col("rep") > F.col("o_rep"))
    room = F.least("s", "o_s", F.col("d") - F.col("place") + 1, F.col("o_d") - F.col("o_place") + 1) >= (F.col("u") + F.col("o_u")) / 2 - 1e-9
    meet = (F.col("pivot") == F.col("op")) & (F.col("element") == F.col("o_element")) & (F.col("component") != F.col("o_component")) & once & room
    out = materialize(shown.join(other, meet).select(F.greatest("rep", "o_rep").alias("src"), F.least("rep", "o_rep").alias("dst")).distinct(), "left-pairs")
    release(apart, counted, docs, shown)
    return out


def _relabelled(components: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component after further links: only the components that these join are worked on."""
    if components is None:
        return connected_components(links)
    first, second = (components.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("n1", "c1"), ("n2", "c2")))
    ends = links.join(first, F.col("src") == F.col("n1"), "left").join(second, F.col("dst") == F.col("n2"), "left")
    found = connected_components(ends.select(F.coalesce("c1", "src").alias("src"), F.coalesce("c2", "dst").alias("dst")))
    joined = found.select(F.col("node").alias("j"), F.col("component").alias("to"))
    old = components.join(joined, F.col("component") == F.col("j"), "left").select("node", F.coalesce("to", "component").alias("component"))
    new = joined.join(components, F.col("j") == F.col("node"), "left_anti").select(F.col("j").alias("node"), F.col("to").alias("component"))
    out = materialize(old.unionByName(new), "classes")
    release(found, components)
    return out


def _placed(members: DataFrame, components: DataFrame) -> DataFrame:
    """members (bucket, rep, met, first) with their component and that of the bucket's first pivot, of the buckets in which some
    member is in another one than the pivot."""
    of = components.select("node", F.col("component").alias("of"))
    out = members.join(of, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("of", "rep")).drop("node", "of")
    out = out.join(of, F.col("first") == F.col("node"), "left").withColumn("main", F.coalesce("of", "first")).drop("node", "of")
    open_ = out.where("component != main").select(F.col("bucket").alias("b")).distinct()
    return materialize(out.join(open_, F.col("bucket") == F.col("b"), "left_semi"), "open")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, threshold: float = SIMILARITY, weight: str = "unit", shrinking: float = 0.8) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), one row for each doc_id of (doc_id, text).

    shrinking: while a round of further pivots leaves at most this share of the texts that were in no pivot's component, there
    is another round; then `_left_pairs` compares what is left.
    """
    if weight not in ("unit", "count"):
        raise ValueError(f"weight is unit or count, not {weight!r}")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).where(F.col("doc_id").isNotNull())
    signed = materialize(rows.mapInArrow(lean(_sign(k, weight)), SIGNED), "signatures")
    # equal words, one representative; of rows with one doc_id, the one with the smallest key stands for it
    key_of = signed.groupBy("doc_id").agg(F.min(F.struct("key", "text_hash")).alias("m")).select("doc_id", "m.key", "m.text_hash")
    # written, so that the join can split the many copies of one text
    reps = materialize(key_of.groupBy("key").agg(F.min("doc_id").alias("rep")), "representatives")
    membership = materialize(key_of.join(reps, "key").select("doc_id", "text_hash", "rep"), "membership")
    release(reps)
    chosen = membership.where(F.col("doc_id") == F.col("rep")).select("rep", F.col("text_hash").alias("h"))
    is_chosen = (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("h"))
    own = signed.join(chosen, is_chosen).select("rep", "bands").dropDuplicates(["rep"])
    buckets = own.select("rep", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("b"), "n")
    shared = materialize(buckets.join(sizes, F.col("bucket") == F.col("b")).drop("b"), "buckets")
    release(signed)
    # how many others a text meets: a group's centre meets the most, copies of it meet each other less often
    met = shared.groupBy(F.col("rep").alias("r")).agg(F.sum("n").alias("met"))
    every = materialize(shared.join(met, F.col("rep") == F.col("r")).select("bucket", "rep", "met", (F.col("n") <= SMALL).alias("small")), "buckets")
    release(shared)
    wanted = chosen.join(every.select(F.col("rep").alias("r")), F.col("rep") == F.col("r"), "left_semi")
    texts = materialize(rows.join(wanted, is_chosen).select("rep", "text").dropDuplicates(["rep"]), "candidate-texts")

    most_met = F.max(F.struct("met", (-F.col("rep")).alias("least"), "rep"))
    pivots = every.groupBy("bucket").agg(most_met.alias("m")).select(F.col("bucket").alias("b"), F.col("m.rep").alias("first"))
    members = materialize(every.join(pivots, F.col("bucket") == F.col("b")).where(F.col("rep") != F.col("first")).drop("b"), "members")
    release(every)
    pairs = members.select(F.greatest("rep", "first").alias("src"), F.least("rep", "first").alias("dst"))
    other = members.where("small").select(F.col("bucket").alias("b"), F.col("rep").alias("dst"))
    each = members.where("small").join(other, (F.col("bucket") == F.col("b")) & (F.col("rep") > F.col("dst")))
    pairs = pairs.unionByName(each.select(F.col("rep").alias("src"), "dst"))
    pairs = materialize(pairs.distinct(), "pairs")
    found = materialize(_links(pairs, texts, k, weight, threshold), "links")
    release(pairs)
    components = _relabelled(None, found)
    open_ = _placed(members.where("not small").select("bucket", "rep", "met", "first"), components)
    release(members, found)
    outside = lambda: open_.where("component != main").select("rep").distinct().count()
    now, before = outside(), None
    while now and (before is None or now <= shrinking * before):
        # the next pivot: the one that meets most others among those outside the component of the first
        next_ = open_.where("component != main").groupBy("bucket").agg(most_met.alias("m")).select(F.col("bucket").alias("b"), F.col("m.rep").alias("pivot"))
        met_next = open_.join(next_, F.col("bucket") == F.col("b")).drop("b")
        own = met_next.where(F.col("rep") == F.col("pivot")).select(F.col("bucket").alias("b"), F.col("component").alias("pc"))
        met_next = materialize(met_next.join(own, F.col("bucket") == F.col("b")).drop("b").where(F.col("rep") != F.col("pivot")), "open")
        pairs = met_next.where("component != pc").select(F.greatest("rep", "pivot").alias("src"), F.least("rep", "pivot").alias("dst")).distinct()
        found = materialize(_links(pairs, texts, k, weight, threshold), "links")
        if not found.isEmpty():
            components = _relabelled(components, found)
        release(open_, found)
        open_ = _placed(met_next.select("bucket", "rep", "met", "first"), components)
        release(met_next)
        before, now = now, outside()
    if now:
        pairs = _left_pairs(open_.select(F.col("first").alias("pivot"), "rep", "component", "main"), texts, k, weight, threshold)
        found = materialize(_links(pairs, texts, k, weight, threshold), "links")
        if not found.isEmpty():
            components = _relabelled(components, found)
        release(pairs, found)
    release(open_, texts)
    classes = membership.join(components, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    wordless = rows.select("doc_id").distinct().join(membership.select(F.col("doc_id").alias("d")), F.col("doc_id") == F.col("d"), "left_anti")
    return classes.unionByName(wordless.withColumn("class_id", F.col("doc_id")))


def with_own_id(docs: DataFrame) -> DataFrame:
    """Adds own_id: one 64-bit hash for each distinct (doc_id, text), nulls included. doc_id alone may be null or repeat.

    Two different ones of n documents share a hash with odds of n^2 / 2^65.
    """
    return docs.withColumn("own_id", F.xxhash64("doc_id", F.col("doc_id").isNull(), F.col("text").isNull(), "text"))


def document_classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, own_id, class_id, kept of every distinct (doc_id, text): near_duplicates' classes, whatever doc_id is.

    class_id: the smallest doc_id of the class, null if it has none. kept: true for one document of each class, the one of
    that doc_id (of several, the one with the smallest own_id). Columns but doc_id and text are ignored.
    """
    keyed = with_own_id(docs.select(F.col("doc_id").cast("long"), "text"))
    names = keyed.select("own_id", "doc_id").distinct()
    classes = near_duplicates(keyed.select(F.col("own_id").alias("doc_id"), "text"), **how)
    named = materialize(classes.select(F.col("doc_id").alias("classed"), F.col("class_id").alias("own_class")).join(names, F.col("classed") == F.col("own_id")).drop("classed"), "named")
    first = named.groupBy(F.col("own_class").alias("c")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "own_id")).alias("m"))
    # written, so that the join can split a class of a third of all documents
    first = materialize(first.select("c", F.col("m.doc_id").alias("class_id"), F.col("m.own_id").alias("first")), "first-of-class")
    return named.join(first, F.col("own_class") == F.col("c")).select("doc_id", "own_id", "class_id", (F.col("own_id") == F.col("first")).alias("kept"))
