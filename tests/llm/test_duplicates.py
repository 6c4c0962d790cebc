"""Near-dedup, suffix-array dedup, decontamination and components against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidspark.llm import decontam, minhash, queries, suffixdedup
from braidspark.llm.common import WordHashes, shingles
from braidspark.llm.components import connected_components

WORD = re.compile(r"\w+")


def shingle_set(text):
    w = WORD.findall((text or "").lower())
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def classes_by_brute_force(rows):
    sets, parent = {d: shingle_set(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def near_copies(seed=3, n=150):
    rng = random.Random(seed)
    words = [f"wört{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.choice([1, 3, 4, 5, 6, 30, 90, 300])) for _ in range(25)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, " ".join(w).title() if i % 3 else "\n".join(w)))
    return out


@pytest.mark.parametrize("shrinking", [0.0, 0.8, 0.99])
def test_near_duplicates_match_brute_force(spark, shrinking):
    rows = [*near_copies(), (900, None), (901, ""), (902, " .!"), (903, "a b c d e f g"), (904, "a b c d e f g"), (905, "w " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).repartition(3)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, shrinking=shrinking).collect()}
    assert got == classes_by_brute_force(rows)


def copies_of_a_missing_text(n, seed=9, length=110):
    """Copies of one text that is not there, each with edits of its own, some of them shared by a few."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(length)]
    shared = [(rng.randrange(length), f"s{i}") for i in range(12)]
    out = []
    for i in range(n):
        w = list(base)
        for j in range(rng.choice([1, 1, 2, 2, 3, 4])):
            w[rng.randrange(length)] = f"e{i}x{j}"
        for at, new in rng.sample(shared, rng.choice([0, 0, 1, 3])):
            w[at] = new
        out.append((i, " ".join(w)))
    return out


def test_thousands_of_copies_around_a_missing_text(spark, monkeypatch):
    rows = copies_of_a_missing_text(1000)
    made, keep = [], minhash.materialize

    def counted(df, name):
        out = keep(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = classes_by_brute_force(rows)
    assert got == want and 20 < len(set(want.values())) < 950
    # hundreds of thousands of pairs of texts share a bucket; nearly all are ruled out before they meet
    assert 0 < dict(made)["left-pairs"] < 20_000


def test_near_duplicates_by_counts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(80):
        line = [f"l{i % 8}w{j}" for j in range(rng.choice([3, 6, 9]))]
        w = line * rng.choice([4, 5, 5, 6, 20])
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    words = WordHashes()
    sets = {d: minhash.weighted(words.of(t), 5, "count") for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            both, at, to = np.intersect1d(sets[a][0], sets[b][0], return_indices=True)
            low = np.minimum(sets[a][1][at], sets[b][1][to]).sum()
            high = sets[a][1].sum() + sets[b][1].sum() - low
            assert minhash.similarity(rows[a][1], rows[b][1], words, weight="count") == pytest.approx(low / high)
            if a < b and low >= 0.8 * high - 1e-9:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, weight="count").collect()}
    assert got == {d: find(d) for d in sets} and 8 < len(set(got.values())) < 80


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 1), (2, 1)]


def test_documents_are_told_apart_by_id_and_text(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(None, text(0)), (7, text(1)), (7, text(2)), (7, text(2)), (8, text(1) + " end"), (None, text(2) + " end"), (None, text(3)), (None, text(3) + " end"), (None, None), (5, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own_id", F.lit("clash")).withColumn("class_id", F.lit(1))
    got = minhash.document_classes(df).collect()
    assert sorted(((r.doc_id, r.class_id, r.kept) for r in got), key=str) == sorted(
        [(None, None, True), (7, 7, True), (7, 7, True), (8, 7, False), (None, 7, False), (None, None, True), (None, None, False), (None, None, True), (5, 5, True), (None, None, True)], key=str
    )
    assert minhash.document_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("weight", [False, True])
def test_signatures_estimate_weighted_similarity(weight):
    rng = np.random.default_rng(4)
    a, b = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)), np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    both = np.unique(rng.integers(0, 2**63, 700).astype(np.uint64))
    x, y = np.union1d(a, both), np.union1d(b, both)
    wx = rng.uniform(0.2, 3, len(x)) if weight else None
    wy = np.where(np.isin(y, x), wx[np.searchsorted(x, y).clip(0, len(x) - 1)] * 0.8, rng.uniform(0.2, 3, len(y))) if weight else None
    sig = [minhash.dart_minhash(e, w, 2048) for e, w in ((x, wx), (y, wy))]
    full = {}
    for name, e, w in (("x", x, wx), ("y", y, wy)):
        for i, v in enumerate(e.tolist()):
            full.setdefault(v, {})[name] = 1.0 if w is None else w[i]
    low = sum(min(v.get("x", 0), v.get("y", 0)) for v in full.values())
    high = sum(max(v.get("x", 0), v.get("y", 0)) for v in full.values())
    assert (sig[0] == sig[1]).mean() == pytest.approx(low / high, abs=0.05)


def test_signature_of_few_elements():
    assert len(set(minhash.dart_minhash(np.array([5], np.uint64)).tolist())) == minhash.K
    with pytest.raises(ValueError):
        minhash.dart_minhash(np.empty(0, np.uint64))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 50)] + [(7, 7), (3, 2), (2, 3), (None, 4), (500, 400)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 400: 400, 500: 400}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    names = dict(connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")).collect())
    assert names == {"a": "a", "b": "a", "c": "a"}


def repeats(seed=5):
    rng = random.Random(seed)
    words = [f"wort{i}" for i in range(300)]
    base = [rng.choices(words, k=rng.randint(1, 300)) for _ in range(20)]
    docs = []
    for _ in range(90):
        w, k = list(rng.choice(base)), rng.random()
        for _ in range(rng.randint(0, 3) if k > 0.3 else 0):
            w[rng.randrange(len(w))] = f"äx{rng.randrange(9)}"
        if k > 0.7:
            w = rng.choices(words, k=rng.randint(0, 60)) + w[rng.randrange(len(w)) :] + rng.choices(words, k=9)
        docs.append(" ".join(w))
    return [*docs, "a" * 1000, "ab" * 700, None, "", "x" * 399, "y" * 400, "a" * 401, "abc" * 200, docs[3], docs[3]]


@pytest.mark.parametrize("shard", [suffixdedup.SHARD_CONTEXTS, 3])
def test_suffix_dedup_matches_brute_force(spark, shard):
    docs = repeats()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("context", F.lit(1)).repartition(5)
    got = {r[0]: tuple(r[1:5]) for r in suffixdedup.digest(suffixdedup.remove_repeats(df, shard_contexts=shard)).collect()}
    assert got == dict(enumerate(suffixdedup.brute_force(docs)))


def test_suffix_dedup_edges(spark):
    schema = "doc_id long, text string"
    assert suffixdedup.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "q" + "abcdefgh" * 60), (1, "q" + "abcdefgh" * 60), (None, "z" * 500), (None, None)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0), (0, 500), (1, 481), (1, 481)]


def test_suffix_dedup_of_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "PART_BYTES", 300)
    monkeypatch.setattr(suffixdedup, "SLICE_BYTES", 300)
    docs = repeats()
    blobs = [(d or "").encode() for d in docs]
    parts = list(suffixdedup._parts(blobs, 400))
    assert any(offset for _, offset, _ in parts)
    whole = {(a, i) for a, b in enumerate(blobs) for i in range(len(b) - 399)}
    seen = [(a + k, offset + i) for a, offset, texts in parts for k, t in enumerate(texts) for i in range(len(t) - 399)]
    assert sorted(seen) == sorted(whole)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {}
    run = suffixdedup._find_runs(400, 64)
    batch = df.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash")).toArrow().combine_chunks().to_batches()[0]
    for got in run([batch]):
        for r in got.to_pylist():
            for d in range(r["low"], r["high"] + 1):
                key = (r["doc_id"], r["at"] - d)
                assert key not in found
                found[key] = r["anchor"]
    assert sorted(found) == sorted(whole)


def test_what_is_left(spark):
    df = spark.createDataFrame([(1, "é" + "x" * 450), (2, "x" * 450 + "ü"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in suffixdedup.digest(suffixdedup.remove_repeats(df)).collect()}
    assert got == {1: (450, "é"), 2: (450, "ü"), 3: (0, "")}


def test_suffix_dedup_cross_boundary_and_runs():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    ends = np.array([0, 100, 499, 900, 900, 3000, 5000])
    first, last, anchor, _ = suffixdedup.runs(data, ends, 120, 16)
    windows = [p for a, b in zip([0, *ends[:-1]], ends) for p in range(a, b - 119)]
    assert [p for a, b in zip(first, last) for p in range(a, b + 1)] == windows
    assert ((anchor >= last) & (anchor <= first + 104)).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 25), st.integers(1, 7), st.integers(1, 3), st.integers(0, 10**6))
def test_suffix_array_and_common_prefixes(m, s, letters, seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, letters + 1, (m, 8 * s)).astype(np.uint8)
    rows[m // 2 :] = rows[: m - m // 2]
    order, prefix = suffixdedup.anchored_order(rows)
    blobs = [r.tobytes() for r in rows]
    assert [blobs[i] for i in order] == sorted(blobs)
    for k in range(1, m):
        a, b = blobs[order[k - 1]], blobs[order[k]]
        assert prefix[k] == next((i for i in range(len(a)) if a[i] != b[i]), len(a))


def test_contamination_matches_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 9, 14, 40, 59, 200])))) for i in range(60)]
    docs = []
    for i in range(200):
        body = rng.choices(words, k=rng.choice([0, 5, 60, 900, 6000]))
        for _ in range(rng.choice([0, 1, 2])):
            own = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = "x"
            at = rng.randrange(len(body) + 1)
            body[at:at] = own
        docs.append((i, " ".join(body).upper()))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1])]
    items += [(70, None), (71, "..."), (5, items[5][1])]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(-1)), spark.createDataFrame(items, "item_id long, text string"))
    sets = {(i, t): shingle_set(t) for i, t in items}
    expected = sorted((d, i, len(s & shingle_set(t)), len(s)) for d, t in docs for (i, _), s in sets.items() if s and len(s & shingle_set(t)) >= 0.8 * len(s) - 1e-9)
    assert sorted(tuple(r)[:4] for r in got.collect()) == expected and len(expected) > 50


def test_contamination_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h"), (None, "a b c d e f g h"), (1, None), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c d e f"), (3, "c d e f g h"), (4, None)], "item_id long, text string")
    got = sorted((tuple(r)[:4] for r in decontam.contaminated(docs, items).collect()), key=str)
    assert got == sorted([(None, None, 2, 2)] * 2 + [(None, 3, 2, 2)] * 2, key=str)


def test_contamination_in_chunks_and_empty(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "q r s t u v")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{x} r s t u v") for i, x in enumerate("qab")] + [(9, "a b c d e f")], "item_id long, text string")
    monkeypatch.setattr(decontam, "CHUNK_ITEMS", 1)
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()) == [(1, 9), (2, 0)]
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.contaminated(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("n_words", [5, 6, 8])
def test_short_items_are_always_met(n_words):
    rng = random.Random(n_words)
    index = decontam.build_index([(i, " ".join(f"i{i}w{j}" for j in range(n_words))) for i in range(4000)])
    words, grams = WordHashes(), []
    for i in range(4000):
        text = [f"d{rng.random()}" for _ in range(80)]
        at = rng.randrange(80)
        grams.append(shingles(words.of(" ".join(text[:at] + [f"i{i}w{j}" for j in range(n_words)] + text[at:])), 5))
    assert decontam.candidates(index, grams) >= {(i, i) for i in range(4000)}


def test_shingles_of_short_texts():
    w = WordHashes()
    assert len(shingles(w.of("one two"))) == 1 and len(shingles(w.of(""))) == 0 and len(shingles(w.of(None))) == 0
    assert len(shingles(w.of("a b c d e f"))) == 2


def test_query_on_driver_data(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.class_id, r.kept) for r in queries.op5_minhash_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (c, c == d) for d, c in classes_by_brute_force([tuple(r) for r in rows]).items()}
