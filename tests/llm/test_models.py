"""Language ID, quality classifier: held-out accuracy and edge cases."""

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidspark.llm import langid, quality, queries
from braidspark.llm.common import held_out

DATA = "/root/testdata/sf0.01"


def test_language_id_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op4_language_id(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()
    assert len(rows) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert all(rows[d.doc_id].held_out for d in held) and sum(r.held_out for r in rows.values()) == len(held)
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows.values())


EDGES = [(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (4, "the cat and the dog", "en"), (5, "der Hund und die Katze", "de"), (6, "der " * 20000, None), (7, "the cat and the dog", "en"), (None, "die Katze", "de")]
#: Numbers, marks and signs that are no letters, however much they look like some.
NO_LETTERS = ["½", "²³", "Ⅷ ①", "٣", "__", "\u0301", "½ x".replace("x", "¾"), "\U0001f600"]


def test_language_id_edges(spark):
    rows = EDGES + [(100 + i, t, None) for i, t in enumerate(NO_LETTERS)] + [(200, "½ ª", None), (201, "ʰ", None), (202, "漢", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(df)
    assert model.langs == ("de", "en")
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(df, model, ["doc_id"]).collect()}
    plain = {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, "de"), (7, "en"), (None, "de")}
    assert {g for g in got if g[0] is None or g[0] < 100} == plain
    assert all(pred == "und" for d, pred in got if d and 100 <= d < 200) and all(pred != "und" for d, pred in got if d and d >= 200)


def test_letters_are_unicode_letters():
    for c in range(0x30000):
        if not 0xD800 <= c < 0xE000:
            assert langid.has_letter(chr(c)) == unicodedata.category(chr(c)).startswith("L"), hex(c)


def naive_bayes_by_hand(rows):
    """doc_id -> language by a plain multinomial naive Bayes, counted gram by gram in Python."""

    def grams(text):
        kept = [c if "a" <= c <= "z" or ord(c) >= 170 else " " for c in f" {text.lower()} "]
        for n in langid.ORDERS:
            for i in range(len(kept) - n + 1):
                acc = n
                for c in kept[i : i + n]:
                    acc = (acc ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
                    acc ^= acc >> 15
                yield acc % langid.BUCKETS

    counts, texts = {}, Counter()
    for doc, text, lang in rows:
        if doc is not None and zlib.crc32(str(doc).encode()) % 5 != 0 and text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
            texts[lang] += 1
    total = {lang: sum(c.values()) + 0.5 * langid.BUCKETS for lang, c in counts.items()}
    out = {}
    for doc, text, _ in rows:
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            out[doc] = "und"
            continue
        own = Counter(grams(text))
        scores = {lang: np.log(texts[lang] / sum(texts.values())) + sum(n * np.log((c[g] + 0.5) / total[lang]) for g, n in own.items()) for lang, c in counts.items()}
        out[doc] = max(sorted(scores), key=scores.get)
    return out


def test_language_id_query_matches_naive_bayes_by_hand(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()[:60]
    # a row without a doc_id has no remainder: it is not learned from, and it would teach a language of its own
    rows = [tuple(r) for r in docs] + [(None, docs[0].text, "xx"), (10**6 + 1, "½", None), (10**6 + 3, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op4_language_id(spark, str(tmp_path)).collect()}
    assert {d: r.lang_pred for d, r in got.items()} == naive_bayes_by_hand(rows)
    assert not got[None].held_out and got[None].lang_pred != "xx"


def test_language_id_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(none)
    assert langid.predict(none, model, ["doc_id"]).count() == 0
    some = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.predict(some, model, ["doc_id"]).collect()] == [(1, "und", 0.0)]


def test_naive_bayes_matches_brute_force():
    texts = ["abba ab", "ba", "x" * 500]
    rng = np.random.default_rng(0)
    table = np.log(rng.dirichlet(np.ones(langid.BUCKETS), 3).T)
    model = langid.LanguageModel(("a", "b", "c"), np.log([0.2, 0.3, 0.5]), table)
    best, sure = langid.score_texts(model, texts)
    for i, t in enumerate(texts):
        _, buckets = langid.hashed_grams([t])
        total = table[buckets].sum(axis=0) * min(1, langid.FULL_GRAMS / len(buckets)) + model.log_prior
        p = np.exp(total - total.max())
        p /= p.sum()
        assert best[i] == p.argmax() and sure[i] == pytest.approx(p.max())


def test_prior_does_not_outweigh_a_long_text():
    rng = np.random.default_rng(1)
    common = np.log(rng.dirichlet(np.full(langid.BUCKETS, 50.0)))
    model = langid.LanguageModel(("common", "rare"), np.log([0.97, 0.03]), np.stack([common, common + 0.05], axis=1))
    best, sure = langid.score_texts(model, ["abcd " * 500, "ab"])
    # 0.05 nats for each of 60 n-grams is 3.0, the priors are 3.5 apart; the whole text has over 200
    assert best.tolist() == [1, 0] and sure[0] == pytest.approx(1 / (1 + np.exp(-3.0))) and sure[1] > 0.9


def test_quality_counts_equal_rows_as_often_as_they_occur(spark):
    rows = [(1, "the good cat sat on a mat")] * 30 + [(i, f"buy {i} !!! now") for i in range(2, 12)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = quality.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels)
    x = quality.features_of([t for _, t in rows]).astype(float)
    plain = [i for i in range(quality.FEATURES) if got.scale[i] != 1.0]
    assert plain and got.mean[plain] == pytest.approx(x.mean(axis=0)[plain], abs=1e-5)
    features = quality.extract(spark.createDataFrame(rows + [(1, "another")], "doc_id long, text string").repartition(3), ["doc_id"])
    positive, counts = quality._positives(features, labels, 1000)
    assert sorted(counts.tolist()) == [1, 30] and len(positive) == 2


def test_quality_query_learns_from_its_folds_alone(spark, tmp_path):
    rows = [(i, f"Some plain words {i} here. And more of them." if i % 2 else "$$$ AAA!! ### $$$ " * 9) for i in range(60)] + [(None, "null id $$$")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2) for i in range(60)]
    seen = []
    for flip in (False, True):
        # labels of held-out rows must not matter, nor any label but 1
        own = [(d, 1 - q if flip and zlib.crc32(str(d).encode()) % 5 == 0 else q) for d, q in labels if not flip or q == 1 or zlib.crc32(str(d).encode()) % 5 == 0]
        spark.createDataFrame(own, "doc_id long, quality int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, str(tmp_path)).collect()}
        seen.append({d: r.score for d, r in got.items()})
        assert len(got) == 61 and not got[None].held_out
    assert seen[0] == pytest.approx(seen[1])


def test_runs_of_a_slice_are_those_of_each_text():
    texts = ["Hello World. ab", "", "a", "ab cd", "x" * 50, "ÄÖ ü 12 漢", "$$ a1 b2"]
    both = quality.run_shares(texts)
    assert all((both[i] == quality.run_shares([t])[0]).all() for i, t in enumerate(texts))


def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [r for r in labels if got[r.doc_id].held_out]
    assert len(held) > 50
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, f"Some plain words {i} here. And more of them." if i % 2 else "$$$ AAA!! ### $$$ " * 9) for i in range(40)] + [(99, None), (98, ""), (97, "w " * 50000), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(30)] + [(99, None), (1, 1)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert len(got) == 44 and all(0 <= r.score <= 1 for r in got.values())
    assert got[39].predicted == 1 and got[38].score < got[39].score
    only_positive = quality.train(docs, labels.where("quality = 1"))
    assert only_positive.prior < 1
    none = quality.train(docs.limit(0), labels)
    assert {r.score for r in quality.score(docs, none, ["doc_id"]).collect()} == {0.5}
    assert quality.score(docs.limit(0), model, ["doc_id"]).count() == 0


def two_classes(rng, n_p=500, n_u=(400, 600)):
    one = lambda n: np.column_stack([rng.normal([2, 0], 1, (n, 2)), np.ones(n)])
    zero = lambda n: np.column_stack([rng.normal([-2, 0], 1, (n, 2)), np.ones(n)])
    return one, zero, one(n_p), np.concatenate([one(n_u[0]), zero(n_u[1])])


def risk_on(u):
    return lambda w: (np.logaddexp(0, u @ w).mean(), u.T @ (1 / (1 + np.exp(-(u @ w)))) / len(u))


def test_non_negative_risk_separates_positives():
    one, zero, p, u = two_classes(np.random.default_rng(1))
    w = quality.fit_nnpu(p, risk_on(u), 0.4)
    assert (one(500) @ w > 0).mean() > 0.93 and (zero(500) @ w < 0).mean() > 0.93
    plain = quality.fit_plain(p[::2], risk_on(u), np.ones(250))
    prior = quality.estimate_prior(p[1::2] @ plain, np.ones(250), lambda cuts: (u @ plain >= cuts[:, None]).mean(axis=1))
    assert prior == pytest.approx(0.4, abs=0.08)


@pytest.mark.parametrize("prior", [0.4, 0.9])
def test_the_non_negative_risk_is_at_its_minimum(prior):
    """Against a search over a grid: 0.9 is too much, so that the bracket would fall below zero."""
    _, _, p, u = two_classes(np.random.default_rng(2), 150, (60, 90))

    def risk(w):
        good, bad, un = np.logaddexp(0, -p @ w).mean(axis=0), np.logaddexp(0, p @ w).mean(axis=0), np.logaddexp(0, u @ w).mean(axis=0)
        return prior * good + np.maximum(0, un - prior * bad) + 0.5 * 1e-3 * (w**2).sum(axis=0)

    grid = np.stack(np.meshgrid(np.linspace(-1, 6, 71), np.linspace(-1, 1, 11), np.linspace(-5, 12, 86)), axis=0).reshape(3, -1)
    w = quality.fit_nnpu(p, risk_on(u), prior)
    assert risk(w[:, None])[0] <= risk(grid).min() + 0.01


def test_unlabelled_risk_is_that_of_all_rows(spark, monkeypatch):
    rows = [(i, f"Some plain words {i} here." if i % 2 else f"$$$ AAA!! {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    features = quality.extract(df, ["doc_id"])
    x = quality.features_of([t for _, t in rows]).astype(float)
    sums = quality._sums(features, quality.FEATURES + 1, lambda m: np.append(m.sum(axis=0), len(m)))
    assert sums == pytest.approx(np.append(x.sum(axis=0), 200), abs=1e-2)


def test_held_out_of_null_keys(spark):
    df = spark.createDataFrame([(None,), (0,), (3,)], "k long")
    assert [r[0] for r in df.select(held_out(F.col("k"))).collect()] == [False, zlib.crc32(b"0") % 5 == 0, zlib.crc32(b"3") % 5 == 0]
