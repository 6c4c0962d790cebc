"""Mixing, URL filters, chat formatting, top-k search, token store and the pipeline."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from braidspark.llm import chat, mixing, queries, tokenstore, topk, urlfilter
from braidspark.llm.common import materialize, scratch_path

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_by_steps():
    sizes = {"a": 100, "b": 5, None: 40, "c": 300}
    got = mixing.source_targets(sizes)
    # 667.5 words to a, b, c, null at 3, 1, 2, 3: b and null stop, then a
    assert got["b"] == 10 and got[None] == 80 and got["a"] == 200
    assert sum(got.values()) == Fraction(3, 2) * 445 and got["c"] == Fraction(3, 2) * 445 - 290
    assert mixing.source_targets({}) == {}


def documents(n=300, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 7, 60, 400])), rng.choice(["hot", "hot", "hot", "s1", "s2", None])) for i in range(n)]
    return [*rows, (900, None, "s1"), (901, " \n\t", "hot"), (902, "x y\x1fz\xa0q", "s2"), (903, "v " * 30000, "hot"), (1, rows[1][1], rows[1][2]), (1, rows[1][1], rows[1][2])]


def test_mix(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("bucket", F.lit(0)).repartition(4)
    parts = mixing.mix(df, block_words=64)
    got = mixing.taken_by_document(*parts).collect()
    size = lambda t: len(BLANK.findall(t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    targets = mixing.source_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == float(targets[r.source])
        taken[r.source] += r.taken
    # within a few blocks of 64 words
    assert all(abs(taken[s] - targets[s]) <= 4 * 64 for s in sizes) and abs(sum(taken.values()) - sum(targets.values())) <= 4 * 64
    again = mixing.taken_by_document(*mixing.mix(df.repartition(7), block_words=64)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    # any long run of the schedule holds the sources in their shares
    slots = parts[1].groupBy("position", "source").agg(F.sum("n_words").alias("n")).orderBy("position").collect()
    half = Counter()
    for r in slots[: len(slots) // 2]:
        half[r.source] += r.n
    for s in sizes:
        assert abs(half[s] / sum(half.values()) - float(targets[s]) / float(sum(targets.values()))) < 0.06


def test_the_schedule_decides(spark, monkeypatch):
    df = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    plain = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda spark, goals, n: plain(spark, goals, n).where("slot < 40"))
    documents_, pieces = mixing.mix(df, block_words=16)
    got = mixing.taken_by_document(documents_, pieces).collect()
    assert sum(r.taken for r in got) == 40 * 16 and max(r.first_slot or 0 for r in got) < 40
    monkeypatch.setattr(mixing, "schedule", lambda spark, goals, n: plain(spark, goals, 0))
    assert sum(r.taken for r in mixing.taken_by_document(*mixing.mix(df)).collect()) == 0


def test_golden_slots_match_brute_force(spark):
    goals = [7000, 0, 1000, 2500]
    got = sorted(tuple(r) for r in mixing.schedule(spark, goals, 3000).collect())
    seen, want = Counter(), []
    for i in range(3000):
        point = Fraction(i * mixing.GOLDEN % 2**32, 2**32) * sum(goals)
        source = next(s for s in range(4) if point < sum(goals[: s + 1]) - Fraction(sum(goals), 2**32) * 0 and goals[s])
        want.append((i, source, seen[source]))
        seen[source] += 1
    assert sum(a != b for a, b in zip(got, want)) == 0
    assert all(abs(seen[s] - 3000 * goals[s] / sum(goals)) < 3 for s in range(4))


def test_equal_rows_share_what_they_take(spark):
    rows = [(1, "a b c", "x")] * 301 + [(1, "d e", "x"), (None, "f g h", "x"), (None, None, "x"), (2, "a b c", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.taken_by_document(*mixing.mix(df, block_words=2)).collect()
    taken = sorted(r.taken for r in got if r.size == 3 and r.source == "x" and r.doc_id == 1)
    assert len(got) == len(rows) and len(taken) == 301 and taken[-1] - taken[0] <= 1 and taken[-1] <= 6
    mixed = mixing.mixed_documents(df.withColumn("n_chars", F.lit(0).cast("long")).withColumn("lang", F.lit("en")), list(corpus_pipeline.COLUMNS), block_words=2).collect()
    assert sum(len(BLANK.findall(r.text)) for r in mixed if r.doc_id == 1 and r.text[0] == "a") == sum(taken)


def test_mixed_documents(spark):
    rows = [(i, f" a{i} b\tc\n" * 20, "x" if i % 3 else None) for i in range(30)] + [(99, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    got = mixing.mixed_documents(df, list(corpus_pipeline.COLUMNS), block_words=16).collect()
    texts = {d: t for d, t, _ in rows}
    assert all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in got)
    documents, pieces = mixing.mix(df, block_words=16)
    taken = mixing.taken_by_document(documents, pieces).collect()
    want = {r.doc_id: r.taken for r in taken}
    # rows come in the order of the mix
    first = {r.doc_id: r.first_slot for r in taken}
    order = [first[d] for d in dict.fromkeys(r.doc_id for r in got)]
    assert order == sorted(order)
    words = Counter()
    for r in got:
        words[r.doc_id] += len(BLANK.findall(r.text))
    assert all(words[d] == n for d, n in want.items()) and max(Counter(r.doc_id for r in got).values()) == 2


def test_mix_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken_by_document(*mixing.mix(none)).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.taken) for r in mixing.taken_by_document(*mixing.mix(blank)).collect()) == [(1, 0), (2, 0)]


PAGES = [
    (1, "http://a.com/en/x?q#f", None, "a.com", "/en/x", "com/en/", "block"),
    (2, "https://EXAMPLE.com/en/7a", "", "example.com", "/en/7a", "example.com/en/7", "allow"),
    (3, "https://www.example.net/de/81", "<p>", "www.example.net", "/de/81", "example.net/de/8", "block"),
    (4, "https://x.net/de/1", "", "x.net", "/de/1", "net/de/", "allow"),
    (5, "http://notcom/en/", "", "notcom", "/en/", None, "allow"),
    (6, None, "", "", "", None, "allow"),
    (7, "no scheme", "", "", "", None, "allow"),
    (8, "s://h?x=://y/z", "", "h", "", None, "allow"),
    # aliases of page 1, by a canonical link, and of that by a redirect
    (9, "http://alias.info/p", '<link href="https://A.com/en/x?q" rel="canonical">', "alias.info", "/p", None, "block"),
    (10, "http://other.info/r", "<META http-equiv='refresh' content='0; url=http://alias.info/p#top'>", "other.info", "/r", None, "block"),
    # a rule's allow stays, and does not spread over a block
    (11, "http://b.net/de/2", '<link rel=canonical href=http://alias.info/p>', "b.net", "/de/2", "net/de/", "allow"),
    (12, "http://rel.info/d/e", '<link rel="canonical" href="../x">', "rel.info", "/d/e", None, "allow"),
    (13, "http://alias.info/p/", None, "alias.info", "/p/", None, "block"),
    (13, "http://alias.info/p/", None, "alias.info", "/p/", None, "block"),
]


def test_url_filters(spark):
    df = spark.createDataFrame([p[:3] for p in PAGES], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("node", F.lit(1))
    got = sorted(tuple(r)[:5] for r in urlfilter.judge(df).collect())
    assert got == sorted((p[0], p[3], p[4], p[5], p[6]) for p in PAGES)
    log = spark.createDataFrame([("http://notcom/en/", "http://other.info/r"), (None, "x")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, redirects=log).collect()}[5] == "block"
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_url_filters_judge_ends_that_are_no_pages(spark):
    rows = [
        (1, "http://one.info/a", '<link rel="canonical" href="http://a.com/en/x">'),
        (2, "http://two.info/b", '<meta http-equiv="refresh" content="0; url=http://one.info/a">'),
        (3, "http://b.net/de/2", '<link rel="canonical" href="http://one.info/a">'),
        (4, "http://three.info/c", None),
        (5, "http://four.info/d", '<link rel="canonical" href="http://x.net/de/9">'),
        (6, "http://five.com/en", '<link rel="canonical" href="http://five.com/en/">'),
        (7, "http://six.info/e", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(df).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "allow"}
    log = [("http://three.info/c", "http://hop.info/"), ("http://hop.info", "https://gone.org/es/1"), ("http://z.com/en/y", "http://six.info/e"), (None, "http://z.com/en/y")]
    got = {r.page_id: r.verdict for r in urlfilter.judge(df, redirects=spark.createDataFrame(log, "from_url string, to_url string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "block", 7: "block"}


def test_links_are_resolved(spark):
    cases = [("../x", "h/a/x"), ("../../../../x", "h/x"), ("./y/./z", "h/a/b/y/z"), ("..", "h/a"), (".", "h/a/b"), ("../..", "h"), ("/p/../q?r=../s", "h/q?r=../s")]
    cases += [("/go?u=http://z/y", "h/go?u=http://z/y"), ("go?u=http://z/y", "h/a/b/go?u=http://z/y"), ("//z/y/../w", "z/w"), ("HTTPS://z/a/./b", "z/a/b"), ("..x/.y", "h/a/b/..x/.y"), ("x//../y", "h/a/b/x/y")]
    rows = [(i, "http://h/a/b/c", f'<link rel="canonical" href="{link}">') for i, (link, _) in enumerate(cases)]
    got = urlfilter.alias_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.dst for r in got} == {node for _, node in cases} and {r.src for r in got} == {"h/a/b/c"}
    pages = spark.createDataFrame([(1, "http://h/a/b/c", rows[0][2]), (2, "http://h/a/x", '<link rel="canonical" href="http://k.com/d/../en/1">')], "page_id long, url string, html string")
    assert [r.verdict for r in urlfilter.judge(pages).collect()] == ["block", "block"]


def test_chat_matches_brute_force(spark):
    rng = random.Random(6)
    whole = [[(rng.choice(["user", "assistant"]), rng.choice(["hi", "a", "b", None, ""])) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    convs = {}
    for i in range(200):
        own = rng.choice(whole)
        convs[i] = own[: rng.randint(1, len(own))]
    rows = [(c, 10 * t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("h1", F.lit("clash"))).collect()}
    kept = {}
    for c, own in convs.items():
        if not any(o[: len(own)] == own and (len(o) > len(own) or d < c) for d, o in convs.items() if d != c):
            kept[c] = (len(own), "".join(f"<|{r}|>\n{x or ''}<|end|>\n" for r, x in own))
    assert got == kept and 10 < len(kept) < 100


def test_chat_long_conversations_and_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    long = [(1, t, "user", f"t{t}") for t in range(9000)] + [(2, t, "user", f"t{t}") for t in range(8000)] + [(3, 0, None, "x" * 100000), (None, None, "user", "q"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    got = chat.format_chats(spark.createDataFrame(long, schema), segment_turns=1000).collect()
    assert {r.conv_id for r in got} == {1, 3, 4, None}
    segments = sorted((r.segment, r.rendered) for r in got if r.conv_id == 1)
    assert len(segments) == 11 and "".join(s for _, s in segments) == "".join(f"<|user|>\nt{t}<|end|>\n" for t in range(9000))
    assert [r.n_turns for r in got if r.conv_id == 4] == [2]
    assert next(r.rendered for r in got if r.conv_id == 3).startswith("<|unknown|>\nx")
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_chat_plan_is_native(spark):
    df = queries.op7_chat_formatting(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_top(rows, k=5):
    out = set()
    usable = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, x in usable:
        if q % 50 == 0:
            scores = sorted((-min(max(sum(int(a) * int(b) for a, b in zip(x, y)), -(2**63)), 2**63 - 1), i) for i, y in usable if i != q and len(y) == len(x))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 24))
    rows = [(int(i), (centres[i % 5] + rng.normal(size=24) * 0.3).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)] + [(500, None), (550, [1.0, None]), (600, [float("nan")] * 24), (650, [float("inf")] * 24), (700, [0.5, -0.25, 3.0]), (701, [1.0, 2.0, 3.0]), (750, []), (751, []), (None, [1.0] * 24)]
    # beyond what doubles hold exactly, and beyond a long
    rows += [(800, [5000.0] * 24), (801, [-4096.0, 1e9] * 12), (802, [123456789.0, 0.1] * 12), (850, [3e8] * 24), (851, [1.5, 2e30, -1.0]), (852, [-1.5, 2e30, 1.0])]
    rows = [(i, v if v is None or None in v else np.array(v, np.float32).tolist()) for i, v in rows]
    for size in (topk.QUERY_BYTES, 900):
        monkeypatch.setattr(topk, "QUERY_BYTES", size)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).repartition(4)
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()
        assert {tuple(r) for r in got} == brute_top(rows) and len(got) == len(brute_top(rows))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_whole_products():
    rng = np.random.default_rng(1)
    q, x = (np.trunc(rng.normal(size=(n, 9)) * 2.0 ** rng.integers(0, 90, (n, 9))) for n in (7, 11))
    want = [[sum(int(a) * int(b) for a, b in zip(u, v)) for v in x] for u in q]
    assert topk.whole_products(q, x).tolist() == want


def test_levels_that_pay():
    rng = np.random.default_rng(2)
    smooth, rough = np.repeat(rng.normal(size=(300, 4)), 16, axis=1), rng.normal(size=(300, 64))
    found = []
    for x in (smooth, rough):
        x = topk.scaled(x)
        floor = np.partition(x[:50] @ x.T, -6, axis=1)[:, -6]
        found.append(topk.paying_levels(np.arange(50), x[:50], floor, np.arange(300), x))
    assert found[0][0] <= 4 and found[1] == [32]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, x = rng.integers(-300, 300, (20, 30)).astype(float), rng.integers(-300, 300, (50, 30)).astype(float)
    exact, last = q @ x.T, None
    for s in (1, 4, 16):
        bound = topk._statistics(q, s) @ topk._statistics(x, s).T
        assert (bound >= exact - 1e-6).all() and (last is None or bound.sum() < last)
        last = bound.sum()


TEXTS = [None, "", " ", "Hello, World! it's 123 dön't", "a" * 3000, "naïve Straße ÀÉ ǅ ²³½ x_y __ 'S 'Re", "漢字 and İstanbul", "e\u0301 combining", "<|endoftext|> end", "tab\tnew\nline\x0b\x85\xa0nbsp\x1cfs\x00nul", "ŉ ß Ω", "''ll 'll'll I'LL", "\U0001f600 emoji"]


@pytest.mark.parametrize("layout", ["dictionary", "delta"])
def test_token_store_round_trip(spark, layout):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file())
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(5, "twice"), (5, "twice"), (5, "other"), (None, "no id")]
    path = scratch_path(spark, "test-tokens")
    tokenstore.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).repartition(3), path, queries.tokenizer_file(), 1, layout)
    encode = lambda t: library.encode(t or "", add_special_tokens=False).ids + [1]
    got = tokenstore.digest_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    want = Counter((d, len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for d, t in rows for e in [encode(t)])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert {r.doc_id for r in tokenstore.read_tokens(spark, path, 90, 95).collect()} == {90, 91, 92, 93, 94, 95}
    import pyarrow.parquet as pq

    files = sorted(p for p in __import__("glob").glob(path.removeprefix("file://") + "/*.parquet"))
    column = next(c for f in files for g in [pq.ParquetFile(f).metadata.row_group(0)] for c in [g.column(i) for i in range(g.num_columns)] if c.path_in_schema.startswith("ids"))
    assert column.has_offset_index and column.has_column_index
    assert ("RLE_DICTIONARY" in column.encodings or "PLAIN_DICTIONARY" in column.encodings) if layout == "dictionary" else "DELTA_BINARY_PACKED" in column.encodings


def test_token_store_empty(spark):
    path = scratch_path(spark, "no-tokens")
    tokenstore.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, queries.tokenizer_file())
    assert tokenstore.digest_tokens(spark, path).count() == 0
    with pytest.raises(ValueError):
        tokenstore.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, queries.tokenizer_file(), layout="plain")


def test_other_tasks_drop_the_encoder(spark, monkeypatch):
    mapped, kind = [], type(spark.range(1))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: mapped.append(f) or plain(self, f, *a, **b))
    mixing.schedule(spark, [3, 1], 10)
    tokenstore.encoder_of(queries.tokenizer_file())
    assert list(mapped[0](iter([]))) == []
    assert tokenstore.encoder_of.cache_info().currsize == 0
    # the store's own tasks keep it
    tokenstore.encoder_of(queries.tokenizer_file())
    list(tokenstore._digest(iter([])))
    assert tokenstore.encoder_of.cache_info().currsize == 1


def test_encoder_matches_library(tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(queries.tokenizer_file()), tokenstore.Encoder(queries.tokenizer_file(), 20)
    rng = random.Random(1)
    letters = [chr(c) for c in [*range(0x300), 0x301, 0x308, 0x3A3, 0x2003, 0x3000, 0x6F22]]
    texts = [*TEXTS, *("".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(400)), *("".join(rng.choices("ab'st rél1²_!.  \n", k=40)) for _ in range(400))]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert own.chunked
    for a in range(0, len(texts), 7):
        ids, ends = own.encode(pa.array(texts, pa.string()).slice(a, 7))
        assert [ids[x:y].tolist() for x, y in zip(ends[:-1], ends[1:])] == want[a : a + 7]
    # another file: cased, so that chunks would be wrong
    parts = json.load(open(queries.tokenizer_file()))
    parts["normalizer"] = None
    (tmp_path / "cased.json").write_text(json.dumps(parts))
    library, own = Tokenizer.from_file(str(tmp_path / "cased.json")), tokenstore.Encoder(str(tmp_path / "cased.json"))
    ids, ends = own.encode(pa.array(texts[1:300]))
    assert not own.chunked and [ids[x:y].tolist() for x, y in zip(ends[:-1], ends[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts[1:300]]


def test_pipeline_stages(spark):
    """Every stage against its rule, on its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    extra = spark.createDataFrame([(10**6, "### 123 !!", None, "src1", 10), (10**6 + 1, None, None, None, None)], docs.schema)
    first = corpus_pipeline.identify_language(spark, docs.unionByName(extra), sf)
    kept = {r.doc_id: r for r in first.collect()}
    before = {r.doc_id: r for r in docs.collect()}
    assert set(kept) == set(before) and all(kept[d].text == before[d].text for d in kept)
    second = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    from test_duplicates import classes_by_brute_force, shingle_set

    classes = classes_by_brute_force([(d, r.text) for d, r in before.items()])
    assert {r.doc_id for r in second.collect()} == {d for d, c in classes.items() if c == d}
    third = corpus_pipeline.decontaminate(spark, docs, sf)
    items = [shingle_set(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {d for d, r in before.items() if not any(len(s & shingle_set(r.text)) >= 0.8 * len(s) - 1e-9 for s in items if s)}
    assert {r.doc_id for r in third.collect()} == clean and len(clean) < len(before)
    fourth = materialize(corpus_pipeline.mix_sources(spark, docs, sf), "test-mixed")
    mixed = fourth.select("doc_id", "text", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    documents_, pieces = mixing.mix(docs)
    taken = {r.doc_id: r for r in mixing.taken_by_document(documents_, pieces).collect()}
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len(BLANK.findall(r.text))
    assert all(words[d] == r.taken for d, r in taken.items())
    slots = [taken[d].first_slot for d in dict.fromkeys(r.doc_id for r in mixed)]
    assert slots == sorted(slots)
    # the token store holds the mix in its order
    fifth = corpus_pipeline.store_tokens(spark, fourth, sf).orderBy("start").collect()
    assert [r.doc_id for r in fifth] == [r.doc_id for r in mixed] != sorted(r.doc_id for r in mixed)
    rows = corpus_pipeline.run(spark, sf).orderBy("start").collect()
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    assert {r.doc_id for r in rows} <= {d for d, c in classes.items() if c == d} & clean


def test_pipeline_of_empty_tables_and_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    items.write.parquet(str(tmp_path / "none/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    some = docs.orderBy("doc_id").limit(12)
    clash = some.select("*", *[F.lit(1).alias(c) for c in ("own_id", "score", "file", "row", "place", "words", "key", "h")])
    clash.write.parquet(str(tmp_path / "some/documents.parquet"))
    items.limit(0).write.parquet(str(tmp_path / "some/benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in some.collect()} and len(got) > 8


def test_pipeline_keeps_texts_of_null_and_repeated_ids(spark):
    sf = "/root/testdata/sf0.001"
    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) > 15)
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    near = text(1) + " end"
    rows = [(None, text(0)), (None, text(1)), (7, near), (7, text(2)), (7, text(3)), (7, text(3)), (8, text(4)), (9, text(4) + " end"), (None, text(5)), (None, text(5) + " end"), (None, None), (5, None), (None, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, x, "en", "s", len(x or "")) for d, x in rows], schema).repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect())
    of_five = [k for k in got if k[1] in (text(5), text(5) + " end")]
    assert len(of_five) == 1
    assert got - Counter(of_five) == Counter([(None, text(0)), (7, near), (7, text(2)), (7, text(3)), (8, text(4)), (None, None), (5, None), (None, "")])
    leaks = [(None, f"{text(0)} {item}"), (None, text(1)), (7, f"{text(2)} {item}"), (7, text(3)), (None, None)]
    docs = spark.createDataFrame([(d, x, "en", "s", len(x or "")) for d, x in leaks], schema)
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, docs, sf).collect()) == Counter([(None, text(1)), (7, text(3)), (None, None)])
