"""The data source, API and rewriting on Spark against the sequential reader and DuckDB."""

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_codec import make_file

import __spark_entry__ as entry
from braidspark import api, fixtures, queries
from braidspark.cli import count as count_cli
from braidspark.cli import deidentify as deidentify_cli
from braidspark.functions.flags import FLAG_COLUMNS, has_flag
from braidspark.operators import rewrite
from braidspark.sources import bam, datasource, files
from braidspark.streaming.arrivals import read_arrivals


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    return make_file(tmp_path_factory.mktemp("bam"), 700)


def plain(path):
    with open(path, "rb") as f:
        _, first = bam.read_header(f)
        columns = datasource.arrow_schema(True, False).names
        return [r for c in bam.scan(f, first, None) for r in bam.decode(c, columns).to_pylist()]


@pytest.mark.parametrize("splits", [1, 2, 3, 7, 64])
def test_read_equals_sequential_reader(spark, small, splits):
    path, _ = small
    got = api.read_bam(spark, path, splits=splits, full=True, voffset=True).orderBy("voffset").drop("voffset", "split_id").collect()
    assert [r.asDict() for r in got] == plain(path)
    total, mapped = api.sequential_count(path)
    assert api.count(spark, path, splits=splits) == mapped and api.count(spark, path, until_eof=True, splits=splits) == total


def test_without_index_and_many_files(spark, small, tmp_path):
    path, rows = small
    copy = str(tmp_path / "copy.bam")
    open(copy, "wb").write(open(path, "rb").read())
    assert api.count(spark, copy, until_eof=True) == len(rows)
    assert api.read_bam(spark, [path, copy], columns=["flag"]).count() == 2 * len(rows)


def test_filters_are_pushed_and_right(spark, small):
    path, _ = small
    df = api.read_bam(spark, path, splits=3).where("is_unmapped and reference_id = 1 and mapping_quality is null and flag in (4, 5)")
    want = [r for r in plain(path) if r["is_unmapped"] and r["reference_id"] == 1]
    assert df.count() == len(want) > 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert df.count() == len(want)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = datasource.BamReader({"path": path}, spark.createDataFrame([], "flag int").schema)
    kept = list(reader.pushFilters([datasource.EqualTo(("is_unmapped",), True), datasource.Not(datasource.EqualTo(("flag",), 4))]))
    assert len(kept) == 2 and len(reader.decoder.filters) == 2


def test_count_plan_has_partial_aggregation(spark, small):
    plan = api.count_by_split(spark, small[0]).agg(F.sum("records"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


def test_facade(spark, small):
    path, rows = small
    with api.AlignmentFile(spark, path) as f:
        assert f.count() < f.count(until_eof=True) == len(rows)
        reads = iter(f)
        assert len(reads) == len(rows)
        first = next(reads)
        assert len(reads) == len(rows) - 1 and first.query_name == "read-0" and first.is_unmapped
        assert repr(first) == 'BamRecord(query_name="read-0", flag=4, ref_start=0)'
        assert [r.query_name for r in reads] == [r["query_name"] for r in rows[1:]]
    with pytest.raises(Exception):
        first.flag = 1
    with pytest.raises(FileNotFoundError):
        api.AlignmentFile(spark, path + ".none")
    assert [r.name for r in api.references(spark, path).orderBy("reference_id").collect()] == ["chrA", "chrB"]
    assert api.linear_index(spark, path + ".bai").where(api.block_of(F.col("voffset")) != F.col("block")).count() == 0
    assert api.splits(spark, path, most=4).count() <= 4
    assert files.file_size(path) > 1000
    with pytest.raises(ValueError):
        api.read_bam(spark, path, splits=0)


def test_predicates_agree_with_the_flag(spark, small):
    df = api.read_bam(spark, small[0])
    assert df.where(" or ".join(f"{c} <> ((flag & {m}) <> 0)" for c, m in FLAG_COLUMNS.items())).count() == 0
    assert df.where(has_flag("is_unmapped") != F.col("is_unmapped")).count() == 0


def test_round_trip_keeps_every_field_and_the_order(spark, small, tmp_path):
    path, rows = small
    out = str(tmp_path / "out.bam")
    assert rewrite.filter_map(spark, path, out, splits=5) == len(rows)
    assert plain(out) == plain(path) and api.bam_header(out) == api.bam_header(path)
    data = open(out, "rb").read()
    assert data.endswith(bam.bgzf.EOF_BLOCK) and data.count(bam.bgzf.EOF_BLOCK) == 1
    assert not list(tmp_path.glob("*.parts*"))


def test_deidentify(spark, small, tmp_path):
    path, rows = small
    out = str(tmp_path / "out.bam")
    assert rewrite.deidentify(spark, path, out, "-", "REPLACED") == len(rows)
    assert [r["query_name"] for r in plain(out)] == [r["query_name"].replace("-", "REPLACED") for r in rows]
    rewrite.filter_map(spark, path, out, lambda r: rewrite.update_records(r, {"name": "$1", "other": "x"}, "r.ad"))
    assert plain(out) == plain(path)
    with pytest.raises(ValueError):
        rewrite.deidentify(spark, path, out, "", "x")


def test_missing_name_is_an_error_and_leaves_no_file(spark, tmp_path):
    source, out = str(tmp_path / "in.bam"), str(tmp_path / "out.bam")
    api.write_bam(spark.createDataFrame([(4, None)], "flag int, query_name string"), source, references=[])
    with pytest.raises(PySparkException):
        rewrite.deidentify(spark, source, out, "a", "b")
    assert not files.exists(out) and not list(tmp_path.glob("out*"))


def test_writer_checks_the_dictionary(spark, tmp_path):
    with pytest.raises(PySparkException):
        api.write_bam(spark.createDataFrame([(0, 3)], "flag int, reference_id int"), str(tmp_path / "x.bam"), references=[["a", 10]])


def test_clis(spark, small, tmp_path, capsys):
    path, rows = small
    assert count_cli.main(["-t", "2", "-v", path, path + ".bai"]) == 0
    assert capsys.readouterr().out.strip() == str(len(rows))
    assert deidentify_cli.main([path]) == 1
    assert deidentify_cli.main([path, path + ".bai", str(tmp_path / "o.bam"), "read", "x"]) == 0


def test_arrivals(spark, tmp_path):
    path, rows = make_file(tmp_path, 900, n=50)
    query = read_arrivals(spark, str(tmp_path)).writeStream.format("memory").queryName("arrivals").start()
    try:
        query.processAllAvailable()
        assert spark.table("arrivals").count() == len(rows)
        make_file(tmp_path, 901, n=20)
        query.processAllAvailable()
        assert spark.table("arrivals").count() == len(rows) + 20
    finally:
        query.stop()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("nation", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    want = con.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert got == sorted(repr(r) for r in want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(queries.ORACLES) == set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shards_are_whole_files_in_order(spark, small, tmp_path):
    path, rows = small
    out = str(tmp_path / "shards")
    df = api.read_bam(spark, path, splits=3, full=True)
    api.write_bam(df, out, header_from=path, shards=True)
    names = files.names_in(out)
    assert names == [f"part-{i:05d}.bam" for i in range(df.rdd.getNumPartitions())]
    assert sum(api.sequential_count(f"{out}/{n}")[0] for n in names) == len(rows)
    got = api.read_bam(spark, out, full=True, voffset=True).orderBy("split_id", "voffset").drop("voffset", "split_id")
    assert [r.asDict() for r in got.collect()] == plain(path)
    # again, with fewer parts: none of the old stay
    api.write_bam(df.coalesce(1), out, header_from=path, shards=True)
    assert files.names_in(out) == ["part-00000.bam"]
    api.write_bam(df, out, header_from=path)
    assert plain(out) == plain(path)


def test_an_index_for_each_file(spark, small, tmp_path):
    path, rows = small
    copy = str(tmp_path / "copy.bam")
    open(copy, "wb").write(open(path, "rb").read())
    with pytest.raises(PySparkException):
        api.read_bam(spark, [path, copy], path + ".bai", columns=["flag"]).count()
    assert api.read_bam(spark, [path, copy], [path + ".bai", path + ".bai"], columns=["flag"]).count() == 2 * len(rows)


def test_positions_in_file_order(spark, small):
    path, rows = small
    got = api.in_file_order(api.read_bam(spark, path, splits=4, voffset=True)).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows))) and [r.query_name for r in got] == [r["query_name"] for r in rows]


def test_repeated_file(spark, sf, tmp_path):
    path = fixtures.bam_of(spark, sf)
    out = fixtures.repeated(path, str(tmp_path / "many.bam"), 5)
    n, mapped = api.sequential_count(path)
    assert api.sequential_count(out, threads=3) == (5 * n, 5 * mapped)
    for splits in (1, 8, 100):
        assert api.count(spark, out, until_eof=True, splits=splits) == 5 * n
    assert api.splits(spark, out, most=8).count() == 8


def test_sum_of_what_is_left(spark, small):
    path, rows = small
    flags = [r["flag"] for r in rows]
    with api.AlignmentFile(spark, path) as f:
        for given in (0, 1, 250, len(rows)):
            reads = iter(f)
            assert sum(next(reads).flag for _ in range(given)) == sum(flags[:given])
            assert reads.rest().count() == len(reads) == len(rows) - given
            assert reads.sum("flag") == sum(flags[given:])
            assert len(reads) == 0 and list(reads) == []


@pytest.fixture(scope="module")
def noisy(spark, tmp_path_factory):
    """A file of its own splitting index: 40,000 records, names and bases that hardly pack."""
    path = str(tmp_path_factory.mktemp("noisy") / "n.bam")
    bases = F.translate(F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(i)), 256) for i in range(2)]), "0123456789abcdef", "ACGTACGTACGTACGT")
    rows = spark.range(0, 40_000, 1, 3).select(F.sha2(F.col("id").cast("string"), 256).alias("query_name"), (F.col("id") % 3).cast("int").alias("flag"), bases.alias("query_sequence"))
    return api.write_bam(rows, path), rows


def test_written_files_are_read_by_many_tasks(spark, noisy, tmp_path):
    path, rows = noisy
    with open(path, "rb") as f:
        _, first = bam.read_header(f)
        places = [v for c in bam.scan(f, first, None) for v in c.voffsets.tolist()]
    spots = datasource.bai.read_splitting(path, files.file_size(path))
    assert len(spots) > 4 and set(spots) <= set(places) and spots[0] == first
    for options in ({}, {"splits": 3}, {"splits": 1 << 30}):
        got = api.read_bam(spark, path, columns=["query_name", "voffset"], **options)
        assert got.rdd.getNumPartitions() > 1
        assert sorted(r.voffset for r in got.collect()) == places
    assert [r.query_name for r in api.read_bam(spark, path, columns=["query_name"]).collect()] == [r.query_name for r in rows.select("query_name").collect()]
    out = str(tmp_path / "shards")
    api.write_bam(rows.coalesce(1), out, shards=True)
    assert api.read_bam(spark, out, splits=4).rdd.getNumPartitions() > 1
    assert api.read_bam(spark, out, splits=4).select("query_name").exceptAll(rows.select("query_name")).isEmpty()


def test_an_old_splitting_index_does_no_harm(spark, noisy, tmp_path):
    path, rows = noisy
    out = str(tmp_path / "o.bam")
    open(out, "wb").write(open(path, "rb").read())
    api.write_bam(rows, out)
    assert files.exists(out + ".sbi")
    old = open(out + ".sbi", "rb").read()
    api.write_bam(rows.limit(5), out)  # too small for one
    assert not files.exists(out + ".sbi") and api.count(spark, out, until_eof=True) == 5
    open(out + ".sbi", "wb").write(old)  # of a file of another size
    assert api.count(spark, out, until_eof=True) == 5


def test_index_by_the_executors(spark, tmp_path):
    """Of a sorted file of many splits, some of whose records are unplaced or reach over windows, the index is that of one pass."""
    bases = F.translate(F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(i)), 256) for i in range(2)]), "0123456789abcdef", "ACGTACGTACGTACGT")
    placed, n = F.col("id") < 36_000, F.length("query_sequence").cast("string")
    rows = spark.range(0, 40_000, 1, 3).select("id", F.sha2(F.col("id").cast("string"), 256).alias("query_name"), bases.alias("query_sequence")).select(
        "query_name",
        "query_sequence",
        F.when(placed, (F.col("id") / 20_000).cast("int")).alias("reference_id"),
        F.when(placed, F.col("id") % 20_000 * 5).alias("reference_start"),
        F.when(F.col("id") % 7 == 0, F.concat(F.lit("10M"), F.col("id").cast("string"), F.lit("N"), F.lit("118M"))).otherwise(F.concat(n, F.lit("M"))).alias("cigarstring"),
    )
    path = api.write_bam(rows, str(tmp_path / "s.bam"), references=[["a", 10**6], ["b", 10**6], ["c", 10**6]])
    whole = open(datasource.bai.build_index(path, str(tmp_path / "whole.bai")), "rb").read()
    assert api.splits(spark, path, most=100).count() > 4
    assert open(api.build_index(spark, path), "rb").read() == whole
    # a stale index is not what the new one is planned by
    open(path + ".bai", "wb").write(b"none")
    assert open(api.build_index(spark, path), "rb").read() == whole
    api.write_bam(rows.orderBy("query_name"), path, references=[["a", 10**6], ["b", 10**6], ["c", 10**6]])
    with pytest.raises((ValueError, PySparkException), match="not sorted"):
        api.build_index(spark, path)


def test_shards_grow_with_the_table(spark, sf, monkeypatch):
    monkeypatch.setattr(fixtures, "SHARD_ROWS", 500)
    monkeypatch.setattr(fixtures, "_made", {})
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert len(files.names_in(fixtures.odd_names_of(spark, sf))) == -(-n // 500) > 4


def test_a_large_split_is_put_in_order_by_stretches(spark, noisy):
    path, rows = noisy
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ordered = api.in_file_order(api.read_bam(spark, path, splits=1, columns=["query_name", "voffset", "split_id"], voffset=True))
        got = ordered.select("position", "query_name", F.spark_partition_id().alias("task")).orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [r.position for r in got] == list(range(40_000)) and len({r.task for r in got}) > 1
    assert [r.query_name for r in got] == [r.query_name for r in rows.select("query_name").collect()]


def test_predicates_do_not_travel_to_the_writer(spark, small):
    df = api.read_bam(spark, small[0], full=True)
    assert api.stored(df).columns == [c for c in df.columns if c not in FLAG_COLUMNS] and len(api.stored(df).columns) < len(df.columns)
