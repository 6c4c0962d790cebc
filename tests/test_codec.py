"""Codec and planner: hand-made bytes, planner vectors, adversarial layouts."""

import gzip
import io
import struct

import numpy as np
import pyarrow as pa
import pytest

from braidspark.plans import splits
from braidspark.sources import bai, bam, bgzf, datasource

MAPPED = bytes.fromhex("2d000000 00000000 63000000 03 3c 4912 0100 6300 04000000 00000000 c7000000 68000000 723100 40000000 1248 1e1e1e1e".replace(" ", ""))
EMPTY = bytes.fromhex("22000000 ffffffff ffffffff 02 ff 4812 0000 0400 00000000 ffffffff ffffffff 00000000 2a00".replace(" ", ""))
EIGHT = [name for name, _ in bam.CORE]


def decoded(data, wanted=EIGHT):
    chunks = bam.scan(io.BytesIO(bgzf.deflate_block(data) + bgzf.EOF_BLOCK), 0, None)
    return [tuple(r.values()) for c in chunks for r in bam.decode(c, list(wanted)).to_pylist()]


def test_eof_block():
    assert len(bgzf.EOF_BLOCK) == 28 and bgzf.inflate_block(bgzf.EOF_BLOCK) == b""


def test_hand_made_records():
    assert decoded(MAPPED + EMPTY) == [("r1", 99, 0, 99, 60, "4M", "ACGT", 104), (None, 4, None, None, None, "*", "*", 0)]
    flags = decoded(MAPPED + EMPTY, ["is_paired", "is_proper_pair", "is_unmapped", "is_reverse"])
    assert flags == [(True, True, False, False), (False, False, True, False)]


def test_encoder_gives_the_same_bytes():
    row = {"query_name": "r1", "flag": 99, "reference_id": 0, "reference_start": 99, "mapping_quality": 60, "cigarstring": "4M", "query_sequence": "ACGT", "template_length": 104, "next_reference_id": 0, "next_reference_start": 199, "qualities": b"\x1e" * 4}
    assert bam.encode_record(row) == MAPPED
    assert bam.encode_record({"flag": 4}) == EMPTY


def test_names_cigars_and_bases():
    rows = [
        {"flag": 0, "raw_name": b"\xff\xfe"},
        {"flag": 0, "query_name": "é" * 100},
        {"flag": 0, "query_name": "a", "cigarstring": "1M2I3D4N5S6H7P8=9X", "query_sequence": "=ACMGRSVTWYHKDBN"},
        {"flag": 0, "query_name": "b", "query_sequence": "ACGTN", "tags": b"NMCx"},
        {"flag": 0, "query_name": "c", "cigarstring": "1M1I" * 33000, "query_sequence": "A" * 66000},
    ]
    data = b"".join(map(bam.encode_record, rows))
    schema = pa.schema([f for f in datasource.arrow_schema(True) if f.name in {k for r in rows for k in r}])
    assert bam.encode_batch(pa.RecordBatch.from_pylist(rows, schema=schema)) == data
    short = [{k: v for k, v in r.items()} for r in rows[:4]]
    assert bam.encode_batch(pa.RecordBatch.from_pylist(short, schema=schema)) == b"".join(map(bam.encode_record, short))
    got = decoded(data, ["query_name", "cigarstring", "query_sequence", "tags", "raw_name"])
    assert [g[0] for g in got] == [None, "é" * 100, "a", "b", "c"] and got[0][4] == b"\xff\xfe"
    assert [g[1] for g in got] == ["*", "*", "1M2I3D4N5S6H7P8=9X", "*", "1M1I" * 33000]
    assert [g[2] for g in got][2:4] == ["=ACMGRSVTWYHKDBN", "ACGTN"] and got[3][3] == b"NMCx"


@pytest.mark.parametrize("bad", [{"query_name": "x" * 255}, {"query_name": ""}, {"query_sequence": "A?"}, {"cigarstring": "3"}, {"cigarstring": "3Q"}, {"query_sequence": "AC", "qualities": b"1"}])
def test_encoder_rejects(bad):
    row = {"flag": 0, "query_name": "r"} | bad
    with pytest.raises(ValueError):
        bam.encode_record(row)
    with pytest.raises(ValueError):
        bam.encode_batch(pa.RecordBatch.from_pylist([row], schema=pa.schema([f for f in datasource.arrow_schema(True) if f.name in row])))


def test_batches_encode_like_rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        l = int(rng.integers(0, 20))
        start = None if i % 7 == 0 else int(rng.integers(0, 2**29 - 100))
        rows.append({"query_name": None if i % 11 == 0 else "n" * int(rng.integers(1, 255)), "raw_name": b"\xff" if i % 22 == 0 else None, "flag": int(rng.integers(0, 65536)), "reference_id": None if start is None else 1, "reference_start": start, "mapping_quality": None if i % 5 == 0 else int(rng.integers(0, 255)), "cigarstring": "*" if i % 3 == 0 else f"{i + 1}M{i % 9 + 1}D2I", "query_sequence": "".join(rng.choice(list("ACGTNacgt"), l)) or "*", "template_length": int(rng.integers(-5, 5)), "qualities": bytes(l) if i % 2 else None, "tags": b"XXZab\0" if i % 4 else None, "bin": None if i % 2 else 77})
    schema = pa.schema([f for f in datasource.arrow_schema(True) if f.name in rows[0]])
    assert bam.encode_batch(pa.RecordBatch.from_pylist(rows, schema=schema)) == b"".join(map(bam.encode_record, rows))
    assert bam.encode_batch(pa.RecordBatch.from_pylist([], schema=schema)) == b""


@pytest.mark.parametrize("cut, error", [(3, None), (20, EOFError)])
def test_truncated(cut, error):
    data = MAPPED + EMPTY[:cut]
    if error is None:
        assert len(decoded(data)) == 1
    else:
        with pytest.raises(error):
            decoded(data)


V = bgzf.voffset


def test_planner_vectors():
    assert splits.reduce_offsets([V(1, 0), V(1, 10), V(1, 20), V(3, 0), V(5, 5)]) == [V(1, 0), V(3, 0), V(5, 5)]
    assert splits.intervals([V(1, 0), V(5, 0), V(5, 0)]) == [(V(1, 0), V(5, 0))]
    chunk = lambda points, n: [(bgzf.coffset_of(a), bgzf.coffset_of(b)) for a, b in splits.merge_intervals([(V(a, 0), V(b, 0)) for a, b in zip(points, points[1:])], n)]
    assert chunk(range(11), 3) == [(0, 4), (4, 8), (8, 10)]
    assert chunk(range(6), 10) == [(i, i + 1) for i in range(5)]
    assert chunk([0, 10, 20, 30, 40], 1) == [(0, 40)] and len(chunk([0, 10, 20, 30, 40], 4)) == 4
    assert chunk([0, 10, 20, 30, 40, 50], 4) == [(0, 20), (20, 40), (40, 50)]
    assert chunk([0, 1, 2, 3, 100], 2) == [(0, 100)]
    assert chunk([0, 90, 91, 92, 100], 2) == [(0, 90), (90, 100)]
    with pytest.raises(ValueError):
        splits.merge_intervals([(0, 1)], 0)


@pytest.mark.parametrize("offsets", [[], [V(7, 0)], [V(0, 100), V(0, 900)]])
def test_short_indexes_give_the_whole_file(offsets):
    assert splits.plan(offsets, V(0, 50), 1000, 4) == [(V(0, 50), V(972, 0))]


def test_tail_and_sentinel():
    assert splits.whole_file([(0, V(500, 0))], V(0, 77), 1000) == [(V(0, 77), V(500, 0)), (V(500, 0), V(972, 0))]
    assert splits.whole_file([(V(1, 0), V(972, 0))], V(1, 0), 1000) == [(V(1, 0), V(972, 0))]


def make_file(tmp_path, payload, n=400, own_header_block=True, eof=True, seed=0):
    rng = np.random.default_rng(seed)
    header, path = bam.Header("@HD\tVN:1.6\n", [("chrA", 10**6), ("chrB", 10**6)]), str(tmp_path / f"f{payload}.bam")
    rows = []
    for i in range(n):
        placed = i < n * 0.8
        rows.append({"query_name": f"read-{i}", "flag": 4 if i % 9 == 0 or not placed else 0, "reference_id": int(i > n // 2) if placed else None, "reference_start": 700 * i if placed else None, "cigarstring": "*" if i % 9 == 0 else f"{i % 60 + 1}M", "query_sequence": "ACGTN"[: i % 5 + 1] * int(rng.integers(1, 30)), "tags": b"XXZ" + b"t" * (i % 70) + b"\0"})
    with open(path, "wb") as f:
        out = bgzf.BlockWriter(f, payload)
        out.write(header.encode())
        if own_header_block:
            out.cut()
        for r in rows:
            out.write(bam.encode_record(r))
        out.finish(eof)
    bai.build_index(path)
    return path, rows


@pytest.mark.parametrize("payload", [64, 1000, 0xFF00])
@pytest.mark.parametrize("own_block", [True, False])
@pytest.mark.parametrize("eof", [True, False])
def test_every_split_count_reads_every_record_once(tmp_path, payload, own_block, eof):
    path, rows = make_file(tmp_path, payload, own_header_block=own_block, eof=eof)
    with open(path, "rb") as f:
        _, first = bam.read_header(f)
        everything = [v for c in bam.scan(f, first, None, 4096) for v in c.voffsets.tolist()]
        assert len(everything) == len(rows) and everything == sorted(set(everything))
        size = len(open(path, "rb").read()) + (0 if eof else 28)
        for most in (1, 2, 3, 7, 64):
            plan = splits.plan(bai.read_linear_index(path + ".bai"), first, size, most)
            assert len(plan) <= most
            got = [v for a, b in plan for c in bam.scan(f, a, b, 2000) for v in c.voffsets.tolist()]
            assert got == everything


def test_header_only_file(tmp_path):
    path, _ = make_file(tmp_path, 500, n=0)
    with open(path, "rb") as f:
        header, first = bam.read_header(f)
        assert header.references == [("chrA", 10**6), ("chrB", 10**6)] and list(bam.scan(f, first, None)) == []


def test_bad_files(tmp_path):
    with pytest.raises(ValueError):
        bam.read_header(io.BytesIO(bgzf.deflate_block(b"not a bam file") + bgzf.EOF_BLOCK))
    with pytest.raises(ValueError):
        list(bgzf.blocks(io.BytesIO(b"x" * 100), 0))
    with pytest.raises(EOFError):
        list(bgzf.blocks(io.BytesIO(bgzf.deflate_block(b"abc")[:-3]), 0))
    (tmp_path / "x.bai").write_bytes(b"BAI\1" + struct.pack("<i", 3))
    with pytest.raises(ValueError):
        bai.read_linear_index(str(tmp_path / "x.bai"))


@pytest.mark.parametrize("payload", [64, 700, bgzf.PAYLOAD])
@pytest.mark.parametrize("aligned", [True, False])
def test_all_blocks_walked_at_once(payload, aligned):
    rng = np.random.default_rng(payload)
    records = [struct.pack("<i", n) + bytes(n) for n in rng.integers(32, 300, 3000).tolist()]
    data, ends = b"".join(records), np.cumsum([len(r) for r in records])
    out = io.BytesIO()
    writer = bgzf.BlockWriter(out, payload)
    writer.write_records(data, ends) if aligned else writer.write(data)
    writer.finish()
    got = [x for c in bam.scan(io.BytesIO(out.getvalue()), 0, None, 100_000) for x in c.voffsets.tolist()]
    blocks = list(bgzf.blocks(io.BytesIO(out.getvalue()), 0))
    assert blocks == list(bgzf.blocks(io.BytesIO(out.getvalue()), 0, threads=3)) and b"".join(b for _, b in blocks) == data
    begins = np.concatenate([[0], np.cumsum([len(b) for _, b in blocks])[:-1]])
    assert got == bgzf.positions(begins, np.array([c for c, _ in blocks]), np.concatenate([[0], ends[:-1]])).tolist()


def test_zlib_and_libdeflate_agree(monkeypatch):
    for n in (0, 1, 5000, 65536):
        block = bgzf.deflate_block(bytes(np.random.default_rng(n).integers(0, 9, n).astype(np.uint8)))
        broken = block[:-5] + bytes([block[-5] ^ 1]) + block[-4:]
        found = []
        for own in (bgzf._deflate(), None):
            monkeypatch.setattr(bgzf, "_DEFLATE", own)
            found.append(bytes(bgzf.inflate_block(block)))
            with pytest.raises(ValueError):
                bgzf.inflate_block(broken)
        assert found[0] == found[1] and len(found[0]) == n


def test_blocks_are_packed_by_either_library(monkeypatch):
    rng, own = np.random.default_rng(5), bgzf._deflate()
    if own is None:
        pytest.skip("no libdeflate here")
    for n, kinds in ((0, 1), (1, 1), (5000, 4), (bgzf.PAYLOAD, 4), (bgzf.PAYLOAD, 256)):
        data, found = rng.integers(0, kinds, n).astype(np.uint8).tobytes(), []
        for library in (own, None):
            monkeypatch.setattr(bgzf, "_DEFLATE", library)
            found.append(bgzf.deflate_block(data))
            assert bgzf.block_size(found[-1], 0) == len(found[-1])
        for block in found:
            assert bytes(bgzf.inflate_block(block)) == data == gzip.decompress(block)
        if kinds == 4 and n > 1:
            assert own.deflate(data, 6) == found[0][18:-8]


def test_decoding_takes_little_memory(tmp_path):
    """Of a file of any size, the arrays of a batch at once."""
    import tracemalloc

    n = 300_000
    names = pa.array([f"read-{i}" for i in range(n)])
    batch = pa.record_batch({"query_name": names, "query_sequence": pa.array(["ACGTACGTACGTACGTACGT"] * n), "cigarstring": pa.array(["20M"] * n)})
    with open(tmp_path / "m.bam", "wb") as f:
        out = bgzf.BlockWriter(f)
        out.write(bam.Header("").encode())
        out.cut()
        out.write_records(*bam.encode_records(batch))
        out.finish()
    del names, batch
    columns = [name for name, _ in [*bam.CORE, *bam.REST]]
    with open(tmp_path / "m.bam", "rb") as f:
        _, first = bam.read_header(f)
        tracemalloc.start()
        try:
            found = sum(bam.decode(c, columns).num_rows for c in bam.scan(f, first, None))
            _, peak = tracemalloc.get_traced_memory()
        finally:
            tracemalloc.stop()
    assert found == n and peak < 50 << 20, peak
