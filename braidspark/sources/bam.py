"""BAM header and records, as Arrow columns (public SAM/BAM specification)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from braidspark.functions.flags import FLAG_COLUMNS
from braidspark.sources import bgzf

MAGIC = b"BAM\x01"
#: Fixed values of the format.
CIGAR_OPS = "MIDNSHP=X"
BASES = b"=ACMGRSVTWYHKDBN"
FIXED = np.dtype(
    [("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")]
)
#: For columns: indices and columns of a batch take some 30 times its bytes while it is decoded, in each worker.
BATCH_BYTES = 2 << 20
#: For counts: the more blocks at once, the fewer steps a record.
COUNT_BYTES = 32 << 20
#: So many blocks at least are walked at once.
LANES = 16

CORE = [
    ("query_name", pa.string()),
    ("flag", pa.int32()),
    ("reference_id", pa.int32()),
    ("reference_start", pa.int64()),
    ("mapping_quality", pa.int32()),
    ("cigarstring", pa.string()),
    ("query_sequence", pa.string()),
    ("template_length", pa.int32()),
]
REST = [("next_reference_id", pa.int32()), ("next_reference_start", pa.int64()), ("bin", pa.int32()), ("qualities", pa.binary()), ("tags", pa.binary()), ("raw_name", pa.binary())]
PLACE = [("voffset", pa.int64()), ("split_id", pa.int32())]


@dataclass
class Header:
    text: str
    references: list[tuple[str, int]] = field(default_factory=list)

    def encode(self) -> bytes:
        text = self.text.encode()
        out = [MAGIC, struct.pack("<i", len(text)), text, struct.pack("<i", len(self.references))]
        for name, length in self.references:
            raw = name.encode() + b"\0"
            out += [struct.pack("<i", len(raw)), raw, struct.pack("<i", length)]
        return b"".join(out)


def read_header(file) -> tuple[Header, int]:
    """The header, and the virtual offset of the first record (in the next block if its own is used up)."""
    data, starts, coffsets, needed = bytearray(), [], [], 12
    source = bgzf.blocks(file, 0, 1 << 18)

    def want(n: int) -> None:
        while len(data) < n:
            try:
                coffset, block = next(source)
            except StopIteration:
                raise ValueError("the file ends inside its BAM header") from None
            starts.append(len(data))
            coffsets.append(coffset)
            data.extend(block)

    want(8)
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a BAM file")
    (l_text,) = struct.unpack_from("<i", data, 4)
    want(needed + l_text)
    text = bytes(data[8 : 8 + l_text]).rstrip(b"\0").decode("utf-8", "replace")
    (n,) = struct.unpack_from("<i", data, 8 + l_text)
    at, references = 12 + l_text, []
    for _ in range(n):
        want(at + 4)
        (size,) = struct.unpack_from("<i", data, at)
        want(at + 8 + size)
        name = bytes(data[at + 4 : at + 4 + size]).rstrip(b"\0").decode("utf-8", "replace")
        references.append((name, struct.unpack_from("<i", data, at + 4 + size)[0]))
        at += 8 + size
    if at == len(data):
        for coffset, block in source:
            if block:
                return Header(text, references), bgzf.voffset(coffset, 0)
        last = coffsets[-1] if coffsets else 0
        return Header(text, references), bgzf.voffset(last, at - starts[-1])
    block = int(np.searchsorted(starts, at, side="right")) - 1
    return Header(text, references), bgzf.voffset(coffsets[block], at - starts[block])


@dataclass
class Chunk:
    """Whole records in a buffer: where they begin, and where its blocks do, here and in the file."""

    data: bytes
    at: np.ndarray
    blocks: np.ndarray
    coffsets: np.ndarray

    @property
    def voffsets(self) -> np.ndarray:
        return bgzf.positions(self.blocks, self.coffsets, self.at)

    def of(self, rows: np.ndarray) -> Chunk:
        """The chunk with some of its records."""
        return Chunk(self.data, self.at[rows], self.blocks, self.coffsets)


def _record_starts(data: bytes, first: int, blocks: np.ndarray) -> tuple[np.ndarray, int]:
    """Where the whole records of a buffer begin, and the place behind the last; `blocks` begin at these places.

    Writers mostly begin a block with a record. Where the first block's records end with it, all blocks are walked at once,
    a record of each in a step; each block whose walk ends where the next begins vouches for that one. From a
    block that does not, and in other files, records are walked one by one.
    """
    unpack, n = struct.Struct("<i").unpack_from, len(data)

    def walk(pos: int, until: int) -> tuple[list[int], int]:
        at: list[int] = []
        note, last = at.append, min(n - 4, until - 1)
        while pos <= last:
            size = unpack(data, pos)[0]
            after = pos + 4 + size
            if after > n:
                break
            if size < 32:
                raise ValueError("a record is shorter than its fixed fields")
            note(pos)
            pos = after
        return at, pos

    found, pos, lane = [], first, int(np.searchsorted(blocks, first, side="right"))
    if len(blocks) - lane >= LANES:
        at, pos = walk(first, int(blocks[lane]))
        found.append(np.array(at, np.int64))
        if pos == blocks[lane]:
            begins, ends = blocks[lane:], np.append(blocks[lane + 1 :], n)
            sizes = np.ndarray((n - 3,), "<u4", data, 0, (1,))
            at, steps = begins, []
            alive = np.minimum(ends, n - 3)
            while True:
                going = at < alive
                if not going.any():
                    break
                steps.append(np.where(going, at, n))
                at = np.where(going, at + 4 + sizes[np.minimum(at, n - 4)], at)
            places = np.concatenate(steps).reshape(-1, len(begins))
            # a block is as its walk has found it if that ends where the next begins; odd sizes end elsewhere
            bad = np.flatnonzero((at != ends) | (np.where(places < n, sizes[np.minimum(places, n - 4)], 32) < 32).any(axis=0))
            sound = int(bad[0]) if len(bad) else len(begins)
            own = places[:, :sound].T.ravel()
            found.append(own[own < n])
            pos = int(ends[sound - 1]) if sound else pos
    at, pos = walk(pos, n)
    return np.concatenate([*found, np.array(at, np.int64)]), pos


def scan(file, start: int, end: int | None, batch_bytes: int = BATCH_BYTES, threads: int = 1) -> Iterator[Chunk]:
    """Records whose start lies in [start, end) of virtual offsets, read on past `end` to the last one's end.

    A file that ends before a record's length ends the scan; one that ends inside a record is an error.
    """
    held, starts, coffsets, length = [], [], [], 0
    skip, done = bgzf.uoffset_of(start), False
    source = bgzf.blocks(file, bgzf.coffset_of(start), threads=threads)
    while not done:
        while length < batch_bytes:
            found = next(source, None)
            if found is None:
                done = True
                break
            starts.append(length)
            coffsets.append(found[0])
            held.append(found[1])
            length += len(found[1])
            # the blocks behind the one that `end` lies in only finish the last record
            if end is not None and found[0] > bgzf.coffset_of(end):
                break
        frozen, n = b"".join(held), length
        s, c = np.array(starts, np.int64), np.array(coffsets, np.int64)
        at, pos = _record_starts(frozen, skip, s)
        last = bgzf.positions(s, c, np.array([pos]))[0] if len(s) else start
        reached_end = False
        if end is not None and len(s):
            # places grow with virtual offsets: a bound of the last block's is enough where it lies before the end
            inside = len(at) if last < end else int(np.searchsorted(bgzf.positions(s, c, at), end))
            reached_end = inside < len(at) or (pos < n and last >= end) or (pos >= n and c[-1] >= bgzf.coffset_of(end) and last >= end)
            at = at[:inside]
        if len(at):
            yield Chunk(frozen, at, s, c)
        if reached_end:
            return
        if done:
            if n - pos >= 4:
                raise EOFError("the file ends inside a record")
            return
        # keep what follows the last whole record
        keep = int(np.searchsorted(s, min(pos, n - 1), side="right")) - 1 if n else 0
        base = starts[keep] if starts else 0
        if pos >= n and n:
            held, starts, coffsets, skip, length = [], [], [], 0, 0
        elif n:
            held, skip, length = [frozen[base:]], pos - base, n - base
            starts, coffsets = [x - base for x in starts[keep:]], coffsets[keep:]
        if n - pos > 0 and length >= batch_bytes:
            batch_bytes *= 2  # one record is larger than a batch


def count_records(file, start: int, end: int | None, threads: int = 1) -> tuple[int, int]:
    """Records, and mapped ones, in a range: only lengths and flags are looked at."""
    total = mapped = 0
    for chunk in scan(file, start, end, COUNT_BYTES, threads):
        total += len(chunk.at)
        low = np.frombuffer(chunk.data, np.uint8)[chunk.at + 18]
        mapped += int(((low & 4) == 0).sum())
    return total, mapped


def flat(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices begin[i] .. begin[i] + lengths[i] - 1 of all i, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begin - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _strings(raw: np.ndarray, lengths: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    mask = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes()), mask)


def _names(buf: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> pa.Array:
    raw = buf[flat(begin, lengths)]
    null = (lengths == 0) | ((lengths == 1) & (buf[np.minimum(begin, len(buf) - 1)] == ord("*")))
    if len(raw) and raw.max() >= 128:
        ends = np.cumsum(lengths)
        for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
            try:
                raw[a:b].tobytes().decode()
            except UnicodeDecodeError:
                null[i] = True
    clean = np.where(null, 0, lengths)
    return _strings(raw[np.repeat(~null, lengths)], clean, null)


def _long_cigar(tags: bytes) -> list[int] | None:
    """The operations in a CG tag, if there is one."""
    at, sizes = 0, {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    while at + 3 <= len(tags):
        name, kind, at = tags[at : at + 2], chr(tags[at + 2]), at + 3
        if kind in "ZH":
            at = tags.index(0, at) + 1
        elif kind == "B":
            item, (n,) = chr(tags[at]), struct.unpack_from("<i", tags, at + 1)
            if name == b"CG" and item == "I":
                return list(struct.unpack_from(f"<{n}I", tags, at + 5))
            at += 5 + n * sizes[item]
        else:
            at += sizes[kind]
    return None


def _cigars(buf: np.ndarray, begin: np.ndarray, n_ops: np.ndarray, long_ops: dict[int, list[int]]) -> pa.Array:
    words = np.ascontiguousarray(buf[flat(begin, 4 * n_ops)]).view("<u4")
    kinds, at = np.unique(words, return_inverse=True)
    names = pa.array([f"{k >> 4}{CIGAR_OPS[k & 15]}" if (k & 15) < 9 else "?" for k in kinds.tolist()], pa.string())
    offsets = np.concatenate([[0], np.cumsum(n_ops)]).astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(at.astype(np.int32)))), "")
    texts = pc.if_else(pa.array(n_ops == 0), "*", texts)
    if long_ops:
        values = texts.to_pylist()
        for i, ops in long_ops.items():
            values[i] = "".join(f"{k >> 4}{CIGAR_OPS[k & 15]}" for k in ops)
        texts = pa.array(values, pa.string())
    return texts


def _sequences(buf: np.ndarray, begin: np.ndarray, l_seq: np.ndarray) -> pa.Array:
    shown = np.where(l_seq == 0, 1, l_seq)
    ends = np.cumsum(shown)
    base = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - shown, shown)
    packed = buf[np.minimum(np.repeat(begin, shown) + base // 2, len(buf) - 1)]
    text = np.frombuffer(BASES, np.uint8)[np.where(base % 2 == 0, packed >> 4, packed & 15)]
    text[np.repeat(l_seq == 0, shown)] = ord("*")
    return _strings(text, shown)


def fixed_fields(chunk: Chunk) -> np.ndarray:
    """The fixed fields of a chunk's records."""
    return np.ascontiguousarray(np.frombuffer(chunk.data, np.uint8)[chunk.at[:, None] + np.arange(36)]).view(FIXED).ravel()


def spans(chunk: Chunk, fixed: np.ndarray) -> np.ndarray:
    """Reference bases under each record. Where the CIGAR is in a tag, the field holds an operation of that length."""
    n_ops = fixed["n_cigar"].astype(np.int64)
    begin = chunk.at + 36 + fixed["l_name"]
    if (begin + 4 * n_ops > chunk.at + 4 + fixed["size"]).any():
        raise ValueError("a record's fields are longer than the record")
    words = np.ascontiguousarray(np.frombuffer(chunk.data, np.uint8)[flat(begin, 4 * n_ops)]).view("<u4")
    if (words & 15 > 8).any():
        raise ValueError("bad CIGAR")
    covered = np.where(np.array([c in "MDN=X" for c in CIGAR_OPS])[words & 15], words >> 4, 0).astype(np.int64)
    sums, ends = np.concatenate([[0], np.cumsum(covered)]), np.cumsum(n_ops)
    return sums[ends] - sums[ends - n_ops]


def decode(chunk: Chunk, wanted: list[str], split_id: int = 0) -> pa.RecordBatch:
    """Arrow columns of the records of a chunk; only the wanted ones are decoded."""
    buf = np.frombuffer(chunk.data, np.uint8)
    fixed = fixed_fields(chunk)
    l_name, n_cigar, l_seq = fixed["l_name"].astype(np.int64), fixed["n_cigar"].astype(np.int64), fixed["l_seq"].astype(np.int64)
    name_at = chunk.at + 36
    cigar_at = name_at + l_name
    seq_at = cigar_at + 4 * n_cigar
    qual_at = seq_at + (l_seq + 1) // 2
    tags_at = qual_at + l_seq
    ends = chunk.at + 4 + fixed["size"]
    if (tags_at > ends).any() or (l_seq < 0).any():
        raise ValueError("a record's fields are longer than the record")

    def blob(begin, lengths):
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf[flat(begin, lengths)].tobytes())])

    def cigars():
        few = np.flatnonzero(n_cigar == 2)
        first = {int(i): int(np.ascontiguousarray(buf[cigar_at[i] : cigar_at[i] + 4]).view("<u4")[0]) for i in few[tags_at[few] + 8 < ends[few]]}
        holders = [i for i, op in first.items() if op & 15 == 4 and op >> 4 == l_seq[i]]
        long_ops = {i: ops for i in holders if (ops := _long_cigar(buf[tags_at[i] : ends[i]].tobytes())) is not None}
        return _cigars(buf, cigar_at, n_cigar, long_ops)

    make = {
        "query_name": lambda: _names(buf, name_at, np.maximum(l_name - 1, 0)),
        "flag": lambda: pa.array(fixed["flag"].astype(np.int32)),
        "reference_id": lambda: pa.array(fixed["ref"], mask=fixed["ref"] < 0),
        "reference_start": lambda: pa.array(fixed["pos"].astype(np.int64), mask=fixed["pos"] < 0),
        "mapping_quality": lambda: pa.array(fixed["mapq"].astype(np.int32), mask=fixed["mapq"] == 255),
        "cigarstring": cigars,
        "query_sequence": lambda: _sequences(buf, seq_at, l_seq),
        "template_length": lambda: pa.array(fixed["tlen"]),
        "next_reference_id": lambda: pa.array(fixed["next_ref"], mask=fixed["next_ref"] < 0),
        "next_reference_start": lambda: pa.array(fixed["next_pos"].astype(np.int64), mask=fixed["next_pos"] < 0),
        "bin": lambda: pa.array(fixed["bin"].astype(np.int32)),
        "qualities": lambda: blob(qual_at, l_seq),
        "tags": lambda: blob(tags_at, ends - tags_at),
        "raw_name": lambda: blob(name_at, np.maximum(l_name - 1, 0)),
        "voffset": lambda: pa.array(chunk.voffsets),
        "split_id": lambda: pa.array(np.full(len(chunk.at), split_id, np.int32)),
    } | {name: (lambda mask=mask: pa.array((fixed["flag"] & mask) != 0)) for name, mask in FLAG_COLUMNS.items()}
    return pa.RecordBatch.from_arrays([make[c]() for c in wanted], wanted)


def region_bin(start: int, end: int) -> int:
    """The index bin of [start, end), by the binning scheme of the specification."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


_OP = {c: i for i, c in enumerate(CIGAR_OPS)}
_BASE = {chr(c): i for i, c in enumerate(BASES)}


def parse_cigar(text: str) -> list[int]:
    if text == "*":
        return []
    out, n = [], ""
    for c in text:
        if c.isdigit():
            n += c
        else:
            if c not in _OP or not n:
                raise ValueError(f"bad CIGAR {text!r}")
            out.append(int(n) << 4 | _OP[c])
            n = ""
    if n:
        raise ValueError(f"bad CIGAR {text!r}")
    return out


def reference_length(ops: list[int]) -> int:
    return sum(op >> 4 for op in ops if CIGAR_OPS[op & 15] in "MDN=X")


def encode_record(row: dict) -> bytes:
    """A record of a row of the schema. Fields that are missing have the format's value for absent."""
    raw = row.get("raw_name")
    name = row.get("query_name")
    # a name that is not UTF-8 is null as text and kept as bytes
    body = name.encode() if name is not None else bytes(raw) if raw else b"*"
    if not 1 <= len(body) <= 254 or b"\0" in body:
        raise ValueError(f"a read name has {len(body)} bytes; 1 to 254 without NUL are allowed")
    ops, tags = parse_cigar(row.get("cigarstring") or "*"), bytes(row.get("tags") or b"")
    seq = row.get("query_sequence") or "*"
    seq = "" if seq == "*" else seq
    start = row.get("reference_start")
    pos = -1 if start is None else start
    span = reference_length(ops)
    if len(ops) > 65535:
        if _long_cigar(tags) is None:
            tags += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [len(seq) << 4 | 4, span << 4 | 3]
    number = row.get("bin")
    if number is None:
        number = region_bin(pos, pos + max(span, 1)) if pos >= 0 else 4680
    try:
        nibbles = [_BASE[c] for c in seq.upper()] + [0] * (len(seq) % 2)
    except KeyError as e:
        raise ValueError(f"no base {e.args[0]!r}") from None
    packed = bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2]))
    qualities = bytes(row.get("qualities") or b"\xff" * len(seq))
    if len(qualities) != len(seq):
        raise ValueError("qualities and sequence differ in length")
    absent = lambda v: -1 if v is None else v
    quality = row.get("mapping_quality")
    fixed = struct.pack(
        "<iiBBHHHiiii", absent(row.get("reference_id")), pos, len(body) + 1, 255 if quality is None else quality, number, len(ops), row.get("flag") or 0, len(seq), absent(row.get("next_reference_id")), absent(row.get("next_reference_start")), row.get("template_length") or 0
    )
    record = b"".join([fixed, body, b"\0", struct.pack(f"<{len(ops)}I", *ops), packed, qualities, tags])
    return struct.pack("<i", len(record)) + record


_NIBBLE = np.full(256, 255, np.uint8)
for _i, _c in enumerate(BASES.decode()):
    _NIBBLE[ord(_c)] = _NIBBLE[ord(_c.lower())] = _i


def _bytes_of(column: pa.Array, empty: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes, end to end, and lengths; nulls count as `empty`."""
    column = pc.fill_null(column.cast(pa.binary()), pa.scalar(empty, pa.binary()))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], np.diff(offsets)


def _bins(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """`region_bin` of many regions."""
    last, out = end - 1, np.zeros(len(start), np.int64)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = np.where(start >> shift == last >> shift, first + (start >> shift), out)
    return out


def encode_batch(batch: pa.RecordBatch) -> bytes:
    """Records of a batch, as `encode_record` encodes each row."""
    return encode_records(batch)[0]


def encode_records(batch: pa.RecordBatch) -> tuple[bytes, np.ndarray]:
    """Records of a batch, and where each one ends."""
    n, names = batch.num_rows, set(batch.schema.names)
    if not n:
        return b"", np.empty(0, np.int64)

    def number(name: str, absent: int) -> np.ndarray:
        if name not in names:
            return np.full(n, absent, np.int64)
        return pc.fill_null(batch.column(name).cast(pa.int64()), absent).to_numpy(zero_copy_only=False)

    def text(name: str) -> pa.Array:
        return batch.column(name) if name in names else pa.nulls(n, pa.binary())

    raw = text("raw_name").cast(pa.binary())
    raw = pc.if_else(pc.equal(pc.binary_length(raw), 0), pa.scalar(None, pa.binary()), raw)
    name, l_name = _bytes_of(pc.coalesce(text("query_name").cast(pa.binary()), raw), b"*")
    if (l_name < 1).any() or (l_name > 254).any() or (name == 0).any():
        raise ValueError("a read name has 1 to 254 bytes without NUL")

    cigars = pc.fill_null(text("cigarstring").cast(pa.string()), "*").dictionary_encode()
    parsed = [parse_cigar(c or "*") for c in cigars.dictionary.to_pylist()]
    if any(len(ops) > 65535 for ops in parsed):
        own = [encode_record(r) for r in batch.to_pylist()]
        return b"".join(own), np.cumsum([len(r) for r in own])
    which = cigars.indices.to_numpy()
    ops_each = np.array([len(p) for p in parsed], np.int64)
    words = np.array([op for p in parsed for op in p], "<u4")
    n_ops = ops_each[which]
    ops = words[flat((np.cumsum(ops_each) - ops_each)[which], n_ops)]
    spans = np.array([reference_length(p) for p in parsed], np.int64)[which]

    seq, l_seq = _bytes_of(text("query_sequence"), b"*")
    star = (l_seq == 1) & (seq[np.minimum(np.cumsum(l_seq) - l_seq, len(seq) - 1)] == ord("*"))
    seq, l_seq = seq[np.repeat(~star, l_seq)], np.where(star, 0, l_seq)
    if (_NIBBLE[seq] == 255).any():
        raise ValueError(f"no base {chr(int(seq[_NIBBLE[seq] == 255][0]))!r}")
    n_packed = (l_seq + 1) // 2
    ends = np.cumsum(2 * n_packed)
    nibbles = np.zeros(int(ends[-1]), np.uint8)
    nibbles[flat(ends - 2 * n_packed, l_seq)] = _NIBBLE[seq]
    packed = nibbles[::2] << 4 | nibbles[1::2]

    quality, l_quality = _bytes_of(text("qualities"))
    missing = (l_quality == 0) & (l_seq > 0)
    if (l_quality[~missing] != l_seq[~missing]).any():
        raise ValueError("qualities and sequence differ in length")
    qualities = np.full(int(l_seq.sum()), 255, np.uint8)
    qualities[flat((np.cumsum(l_seq) - l_seq)[~missing], l_seq[~missing])] = quality
    tags, l_tags = _bytes_of(text("tags"))

    fixed = np.zeros(n, FIXED)
    pos = number("reference_start", -1)
    computed = np.where(pos >= 0, _bins(pos, pos + np.maximum(spans, 1)), 4680)
    bins = number("bin", -1)
    sizes = 32 + l_name + 1 + 4 * n_ops + n_packed + l_seq + l_tags
    values = {"size": sizes, "ref": number("reference_id", -1), "pos": pos, "l_name": l_name + 1, "mapq": number("mapping_quality", 255), "bin": np.where(bins < 0, computed, bins), "n_cigar": n_ops, "flag": number("flag", 0), "l_seq": l_seq, "next_ref": number("next_reference_id", -1), "next_pos": number("next_reference_start", -1), "tlen": number("template_length", 0)}
    for field_name, v in values.items():
        limits = np.iinfo(FIXED[field_name])
        if len(v) and (v.min() < limits.min or v.max() > limits.max):
            raise ValueError(f"{field_name} is out of range")
        fixed[field_name] = v
    out = np.zeros(int((sizes + 4).sum()), np.uint8)
    at = np.cumsum(sizes + 4) - sizes - 4
    for data, lengths in ((fixed.view(np.uint8), np.full(n, 36)), (name, l_name), (None, np.ones(n, np.int64)), (ops.view(np.uint8), 4 * n_ops), (packed, n_packed), (qualities, l_seq), (tags, l_tags)):
        if data is not None:
            out[flat(at, lengths)] = data
        at = at + lengths
    return out.tobytes(), np.cumsum(sizes + 4)
