"""BAI indexes: the linear index for split planning, and a writer (public SAM/BAM specification); splitting indexes of written files."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from braidspark.sources import bam, bgzf
from braidspark.sources.files import create_file, exists, open_file, remove, rename

MAGIC = b"BAI\x01"
WINDOW = 14
#: Magic, file size, digest and id (both left zero), records, granularity (0: uneven), offsets; after htsjdk's splitting index.
SPLITTING = struct.Struct("<4sQ16x16xQQQ")
SPLITTING_MAGIC = b"SBI\x01"


def read_linear_index(path: str) -> list[int]:
    """Virtual offsets of all references' linear indexes: repeats that follow each other dropped, then sorted."""
    found = [v for own in read_windows(path) for v in own]
    return sorted(v for i, v in enumerate(found) if i == 0 or v != found[i - 1])


def write_linear_index(path: str, offsets: list[int]) -> None:
    """An index of one reference without bins, for split planning alone."""
    with create_file(path) as f:
        f.write(MAGIC + struct.pack(f"<3i{len(offsets)}Q", 1, 0, len(offsets), *offsets))


def write_splitting(bam_path: str, size: int, records: int, offsets: list[int]) -> None:
    """Beside a BAM file of so many bytes, the virtual offsets to cut it at, where there are several; an old index goes."""
    path = f"{bam_path}.sbi"
    remove(path)
    if len(offsets) > 1:
        ends = [*offsets, bgzf.voffset(size, 0)]
        with create_file(f"{path}.new") as f:
            f.write(SPLITTING.pack(SPLITTING_MAGIC, size, records, 0, len(ends)) + struct.pack(f"<{len(ends)}Q", *ends))
        rename(f"{path}.new", path)


def read_splitting(bam_path: str, size: int) -> list[int]:
    """Virtual offsets to cut a BAM file of so many bytes at; none without an index, or with one of a file of another size."""
    path = f"{bam_path}.sbi"
    if not exists(path):
        return []
    with open_file(path) as f:
        data = f.read()
    if len(data) < SPLITTING.size:
        return []
    magic, own, _, _, n = SPLITTING.unpack_from(data)
    if magic != SPLITTING_MAGIC or own != size or len(data) != SPLITTING.size + 8 * n:
        return []
    return [v for v in struct.unpack_from(f"<{n}Q", data, SPLITTING.size) if bgzf.coffset_of(v) < size]


def read_windows(path: str) -> list[tuple[int, ...]]:
    """The linear index of each reference: the virtual offset of the first record that overlaps each window of 2^14 bases, 0 if none does."""
    with open_file(path) as f:
        data = f.read()
    if data[:4] != MAGIC:
        raise ValueError(f"{path} is not a BAI index")
    try:
        (n_ref,), at, found = struct.unpack_from("<i", data, 4), 8, []
        for _ in range(n_ref):
            (n_bin,) = struct.unpack_from("<i", data, at)
            at += 4
            for _ in range(n_bin):
                (n_chunk,) = struct.unpack_from("<i", data, at + 4)
                at += 8 + 16 * n_chunk
            (n_window,) = struct.unpack_from("<i", data, at)
            found.append(struct.unpack_from(f"<{n_window}Q", data, at + 4))
            at += 4 + 8 * n_window
    except struct.error:
        raise ValueError(f"{path} is cut short") from None
    return found


@dataclass
class Piece:
    """What an index says of some neighbouring records: runs (reference << 16 | bin, begin, end) and, for (reference << 32 | window), the first overlapping record."""

    first: int
    unplaced: int
    #: Of the first and last placed record, reference << 32 | position; empty if there is none.
    ends: np.ndarray
    runs: np.ndarray
    windows: np.ndarray
    #: Whether the last run goes up to the next piece, wherever that begins.
    reaches: bool

    def pack(self) -> bytes:
        head = np.array([self.first, self.unplaced, len(self.ends), len(self.runs), self.reaches], "<i8")
        return b"".join(x.astype("<i8").tobytes() for x in (head, self.ends, self.runs, self.windows))

    @classmethod
    def unpack(cls, data: bytes) -> Piece:
        all_ = np.frombuffer(data, "<i8")
        first, unplaced, n_ends, n_runs, reaches = all_[:5].tolist()
        ends, runs, windows = np.split(all_[5:], [n_ends, n_ends + 3 * n_runs])
        return cls(first, unplaced, ends, runs.reshape(-1, 3), windows.reshape(-1, 2), bool(reaches))


def piece_of(chunk: bam.Chunk) -> Piece:
    """The index of a chunk of one record at least."""
    fixed, v, n = bam.fixed_fields(chunk), chunk.voffsets, len(chunk.at)
    ref, pos = fixed["ref"].astype(np.int64), fixed["pos"].astype(np.int64)
    placed = (ref >= 0) & (pos >= 0)
    key = np.where(placed, ref << 16 | fixed["bin"], -1)
    turns = np.flatnonzero(key[1:] != key[:-1]) + 1
    # behind the last record, a place behind its start: chunks of an index may reach further
    runs = np.stack([key[np.append(0, turns)], v[np.append(0, turns)], np.append(v[turns], v[-1] + int(fixed["size"][-1]) + 4)], axis=1)
    order = (ref << 32 | pos)[placed]
    if (order[1:] < order[:-1]).any():
        raise ValueError("the file is not sorted by coordinate")
    low = pos >> WINDOW
    high = pos + np.maximum(bam.spans(chunk, fixed), 1) - 1 >> WINDOW
    # neighbours over the same windows add nothing
    new = np.append(True, (ref[1:] != ref[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | ~placed[:-1]) & placed
    ref, low, v_new, counts = ref[new], low[new], v[new], (high - low + 1)[new]
    windows, at = np.unique(np.repeat(ref << 32, counts) | bam.flat(low, counts), return_index=True)
    return Piece(int(v[0]), int((fixed["ref"] < 0).sum()), order[[0, -1]] if len(order) else order, runs[runs[:, 0] >= 0], np.stack([windows, np.repeat(v_new, counts)[at]], axis=1), bool(key[n - 1] >= 0))


def join(pieces: list[Piece]) -> Piece:
    """One piece of neighbouring ones, in their order."""
    if not pieces:
        return Piece(0, 0, np.empty(0, np.int64), np.empty((0, 3), np.int64), np.empty((0, 2), np.int64), False)
    ends = np.concatenate([p.ends for p in pieces])
    if (ends[1:] < ends[:-1]).any():
        raise ValueError("the file is not sorted by coordinate")
    parts = [p.runs.copy() for p in pieces]
    for own, piece, after in zip(parts, pieces, pieces[1:]):
        if piece.reaches:
            own[-1, 2] = after.first
    runs = np.concatenate(parts)
    if len(runs):
        apart = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] > runs[:-1, 2])
        begins = np.flatnonzero(np.append(True, apart))
        runs = np.stack([runs[begins, 0], runs[begins, 1], runs[np.append(begins[1:], len(runs)) - 1, 2]], axis=1)
    windows = np.concatenate([p.windows for p in pieces])
    _, at = np.unique(windows[:, 0], return_index=True)
    return Piece(pieces[0].first, sum(p.unplaced for p in pieces), ends[[0, -1]] if len(ends) else ends, runs, windows[at], pieces[-1].reaches)


def index_range(file, start: int, end: int | None) -> Piece | None:
    """The index of the records of a range of virtual offsets; None if there are none."""
    pieces = [piece_of(c) for c in bam.scan(file, start, end)]
    return join(pieces) if pieces else None


def write_index(bai_path: str, n_references: int, piece: Piece) -> str:
    bins: list[list[bytes]] = [[] for _ in range(n_references)]
    keys, at = np.unique(np.sort(piece.runs[:, 0]), return_index=True)
    runs = piece.runs[np.argsort(piece.runs[:, 0], kind="stable"), 1:]
    for key, own in zip(keys.tolist(), np.split(runs, at[1:])):
        bins[key >> 16].append(struct.pack("<Ii", key & 0xFFFF, len(own)) + own.astype("<u8").tobytes())
    out, refs = [MAGIC, struct.pack("<i", n_references)], piece.windows[:, 0] >> 32
    for i, own in enumerate(bins):
        windows = piece.windows[refs == i]
        numbers = windows[:, 0] & 0xFFFFFFFF
        linear = np.zeros(int(numbers.max()) + 1 if len(numbers) else 0, "<u8")
        linear[numbers] = windows[:, 1]
        out += [struct.pack("<i", len(own)), *own, struct.pack("<i", len(linear)), linear.tobytes()]
    out.append(struct.pack("<Q", piece.unplaced))
    with create_file(bai_path) as f:
        f.write(b"".join(out))
    return bai_path


def build_index(bam_path: str, bai_path: str | None = None) -> str:
    """Index a coordinate-sorted BAM by one sequential pass; `api.build_index` does it by the executors."""
    with open_file(bam_path) as f:
        header, first = bam.read_header(f)
        piece = index_range(f, first, None)
    return write_index(bai_path or f"{bam_path}.bai", len(header.references), piece or join([]))


def debug_rows(path: str) -> list[tuple[int, int, int]]:
    """voffset, block, in-block offset of every entry."""
    return [(v, bgzf.coffset_of(v), bgzf.uoffset_of(v)) for v in read_linear_index(path)]
