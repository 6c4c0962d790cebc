"""BGZF: gzip members of at most 64 KiB, addressed by virtual offsets (public SAM/BAM specification)."""

from __future__ import annotations

import ctypes
import ctypes.util
import struct
import threading
import zlib
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np

#: Fixed value of the format: the empty block that ends a file.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Most bytes that a writer puts in a block.
PAYLOAD = 0xFF00
READ_BYTES = 4 << 20
#: A writer notes where records begin once in so many bytes at most.
SPOT_BYTES = 256 << 10
#: Deflate data grows no more than so many times.
MOST_FOLD = 1032
#: Most bytes of deflate data that a block's size, of 16 bits, has room for.
MOST_BODY = 0xFFFF - 25
MAX_COFFSET = (1 << 48) - 1


def voffset(coffset: int, uoffset: int) -> int:
    return coffset << 16 | uoffset


def coffset_of(v: int) -> int:
    return v >> 16


def uoffset_of(v: int) -> int:
    return v & 0xFFFF


def block_size(data: bytes | memoryview, at: int) -> int | None:
    """Bytes of the block that begins at `at`; None if its header is not all there."""
    if len(data) - at < 18:
        return None
    if bytes(data[at : at + 4]) != b"\x1f\x8b\x08\x04":
        raise ValueError(f"no BGZF block at byte {at}")
    (extra,) = struct.unpack_from("<H", data, at + 10)
    pos, end = at + 12, at + 12 + extra
    if len(data) < end:
        return None
    while pos + 4 <= end:
        tag, length = bytes(data[pos : pos + 2]), struct.unpack_from("<H", data, pos + 2)[0]
        if tag == b"BC":
            return struct.unpack_from("<H", data, pos + 4)[0] + 1
        pos += 4 + length
    raise ValueError(f"block at byte {at} has no size")


class _Deflate:
    """The system's libdeflate, where there is one: two to three times as fast as zlib, with the same results."""

    def __init__(self):
        lib = ctypes.CDLL(ctypes.util.find_library("deflate") or "libdeflate.so.0")
        lib.libdeflate_alloc_decompressor.restype = ctypes.c_void_p
        lib.libdeflate_deflate_decompress.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t, ctypes.c_void_p, ctypes.c_size_t, ctypes.c_void_p]
        lib.libdeflate_crc32.argtypes = [ctypes.c_uint32, ctypes.c_void_p, ctypes.c_size_t]
        lib.libdeflate_crc32.restype = ctypes.c_uint32
        lib.libdeflate_alloc_compressor.argtypes = [ctypes.c_int]
        lib.libdeflate_alloc_compressor.restype = ctypes.c_void_p
        lib.libdeflate_deflate_compress.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t, ctypes.c_void_p, ctypes.c_size_t]
        lib.libdeflate_deflate_compress.restype = ctypes.c_size_t
        self.lib, self.local = lib, threading.local()

    def inflate(self, body: np.ndarray, size: int, crc: int) -> bytearray | None:
        """The data of a deflate stream; None if it does not fit its size and checksum."""
        if not hasattr(self.local, "own"):
            self.local.own = self.lib.libdeflate_alloc_decompressor()
        out = bytearray(size)
        at = (ctypes.c_char * size).from_buffer(out) if size else None
        # without a place for the true size, any other size is an error
        if self.lib.libdeflate_deflate_decompress(self.local.own, body.ctypes.data, len(body), at, size, None):
            return None
        return out if self.lib.libdeflate_crc32(0, at, size) == crc else None

    def deflate(self, data: bytes, level: int) -> bytes | None:
        """A deflate stream of the data; None if it would not fit a block, or for a level that is not known."""
        packers = self.local.__dict__.setdefault("packers", {})
        if level not in packers:
            packers[level] = self.lib.libdeflate_alloc_compressor(level)
            self.local.room = ctypes.create_string_buffer(MOST_BODY)
        if not packers[level]:
            return None
        n = self.lib.libdeflate_deflate_compress(packers[level], data, len(data), self.local.room, MOST_BODY)
        return ctypes.string_at(self.local.room, n) if n else None


def _deflate() -> _Deflate | None:
    try:
        return _Deflate()
    except (OSError, AttributeError):
        return None


_DEFLATE = _deflate()


def inflate_block(block: bytes | memoryview) -> bytes | bytearray:
    (extra,) = struct.unpack_from("<H", block, 10)
    crc, size = struct.unpack_from("<II", block, len(block) - 8)
    body = block[12 + extra : len(block) - 8]
    if size > MOST_FOLD * (len(body) + 1):
        raise ValueError(f"a BGZF block of {len(body)} bytes cannot hold {size}")
    if _DEFLATE:
        data = _DEFLATE.inflate(np.frombuffer(body, np.uint8), size, crc)
    else:
        data = zlib.decompress(body, -15, max(size, 1))
        data = data if len(data) == size and zlib.crc32(data) == crc else None
    if data is None:
        raise ValueError("a BGZF block's checksum or size does not fit its data")
    return data


def deflate_block(data: bytes | memoryview, level: int = 6) -> bytes:
    body = _DEFLATE.deflate(bytes(data), level) if _DEFLATE else None
    if body is None:
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(file, coffset: int, read_bytes: int = READ_BYTES, threads: int = 1) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of the blocks from `coffset` to the end of the file. A file may end after any block.

    threads: how many inflate blocks at once, ahead of the reader.
    """
    if threads > 1:
        with ThreadPoolExecutor(threads) as pool:
            pending = deque()
            for at, block in packed_blocks(file, coffset, read_bytes):
                pending.append((at, pool.submit(inflate_block, block)))
                if len(pending) >= 16 * threads:
                    at, done = pending.popleft()
                    yield at, done.result()
            for at, done in pending:
                yield at, done.result()
        return
    for at, block in packed_blocks(file, coffset, read_bytes):
        yield at, inflate_block(block)


def packed_blocks(file, coffset: int, read_bytes: int = READ_BYTES) -> Iterator[tuple[int, memoryview]]:
    """(offset, block) from `coffset` to the end of the file, not inflated."""
    file.seek(coffset)
    data, at = b"", 0
    while True:
        size = block_size(data, at)
        if size is None or len(data) - at < size:
            more = file.read(read_bytes)
            if not more:
                if len(data) > at:
                    raise EOFError(f"the file ends inside the block at byte {coffset}")
                return
            data, at = data[at:] + more, 0
            continue
        yield coffset, memoryview(data)[at : at + size]
        at += size
        coffset += size


class BlockWriter:
    """Packs bytes into blocks of at most `payload` bytes. `cut()` ends a block early."""

    def __init__(self, file, payload: int = PAYLOAD, level: int = 6):
        self.file, self.payload, self.level = file, payload, level
        self.pending, self.coffset = bytearray(), 0
        #: Blocks, SPOT_BYTES apart at least, that begin with a record.
        self.spots: list[int] = []

    def tell(self) -> int:
        return voffset(self.coffset, len(self.pending))

    def write(self, data: bytes) -> None:
        self.pending += data
        while len(self.pending) >= self.payload:
            self._put(self.payload)

    def write_records(self, data: bytes, ends: np.ndarray) -> None:
        """Write records that end at `ends`, each block with whole ones, but for those that no block can hold."""
        view, start = memoryview(data), 0
        while start < len(data):
            room = start + self.payload - len(self.pending)
            fit = int(np.searchsorted(ends, room, side="right"))
            end = int(ends[fit - 1]) if fit else 0
            if end > start:
                self._note()
                self.write(view[start:end])
                start = end
            elif self.pending:
                self.cut()
            else:
                end = int(ends[fit])
                self._note()
                self.write(view[start:end])
                self.cut()
                start = end

    def _note(self) -> None:
        if not self.pending and (not self.spots or self.coffset - self.spots[-1] >= SPOT_BYTES):
            self.spots.append(self.coffset)

    def _put(self, n: int) -> None:
        block = deflate_block(bytes(self.pending[:n]), self.level)
        self.file.write(block)
        self.coffset += len(block)
        del self.pending[:n]

    def cut(self) -> None:
        while self.pending:
            self._put(min(len(self.pending), self.payload))

    def finish(self, eof: bool = True) -> None:
        self.cut()
        if eof:
            self.file.write(EOF_BLOCK)


def positions(starts: np.ndarray, coffsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Virtual offsets of places `at` in data whose blocks begin at `starts` there and at `coffsets` in the file."""
    block = np.searchsorted(starts, at, side="right") - 1
    return coffsets[block] << 16 | (at - starts[block])
