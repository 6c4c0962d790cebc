"""Split planning: linear index -> intervals of virtual offsets -> at most n chunks of like compressed size.

Pure functions on the driver; an interval is a half-open pair of virtual offsets. Where the index is missing or has too
few entries to cut the file, the whole file is one interval, so that small files work like large ones.
"""

from __future__ import annotations

from braidspark.sources.bgzf import EOF_BLOCK, MAX_COFFSET, coffset_of, voffset

Interval = tuple[int, int]


def reduce_offsets(offsets: list[int]) -> list[int]:
    """The smallest virtual offset of every block, in order."""
    least: dict[int, int] = {}
    for v in offsets:
        if coffset_of(v) > MAX_COFFSET:
            raise ValueError(f"virtual offset {v} is out of range")
        least[coffset_of(v)] = min(v, least.get(coffset_of(v), v))
    return sorted(least.values())


def intervals(offsets: list[int]) -> list[Interval]:
    """Neighbouring reduced offsets; none if there are fewer than two."""
    reduced = reduce_offsets(offsets)
    return list(zip(reduced, reduced[1:]))


def whole_file(pairs: list[Interval], first_record: int, size: int) -> list[Interval]:
    """The intervals stretched to the whole file: from the first record to the block that ends it."""
    end = voffset(max(size - len(EOF_BLOCK), 0), 0)
    if not pairs:
        return [(first_record, max(end, first_record))]
    out = [(max(a, first_record), b) for a, b in pairs if b > first_record]
    if not out:
        return [(first_record, max(end, first_record))]
    out[0] = (first_record, out[0][1])
    if coffset_of(out[-1][1]) < coffset_of(end):
        out.append((out[-1][1], end))
    return out


def merge_intervals(pairs: list[Interval], most: int) -> list[Interval]:
    """At most `most` chunks of neighbouring intervals, each closed once it spans its share of compressed bytes."""
    if most < 1:
        raise ValueError("at least one split is needed")
    if len(pairs) <= most:
        return list(pairs)
    span = coffset_of(pairs[-1][1]) - coffset_of(pairs[0][0])
    share = -(-span // most)
    out, start = [], pairs[0][0]
    for a, b in pairs:
        if coffset_of(b) - coffset_of(start) >= share or b == pairs[-1][1]:
            out.append((start, b))
            start = b
    return out


def plan(offsets: list[int], first_record: int, size: int, most: int) -> list[Interval]:
    """Splits of a file. The last one is open-ended in effect: what precedes the end block belongs to it."""
    return merge_intervals(whole_file(intervals(offsets), first_record, size), most)
