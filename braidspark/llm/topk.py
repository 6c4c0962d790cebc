"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector's segments have a mean and a deviation (the root of the summed squares of what is left of its
mean). For a query q and a vector x cut into the same segments of m components,

    <q, x>  =  sum over segments of  m * mean(q) * mean(x) + <rest of q, rest of x>
            <= sum over segments of  m * mean(q) * mean(x) + dev(q) * dev(x),

an upper bound of the product, that is, with |q|^2 + |x|^2 - 2 <q, x>, a lower bound of the squared distance. The
bounds of coarse segments are cheap; pairs that may still reach the query's k-th score go on to finer segments, down to
segments of two components, and only the survivors get the exact integer product. Where more than a share of DENSE of a
block's pairs are alive, a step is one matrix product of the block; else the pairs are gathered. Which of the levels pay is
measured on a pilot: a coarse level that rules out less than a share of PAYS of the pairs that reach it is left out, the
finest level never is. (Vectors whose components are alike and independent are the method's worst case: on the
driver's embeddings the coarse levels rule out nothing and the finest one most pairs.)

Queries are taken in chunks of at most about QUERY_BYTES, one after another: a chunk is collected, broadcast, meets all
candidates in a map-side scan, block by block, and is released when its part is written. A query's k-th score so far starts
from its exact scores against a pilot of about PILOT candidates chosen by hash, and rises
as a task goes on. A task returns at most 2 k rows for each query; the k best of those are the result. Queries that are
a fixed share of the rows make the work grow with the square of the rows, whatever is pruned.

Scores are exact: components whose products could leave the 53 bits of a double are split into limbs, whose matrix
products are exact, and summed up as whole numbers of any size.

Edge cases: vectors that are null or hold null or non-finite components take no part; vectors are only
compared with vectors of their length (an empty vector scores 0); ties go to the smaller vec_id; rows with a null vec_id
take no part; rows with equal vec_id are each candidates, and queries, of their own, and a query's
own row is every row with its vec_id; an empty table gives no rows. A score beyond 64 bits is given as the least or greatest
long, and ties there go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidspark.llm.common import materialize

#: Of the queries that one broadcast holds, as doubles.
QUERY_BYTES = 32 << 20
QUERY_BLOCK = 256
CANDIDATE_BLOCK = 2048
PILOT = 4096
SCALE = 256
DENSE, PAYS = 1 / 16, 1 / 10
RESULT = "query_id long, copy long, vec_id long, score long"


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (array of doubles) of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long"), x.cast("array<double>").alias("x"))


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): whole numbers, as doubles. SCALE is a power of two; what it takes beyond the largest double stays there."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * x))


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row: sqrt(m) * mean and deviation of each segment; the product of two rows' statistics bounds theirs."""
    bounds = np.linspace(0, x.shape[1], segments + 1).astype(int)
    sizes = np.diff(bounds)
    mean = np.add.reduceat(x, bounds[:-1], axis=1) / sizes
    rest = (x - np.repeat(mean, sizes, axis=1)) ** 2
    return np.concatenate([mean * np.sqrt(sizes), np.sqrt(np.add.reduceat(rest, bounds[:-1], axis=1))], axis=1)


def _levels(dim: int) -> list[int]:
    return sorted({s for s in (1, 4, 16, dim // 2) if 0 < s < dim})


def _slack(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """More than rounding can take from a bound."""
    return 1e-6 * (1 + np.sqrt((queries**2).sum(axis=1) * max((x**2).sum(axis=1).max(initial=0), 1)))


def paying_levels(query_ids, queries, floor, ids, x) -> list[int]:
    """The levels worth their cost, by the pairs of a pilot that each rules out."""
    alive = (query_ids[:, None] != ids[None, :]) if len(x) else np.zeros((0, 0), bool)
    slack, levels, out = _slack(queries, x), _levels(queries.shape[1]), []
    for s in levels:
        still = alive & (_statistics(queries, s) @ _statistics(x, s).T + slack[:, None] >= floor[:, None]) if alive.size else alive
        if s == levels[-1] or alive.sum() - still.sum() >= PAYS * alive.sum():
            out.append(s)
            alive = still
    return out


def search_block(query_ids, queries, floor, ids, x, k, stats):
    """(query row, candidate row, score) of each query's k best in a block. floor: its k-th score so far (-inf: none).

    stats: (segments, statistics of the queries, of the candidates) of each level, coarse to fine.
    """
    alive = query_ids[:, None] != ids[None, :]
    slack, pairs = _slack(queries, x), None
    for of_queries, of_candidates in [*stats, (queries, x)]:
        spare = slack if of_queries is not queries else 0 * slack
        if pairs is None:
            bound = of_queries @ of_candidates.T
            alive &= bound + spare[:, None] >= floor[:, None]
            if np.count_nonzero(alive) <= DENSE * alive.size or of_queries is queries:
                pairs = np.nonzero(alive)
                bound = bound[pairs]
        else:
            rows, cols = pairs
            bound = np.empty(len(rows))
            for a in range(0, len(rows), 1 << 14):
                r, c = rows[a : a + (1 << 14)], cols[a : a + (1 << 14)]
                bound[a : a + (1 << 14)] = np.einsum("ij,ij->i", of_queries[r], of_candidates[c])
            keep = bound + spare[rows] >= floor[rows]
            pairs, bound = (rows[keep], cols[keep]), bound[keep]
    return _best(*pairs, bound, ids, k)


def _best(rows, cols, scores, ids, k):
    """The k best of every query row, ties to the smaller id."""
    order = np.lexsort((ids[cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[top], cols[top], scores[top]


def _limit(dim: int) -> float:
    """Products of vectors of smaller components stay in the 53 bits of a double."""
    return float(int((2.0**53 / max(dim, 1)) ** 0.5))


def whole_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products (Python's integers) of rows of whole numbers of any size."""
    bits = int(np.log2(_limit(q.shape[1])))

    def limbs(v):
        out = []
        while not out or v.any():
            high = np.trunc(v / 2.0**bits)
            out.append(v - high * 2.0**bits)
            v = high
        return out

    total = np.zeros((len(q), len(x)), object)
    right = limbs(x)
    for i, a in enumerate(limbs(q)):
        for j, b in enumerate(right):
            total += (a @ b.T).astype(np.int64).astype(object) << (bits * (i + j))
    return total


def _search_large(query_ids, q, ids, x, k):
    """(query row, candidate row, score) of each query's k best of the candidates, by products of any size."""
    out = []
    for a in range(0, len(q), QUERY_BLOCK):
        for c in range(0, len(x), CANDIDATE_BLOCK):
            products = whole_products(q[a : a + QUERY_BLOCK], x[c : c + CANDIDATE_BLOCK])
            for i, row in enumerate(products.tolist()):
                own = [(-min(max(v, -(2**63)), 2**63 - 1), ids[c + j], j) for j, v in enumerate(row) if ids[c + j] != query_ids[a + i]]
                out += [(a + i, c + j, -score) for score, _, j in heapq.nsmallest(k, own)]
    out.sort(key=lambda r: (r[0], -r[2], ids[r[1]]))
    seen: dict[int, int] = {}
    kept = [r for r in out if seen.setdefault(r[0], 0) < k and not seen.update({r[0]: seen[r[0]] + 1})]
    return tuple(np.array([r[i] for r in kept], np.int64) for i in range(3))


def _matrices(table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of the vectors: their ids, a matrix of them, scaled, and which of them have large components."""
    ids, lists = table.column("vec_id").to_numpy(zero_copy_only=False), table.column("x")
    lengths = np.diff(lists.offsets.to_numpy())
    flat, at = scaled(lists.flatten().to_numpy(zero_copy_only=False)), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    out = {}
    for d in np.unique(lengths).tolist():
        m = np.flatnonzero(lengths == d)
        x = flat[at[m][:, None] + np.arange(d)[None, :]].reshape(len(m), d)
        out[d] = ids[m], x, (np.abs(x) >= _limit(d)).any(axis=1)
    return out


@dataclass
class Queries:
    """Of one length: ids and numbers of the queries, their vectors, scores to reach, and the levels that pay."""

    ids: np.ndarray
    copies: np.ndarray
    x: np.ndarray
    floors: np.ndarray
    levels: list[int]


def _search(shared, k: int):
    """Each query's k best among a task's candidates, at or above its pilot's k-th score."""

    def run(batches):
        small, large = shared.value
        floors = {dim: own.floors.copy() for dim, own in small.items()}
        best: dict[tuple[int, int], tuple] = {}
        of_queries: dict[tuple[int, int], list] = {}
        found = []
        for batch in batches:
            for dim, (ids, x, big) in _matrices(batch).items():
                for own, rows in ((large.get(dim), slice(None)), (small.get(dim), big)):
                    if own is not None and len(ids[rows]):
                        r, c, scores = _search_large(own.ids, own.x, ids[rows], x[rows], k)
                        found.append((own.ids[r], own.copies[r], ids[rows][c], scores))
                if dim not in small:
                    continue
                own, floor, ids, x = small[dim], floors[dim], ids[~big], x[~big]
                for c in range(0, len(x), CANDIDATE_BLOCK):
                    block_ids, block = ids[c : c + CANDIDATE_BLOCK], x[c : c + CANDIDATE_BLOCK]
                    stats = [_statistics(block, s) for s in own.levels]
                    for a in range(0, len(own.x), QUERY_BLOCK):
                        part = slice(a, a + QUERY_BLOCK)
                        if (dim, a) not in of_queries:
                            of_queries[dim, a] = [_statistics(own.x[part], s) for s in own.levels]
                        rows, cols, scores = search_block(own.ids[part], own.x[part], floor[part], block_ids, block, k, list(zip(of_queries[dim, a], stats)))
                        had = best.get((dim, a), (np.empty(0, int), np.empty(0, np.int64), np.empty(0)))
                        rows, vecs, scores = (np.concatenate(z) for z in zip(had, (rows, block_ids[cols], scores)))
                        rows, at, scores = _best(rows, np.arange(len(rows)), scores, vecs, k)
                        best[dim, a] = rows, vecs[at], scores
                        last = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows) == k - 1)
                        floor[a + rows[last]] = np.maximum(floor[a + rows[last]], scores[last])
        found += [(small[dim].ids[a + rows], small[dim].copies[a + rows], vecs, scores.astype(np.int64)) for (dim, a), (rows, vecs, scores) in best.items()]
        for columns in found:
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in columns], ["query_id", "copy", "vec_id", "score"])

    return run


def _prepared(chunk, pilot: dict, first: int, k: int) -> tuple[dict[int, Queries], dict[int, Queries]]:
    """A chunk's queries by length, those with large components apart; copies are numbered from `first`."""
    small, large = {}, {}
    for dim, (ids, q, big) in _matrices(chunk).items():
        copies, floors, levels = first + np.arange(len(ids)), np.full(len(ids), -np.inf), _levels(dim)
        first += len(ids)
        pilot_ids, x, pilot_big = pilot.get(dim, (np.empty(0, np.int64), np.empty((0, dim)), np.empty(0, bool)))
        pilot_ids, x = pilot_ids[~pilot_big], x[~pilot_big]
        for a in range(0, len(ids) if len(x) > k else 0, QUERY_BLOCK):
            own = slice(a, a + QUERY_BLOCK)
            known = np.where(ids[own, None] == pilot_ids[None, :], -np.inf, q[own] @ x.T)
            floors[own] = np.partition(known, -k, axis=1)[:, -k]
        if len(x) > k:
            levels = paying_levels(ids[~big][:QUERY_BLOCK], q[~big][:QUERY_BLOCK], floors[~big][:QUERY_BLOCK], pilot_ids, x)
        for out, rows in ((small, ~big), (large, big)):
            if rows.any():
                out[dim] = Queries(ids[rows], copies[rows], q[rows], floors[rows], levels)
    return small, large


def top_k(embeddings: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query among all other rows.

    is_query: a condition on vec_id.
    """
    spark = embeddings.sparkSession
    rows = materialize(usable(embeddings), "vectors")
    n, n_queries, n_bytes = rows.agg(F.count("*"), F.count_if(is_query), F.sum(F.when(is_query, 8 * F.size("x") + 64))).first()
    share = max(1, n // PILOT)
    pilot = _matrices(_one(rows.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(share)) == 0).limit(2 * PILOT)))
    n_chunks = -(-(n_bytes or 0) // QUERY_BYTES)
    found = spark.createDataFrame([], RESULT)
    for c in range(n_chunks):
        chunk = _one(rows.where(is_query & (F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks)) == c)))
        shared = spark.sparkContext.broadcast(_prepared(chunk, pilot, c << 32, k))
        part = materialize(rows.mapInArrow(_search(shared, k), RESULT), "neighbours")
        found = part if n_chunks == 1 else found.unionByName(part)
        shared.unpersist()
    best = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _one(rows: DataFrame) -> pa.RecordBatch:
    """A bounded table, collected in one record batch."""
    table = rows.toArrow().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)
