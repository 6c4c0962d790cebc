"""Connected components by alternating large-star and small-star steps on an edge table.

Every round is two joins and a distinct on (src, dst); nothing is collected but a count and a checksum.
A hub's neighbours meet in a sort-merge join on the hub, which Spark splits when it is skewed, and its minimum
is aggregated map-side. Rounds grow with the logarithm of the number of nodes; each round's edges
are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidspark.llm.common import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m"))
    least = least.select(F.col("src").alias("s"), F.least("src", "m").alias("m"))
    return both.join(least, F.col("src") == F.col("s")).where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("s"), "m")
    moved = down.join(least, F.col("src") == F.col("s")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select(F.col("s").alias("src"), F.col("m").alias("dst"))).where(F.col("src") != F.col("dst")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.bit_xor(F.xxhash64("dst", "src"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of it) of every node of an edge (src, dst) with src != dst.

    Self-loops and nulls are ignored, repeated edges do not matter; no edges give no rows.
    """
    kept = edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct()
    now = materialize(kept, "components")
    state = _state(now)
    while state[0]:
        old, now = now, materialize(_small_star(_large_star(now)), "components")
        release(old)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("dst").alias("node")).distinct()
    out = now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
    out = materialize(out, "components")
    release(now)
    return out
