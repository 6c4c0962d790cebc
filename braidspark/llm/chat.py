"""Chat formatting after collapsing cumulative snapshots. DataFrame functions only.

Services log a conversation again after every turn, so that most logged conversations are prefixes of
longer ones. Each turn gets a rolling hash of the turns up to it: the exclusive-or of hashes of
(position, role, md5 of the text), in two 64-bit lanes, so that equal hashes at equal lengths mean equal prefixes (two
different ones meet with odds of n^2 / 2^129 among n turns).
A conversation is dropped if its last turn's hash is the same-length prefix hash of a longer one, or
of an equal one with a smaller conv_id (anti-joins); the maximal ones are rendered.

Positions and rolling hashes come from two-level running sums over ranges of `turn`, so that a long
conversation is no single task's; prefix hashes are aggregated map-side, so that a common first turn
is one row for each task. Texts are shuffled once, by range, to be rendered; what is written in between holds hashes
alone. A rendered conversation is given in segments of at most `segment_turns` turns, none of which goes on in another
range.

Edge cases: null role or text count as themselves (not as empty) when compared, and are rendered as
``unknown`` and as nothing; turns are ordered by (turn, role, md5 of the text), nulls first; repeated rows are
repeated turns; a null conv_id is one conversation of its own, and a null turn comes first; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidspark.llm.common import materialize

#: Turn numbers of a range: at most so many turns with different numbers are ordered by one task.
RANGE = 4096
SEGMENT_TURNS = 1024
#: A conversation's key, and a range's, without nulls: so joins and windows share a partitioning.
CONVERSATION = ["_c", "_c_null"]
KEYS = [*CONVERSATION, "_r", "_r_null"]


def _keyed(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("_m"))
    rows = rows.withColumn("_c", F.coalesce("conv_id", F.lit(0))).withColumn("_c_null", F.col("conv_id").isNull())
    return rows.withColumn("_r", F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(0))).withColumn("_r_null", F.col("turn").isNull())


def _in_range():
    return Window.partitionBy(*KEYS).orderBy("turn", "role", "_m")


def _before():
    return Window.partitionBy(*CONVERSATION).orderBy(F.desc("_r_null"), "_r").rowsBetween(Window.unboundedPreceding, -1)


def ranges(conversations: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """KEYS, start, first_segment: turns and segments of the conversation before each range."""
    counts = _keyed(conversations).groupBy(*KEYS).agg(F.count("*").alias("n"))
    sums = [F.coalesce(F.sum(x).over(_before()), F.lit(0)) for x in (F.col("n"), F.ceil(F.col("n") / segment_turns))]
    return materialize(counts.select(*KEYS, sums[0].alias("start"), sums[1].alias("first_segment")), "chat-ranges")


def rolling(conversations: DataFrame, starts: DataFrame) -> DataFrame:
    """conv_id, position (from 1), and h1, h2: the rolling hash up to the turn."""
    placed = _keyed(conversations).drop("text").join(starts.select(*KEYS, "start"), KEYS).withColumn("position", F.row_number().over(_in_range()) + F.col("start"))
    own = [F.xxhash64(F.lit(lane), "position", F.col("role").isNull(), "role", F.col("_m").isNull(), "_m") for lane in (1, 2)]
    hashed = materialize(placed.select("conv_id", *KEYS, "position", own[0].alias("o1"), own[1].alias("o2")), "chat-turns")
    sums = hashed.groupBy(*KEYS).agg(F.bit_xor("o1").alias("x1"), F.bit_xor("o2").alias("x2"))
    carried = sums.select(*KEYS, *[F.coalesce(F.bit_xor(f"x{i}").over(_before()), F.lit(0).cast("long")).alias(f"c{i}") for i in (1, 2)])
    up_to = Window.partitionBy(*KEYS).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.join(carried, KEYS)
    return local.select("conv_id", "position", *[F.bit_xor(f"o{i}").over(up_to).bitwiseXOR(F.col(f"c{i}")).alias(f"h{i}") for i in (1, 2)])


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that are no prefix of another, the smallest conv_id of equal ones.

    turns: as `rolling` gives them.
    """
    lengths = turns.groupBy("conv_id").agg(F.max("position").alias("n_turns"))
    sized = lengths.withColumnRenamed("conv_id", "c")
    hashes = turns.join(sized, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    ends = hashes.where(F.col("position") == F.col("n_turns"))
    # one row for each proper prefix, however many conversations begin with it
    longer = hashes.where(F.col("position") < F.col("n_turns")).groupBy("position", "h1", "h2").agg(F.count("*").alias("_n")).drop("_n")
    kept = ends.join(longer, ["position", "h1", "h2"], "left_anti")
    return kept.groupBy("position", "h1", "h2").agg(F.min("conv_id").alias("conv_id")).select("conv_id", F.col("position").alias("n_turns"))


def render(conversations: DataFrame, starts: DataFrame, kept: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """conv_id, segment (from 0), n_turns (of the conversation), rendered."""
    named = kept.select(F.coalesce("conv_id", F.lit(0)).alias("_c"), F.col("conv_id").isNull().alias("_c_null"), "n_turns")
    wanted = materialize(starts.join(named, CONVERSATION).drop("start"), "chat-kept")
    own = _keyed(conversations).join(wanted, KEYS)
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    placed = own.withColumn("place", F.row_number().over(_in_range())).withColumn("line", line)
    placed = placed.withColumn("segment", F.col("first_segment") + F.floor((F.col("place") - 1) / segment_turns))
    parts = placed.groupBy(*KEYS, "conv_id", "n_turns", "segment").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return parts.select("conv_id", "segment", "n_turns", F.array_join(F.col("lines.line"), "").alias("rendered"))


def format_chats(conversations: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """conv_id, segment, n_turns, rendered of the maximal conversations of (conv_id, turn, role, text)."""
    starts = ranges(conversations, segment_turns)
    turns = materialize(rolling(conversations, starts), "chat-rolling")
    return render(conversations, starts, maximal(turns), segment_turns)
