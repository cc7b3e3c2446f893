"""Chat formatting with cumulative-snapshot collapse.

A log often holds a conversation several times, each time with more turns.
Every turn gets the rolling hash of all turns up to it: 128 bits, the exclusive or of
hashes of (position, role, text). A conversation whose last hash is an inner
turn hash of another one is a prefix of it; an anti-join drops it. Equal
conversations fold to the smallest conv_id. What is left is rendered.

Positions come first: rows are split by ranges of (conversation, turn, role,
first HEAD characters of the text), and rows of short texts that are equal in
all of these by a number written with them. So a conversation that holds a
third of all rows spans many tasks, its turn numbers null or equal or not; only
long texts that share conversation, turn, role and HEAD characters meet in one.
From there on turns are handled in chunks of CHUNK positions, and chunk totals
carry hashes onward. Rendered text is likewise one row per PART turns.

Only column functions are used.

Defined results: turns are ordered by (turn, role, text), nulls first, and
repeated turns all count; a null role or text is empty; rows with a null
conv_id are one conversation; usual conversations have the single part 0; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtide.operators.ordered import OrderedRuns
from flowtide.session import cut

HEAD = 64
CHUNK = 256
PART = 256


def numbered_turns(log: DataFrame) -> DataFrame:
    """conv_id, role, body, pos (from 1), h1, h2 (hash of all turns up to this one)."""
    turns = log.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
    )
    # Null ids get a place of their own among the keys, so plain equality joins find them.
    turns = turns.withColumn("none", F.col("conv_id").isNull()).fillna(0, ["conv_id"])
    # Written once, so the numbers that split equal rows are the same in every later stage and retry.
    turns = cut(turns.withColumn("nth", F.monotonically_increasing_id()), "turns")
    short = F.char_length("body") <= HEAD
    turns = turns.withColumns({"head": F.substring("body", 1, HEAD), "tie": F.when(short, F.col("nth")).otherwise(F.lit(2**62))})
    runs = OrderedRuns(turns, ["none", "conv_id"], ["turn", "role", "head", "tie"], inside=["body"])
    placed = runs.scan({"pos": ("row_number", None)}).select(
        "none", "conv_id", "role", "body", "pos", F.floor((F.col("pos") - 1) / CHUNK).alias("chunk"))
    keys = ["none", "conv_id", "chunk"]
    before = Window.partitionBy("none", "conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    hashed = placed.withColumns({
        "t1": F.xxhash64("pos", "role", "body"), "t2": F.xxhash64(F.lit("second"), "pos", "role", "body")})
    # Running values inside the chunk, then what earlier chunks add up to.
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.withColumns({"r1": F.bit_xor("t1").over(upto), "r2": F.bit_xor("t2").over(upto)})
    totals = hashed.groupBy(*keys).agg(F.bit_xor("t1").alias("c1"), F.bit_xor("t2").alias("c2"))
    carried = totals.select(
        *keys, F.coalesce(F.bit_xor("c1").over(before), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("c2").over(before), F.lit(0)).alias("b2"))
    return cut(running.join(carried, keys).select(
        "none", "conv_id", "role", "body", "pos",
        F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2")), "numbered")


def maximal(turns: DataFrame) -> DataFrame:
    """none, conv_id, n of one conversation of each content that no longer one continues."""
    last = turns.groupBy("none", "conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("last"))
    folded = last.groupBy("last").agg(F.min(F.struct("none", "conv_id")).alias("id"))
    inner = turns.select("none", "conv_id", F.struct("pos", "h1", "h2").alias("last")) \
        .join(last.select("none", "conv_id", F.col("last.pos").alias("n")), ["none", "conv_id"]) \
        .where("last.pos < n").select("last").distinct()
    return folded.join(inner, "last", "left_anti").select("id.none", "id.conv_id", F.col("last.pos").alias("n"))


def format_chats(log: DataFrame) -> DataFrame:
    """conv_id, part, n_turns (of the conversation), text of every maximal conversation."""
    turns = numbered_turns(log)
    shown = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "body", F.lit("<|im_end|>\n"))
    parts = turns.join(maximal(turns), ["none", "conv_id"]).groupBy(
        "none", "conv_id", F.floor((F.col("pos") - 1) / PART).alias("part")).agg(
        F.first("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("pos", shown.alias("shown")))).alias("turns"))
    return parts.select(
        F.when(~F.col("none"), F.col("conv_id")).alias("conv_id"), "part", "n_turns",
        F.array_join("turns.shown", "").alias("text"))
