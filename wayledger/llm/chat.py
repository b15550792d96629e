"""Cumulative-snapshot collapse of logged conversations, then rendering.

A log that stores a conversation after every turn holds each state as a prefix of the next.  Every turn gets its place in its
conversation and a hash of the place, the role and the text; the running exclusive-or of these is the hash of the prefix that ends
there (two independent 64-bit hashes together).  A conversation is dropped if its whole hash is the hash of a proper prefix of another
one (anti-join), and of equal conversations the one with the smallest id stays.  What remains is rendered in chat markup.

Places and running hashes are taken in two steps, within blocks of ``BLOCK_TURNS`` turn numbers and over the blocks of a conversation,
so that a conversation with very many turns is shared by many tasks; its rendering is a row for each ``BLOCK_TURNS`` turns (``part``).
Prefixes and whole hashes are grouped before they are joined, so common first turns and copies are one row each.  Only DataFrame
functions are used.

Defined results: null role and null text are empty; turns are ordered by number (null first), role and text, and gaps don't matter; a row
that repeats another counts once; rows without a conversation id are left out, as they belong to none; markers inside a text are
broken by a space, so that they can't open or close a turn; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayledger.llm.tables import stored

BLOCK_TURNS = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
MARK, BROKEN = "<|", "< |"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, h1, h2, n): each turn with its place from 1, the hashes of the prefix up to it, and all turns."""
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62)))
    rows = rows.distinct().withColumn("block", block)
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    counts = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.select(
        "conv_id", "block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("skip"), F.sum("m").over(every).alias("n")
    )
    placed = rows.withColumn("own", F.row_number().over(inside)).join(counts, ["conv_id", "block"])
    placed = placed.withColumn("pos", F.col("skip") + F.col("own"))
    one = {f"e{k}": F.xxhash64(F.lit(k), "pos", "role", "text") for k in (1, 2)}
    hashed = stored(placed.withColumns(one).select("conv_id", "block", "pos", "n", "role", "text", "e1", "e2"), "turns")
    sums = hashed.groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("b1"), F.bit_xor("e2").alias("b2"))
    carried = sums.select(
        "conv_id", "block", *[F.coalesce(F.bit_xor(f"b{k}").over(before), F.lit(0).cast("long")).alias(f"p{k}") for k in (1, 2)]
    )
    running = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.withColumns({f"r{k}": F.bit_xor(f"e{k}").over(running) for k in (1, 2)})
    return local.join(carried, ["conv_id", "block"]).select(
        "conv_id", "pos", "n", "role", "text", *[F.col(f"r{k}").bitwiseXOR(F.col(f"p{k}")).alias(f"h{k}") for k in (1, 2)]
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that are no prefix of a longer one; equal ones are one."""
    whole = turns.where("pos = n").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = turns.where("pos < n").select("pos", "h1", "h2").distinct()
    return whole.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, text) of the maximal conversations; parts of a conversation follow one another."""
    turns = stored(prefixes(conversations), "prefixes")
    kept = turns.select("conv_id", "pos", "role", "text").join(maximal(turns), "conv_id")
    clean = lambda c: F.replace(F.col(c), F.lit(MARK), F.lit(BROKEN))
    turn = F.concat(F.lit(OPEN), clean("role"), F.lit("\n"), clean("text"), F.lit(CLOSE + "\n"))
    part = F.floor((F.col("pos") - 1) / BLOCK_TURNS).alias("part")
    grouped = kept.groupBy("conv_id", part, "n_turns", "n_copies").agg(
        F.array_sort(F.collect_list(F.struct("pos", turn.alias("turn")))).alias("turns")
    )
    return grouped.select("conv_id", "part", "n_turns", "n_copies", F.array_join("turns.turn", "").alias("text"))
