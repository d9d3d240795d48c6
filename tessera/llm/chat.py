"""Chat formatting: logged snapshots collapse into the longest conversations, which are then rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``turns`` with ``at`` (place in the conversation, from 1), ``n`` (its turns), and ``h1, h2`` of the prefix so far.

    A prefix hash is the running exclusive-or of position-dependent 64-bit turn hashes, twice with different
    seeds: it rolls on by one turn, and equal prefixes have equal pairs.
    """
    w = Window.partitionBy("conv_id")
    ordered = w.orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.withColumn("at", F.row_number().over(ordered)).withColumn("n", F.count("*").over(w))
    for i, seed in enumerate(("a", "b"), 1):
        one = F.xxhash64(F.lit(seed), "at", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
        rows = rows.withColumn(f"h{i}", F.bit_xor(one).over(so_far))
    return rows


def collapse(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies)`` of the maximal conversations.

    A conversation whose turns (roles and texts, in order) begin another, longer one is left out; of equal ones
    the smallest conv_id stays, with their number.  Repeated turns are turns of their own; null roles and texts
    equal each other; turns without a conv_id are left out.  Both sides of the anti-join are distinct first, so
    a first turn or a conversation that is everywhere is one row there.
    """
    rows = cut(prefix_hashes(turns.where("conv_id is not null").select("conv_id", "turn", "role", "text")).select("conv_id", "at", "n", "h1", "h2"))
    whole = rows.where("at = n").groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    begun = rows.where("at < n").select("h1", "h2").distinct()
    return whole.join(begun, ["h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def chat_format(turns: DataFrame) -> DataFrame:
    """Renders each maximal conversation: ``<|role|>``, a newline, the text and a newline for every turn.

    Returns conv_id, n_turns, n_copies, rendered.  A null role is written as unknown, a null text as empty;
    other columns are ignored; an empty table gives an empty result.
    """
    kept = cut(collapse(turns))
    piece = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = turns.select("conv_id", "turn", "role", "text").join(kept, "conv_id")
    order = [F.col("turn").isNotNull().alias("a"), F.col("turn"), F.col("role").isNotNull().alias("b"), F.col("role"), F.col("text").isNotNull().alias("c"), F.col("text")]
    rendered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, piece.alias("piece")))), lambda t: t["piece"]), "")
    return rows.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), rendered.alias("rendered"))
