"""Turns of conversations in order, and the contract's rebuilt conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import Scratch
from kilnspark.operators.scan import blocks, scan

#: Conversations of one hundred ids share heads of up to five turns.
FAMILY, HEADS = 100, 6


def turn_order(*more: str) -> list[Column]:
    """By turn, nulls first; turns of one number by role and text."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), *[F.col(c) for c in more]]


def ordered(turns: DataFrame, scratch: Scratch, *more: str) -> DataFrame:
    """`turns` (conv_id, turn, role, text; role and text not null) with `pos`, the place in the conversation from 1, and the block of each row.

    A conversation of any length is spread over blocks; none is sorted in one task."""
    order = turn_order(*more)
    return scan(blocks(turns, ["conv_id"], order, scratch, "turns"), ["conv_id"], order, number="pos")


def crc_of(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, ends, and the other columns) of the rebuilt conversations of `turns` (conv_id, pos, ...), with a row of depth 0 and
    nulls for each conversation; ends: the conversation has no further turn.

    A conversation's first h turns are replaced by those of the first of its family (or by as many as that has); what follows is its own."""
    carried = [c for c in turns.columns if c not in ("conv_id", "pos")]
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumns({"base": family, "h": crc_of(F.col("conv_id").cast("string")) % HEADS})
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("__have"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("__have", F.lit(0)))).withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    facts = convs.select("conv_id", "base", "h", "m", "length")
    depth = F.col("pos") - F.col("h") + F.col("m")
    own = turns.join(facts, "conv_id").where("pos > h").select("conv_id", depth.alias("depth"), (depth == F.col("length")).alias("ends"), *carried)
    first = turns.where((F.col("pos") < HEADS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    heads = first.join(facts.where("m > 0"), "base").where("pos <= m").select("conv_id", F.col("pos").alias("depth"), (F.col("pos") == F.col("length")).alias("ends"), *carried)
    kinds = dict(turns.dtypes)
    tops = facts.select("conv_id", F.lit(0).cast("long").alias("depth"), (F.col("length") == 0).alias("ends"), *[F.lit(None).cast(kinds[c]).alias(c) for c in carried])
    return own.unionByName(heads).unionByName(tops)
