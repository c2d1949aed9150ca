"""Prefix trie of conversations: mergeable partial tries.

A node is a distinct sequence of first turns. Its key is a 128-bit digest of the depth and of the sums of two 64-bit hashes of (place, role,
text) over the path: sums run along a conversation as a blocked scan, so that one of any length is spread over tasks. Each block of
conversations gives a partial trie: one row for each of its nodes with members, the least member and the list of conversations
that end there. Blocks are ranges of conv_id, so that merging two partial tries adds members and lays end lists one after
the other. Rounds of merges by (key, group of blocks) bring a node's rows from all blocks down to one.

The rollup goes bottom up. The nodes whose least member is c lie on the lower end of c's path: c's chain. Sums from the bottom of each chain
(a blocked scan again) give what a node has below itself on its own chain; then each chain hands its total to all nodes above it on
c's path, where partial sums meet by key. The number of steps does not depend on the depth of the trie.

Defined cases: rows without a conv_id belong to no conversation; a null role or text is empty; turns of one number are ordered by role and
text; repeated rows are turns of their own; an empty table gives no node; other columns are not looked at."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import Scratch, pick, text_or_empty
from kilnspark.llm.conversations import ordered, rebuilt
from kilnspark.llm.digests import EMPTY, ordered_sha256
from kilnspark.operators.scan import BLOCK, blocks, scan

#: Blocks whose partial tries meet in one merge.
FAN = 64


def turns_of(conversations: DataFrame) -> DataFrame:
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null")
    return rows.withColumns({"role": text_or_empty("role"), "text": text_or_empty("text")})


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, c1, c2, chars): two independent hashes of role and text, and the text's code points."""
    return turns.select("conv_id", "pos", F.xxhash64("role", "text").alias("c1"), F.xxhash64(F.lit(1), "text", "role").alias("c2"), F.char_length("text").cast("long").alias("chars"))


def paths(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, conv_id, depth, ends, key, parent, chars) for each node on each path; steps: (conv_id, depth, ends, c1, c2, chars), depth 0 included."""
    wide = lambda c: F.coalesce(c.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    own = {f"h{i}": F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "depth", "c1", "c2")) for i in (1, 2)}
    steps = steps.select("conv_id", "depth", "ends", F.coalesce("chars", F.lit(0)).alias("chars"), *[v.alias(k) for k, v in own.items()])
    order = [F.col("depth")]
    summed = scan(blocks(steps, ["conv_id"], order, scratch, "steps"), ["conv_id"], order, sums={f"s{i}": wide(F.col(f"h{i}")) for i in (1, 2)})

    def key(depth: Column, s1: Column, s2: Column) -> Column:
        return F.unhex(F.md5(F.encode(F.concat_ws(":", *[c.cast("string") for c in (depth, s1, s2)]), "UTF-8")))

    kind = "decimal(38,0)"  # one form for a sum, however it came about
    sums = [F.col(f"s{i}").cast(kind) for i in (1, 2)]
    above = [(F.col(f"s{i}") - wide(F.col(f"h{i}"))).cast(kind) for i in (1, 2)]
    parent = F.when(F.col("depth") > 0, key(F.col("depth") - 1, *above))
    return summed.select(BLOCK, "conv_id", "depth", "ends", key(F.col("depth"), *sums).alias("key"), parent.alias("parent"), "chars")


def partial_tries(rows: DataFrame) -> DataFrame:
    """One row for each node of each block: members, least member, and the block's end list (ascending, comma-joined, null if empty)."""
    ending = F.array_sort(F.collect_list(F.when(F.col("ends"), F.col("conv_id"))))  # no longer than the block
    listed = F.concat_ws(",", F.transform(ending, lambda c: c.cast("string")))
    told = rows.groupBy(BLOCK, "key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in ("depth", "parent", "chars")], listed.alias("ends"))
    return told.withColumn("ends", F.when(F.col("ends") != "", F.col("ends")))


def merged(partial: DataFrame, fan: int = FAN) -> DataFrame:
    """The nodes of all blocks: rounds of merges of `fan` neighbouring blocks, until one is left."""
    counts = [F.sum("n").alias("n"), *[F.min(c).alias(c) for c in ("conv_id", "depth", "parent", "chars")]]
    n = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = partial.select(BLOCK, "key", "n", "conv_id", "depth", "parent", "chars")
    for _ in range(max(0, math.ceil(math.log(max(n, 2), fan)) - 1)):
        out = out.withColumn(BLOCK, F.expr(f"{BLOCK} div {fan}")).groupBy(BLOCK, "key").agg(*counts)
    return out.groupBy("key").agg(*counts)


def trie(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, conv_id, depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    rows = scratch.table(paths(steps, scratch), "paths")
    partial = scratch.table(partial_tries(rows), "partial-tries")
    ends = ordered_sha256(partial.where("ends is not null").select("key", BLOCK, "ends"), "key", [BLOCK], "ends", ",")
    children = partial.where("parent is not null").select("parent", "key").distinct().groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = merged(partial).join(children, "key", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "own": (F.col("n") - 1) * F.col("chars")})
    nodes = scratch.table(nodes, "nodes")
    # a chain: the nodes of one least member, from `top` down; what hangs below them on it, and the leaf at its end if there is one
    chains = nodes.groupBy("conv_id").agg(F.sum("own").alias("total"), F.min("depth").alias("top"), F.count_if(F.col("n_children") == 0).alias("leaf"))
    chains = scratch.table(chains, "chains")
    order = [F.col("depth").desc()]
    chain = blocks(nodes.select("conv_id", "depth", "key", "parent", "n", "n_children", "own"), ["conv_id"], order, scratch, "chain-nodes")
    upward = scan(chain, ["conv_id"], order, sums={"saved": F.col("own")}).join(chains.select("conv_id", "top", "leaf"), "conv_id")
    at = upward.where("depth = top and parent is not null").select("parent", "key").join(nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    inside = F.when(F.col("depth") > F.col("top"), F.col("conv_id"))
    parts = [
        upward.select("key", "conv_id", "depth", "parent", inside.alias("parent_conv_id"), "n", "n_children", F.col("leaf").alias("n_leaves"), "saved"),
        at.select("key", "parent_conv_id"),
        rows.join(chains, "conv_id").where("depth < top").select("key", F.col("leaf").alias("n_leaves"), F.col("total").alias("saved")).groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")),
        ends.withColumnRenamed("sha256", "ends_sha256"),
    ]
    every = parts[0].unionByName(parts[1], True).unionByName(parts[2], True).unionByName(parts[3], True)
    told = every.groupBy("key").agg(
        *[F.max(c).alias(c) for c in ("conv_id", "depth", "parent", "parent_conv_id")], F.max("n").alias("n_convs"), F.max("n_children").alias("n_children"),
        F.sum("n_leaves").cast("long").alias("n_leaves"), F.sum("saved").cast("long").alias("saved_tokens"), F.coalesce(F.max("ends_sha256"), F.lit(EMPTY)).alias("ends_sha256"),
    )
    return told


def node_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """`nodes` with the role and text of each node's last turn (null at the root); turns: (conv_id, depth, role, text), of all members or of the least."""
    return nodes.join(turns.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")


def trie_report(conversations: DataFrame) -> DataFrame:
    """op12: every node of the trie of the rebuilt conversations."""
    scratch = Scratch(conversations.sparkSession)
    turns = scratch.table(hashed(ordered(turns_of(conversations), scratch)), "ordered")
    nodes = trie(rebuilt(turns), scratch)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
