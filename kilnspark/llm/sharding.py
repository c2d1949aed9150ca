"""Shards along a Hilbert curve.

Several metadata dimensions are quantised by the quantiles of all rows (strings by their whole values); rows are ordered by their cell's index on the
Hilbert curve, then by id, and the order is cut into runs of equal row counts. Each shard then covers a compact
region of every dimension, so that a filter on any of them prunes whole files.

Defined cases: a null text has size 16 and checksum 0; null metadata sorts below all other values; equal rows stay
apart as rows; fewer rows than shards leave shards empty; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.llm.common import Scratch, coded, global_rank, materialize, pick, text_or_empty

BITS = 4
#: Ids are cut at quantiles, one for so many rows (64 to 4096 of them), so that no cell is ordered by a single task, however many rows it holds.
CUT_ROWS, LEAST_CUTS, MOST_CUTS = 100_000, 64, 4096


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (rows of `cells`, each below 2**bits).

    The axes are turned into the transposed index from the highest bit down (exchange and invert the lower bits where a
    bit is unset or set), Gray-coded, and their bits interleaved."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            inverts = (x[i] & q) != 0
            swap = np.where(inverts, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverts, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def level(value: Column, cuts: list) -> Column:
    """How many of the cuts lie at or below the value."""
    out = F.lit(0)
    for c in cuts:
        out = out + (value >= F.lit(c)).cast("int")
    return out


def quantile_cuts(df: DataFrame, parts: dict[str, int]) -> dict[str, list]:
    """Distinct inner quantiles of each column over all rows: at most parts - 1 numbers each, to an eighth of a part."""
    row = df.agg(*[F.percentile_approx(c, [i / n for i in range(1, n)], max(10_000, 8 * n)).alias(c) for c, n in parts.items()]).first()
    return {c: sorted(set(row[c] or [])) for c in parts}


def text_cuts(df: DataFrame, name: str, parts: int) -> list[str]:
    """At most parts - 1 values of a string column that cut its rows (nulls left out) into runs of nearly equal counts.

    Whole values are compared: they are counted, sorted in ranges, and each is placed by the rows before it. Only the cuts leave the executors."""
    scratch = Scratch(df.sparkSession)
    counts = df.select(F.col(name).alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
    ranges = scratch.table(counts.orderBy("value").withColumn("range", F.spark_partition_id()), "shard-values")
    sizes = ranges.groupBy("range").agg(F.sum("n").alias("m"))
    earlier = sizes.select("range", (F.sum("m").over(Window.orderBy("range")) - F.col("m")).alias("ahead"), F.sum("m").over(Window.partitionBy()).alias("total"))
    after = F.col("ahead") + F.sum("n").over(Window.partitionBy("range").orderBy("value"))
    placed = ranges.join(F.broadcast(earlier), "range").withColumn("after", after)  # one row for each range of the sort
    crosses = F.expr(f"(after - n) * {parts} div total < least(after * {parts} div total, {parts - 1})")
    cuts = sorted(r["value"] for r in placed.where(crosses).select("value").collect())
    scratch.drop()
    return cuts


def hilbert_shards(rows: DataFrame, dims: list[str], key: str, shards: int, bits: int = BITS) -> DataFrame:
    """`rows` with shard (int) and slot (long, gapless from 0); `dims` are long or string columns, `key` breaks ties on the curve."""
    strings = [d for d in dims if dict(rows.dtypes)[d] == "string"]
    numbers = {d: 1 << bits for d in dims if d not in strings}
    total = rows.count()
    runs = min(MOST_CUTS, max(LEAST_CUTS, total // CUT_ROWS))
    cuts = quantile_cuts(rows.withColumn("__key", coded(F.col(key))), {**numbers, "__key": runs})
    key_cuts = np.array(cuts.pop("__key"), dtype=np.int64)
    cuts |= {d: text_cuts(rows, d, (1 << bits) - 1) for d in strings}

    def cell(d: str) -> Column:
        """A string's level is one more than that of its value, for nulls take the lowest."""
        return F.coalesce(level(F.col(d), cuts[d]) + 1, F.lit(0)) if d in strings else level(F.col(d), cuts[d])

    def bucket(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        """The place on the curve, and inside a cell the run of ids."""
        for keys, *columns in batches:
            curve = hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits)
            yield pd.Series(curve * (runs + 1) + np.searchsorted(key_cuts, keys.to_numpy(np.int64), side="right"))

    placed = rows.withColumn("__bucket", F.pandas_udf(bucket, "long")(coded(F.col(key)), *[cell(d) for d in dims]))
    tie = [F.col(key).asc_nulls_first(), *[F.col(c) for c in rows.columns if c != key]]
    ranked = global_rank(placed, tie, "__bucket", "__rank")
    shard = F.expr(f"__rank * {shards}L div {max(total, 1)}L")
    start = F.expr(f"(__shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    out = ranked.withColumn("__shard", shard).withColumn("slot", F.col("__rank") - start).withColumn("shard", F.col("__shard").cast("int"))
    return out.drop("__bucket", "__rank", "__shard")


def shard_report(documents: DataFrame, shards: int = 40) -> DataFrame:
    """op3: all documents in shards of counts at most one apart (law `rows`)."""
    docs = pick(documents, doc_id="long", text="string", lang="string", source="string")
    text = F.encode(text_or_empty(), "UTF-8")
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col("lang").alias("d_lang"),
        F.col("source").alias("d_source"),
        F.coalesce("doc_id", F.lit(-1)).alias("d_id"),
    )
    rows = materialize(narrow, "shard-metadata")
    placed = hilbert_shards(rows, ["d_source", "d_lang", "size", "d_id"], "doc_id", shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
