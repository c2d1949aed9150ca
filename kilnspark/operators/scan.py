"""Running sums, numbers and lags inside keys of any size: blocked scans.

A window over a key puts all its rows into one task. Here rows are dealt into blocks, which are ranges of (key, order), so that a key with a
large share of all rows spans many of them. Inside a block the values come from a window over (key, block); what lies before a
block is carried over from the totals of the key's earlier blocks. Only the first and the last key of a block can reach into
another one, so the carried table has at most two rows a block, and is broadcast.

Null keys are one key. Rows that are equal in key and order are dealt at random among the blocks that they fill; which of them comes first is
open. An empty table gives an empty result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.operators.shared import Scratch

BLOCK = "__block"


def blocks(df: DataFrame, key: list[str], order: list[Column], scratch: Scratch, name: str = "blocks") -> DataFrame:
    """`df` as a written table with the number of each row's block; numbers grow along (key, order)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__salt", F.rand(7)).repartitionByRange(n, *[F.col(k) for k in key], *order, F.col("__salt"))
    return scratch.table(dealt.drop("__salt").withColumn(BLOCK, F.spark_partition_id()), name)


def scan(rows: DataFrame, key: list[str], order: list[Column], *, number: str | None = None, sums: dict[str, Column] | None = None, lags: dict[str, Column] | None = None) -> DataFrame:
    """`rows` (of `blocks`, same key and order) with the place of each row in its key (from 1), the running sums of columns up to and with
    the row (null values add nothing), and the values of columns in the row before (null in the first)."""
    adds = {k: F.coalesce(v, F.lit(0)) for k, v in (sums or {}).items()}
    if number:
        adds[number] = F.lit(1).cast("long")
    lags = lags or {}
    place = F.struct(*[F.struct(F.when(c.isNull(), 0).otherwise(1), c) for c in order])
    totals = rows.groupBy(*key, BLOCK).agg(F.count("*").alias("__rows"), *[F.sum(c).alias(k) for k, c in adds.items()], *[F.max_by(F.struct(c.alias("x")), place).alias(k) for k, c in lags.items()])
    ahead = Window.partitionBy(*key).orderBy(BLOCK)
    carried = totals.withColumns(
        {f"__{k}": F.sum(k).over(ahead.rowsBetween(Window.unboundedPreceding, -1)) for k in adds} | {f"__{k}": F.lag(k).over(ahead) for k in lags} | {"__first": F.row_number().over(ahead) == 1}
    ).where("not __first")
    carried = carried.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col(BLOCK).alias("__b"), *[f"__{k}" for k in (*adds, *lags)])
    own = Window.partitionBy(*key, BLOCK).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({k: F.sum(c).over(upto) for k, c in adds.items()} | {f"__l_{k}": F.lag(F.struct(c.alias("x"))).over(own) for k, c in lags.items()})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)], F.col(BLOCK) == F.col("__b"))
    met = inside.join(F.broadcast(carried), same, "left")
    met = met.withColumns({k: F.col(k) + F.coalesce(f"__{k}", F.lit(0)) for k in adds} | {k: F.coalesce(f"__l_{k}", f"__{k}").getField("x") for k in lags})
    return met.drop("__b", *[f"__k{i}" for i in range(len(key))], *[f"__{k}" for k in (*adds, *lags)], *[f"__l_{k}" for k in lags])
