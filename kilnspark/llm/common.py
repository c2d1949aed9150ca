"""What the operators share: bit tables, exact distributed ranks, the label split."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.operators.shared import Scratch, few_files, materialize, shared_dir  # noqa: F401  tables for all operators


MARK_BITS = 27


def bit_table(marks: DataFrame) -> np.ndarray:
    """One bit for each number below 2**MARK_BITS, set for those in column `mark`: 16 MB at any size.

    The bits are set in 128 slices on the executors; the driver lays the slices side by side."""
    low = MARK_BITS - 7

    def slice_bits(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << low, bool)
        bits[group["mark"].to_numpy() & ((1 << low) - 1)] = True
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "bits": [np.packbits(bits).tobytes()]})

    parts = marks.select("mark").distinct().withColumn("part", F.shiftright("mark", low))
    out = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    for row in parts.groupBy("part").applyInPandas(slice_bits, "part long, bits binary").toLocalIterator():
        out[row["part"] << (low - 3) : (row["part"] + 1) << (low - 3)] = np.frombuffer(row["bits"], np.uint8)
    return out


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; other columns (whatever their names) stay behind."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


#: Stands for a null id while rows pass through pandas, where a null would turn whole numbers into floats.
NULL_ID = -(1 << 63)


def coded(value: Column) -> Column:
    return F.coalesce(value.cast("long"), F.lit(NULL_ID))


def decoded(value: Column) -> Column:
    return F.when(value != NULL_ID, value)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5, is 0. Null ids count as the empty text, whose remainder is 0."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _order(target: str) -> list[Column]:
    return [F.xxhash64(F.lit(target), F.col("doc_id")), F.col("doc_id")]


def training_labels(labels: DataFrame, target: str, most: int) -> DataFrame:
    """At most `most` labelled ids outside the held-out fold, in the order of a hash of the id.

    A document labelled more than once takes its largest label. The bound is what allows the caller to
    broadcast the result and to fit on the driver."""
    rows = pick(labels, doc_id="long", **{target: "int"}).where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out(F.col("doc_id")))
    one = rows.groupBy("doc_id").agg(F.max(target).alias("label"))
    return one.orderBy(*_order(target)).limit(most)


def bounded_rows(described: DataFrame, target: str, most_bytes: int) -> list:
    """(doc_id, label, x) of the training rows in the order of `training_labels`, for the driver: one row for each id (the least x), as many as
    fit into `most_bytes`. A row that doesn't fit into what is left is skipped, and those after it are tried.

    described: the labelled ids' rows with their features x; an id may have any number of them."""
    scratch = Scratch(described.sparkSession)
    rows = scratch.table(described.groupBy("doc_id", "label").agg(F.min("x").alias("x")), "training-rows")
    total, kept = 0, []
    for r in rows.orderBy(*_order(target)).select("doc_id", F.octet_length("x").alias("n")).collect():  # as many as there are labels, at most
        if total + r["n"] <= most_bytes:
            total += r["n"]
            kept.append((r["doc_id"],))
    chosen = F.broadcast(described.sparkSession.createDataFrame(kept, "doc_id long"))
    few = rows.join(chosen, "doc_id", "left_semi").orderBy(*_order(target)).select("doc_id", "label", "x")
    out = list(few.toLocalIterator())  # a part at a time: the JVM never holds all of them beside their pickled form
    scratch.drop()
    return out


def global_rank(df: DataFrame, keys: list[str], bucket: str, name: str) -> DataFrame:
    """0-based rank of every row by (bucket, *keys), where `bucket` is a non-decreasing function of the order.

    Each bucket is ranked on its own, so the buckets should be small. The offsets are running sums over the buckets' counts:
    within runs of 4096 bucket numbers, and over the runs."""
    counts = df.groupBy(bucket).agg(F.count("*").alias("__n")).withColumn("__c", F.expr(f"{bucket} div 4096"))
    coarse = counts.groupBy("__c").agg(F.sum("__n").alias("__m"))
    ahead = coarse.select("__c", (F.sum("__m").over(Window.orderBy("__c")) - F.col("__m")).alias("__ahead"))
    inside = F.sum("__n").over(Window.partitionBy("__c").orderBy(bucket)) - F.col("__n")
    before = counts.withColumn("__in", inside).join(ahead, "__c").select(bucket, (F.col("__ahead") + F.col("__in")).alias("__before"))
    within = df.withColumn("__r", F.row_number().over(Window.partitionBy(bucket).orderBy(*keys)))
    return within.join(before, bucket).withColumn(name, F.col("__before") + F.col("__r") - 1).drop("__before", "__r")
