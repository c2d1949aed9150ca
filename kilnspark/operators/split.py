"""Leakage-free splits: assignment strategies, integrity, release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.operators.ranking import with_position


def _by_ratio(ratio: Column, train: float, validation: float) -> Column:
    return F.when(ratio < F.lit(float(train)), "train").when(ratio < F.lit(train + validation), "validation").otherwise("test")


def hash_ratio(key: Column, seed: int = 42) -> Column:
    """A key's fixed place between 0 and 1: the first 32 bits of a seeded SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(0xFFFFFFFF))


def grouped_random(df: DataFrame, group: Column, *, seed: int = 42, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """Adds split; rows of a group stay together. A pure projection: no shuffle."""
    return df.withColumn("split", _by_ratio(hash_ratio(group, seed), train, validation))


def time_based(df: DataFrame, time: str, tie: str, *, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """Adds split by chronological position; rows without a time come first, equal times go by `tie`.

    A whole-number tie also divides the rows of one time, so that no task has to order a whole day."""
    whole = df.schema[tie].dataType.typeName() in ("byte", "short", "integer", "long")
    high = F.floor(F.col(tie) / 65536) if whole else F.lit(0).cast("long")
    placed = with_position(df, [F.col(time), F.col(tie)], F.struct(F.col(time).alias("t"), high.alias("h")), "__at", F.to_date(time))
    total = df.agg(F.count("*").alias("__total"))
    ratio = F.col("__at").cast("double") / F.col("__total")
    return placed.crossJoin(F.broadcast(total)).withColumn("split", _by_ratio(ratio, train, validation)).drop("__at", "__total")


def kfold(df: DataFrame, group: str, *, k: int = 5, fold: int = 0, seed: int = 42) -> DataFrame:
    """Adds fold and split; groups are dealt by the order of a seeded hash (a deliberate change from a shuffled list). Rows without a group are a
    group of their own, the first in that order."""
    groups = df.select(F.col(group).alias("__g")).distinct().withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__g")), 256))
    dealt = with_position(groups, [F.col("__h")], F.substring("__h", 1, 5), "__at", F.substring("__h", 1, 2)).select("__g", (F.col("__at") % k).cast("int").alias("fold"))
    part = F.when(F.col("fold") == fold, "test").when(F.col("fold") == (fold + 1) % k, "validation").otherwise("train")
    return df.join(dealt, F.col(group).eqNullSafe(F.col("__g"))).drop("__g").withColumn("split", part)


def manual(df: DataFrame, id_column: str, group: str, mapping: dict[str, str]) -> DataFrame:
    """Adds split from a map of ids or groups; what the map lacks, or maps to no split, is train."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]) if mapping else F.create_map().cast("map<string,string>")
    found = F.coalesce(table[F.col(id_column).cast("string")], table[F.col(group)])
    return df.withColumn("split", F.when(found.isin("train", "validation", "test"), found).otherwise("train"))


def holdout(df: DataFrame, group: str, held: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col(group) == held, "test").otherwise("train"))


def integrity(df: DataFrame, group: str = "group_key", split: str = "split") -> DataFrame:
    """One row: distinct groups, leaked groups (in more than one split), whether none leaked."""
    groups = df.groupBy(group).agg(F.count_distinct(split).alias("n"))
    return groups.agg(F.count("*").alias("group_count"), F.count_if(F.col("n") > 1).alias("leaked_count"), (F.count_if(F.col("n") > 1) == 0).alias("ok"))


def counts(df: DataFrame, group: str = "group_key", split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("rows_per_split"), F.count_distinct(group).alias("groups_per_split"))


def release_gate(train: Column, validation: Column, test: Column, groups: Column, allowance: Column) -> Column:
    """struct(ok, gate)."""
    alone = (validation <= 0) & (test <= 0) & (groups > 0)

    def verdict(ok: bool, gate: str) -> Column:
        return F.struct(F.lit(ok).alias("ok"), F.lit(gate).alias("gate"))

    return (
        F.when(train <= 0, verdict(False, "train_required"))
        .when(alone & (groups == 1) & ~allowance, verdict(False, "small_corpus_policy"))
        .when(alone, verdict(True, "small_corpus_policy"))
        .otherwise(verdict(True, "ok"))
    )


def small_corpus_splits(groups: Column) -> Column:
    return F.when(groups <= 1, F.array(F.lit("train"))).when(groups == 2, F.array(F.lit("train"), F.lit("validation"))).otherwise(F.array(F.lit("train"), F.lit("validation"), F.lit("test")))
