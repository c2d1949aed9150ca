"""Comparison of large manifests by trees of digests: only folders whose digests differ are opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOP = 2


def levels_for(n: int, fan_out: int = 256) -> int:
    """How many levels of folders, each named by two more hex digits, keep a folder to about `fan_out` entries."""
    levels = 1
    while n > fan_out * 256**levels:
        levels += 1
    return levels


def tree_levels(entries: DataFrame, levels: int) -> DataFrame:
    """(level, folder, sha256, n) of the folders over (path, sha256): folder is the first 2 * level hex digits of a hash of the path."""
    leaf = entries.select("path", "sha256", F.sha2("path", 256).alias("h"))
    inside = F.array_sort(F.collect_list(F.struct("path", "sha256")))  # about `fan_out` entries
    digest = lambda rows, name: F.sha2(F.array_join(F.transform(rows, lambda e: F.concat(e[name], F.lit("\x00"), e["sha256"], F.lit("\n"))), ""), 256)
    level = leaf.groupBy(F.substring("h", 1, 2 * levels).alias("folder")).agg(digest(inside, "path").alias("sha256"), F.count("*").alias("n"))
    out = level.select(F.lit(levels).alias("level"), "folder", "sha256", "n")
    for k in range(levels - 1, -1, -1):
        below = F.array_sort(F.collect_list(F.struct("folder", "sha256")))  # 256 at most
        level = level.groupBy(F.substring("folder", 1, 2 * k).alias("__f")).agg(digest(below, "folder").alias("sha256"), F.sum("n").alias("n")).withColumnRenamed("__f", "folder")
        out = out.unionByName(level.select(F.lit(k).alias("level"), "folder", "sha256", "n"))
    return out


def write_snapshot(entries: DataFrame, path: str, levels: int) -> None:
    """Writes a manifest with all levels of its tree: folders by level, entries by the first two digits of their folder."""
    held = entries.withColumn("folder", F.substring(F.sha2("path", 256), 1, 2 * levels)).withColumn("top", F.substring("folder", 1, TOP))
    held.repartition("top").sortWithinPartitions("folder", "path").write.partitionBy("top").parquet(f"{path}/entries")
    tree_levels(entries, levels).write.partitionBy("level").parquet(f"{path}/levels")


def _levels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("folder string, sha256 string, n long, level int").parquet(f"{path}/levels")


def opened_folders(old: DataFrame, new: DataFrame, levels: int) -> list[DataFrame]:
    """For each level, the folders whose digests differ (folder); old and new: (level, folder, sha256). Below a folder whose
    digests agree, nothing is read: a level is met only by folders that a differing one holds."""
    out: list[DataFrame] = []
    for k in range(levels + 1):
        a, b = (side.where(F.col("level") == k).select("folder", "sha256") for side in (old, new))
        if out:
            holds = out[-1].select(F.col("folder").alias("__up"))
            a, b = (side.join(holds, F.substring("folder", 1, 2 * (k - 1)) == F.col("__up"), "left_semi") for side in (a, b))
        both = a.withColumnRenamed("sha256", "a").join(b.withColumnRenamed("sha256", "b"), "folder", "full_outer")
        out.append(both.where(~F.col("a").eqNullSafe(F.col("b"))).select("folder"))
    return out


def compare_snapshots(spark: SparkSession, old: str, new: str, levels: int, schema: str = "path string, sha256 string") -> DataFrame:
    """(path, change) of two written snapshots of equal levels: changed, missing (only in the old) and extra (only in the new) paths.

    The folders that differ on the lowest level meet the entries by `top` first, by which these are stored, so that folders without a
    difference are not read."""
    lowest = opened_folders(_levels(spark, old), _levels(spark, new), levels)[-1]
    keys = lowest.select(F.substring("folder", 1, TOP).alias("top"), "folder")

    def held(path: str) -> DataFrame:
        rows = spark.read.schema(f"{schema}, folder string, top string").parquet(f"{path}/entries")
        return rows.join(keys, ["top", "folder"], "left_semi").select("path", "sha256")

    met = held(old).withColumnRenamed("sha256", "a").join(held(new).withColumnRenamed("sha256", "b"), "path", "full_outer")
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return met.select("path", change.alias("change")).where("change is not null")


def restore_plan(changes: DataFrame, backup: DataFrame) -> DataFrame:
    """(path, action, sha256) that bring a place back to its backup (path, sha256): `copy` what changed or is missing, `delete` what is
    extra. Changes: from the backup to the place. Contents are those that a blob store keeps under the digests."""
    wanted = changes.join(backup.select("path", "sha256"), "path", "left")
    return wanted.select("path", F.when(F.col("change") == "extra", "delete").otherwise("copy").alias("action"), F.when(F.col("change") != "extra", F.col("sha256")).alias("sha256"))


def restored(place: DataFrame, plan: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path, content) of the place (path, content) after a plan: files that the plan does not name are left as they are, and only the blobs
    (sha256, content) that it copies are read."""
    kept = place.join(plan.select("path"), "path", "left_anti").select("path", "content")
    return kept.unionByName(plan.where("action = 'copy'").join(blobs.select("sha256", "content"), "sha256").select("path", "content"))
