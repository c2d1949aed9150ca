"""Revisions, reviews, versions and pages over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.operators.scan import BLOCK, blocks, scan
from kilnspark.operators.shared import Scratch


def latest(log: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key (an upsert's state over an append-only log): a maximum, combined before rows move; nulls come first."""
    row = F.struct(*[F.col(f"`{c}`") for c in log.columns])
    return log.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("__x")).select("__x.*")


def review_state(decision: Column) -> Column:
    return F.when(decision == "approve", "accepted").when(decision == "reject", "rejected").when(decision == "needs_work", "review")


def apply_reviews(revisions: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new revisions, conflicts): a review counts only if it names the latest revision of its example."""
    top = revisions.groupBy("example_id").agg(F.max("revision_id").alias("latest"))
    joined = reviews.join(top, "example_id", "left")
    fresh = F.col("base_revision") == F.col("latest")
    new = joined.where(fresh).select("example_id", (F.col("latest") + 1).alias("revision_id"), F.col("base_revision").alias("parent_revision_id"), review_state(F.col("decision")).alias("review_state"))
    return new, joined.where(~F.coalesce(fresh, F.lit(False))).select("example_id", "base_revision", "latest")


def version_chain(versions: DataFrame, project: str, order: list[str]) -> DataFrame:
    """Adds parent_version_id and version_no within each project."""
    columns = [F.col(c) for c in order]
    held = blocks(versions, [project], columns, Scratch(versions.sparkSession), "versions")
    return scan(held, [project], columns, number="version_no", lags={"parent_version_id": F.col("version_id")}).drop(BLOCK)


def keyset_page(df: DataFrame, key: str, before: int | None, size: int) -> DataFrame:
    """A page of `size` rows and one more (which tells whether there are others), by falling key, below the cursor."""
    rows = df if before is None else df.where(F.col(key) < before)
    return rows.orderBy(F.desc(key)).limit(size + 1)


def visible(projects: DataFrame, principal: str, admins: list[str]) -> DataFrame:
    return projects.where(F.lit(principal in admins or principal in ("local", "system")) | (F.col("owner") == principal))


def stamp(examples: DataFrame, version_id: str) -> DataFrame:
    """Accepted examples get the version's id, those of older versions too; others keep what they have."""
    return examples.withColumn("version_id", F.when(F.col("quality_status") == "accepted", F.lit(version_id)).otherwise(F.col("version_id")))
