"""Exact global positions without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_position(df: DataFrame, order: list[Column], bucket: Column, name: str, coarse: Column | None = None) -> DataFrame:
    """0-based position of each row in `order`; `bucket` must not decrease along it (a date, a hash prefix, a key's high part), nor must
    `coarse` along the buckets. Nulls come first.

    Rows are numbered inside their bucket. What lies before a bucket is a running sum over the buckets of its coarse part and one
    over the coarse parts, so no task sees more than one part's buckets."""
    keyed = df.withColumn("__coarse", F.lit(0) if coarse is None else coarse).withColumn("__bucket", bucket)
    counts = keyed.groupBy("__coarse", "__bucket").agg(F.count("*").alias("__n"))
    parts = counts.groupBy("__coarse").agg(F.sum("__n").alias("__m"))
    before_part = parts.select(F.col("__coarse").alias("__c"), (F.sum("__m").over(Window.orderBy("__coarse")) - F.col("__m")).alias("__before"))
    inside_part = F.sum("__n").over(Window.partitionBy("__coarse").orderBy("__bucket")) - F.col("__n")
    ahead = counts.withColumn("__part", inside_part).join(before_part, F.col("__coarse").eqNullSafe(F.col("__c")))
    ahead = ahead.select(F.col("__coarse").alias("__c"), F.col("__bucket").alias("__b"), (F.col("__before") + F.col("__part")).alias("__ahead"))
    inside = F.row_number().over(Window.partitionBy("__coarse", "__bucket").orderBy(*order)) - 1
    met = keyed.withColumn("__inside", inside).join(ahead, F.col("__coarse").eqNullSafe(F.col("__c")) & F.col("__bucket").eqNullSafe(F.col("__b")))
    return met.withColumn(name, F.col("__ahead") + F.col("__inside")).drop("__coarse", "__bucket", "__inside", "__ahead", "__c", "__b")
