"""Sinks: JSON lines with a digest, Parquet, content-addressed blobs, metrics text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_json(df: DataFrame) -> DataFrame:
    """(value): each row as one JSON object with its keys in alphabetical order."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> DataFrame:
    """Writes JSON lines in parallel part files; returns one row (n_rows, digest), digest not depending on the order of rows."""
    lines = sorted_json(df)
    lines.write.mode("overwrite").text(path)
    digest = F.sum(F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)"))
    return df.sparkSession.read.text(path).agg(F.count("*").alias("n_rows"), digest.alias("digest"))


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def blobs(files: DataFrame) -> DataFrame:
    """(sha256, object_path, content) once for each distinct content."""
    rows = files.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    return rows.withColumn("object_path", F.concat_ws("/", F.lit("objects"), F.substring("sha256", 1, 2), "sha256"))


def damaged_blobs(stored: DataFrame) -> DataFrame:
    """(sha256, actual) of stored blobs whose content doesn't give the digest they are kept under."""
    return stored.select("sha256", F.sha2("content", 256).alias("actual")).where("actual is distinct from sha256")


def write_blobs(files: DataFrame, path: str) -> DataFrame:
    """Writes blobs that the store doesn't hold yet, by the first two digits of their digest; returns what the store holds. The path may be of
    any file system that Spark can write to."""
    spark = files.sparkSession
    new = blobs(files).withColumn("folder", F.substring("sha256", 1, 2))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    new.write.mode("append").partitionBy("folder").parquet(path)
    return spark.read.parquet(path).drop("folder")


#: The tables of a run in the order in which they refer to one another.
GRAPH = ["parsed", "spans", "chunks", "candidates", "examples"]


def write_graph(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes a run's tables below a new folder, each after those that it refers to, and last the number of rows of each: a folder without that
    table is a run that broke off. Whether references hold is for `provenance.violations` to say before."""
    unknown = set(tables) - set(GRAPH)
    if unknown or not tables:
        raise ValueError(f"tables of a run are {GRAPH}, got {sorted(tables)}")
    spark = next(iter(tables.values())).sparkSession
    written = [name for name in GRAPH if name in tables]
    for name in written:
        tables[name].write.parquet(f"{path}/{name}")
    counts = [(name, spark.read.parquet(f"{path}/{name}").count()) for name in written]
    spark.createDataFrame(counts, "name string, n_rows long").coalesce(1).write.parquet(f"{path}/written")
    return spark.read.parquet(f"{path}/written")


def publication_plan(records: DataFrame, repository: str, *, authorized: bool = False) -> DataFrame:
    """(path, size_bytes, sha256, target, action) for each manifest record of a release: what would be uploaded where. Without an explicit
    authorization every action is a dry run; the upload itself is no Spark job."""
    target = F.concat(F.lit(repository.rstrip("/") + "/"), F.col("path"))
    return records.select("path", "size_bytes", "sha256", target.alias("target"), F.lit("upload" if authorized else "dry_run").alias("action"))


def metrics_text(samples: DataFrame) -> DataFrame:
    """(value): count and sum lines of each metric (name, value)."""
    agg = samples.groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    lines = F.array(F.concat("name", F.lit("_count "), F.col("n").cast("string")), F.concat("name", F.lit("_sum "), F.col("total").cast("string")))
    return agg.select(F.explode(lines).alias("value"))
