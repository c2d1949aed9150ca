"""A call ledger that a stream writes: each call once, however often a micro-batch is tried or a call comes again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ledger's rows; an empty table before the first batch."""
    whole = f"{schema}, batch long"
    return spark.read.schema(whole).parquet(path) if _exists(spark, path) else spark.createDataFrame([], whole)


def ledger_sink(path: str, schema: str, key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: appends the calls whose key the ledger doesn't have yet, the first of each key by `order`.

    A batch has a folder of its own and is compared with earlier batches only, so a batch that is run again writes the same rows over what
    it had written; Spark commits a folder's files together."""

    def write(batch: DataFrame, batch_id: int) -> None:
        known = read_ledger(batch.sparkSession, path, schema).where(F.col("batch") < batch_id).select(*key)
        row = F.struct(*[F.col(c) for c in batch.columns])
        first = batch.groupBy(*key).agg(F.min_by(row, F.struct(*order)).alias("__x")).select("__x.*")
        names = [c.split()[0] for c in schema.split(", ")]
        first.join(known, key, "left_anti").select(*names).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def ledger_lookup(calls: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Calls with `recorded`: the ledger has their key, so that they need not be made."""
    known = ledger.select(*key).distinct().withColumn("__known", F.lit(True))
    return calls.join(known, key, "left").withColumn("recorded", F.coalesce("__known", F.lit(False))).drop("__known")


def replay(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there into a Parquet folder, and stops."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
