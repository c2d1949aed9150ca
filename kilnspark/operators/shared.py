"""Written tables in the folder that driver and executors share: they cut lineage, survive lost executors, and are computed once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Files of a written table: so many for each core at most, or the second number where that is more.
FILES = 4, 32


def few_files(df: DataFrame) -> DataFrame:
    """df in no more partitions than a table should have files, by laying partitions end to end; fewer stay as they are.

    Hadoop's local file system starts a process (chmod) for every file that it makes, and until that process runs its own program it shows
    the whole memory of the executor a second time. Tables of hundreds of tiny files are slow to write and to list anyway."""
    each, least = FILES
    return df.coalesce(max(each * df.sparkSession.sparkContext.defaultParallelism, least))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only in local mode with that unset."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kilnspark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone when the interpreter ends
        pass


class Scratch:
    """Written tables of one job. `drop` frees those that nothing reads any more; what is left goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        few_files(df).write.mode("overwrite").parquet(path)
        atexit.register(remove, self.spark, path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a written table that stays until the driver ends."""
    return Scratch(df.sparkSession).table(df, name)
