"""Upserts without rewriting: bucketed generations, append-only deltas, compaction bucket by bucket.

    <path>/deltas/version=3/bucket=17/    the rows of one upsert, by the hash of their key
    <path>/base/generation=2/bucket=17/   the state of a bucket up to some version
    <path>/_log/00000005.json             what counts: each bucket's generation and version, each delta's buckets

An upsert writes only its own rows; a look at some keys reads only their buckets; a compaction rewrites only buckets that have deltas. Each
change is one new log entry, created if nobody else has created it: readers see the state before or after it, and what a broken write left
behind is in no entry. The log holds a few numbers for each bucket, however many rows there are."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.sources.release import _Folder


class UpsertStore:
    """The last row of each key by `order` (of equal ones the later upsert's); schema: a DDL text that holds them."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        self.folder = _Folder(spark, path)
        self.buckets = self.log()["buckets"] or buckets

    def log(self) -> dict:
        """The newest entry."""
        found = self.folder.fs.globStatus(self.folder.at(f"{self.path}/_log/*.json"))
        names = sorted(f.getPath().getName() for f in found or [])
        if not names:
            return {"entry": 0, "buckets": None, "base": {}, "deltas": {}}
        return json.loads(self.folder.get(f"{self.path}/_log/{names[-1]}"))

    def _commit(self, log: dict, **changes: object) -> None:
        new = log | {"entry": log["entry"] + 1, "buckets": self.buckets} | changes
        out = self.folder.fs.create(self.folder.at(f"{self.path}/_log/{new['entry']:08d}.json"), False)  # fails if the entry is there
        try:
            out.write(json.dumps(new).encode())
        finally:
            out.close()

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _written(self, rows: DataFrame, place: str) -> list[int]:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{place}")
        found = self.folder.fs.globStatus(self.folder.at(f"{self.path}/{place}/bucket=*"))
        return sorted(int(f.getPath().getName().removeprefix("bucket=")) for f in found or [])

    def upsert(self, rows: DataFrame) -> int:
        """Adds rows; returns the version."""
        log = self.log()
        version = max([0, *map(int, log["deltas"]), *(b["version"] for b in log["base"].values())]) + 1
        names = [f.split()[0] for f in self.schema.split(", ")]
        touched = self._written(self._bucketed(rows.select(*names)), f"deltas/version={version}")
        self._commit(log, deltas=log["deltas"] | {str(version): touched})
        return version

    def _places(self, log: dict, wanted: set[int] | None) -> list[str]:
        base = [f"base/generation={b['generation']}/bucket={k}" for k, b in log["base"].items() if wanted is None or int(k) in wanted]
        since = {int(k): b["version"] for k, b in log["base"].items()}
        deltas = [f"deltas/version={v}/bucket={b}" for v, touched in log["deltas"].items() for b in touched if (wanted is None or b in wanted) and int(v) > since.get(b, 0)]
        return base + deltas

    def _rows(self, log: dict, wanted: set[int] | None) -> DataFrame:
        places = self._places(log, wanted)
        if not places:
            return self.spark.createDataFrame([], f"{self.schema}, version int, bucket int")
        read = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in places])
        at = F.col("_metadata.file_path")
        version = F.coalesce(F.nullif(F.regexp_extract(at, r"/version=(\d+)/", 1), F.lit("")).cast("int"), F.lit(0))
        return read.select("*", version.alias("version"), F.regexp_extract(at, r"/bucket=(\d+)/", 1).cast("int").alias("bucket"))

    def _latest(self, rows: DataFrame) -> DataFrame:
        names = [f.split()[0] for f in self.schema.split(", ")]
        last = F.max_by(F.struct(*names), F.struct(*self.order, "version"))
        return rows.groupBy("bucket", *self.key).agg(last.alias("__x")).select("bucket", "__x.*")

    def state(self) -> DataFrame:
        """The last row of every key."""
        return self._latest(self._rows(self.log(), None)).drop("bucket")

    def lookup(self, keys: list[tuple]) -> DataFrame:
        """The last rows of a few keys, read from their buckets alone."""
        kinds = ", ".join(f for f in self.schema.split(", ") if f.split()[0] in self.key)
        asked = self._bucketed(self.spark.createDataFrame(keys, kinds))
        wanted = {r["bucket"] for r in asked.select("bucket").distinct().collect()}
        return self._latest(self._rows(self.log(), wanted).join(F.broadcast(asked.select(*self.key)), self.key, "left_semi")).drop("bucket")

    def compact(self, least: int = 1) -> list[int]:
        """Folds the deltas of the buckets that have `least` or more of them into a new generation; returns these buckets. Old files stay until
        `stale` names them to whoever removes them, so that readers of an older entry are not disturbed."""
        log = self.log()
        since = {int(k): b["version"] for k, b in log["base"].items()}
        waiting: dict[int, int] = {}
        for v, touched in log["deltas"].items():
            for b in touched:
                waiting[b] = waiting.get(b, 0) + (int(v) > since.get(b, 0))
        chosen = {b for b, n in waiting.items() if n >= max(least, 1)}
        if not chosen:
            return []
        generation = max([0, *(b["generation"] for b in log["base"].values())]) + 1
        self._written(self._latest(self._rows(log, chosen)), f"base/generation={generation}")
        newest = max(map(int, log["deltas"]))
        self._commit(log, base=log["base"] | {str(b): {"generation": generation, "version": newest} for b in chosen})
        return sorted(chosen)

    def stale(self) -> list[str]:
        """Folders of buckets that the newest entry does not read."""
        found = [f.getPath().toString() for place in ("base/generation=*", "deltas/version=*") for f in self.folder.fs.globStatus(self.folder.at(f"{self.path}/{place}/bucket=*")) or []]
        live = tuple(f"/{p}" for p in self._places(self.log(), None))
        return sorted(f for f in found if not f.endswith(live))
