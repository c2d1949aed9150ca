"""Releases on disk: named files under a staging folder, published by one rename, checked against their own records.

    <path>/data/<split>/part-00000.jsonl   lines in key order, dealt by a hash of the key
    <path>/<table>/part-00000.jsonl        other tables of lines (sources), dealt likewise
    <path>/README.md, <card>.json          small texts, JSON with sorted keys
    <path>/files.jsonl                     a record for each of the above: path, size, sha256, media type
    <path>/manifest.json                   counts, the content root over the records, the digest of files.jsonl
    <path>.sha256                          the digest of manifest.json, kept beside the release

Executors write and sort the lines, a shard in one task and never in one row; the driver names the finished files (one rename for each shard)
and writes the small ones. Nothing is at <path> before the last rename; a write that is killed leaves a folder that begins with an
underscore. What is written depends on the rows alone, so two writes of the same rows are equal byte for byte."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.operators.export import content_tree, layout, media_type, verify_records
from kilnspark.sources.intake import folder_manifest

SCHEMA = "kilnspark-release/1"
#: Files that every release has.
REQUIRED = ["README.md", "dataset_card.json", "quality_report.json", "license_summary.json", "privacy_summary.json"]
RECORD = "path string, size_bytes long, sha256 string, media_type string"


class _Folder:
    """A file system of Spark's, for the small files."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.at(path).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def put(self, path: str, content: bytes) -> None:
        out = self.fs.create(self.at(path), True)
        try:
            out.write(content)
        finally:
            out.close()

    def get(self, path: str) -> bytes | None:
        if not self.exists(path):
            return None
        given = self.fs.open(self.at(path))
        try:
            return bytes(given.readAllBytes())
        finally:
            given.close()

    def move(self, source: str, target: str) -> None:
        self.fs.mkdirs(self.at(target).getParent())
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"can't rename {source} to {target}")


def _json(value: object) -> bytes:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False).encode()


def _write_lines(lines: DataFrame, key: str, folder: _Folder, staging: str, shard_rows: int) -> dict[str, int]:
    """Writes lines (folder, key, line) as named shards; returns the rows of each folder."""
    spark = lines.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = {r["folder"]: r["n"] for r in lines.groupBy("folder").agg(F.count("*").alias("n")).collect()}  # a few splits and tables
    if not counts:
        return counts
    shards = F.create_map(*[F.lit(x) for name, rows in counts.items() for x in (name, rows // shard_rows + 1)])
    number = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long") % shards[F.col("folder")]
    whole = F.regexp_replace("line", r"\r(?=\n|\z)", "")
    # one column that the key decides, so that the writer asks for no order of its own
    place = F.concat_ws("|", "folder", number.cast("string"))
    dealt = lines.select(place.alias("place"), F.col(key).alias("__key"), whole.alias("value")).repartition(n, "place")
    parts = f"{staging}/_parts"
    dealt.sortWithinPartitions("place", "__key", "value").select("place", "value").write.option("compression", "none").partitionBy("place").text(parts)
    for found in folder.fs.globStatus(folder.at(f"{parts}/place=*/part-*")):
        source = found.getPath()
        named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(source.getParent().getName().removeprefix("place="))
        name, _, number = named.rpartition("|")
        folder.move(source.toString(), f"{staging}/{name}/part-{int(number):05d}.jsonl")
    folder.fs.delete(folder.at(parts), True)
    return counts


def write_release(lines: DataFrame, path: str, *, version: str, project: str, readme: str, cards: dict[str, dict], note: str = "", tables: dict[str, DataFrame] | None = None, key: str = "example_id", shard_rows: int = 4096) -> DataFrame:
    """Writes a release of lines (key, split, line) and returns its records. cards: name to content of each `<name>.json`; tables: name to
    (key, line). A release that is there is never written over."""
    spark, path = lines.sparkSession, path.rstrip("/")
    folder = _Folder(spark, path)
    if folder.exists(path):
        raise FileExistsError(path)
    parent, _, name = path.rpartition("/")
    staging = f"{parent}/_staging-{name}-{uuid.uuid4().hex}"
    every = lines.select(F.concat(F.lit("data/"), F.coalesce("split", F.lit("none"))).alias("folder"), F.col(key), "line")
    for table, rows in (tables or {}).items():
        every = every.unionByName(rows.select(F.lit(table).alias("folder"), F.col(key), "line"))
    counts = _write_lines(every, key, folder, staging, shard_rows)
    folder.put(f"{staging}/README.md", (readme.replace("\r\n", "\n").rstrip("\n") + "\n").encode())
    for card, content in cards.items():
        folder.put(f"{staging}/{card}.json", _json(content))
    records = folder_manifest(spark, staging).withColumn("media_type", media_type(F.col("path")))
    listed = sorted(map(tuple, records.select("path", "size_bytes", "sha256", "media_type").collect()))  # one for each file
    told = "".join(json.dumps(dict(zip(("path", "size_bytes", "sha256", "media_type"), r, strict=True)), sort_keys=True, ensure_ascii=False) + "\n" for r in listed).encode()
    made = spark.createDataFrame(listed, RECORD)
    manifest = {
        "schema": SCHEMA, "version": version, "project_id": project, "note": note, "reproducible": True, "n_files": len(listed),
        "split_counts": {k.removeprefix("data/"): v for k, v in counts.items() if k.startswith("data/")}, "table_counts": {k: v for k, v in counts.items() if not k.startswith("data/")},
        "content_root_sha256": content_tree(made).first()["content_root"], "files_sha256": hashlib.sha256(told).hexdigest(),
        "quality_report_sha256": hashlib.sha256(json.dumps(cards.get("quality_report", {}), sort_keys=True, separators=(",", ":")).encode()).hexdigest(),
    }
    folder.put(f"{staging}/files.jsonl", told)
    folder.put(f"{staging}/manifest.json", _json(manifest))
    folder.put(f"{path}.sha256", hashlib.sha256(_json(manifest)).hexdigest().encode() + b"\n")
    folder.move(staging, path)
    return made


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(f"{path.rstrip('/')}/files.jsonl")


def verify_release(spark: SparkSession, path: str) -> DataFrame:
    """(path, problem) of a release on disk: its detached digest, its manifest, its records, its files. Empty if all is well.

    Files that the records do not list are no problem, as in `export.verify_bundle`."""
    path = path.rstrip("/")
    folder, found = _Folder(spark, path), []
    if not folder.exists(path):
        raise FileNotFoundError(path)
    detached, raw, told = (folder.get(p) for p in (f"{path}.sha256", f"{path}/manifest.json", f"{path}/files.jsonl"))
    if detached is None:
        found.append((f"{path.rpartition('/')[2]}.sha256", "detached_missing"))
    elif raw is not None and hashlib.sha256(raw).hexdigest() not in detached.decode("ascii", "replace").split():
        found.append(("manifest.json", "detached_mismatch"))
    try:
        manifest = json.loads(raw or b"")
    except ValueError:
        manifest = None
    if not isinstance(manifest, dict):
        found.append(("manifest.json", "missing_required" if raw is None else "not_json"))
        manifest = {}
    else:
        if not manifest.get("schema"):
            found.append(("manifest.json", "schema_missing"))
        if not manifest.get("content_root_sha256"):
            found.append(("manifest.json", "content_root_missing"))
        if "bundle_sha256" in manifest:
            found.append(("manifest.json", "self_referential"))
    if told is None or manifest.get("files_sha256") not in (None, hashlib.sha256(told).hexdigest()):
        found.append(("files.jsonl", "missing_required" if told is None else "sha256_mismatch"))
    problems = spark.createDataFrame(found, "path string, problem string")
    if told is None:
        return problems
    root = manifest.get("content_root_sha256")
    return problems.unionByName(verify_records(read_records(spark, path), folder_manifest(spark, path), REQUIRED, root))


def write_lines(rows: DataFrame, path: str, *, key: str, line: str = "line", shard_rows: int = 4096) -> DataFrame:
    """Writes the lines of `rows` (key, line) as `part-00000.jsonl` and so on below a new folder, each shard in key order; returns (path,
    size_bytes, sha256) of the files, the digests being those of their bytes."""
    spark, path = rows.sparkSession, path.rstrip("/")
    folder = _Folder(spark, path)
    if folder.exists(path):
        raise FileExistsError(path)
    parent, _, name = path.rpartition("/")
    staging = f"{parent}/_staging-{name}-{uuid.uuid4().hex}"
    folder.fs.mkdirs(folder.at(f"{staging}/lines"))
    _write_lines(rows.select(F.lit("lines").alias("folder"), F.col(key), F.col(line).alias("line")), key, folder, staging, shard_rows)
    folder.move(f"{staging}/lines", path)
    folder.fs.delete(folder.at(staging), True)
    return folder_manifest(spark, path)


def write_format(examples: DataFrame, name: str, path: str, *, key: str = "example_id", shard_rows: int = 4096) -> DataFrame:
    """Writes examples in one of the trainers' layouts, one JSON object a line with its keys in order; returns the files' records."""
    rows = layout(examples, name, key)
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    return write_lines(rows.select(F.col(key), whole.alias("line")), path, key=key, shard_rows=shard_rows)
