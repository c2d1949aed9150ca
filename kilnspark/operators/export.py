"""Trainer layouts as projections, manifests and their verification."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions.canonical import json_list
from kilnspark.functions.wordlists import SPAN_PRECISIONS
from kilnspark.operators.examples import MESSAGES, contents

PROVENANCE = ["source_document_ids", "source_span_ids", "generation_candidate_ids", "content_hash", "split"]


def _filled(messages: str) -> Column:
    return F.array_join(F.filter(contents(F.col(messages)), lambda c: c != ""), "\n")


def _chat() -> Column:
    system = F.transform("system_messages", lambda c: F.struct(F.lit("system").alias("role"), c.alias("content"))).cast(MESSAGES)
    return F.concat(system, "prompt_messages", "chosen_messages")


def _desirable() -> Column:
    """True where no label is given or it is `good` (a label `bad` is false)."""
    return F.coalesce(F.col("label_or_target") == "good", F.lit(True))


def openai_chat() -> list[Column]:
    return [_chat().alias("messages")]


def sharegpt() -> list[Column]:
    turns = F.transform(F.concat("prompt_messages", "chosen_messages"), lambda m: F.struct(F.when(m["role"].isin("user", "system"), "human").otherwise("gpt").alias("from"), m["content"].alias("value")))
    return [turns.alias("conversations")]


def alpaca() -> list[Column]:
    lines = contents(F.filter("prompt_messages", lambda m: m["role"].isin("user", "system")))
    rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    return [F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("instruction"), rest.alias("input"), _filled("chosen_messages").alias("output")]


def trl_sft() -> list[Column]:
    return [F.array_join(F.transform(_chat(), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("text")]


def trl_preference() -> list[Column]:
    return [_filled(f"{side}_messages").alias(side) for side in ("prompt", "chosen", "rejected")]


def kto() -> list[Column]:
    return [_filled("prompt_messages").alias("prompt"), _filled("chosen_messages").alias("completion"), _desirable().alias("label")]


def evaluation() -> list[Column]:
    return [_filled("prompt_messages").alias("prompt"), _filled("chosen_messages").alias("reference_answer")]


def huggingface_layout() -> list[Column]:
    return [_chat().alias("messages"), F.col("topology"), F.round("quality_score", 4).alias("quality_score")]


FORMATS: dict[str, Callable[[], list[Column]]] = {
    "openai_chat": openai_chat,
    "sharegpt": sharegpt,
    "alpaca": alpaca,
    "trl_sft": trl_sft,
    "trl_preference": trl_preference,
    "kto": kto,
    "evaluation": evaluation,
    "huggingface_layout": huggingface_layout,
}


def layout(examples: DataFrame, name: str, key: str = "example_id") -> DataFrame:
    """Rows of a named layout with key and provenance columns."""
    if name not in FORMATS:
        raise ValueError(f"unknown export format: {name!r}")
    return examples.select(key, *FORMATS[name](), *PROVENANCE)


def content_hash() -> Column:
    """SHA-256 over the topology's contents as canonical JSON."""
    of = lambda c: json_list(contents(F.col(c)))
    pair = F.concat(F.lit('{"c":'), of("chosen_messages"), F.lit(',"r":'), of("rejected_messages"), F.lit("}"))
    first = lambda c: F.coalesce(F.get(contents(F.col(c)), F.lit(0)), F.lit(""))
    asked = json_list(F.array(first("prompt_messages"), first("chosen_messages")))
    chain = json_list(F.concat("system_messages", contents(F.col("prompt_messages")), contents(F.col("chosen_messages"))))
    return F.sha2(F.when(F.col("topology") == "preference", pair).when(F.col("topology") == "evaluation", asked).otherwise(chain), 256)


def manifest(files: DataFrame) -> DataFrame:
    """(path, size_bytes, sha256) of each (path, content)."""
    return files.select("path", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"))


def content_root(entries: DataFrame, group: str | None = None) -> DataFrame:
    """The SHA-256 of the entries' digests in path order; by group if one is named. Each group's digests meet in one row: for groups of a
    known size (a release's files); `content_tree` is for any number."""
    digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda e: e["sha256"]), "")
    grouped = entries.groupBy(group) if group else entries.groupBy()
    return grouped.agg(F.count("*").alias("n_files"), F.sha2(digests, 256).alias("content_root"))


def training_rows(examples: DataFrame, key: str = "example_id") -> DataFrame:
    """Rows for training by topology: prompt, chosen and rejected of a preference; messages and label of a kto (without system turns); messages
    with the system turns first of any other. The columns of other topologies are null."""
    pair, kto = F.col("topology") == "preference", F.col("topology") == "kto"
    turns = F.concat("prompt_messages", "chosen_messages")
    sides = [F.when(pair, F.col(f"{side}_messages")).alias(side) for side in ("prompt", "chosen", "rejected")]
    messages = F.when(kto, turns).when(~pair, _chat()).alias("messages")
    return examples.select(key, "topology", messages, *sides, F.when(kto, F.col("label_or_target")).alias("label"), *PROVENANCE, F.round("quality_score", 4).alias("quality_score"))


SPLITS = ["train", "validation", "test"]


def _counted(rows: DataFrame, section: str, name: str, domain: list[str] | None = None) -> DataFrame:
    """(section, name, n): rows by name; names of the domain that no row has count zero."""
    counts = rows.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    if domain is not None:
        every = rows.sparkSession.createDataFrame([(d,) for d in domain], "name string")
        counts = every.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.select(F.lit(section).alias("section"), "name", "n")


def export_manifest(examples: DataFrame, spans: DataFrame) -> DataFrame:
    """(section, name, n) of an export: its records, the splits' counts, the documents with the examples that cite them, and how many of the
    cited spans (span_id, precision) have each precision."""
    records = examples.agg(F.count("*").alias("n")).select(F.lit("records").alias("section"), F.lit("all").alias("name"), "n")
    cited = examples.select(F.explode("source_span_ids").alias("span_id")).distinct().join(spans.select("span_id", "precision"), "span_id")
    documents = examples.select(F.explode(F.array_distinct("source_document_ids")).alias("document"))
    parts = [_counted(examples, "split", "split", SPLITS), _counted(documents, "document", "document"), _counted(cited, "precision", "precision", SPAN_PRECISIONS)]
    for part in parts:
        records = records.unionByName(part)
    return records


def release_files(lines: DataFrame, key: str = "example_id", shard_rows: int = 4096) -> DataFrame:
    """(path, content) of a release's data: the lines (key, split, line) of each split in shards of about `shard_rows` by a hash of the key, in
    key order, each line ended by a line feed. Carriage returns before line feeds go."""
    shards = lines.groupBy("split").agg((F.floor(F.count("*") / shard_rows) + 1).alias("__shards"))
    number = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % F.col("__shards")
    dealt = lines.join(F.broadcast(shards), "split").withColumn("path", F.format_string("data/%s/part-%05d.jsonl", F.col("split"), number))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("line").alias("l")))), lambda x: x["l"]), "\n")
    return dealt.groupBy("path").agg(F.replace(F.concat(text, F.lit("\n")), F.lit("\r\n"), F.lit("\n")).alias("content"))


def media_type(path: Column) -> Column:
    return F.when(path.endswith(".jsonl"), "application/x-ndjson").when(path.endswith(".json"), "application/json").when(path.endswith(".md"), "text/markdown").otherwise("application/octet-stream")


def bundle_manifest(files: DataFrame) -> DataFrame:
    """(path, size_bytes, sha256, media_type) of a release's files. Its content root is `content_tree` of these rows."""
    return manifest(files).withColumn("media_type", media_type(F.col("path")))


def verify_records(records: DataFrame, have: DataFrame, required: list[str], root: str | None) -> DataFrame:
    """(path, problem) of files (path, size_bytes, sha256) against a release's records: required files that are missing, listed files that are
    absent or differ in size or digest, and a content root that is not the records'. Files that the records do not list are no problem."""
    own = have.select("path", F.col("size_bytes").alias("size"), F.col("sha256").alias("digest"))
    met = records.select("path", "size_bytes", "sha256").join(own, "path", "left")
    problem = F.when(F.col("digest").isNull(), "absent").when(F.col("digest") != F.col("sha256"), "sha256_mismatch").when(F.col("size") != F.col("size_bytes"), "size_mismatch")
    listed = met.select("path", problem.alias("problem")).where("problem is not null")
    needed = records.sparkSession.createDataFrame([(r,) for r in required], "path string")
    missing = needed.join(own.select("path"), "path", "left_anti").select("path", F.lit("missing_required").alias("problem"))
    rooted = content_tree(records).where(F.col("content_root") != F.lit(root)).select(F.lit("").alias("path"), F.lit("content_root_mismatch").alias("problem"))
    return listed.unionByName(missing).unionByName(rooted)


def verify_bundle(records: DataFrame, files: DataFrame, required: list[str], root: str) -> DataFrame:
    """`verify_records` of files (path, content)."""
    return verify_records(records, manifest(files), required, root)


def freeze(examples: DataFrame, version_id: str, key: str = "example_id", most_levels: int | None = None) -> DataFrame:
    """One row: a version's members (accepted examples), their counts by split, and the root of their content hashes in key order of the tree.
    Which examples are members is a table of its own (`lifecycle.stamp`), for a version may have any number of them."""
    members = examples.where("quality_status = 'accepted'")
    counts = members.agg(F.count("*").alias("member_count"), *[F.count_if(F.col("split") == s).alias(f"{s}_count") for s in SPLITS])
    root = content_tree(members.select(F.col(key).alias("path"), F.col("content_hash").alias("sha256")), most_levels=most_levels)
    return counts.crossJoin(root.select("content_root")).withColumn("version_id", F.lit(version_id))


def _digests_in_order(level: DataFrame, digits: int) -> DataFrame:
    """(path, n, sha256) of folders of any size: a folder's digests stream through one hash in path order, so that no row gathers them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, made = None, 0, None
        for batch in batches:
            done = []
            for name, some in batch.groupby("__f", sort=False):
                if name != now:
                    if made is not None:
                        done.append((now, n, made.hexdigest()))
                    now, n, made = name, 0, hashlib.sha256()
                n += int(some["n"].sum())
                made.update("".join(some["sha256"].dropna()).encode())
            yield pd.DataFrame(done, columns=["path", "n", "sha256"])
        if made is not None:
            yield pd.DataFrame([(now, n, made.hexdigest())], columns=["path", "n", "sha256"])

    rows = level.withColumn("__f", F.coalesce(F.substring("__h", 1, digits), F.lit(""))).repartition("__f").sortWithinPartitions("__f", "path", "sha256")
    return rows.select("__f", "n", "sha256").mapInPandas(run, "path string, n long, sha256 string")


def content_tree(entries: DataFrame, fan_out: int = 256, most_levels: int | None = None) -> DataFrame:
    """One row (n_files, content_root) over any number of (path, sha256): folders named by the first hex digits of a hash of the path, two
    digits fewer on each level, as many levels as keep a folder to about `fan_out` entries, and `most_levels` at most. Folders that are larger
    because of that are hashed as streams."""
    n, levels = entries.count(), 0
    while n > fan_out * 256**levels and levels != most_levels:
        levels += 1
    large = levels > 0 and n > fan_out * 256**levels
    level = entries.select("path", "sha256", F.lit(1).cast("long").alias("n"), F.sha2("path", 256).alias("__h"))
    for digits in range(2 * levels, -1, -2):
        if large and digits == 2 * levels:
            path = F.nullif(F.col("path"), F.lit(""))
            level = _digests_in_order(level, digits).select(path.alias("path"), "sha256", "n", path.alias("__h"))
            continue
        inside = F.array_sort(F.collect_list(F.struct("path", "sha256")))
        folder = F.substring("__h", 1, digits) if digits else F.lit("")
        made = level.groupBy(folder.alias("__f")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(inside, lambda e: e["sha256"]), ""), 256).alias("sha256"))
        level = made.select(F.col("__f").alias("path"), "sha256", "n", F.col("__f").alias("__h"))
    empty = F.sha2(F.lit(""), 256)
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.max("sha256"), empty).alias("content_root"))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, problem) for files that are missing, unexpected or changed."""
    e, a = expected.select("path", F.col("sha256").alias("want")), actual.select("path", F.col("sha256").alias("have"))
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") != F.col("want"), "changed")
    return e.join(a, "path", "full_outer").select("path", problem.alias("problem")).where("problem is not null")
