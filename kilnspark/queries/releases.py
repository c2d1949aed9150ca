"""Queries over training rows, export manifests, versions, releases and budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.operators import examples, export, ledger, provenance, tree
from kilnspark.operators.shared import shared_dir
from kilnspark.queries.common import TREE_LEVELS, sql_hash_ratio, sql_list, sql_split_case, sql_tree, table
from kilnspark.queries.examples import _PRECISION, EXAMPLES, _generated_sql, _located, conversation_examples, generated
from kilnspark.queries.operations import SQL_EVENTS, _events
from kilnspark.sources import release, sinks
from kilnspark.sources.intake import folder_manifest
from kilnspark.sources.upserts import UpsertStore

BUDGET = {"cost": 400_000, "calls": 12, "input_tokens": 9_000}
MODEL_CAPS = {"click": 60_000, "purchase": 90_000}


def _by_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as examples whose topology goes by their number."""
    names = F.array(*[F.lit(t) for t in examples.TOPOLOGIES])
    return conversation_examples(spark, sf_dir).withColumn("topology", F.get(names, (F.col("conv_id") % 4).cast("int")))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.training_rows(_by_topology(spark, sf_dir))
    as_json = [F.to_json(c).alias(c) for c in ("messages", "prompt", "chosen", "rejected")]
    return rows.select("example_id", "topology", *as_json, "label", "split", "quality_score")


def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _located(spark, sf_dir).select(F.concat(F.lit("sp_"), "doc_id").alias("span_id"), "precision")
    return export.export_manifest(conversation_examples(spark, sf_dir), spans)


def dataset_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of all examples but every fourth, which isn't accepted."""
    rows = conversation_examples(spark, sf_dir).withColumn("quality_status", F.when(F.col("conv_id") % 4 == 0, "review").otherwise("accepted"))
    return export.freeze(rows, "ver_1", most_levels=TREE_LEVELS)


def content_hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth example has a stored hash that its contents do not give."""
    rows = conversation_examples(spark, sf_dir)
    stored = F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit("stale_"), "conv_id")).otherwise(F.col("content_hash"))
    return provenance.hash_mismatches(rows.withColumn("content_hash", stored), export.content_hash())


def release_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest records of a release of chat lines, in shards of about 64."""
    rows = conversation_examples(spark, sf_dir)
    lines = rows.select("example_id", "split", F.to_json(F.struct(*export.openai_chat())).alias("line"))
    return export.bundle_manifest(export.release_files(lines, shard_rows=64))


def publish_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.publication_plan(release_bundle(spark, sf_dir), "datasets/example/")


def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir).groupBy("topology").agg(F.count("*").alias("n"))


def budget_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's calls with what is spent and the first limit that is reached; the event's type is the model."""
    calls = _events(spark, sf_dir).withColumn("model", F.col("event_type"))
    out = ledger.budget_checks(calls, "user_id", ["ts", "event_id"], BUDGET, per_model=MODEL_CAPS)
    return out.select("event_id", "spent_cost", "spent_calls", "spent_input_tokens", "spent_model", "exceeded")


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A release of chat lines with a line for each source, on disk; its folder."""
    path = f"{shared_dir(spark)}/release-{uuid.uuid4().hex}/v1"
    lines = conversation_examples(spark, sf_dir).select("example_id", "split", F.to_json(F.struct(*export.openai_chat())).alias("line"))
    sources = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    told = sources.select(F.col("source").alias("example_id"), F.to_json(F.struct("source", "n", "chars")).alias("line"))
    cards = {name: {"name": name} for name in ("dataset_card", "quality_report", "license_summary", "privacy_summary")}
    release.write_release(lines, path, version="1.0", project="p", readme="# Release", cards=cards, tables={"sources": told}, shard_rows=64)
    return path


def release_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data and source files of a release, as they lie on disk."""
    path = _written(spark, sf_dir)
    return folder_manifest(spark, path).where("path like 'data/%' or path like 'sources/%'")


def format_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the sharegpt layout, with the digests of their bytes."""
    return release.write_format(conversation_examples(spark, sf_dir), "sharegpt", f"{shared_dir(spark)}/format-{uuid.uuid4().hex}", shard_rows=64)


def release_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check of a release on disk finds after all shards of one split have gone and those of the sources were written again."""
    path = _written(spark, sf_dir)
    folder = release._Folder(spark, path)
    folder.fs.delete(folder.at(f"{path}/data/test"), True)
    for found in folder.fs.listStatus(folder.at(f"{path}/sources")):
        folder.put(found.getPath().toString(), b"other\n")
    return release.verify_release(spark, path)


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[str, str, DataFrame, DataFrame, int]:
    """Two snapshots of the documents as files, written with their trees: some files changed, went or came."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")
    old = docs.where("doc_id % 101 <> 7")
    new = docs.where("doc_id % 97 <> 5").withColumn("content", F.when(F.col("doc_id") % 53 == 3, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    path, levels = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}", tree.levels_for(docs.count())
    for name, rows in (("old", old), ("new", new)):
        tree.write_snapshot(rows.select("path", F.sha2("content", 256).alias("sha256")), f"{path}/{name}", levels)
    return f"{path}/old", f"{path}/new", old, new, levels


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, _, _, levels = _snapshots(spark, sf_dir)
    return tree.compare_snapshots(spark, old, new, levels)


def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan that brings the new snapshot back to the old one."""
    old, new, backup, _, levels = _snapshots(spark, sf_dir)
    return tree.restore_plan(tree.compare_snapshots(spark, old, new, levels), backup.select("path", F.sha2("content", 256).alias("sha256")))


def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' records after three upserts, with a compaction after the second."""
    store = UpsertStore(spark, f"{shared_dir(spark)}/upserts-{uuid.uuid4().hex}", "doc_id long, rev int, source string, n_chars long", ["doc_id"], ["rev"], buckets=16)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("rev"), "source", F.col("n_chars").cast("long").alias("n_chars"))
    store.upsert(rows)
    store.upsert(rows.where("doc_id % 3 = 0").withColumns({"rev": F.lit(1), "n_chars": F.col("n_chars") + 1}))
    store.compact()
    store.upsert(rows.where("doc_id % 5 = 0").withColumns({"rev": F.lit(2), "source": F.lit("moved")}))
    return store.state().withColumn("rev", F.col("rev").cast("long"))


QUERIES = {
    "upsert_state": upsert_state,
    "release_written": release_written,
    "release_damage": release_damage,
    "format_files": format_files,
    "snapshot_changes": snapshot_changes,
    "backup_restore": backup_restore,
    "training_rows": training_rows,
    "export_manifest": export_manifest,
    "dataset_version": dataset_version,
    "content_hash_check": content_hash_check,
    "release_bundle": release_bundle,
    "publish_plan": publish_plan,
    "candidate_counts": candidate_counts,
    "budget_limits": budget_limits,
}

_SPLIT = sql_split_case(sql_hash_ratio("example_id"))
_CHAT = "list_concat(list_concat(list_transform(sys, lambda c: {'role': 'system', 'content': c}), prompt), chosen)"
_KIND = f"({sql_list(examples.TOPOLOGIES)})[conv_id % 4 + 1]"
_CAPPED = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MODEL_CAPS.items())

ORACLES = {
    "training_rows": f"""WITH {EXAMPLES}, k AS (SELECT *, {_KIND} AS topology FROM e)
        SELECT example_id, topology, CASE WHEN topology = 'kto' THEN to_json(list_concat(prompt, chosen))::VARCHAR WHEN topology <> 'preference' THEN to_json({_CHAT})::VARCHAR END AS messages,
            CASE WHEN topology = 'preference' THEN to_json(prompt)::VARCHAR END AS prompt, CASE WHEN topology = 'preference' THEN to_json(chosen)::VARCHAR END AS chosen, CASE WHEN topology = 'preference' THEN '[]' END AS rejected,
            CASE WHEN topology = 'kto' THEN CASE WHEN conv_id % 2 = 0 THEN 'good' WHEN conv_id % 5 = 0 THEN 'bad' END END AS label, {_SPLIT} AS split, round((conv_id % 10)::DOUBLE / 10.0::DOUBLE, 4) AS quality_score FROM k""",
    "export_manifest": f"""WITH {EXAMPLES}, s AS (SELECT {_SPLIT} AS split FROM e), c AS (SELECT DISTINCT doc_id, text FROM e JOIN documents ON doc_id = conv_id WHERE len(spans) > 0), p AS (SELECT {_PRECISION} AS precision FROM c)
        SELECT 'records' AS section, 'all' AS name, count(*) AS n FROM e UNION ALL SELECT 'document', 'doc_' || conv_id, count(*) FROM e GROUP BY 2
        UNION ALL SELECT 'split', d.x, count(s.split) FROM (SELECT unnest({sql_list(export.SPLITS)}) AS x) d LEFT JOIN s ON s.split = d.x GROUP BY 2
        UNION ALL SELECT 'precision', d.x, count(p.precision) FROM (SELECT unnest({sql_list(export.SPAN_PRECISIONS)}) AS x) d LEFT JOIN p ON p.precision = d.x GROUP BY 2""",
    "dataset_version": f"""WITH {EXAMPLES}, m AS (SELECT example_id AS path, content_hash AS h, {_SPLIT} AS split FROM e WHERE conv_id % 4 <> 0), {sql_tree('m')}
        SELECT count(*) AS member_count, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'validation') AS validation_count, count(*) FILTER (split = 'test') AS test_count, (SELECT root FROM tree) AS content_root, 'ver_1' AS version_id FROM m""",
    "content_hash_check": "SELECT DISTINCT 'conv_' || conv_id AS example_id, 'content_hash_mismatch' AS violation, 'stale_' || conv_id AS reference FROM conversations WHERE conv_id % 9 = 0",
    "release_bundle": f"""WITH {EXAMPLES}, l AS (SELECT example_id, {_SPLIT} AS split, to_json({{'messages': {_CHAT}}})::VARCHAR AS line FROM e), n AS (SELECT split, count(*) // 64 + 1 AS shards FROM l GROUP BY 1),
        f AS (SELECT 'data/' || l.split || '/part-' || lpad((('0x' || substr(sha256(example_id), 1, 8))::BIGINT % shards)::VARCHAR, 5, '0') || '.jsonl' AS path, string_agg(line, chr(10) ORDER BY example_id) || chr(10) AS content FROM l JOIN n ON n.split = l.split GROUP BY 1)
        SELECT path, strlen(content)::BIGINT AS size_bytes, sha256(content) AS sha256, 'application/x-ndjson' AS media_type FROM f""",
    "candidate_counts": f"SELECT topology, count(*) AS n FROM ({_generated_sql()}) GROUP BY 1",
    "budget_limits": f"""WITH {SQL_EVENTS}, r AS (SELECT *, sum(cost_micro) OVER j AS spent_cost, count(*) OVER j AS spent_calls, sum(input_tokens) OVER j AS spent_input, sum(cost_micro) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent_model
            FROM c WINDOW j AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
        SELECT event_id, spent_cost::BIGINT AS spent_cost, spent_calls, spent_input::BIGINT AS spent_input_tokens, spent_model::BIGINT AS spent_model,
            CASE WHEN spent_cost >= {BUDGET['cost']} THEN 'cost' WHEN spent_calls >= {BUDGET['calls']} THEN 'calls' WHEN spent_input >= {BUDGET['input_tokens']} THEN 'input_tokens' WHEN spent_model >= CASE event_type {_CAPPED} END THEN 'model_cost' END AS exceeded FROM r""",
}
ORACLES["publish_plan"] = f"SELECT path, size_bytes, sha256, 'datasets/example/' || path AS target, 'dry_run' AS action FROM ({ORACLES['release_bundle']})"

_SHARD = "lpad((('0x' || substr(sha256({key}), 1, 8))::BIGINT % {shards})::VARCHAR, 5, '0')"
_SOURCES = f"""o AS (SELECT source, to_json({{'source': source, 'n': count(*), 'chars': sum(n_chars)::BIGINT}})::VARCHAR AS line, count(*) OVER () // 64 + 1 AS shards FROM documents GROUP BY 1),
    g AS (SELECT 'sources/part-' || {_SHARD.format(key='source', shards='shards')} || '.jsonl' AS path, string_agg(line, chr(10) ORDER BY source) || chr(10) AS content FROM o GROUP BY 1)"""
ORACLES["release_written"] = f"WITH b AS ({ORACLES['release_bundle']}), {_SOURCES} SELECT path, size_bytes, sha256 FROM b UNION ALL SELECT path, strlen(content)::BIGINT, sha256(content) FROM g"
ORACLES["release_damage"] = f"WITH b AS ({ORACLES['release_bundle']}), {_SOURCES} SELECT path, 'absent' AS problem FROM b WHERE starts_with(path, 'data/test/') UNION ALL SELECT path, 'sha256_mismatch' FROM g"
_CHANGES = """f AS (SELECT 'doc/' || doc_id AS path, coalesce(text, '') AS c, doc_id FROM documents),
    d AS (SELECT path, c, CASE WHEN doc_id % 101 = 7 AND doc_id % 97 = 5 THEN NULL WHEN doc_id % 101 = 7 THEN 'extra' WHEN doc_id % 97 = 5 THEN 'missing' WHEN doc_id % 53 = 3 THEN 'changed' END AS change FROM f)"""
ORACLES["snapshot_changes"] = f"WITH {_CHANGES} SELECT path, change FROM d WHERE change IS NOT NULL"
ORACLES["backup_restore"] = f"WITH {_CHANGES} SELECT path, CASE change WHEN 'extra' THEN 'delete' ELSE 'copy' END AS action, CASE WHEN change <> 'extra' THEN sha256(c) END AS sha256 FROM d WHERE change IS NOT NULL"
ORACLES["upsert_state"] = "SELECT doc_id, (CASE WHEN doc_id % 5 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS rev, CASE WHEN doc_id % 5 = 0 THEN 'moved' ELSE source END AS source, (n_chars + CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_chars FROM documents"
_TURNS = "list_transform(prompt || chosen, lambda m: {'from': CASE WHEN m.role IN ('user', 'system') THEN 'human' ELSE 'gpt' END, 'value': m.content})"
ORACLES["format_files"] = f"""WITH {EXAMPLES}, l AS (SELECT example_id, to_json({{'content_hash': content_hash, 'conversations': {_TURNS}, 'example_id': example_id, 'generation_candidate_ids': ['cand_' || conv_id], 'source_document_ids': ['doc_' || conv_id],
        'source_span_ids': spans, 'split': {_SPLIT}}})::VARCHAR AS line, count(*) OVER () // 64 + 1 AS shards FROM e),
    f AS (SELECT 'part-' || {_SHARD.format(key='example_id', shards='shards')} || '.jsonl' AS path, string_agg(line, chr(10) ORDER BY example_id) || chr(10) AS content FROM l GROUP BY 1)
    SELECT path, strlen(content)::BIGINT AS size_bytes, sha256(content) AS sha256 FROM f"""
