"""Splits with nulls, exact positions, plans, training rows, releases, versions and budgets on small tables."""

import hashlib

from pyspark.sql import functions as F

from kilnspark.operators import examples, export, governance, inspection, ledger, lifecycle, planner, provenance, split
from kilnspark.operators.ranking import with_position


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_positions_are_exact_over_nulls_and_parts(spark):
    values = [None, None, *range(40, 0, -1), 7, 7]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    got = with_position(rows, [F.col("v"), F.col("id")], F.floor(F.col("v") / 4), "at", F.floor(F.col("v") / 16)).collect()
    want = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert [r["id"] for r in sorted(got, key=lambda r: r["at"])] == want
    assert sorted(r["at"] for r in got) == list(range(len(values)))


def test_splits_keep_rows_without_time_or_group(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "2024-01-01", None), (3, "2024-01-02", None), (4, None, "b"), (5, "2024-01-01", "a")], "id long, t string, g string").withColumn("t", F.to_date("t"))
    timed = {r["id"]: r["split"] for r in split.time_based(rows, "t", "id", train=0.6, validation=0.2).collect()}
    assert timed == {1: "train", 4: "train", 2: "train", 5: "validation", 3: "test"}
    dealt = split.kfold(rows, "g", k=3).collect()
    assert sorted(r["id"] for r in dealt) == [1, 2, 3, 4, 5] and dealt[0].asDict().keys() == {"id", "t", "g", "fold", "split"}
    assert len({r["fold"] for r in dealt if r["g"] is None}) == 1 and len({r["fold"] for r in dealt}) == 3


def test_round_robin_numbers_each_spec_from_zero(spark):
    specs = spark.createDataFrame([("a", 3), ("b", 0), ("c", 4)], "name string, per_chunk int")
    chunks = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "ordinal long, chunk string")
    got = sorted((r["name"], r["slot"], r["chunk"]) for r in planner.round_robin(specs, chunks, "ordinal", 3).collect())
    assert got == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("c", 0, "x"), ("c", 1, "y"), ("c", 2, "z"), ("c", 3, "x")]
    assert planner.round_robin(specs.limit(0), chunks, "ordinal", 3).count() == 0


def tree(entries, fan_out=256):
    """The content root, by recursion over the folders."""
    levels = 0
    while len(entries) > fan_out * 256**levels:
        levels += 1

    def root(some, digits):
        if digits == 2 * levels:
            return sha("".join(h for _, h in sorted(some)))
        parts = {}
        for path, h in some:
            parts.setdefault(sha(path)[: digits + 2], []).append((path, h))
        return sha("".join(root(parts[p], digits + 2) for p in sorted(parts)))

    return root(entries, 0)


def test_content_tree_has_as_many_levels_as_it_needs(spark):
    for n, fan_out in ((0, 256), (5, 256), (5, 4), (900, 2)):
        entries = [(f"p{i}", sha(str(i))) for i in range(n)]
        got = export.content_tree(spark.createDataFrame(entries, "path string, sha256 string"), fan_out).first()
        assert (got["n_files"], got["content_root"]) == (n, tree(entries, fan_out))


def test_content_tree_of_limited_levels_streams_large_folders(spark):
    entries = [(f"p{i}", sha(str(i)) if i % 90 else None) for i in range(3000)]
    folders = {}
    for path, h in sorted(entries):
        folders.setdefault(sha(path)[:2], []).append(h or "")
    got = export.content_tree(spark.createDataFrame(entries, "path string, sha256 string").repartition(7), 2, most_levels=1).first()
    assert (got["n_files"], got["content_root"]) == (3000, sha("".join(sha("".join(folders[f])) for f in sorted(folders))))


def example_rows(spark):
    said = lambda role, *texts: [(role, t) for t in texts]
    rows = [
        ("e1", "sft", ["be kind"], said("user", "q1"), said("assistant", "a1"), [], None),
        ("e2", "preference", ["be kind"], said("user", "q2"), said("assistant", "good"), said("assistant", "bad"), None),
        ("e3", "kto", ["be kind"], said("user", "q3"), said("assistant", "a3"), [], "good"),
        ("e4", "evaluation", [], said("user", "q4"), said("assistant", "a4"), [], None),
    ]
    frame = spark.createDataFrame(rows, f"example_id string, topology string, system_messages array<string>, prompt_messages {examples.MESSAGES}, chosen_messages {examples.MESSAGES}, rejected_messages {examples.MESSAGES}, label_or_target string")
    lists = {c: F.array(F.concat(F.lit(p), "example_id")) for c, p in (("source_document_ids", "d_"), ("source_span_ids", "s_"), ("generation_candidate_ids", "c_"))}
    splits = F.when(F.col("example_id") == "e4", "test").otherwise("train")
    return frame.withColumns({**lists, "split": splits, "quality_score": F.lit(0.123456), "quality_status": F.when(F.col("example_id") == "e3", "review").otherwise("accepted")}).withColumn("content_hash", export.content_hash())


def test_training_rows_by_topology(spark):
    got = {r["example_id"]: r for r in export.training_rows(example_rows(spark)).collect()}
    plain = lambda messages: messages and [tuple(m) for m in messages]
    assert plain(got["e1"]["messages"]) == [("system", "be kind"), ("user", "q1"), ("assistant", "a1")]
    assert plain(got["e3"]["messages"]) == [("user", "q3"), ("assistant", "a3")] and got["e3"]["label"] == "good"
    assert got["e2"]["messages"] is None and plain(got["e2"]["rejected"]) == [("assistant", "bad")]
    assert plain(got["e4"]["messages"]) == [("user", "q4"), ("assistant", "a4")] and got["e4"]["label"] is None
    assert {r["quality_score"] for r in got.values()} == {0.1235} and got["e1"]["source_span_ids"] == ["s_e1"]


def test_version_counts_members_and_stamps_them(spark):
    rows = example_rows(spark)
    got = export.freeze(rows, "ver_9").first()
    hashes = {r["example_id"]: r["content_hash"] for r in rows.collect()}
    assert (got["member_count"], got["train_count"], got["validation_count"], got["test_count"]) == (3, 2, 0, 1)
    assert got["content_root"] == tree([(i, hashes[i]) for i in ("e1", "e2", "e4")])
    stamped = lifecycle.stamp(rows.withColumn("version_id", F.lit("ver_1")), "ver_9").collect()
    assert {r["example_id"]: r["version_id"] for r in stamped} == {"e1": "ver_9", "e2": "ver_9", "e3": "ver_1", "e4": "ver_9"}
    assert provenance.hash_mismatches(rows, export.content_hash()).count() == 0
    assert [r["example_id"] for r in provenance.hash_mismatches(rows.withColumn("content_hash", F.when(F.col("example_id") != "e2", F.col("content_hash"))), export.content_hash()).collect()] == ["e2"]


def test_export_manifest_counts_zeros_too(spark):
    spans = spark.createDataFrame([("s_e1", "chunk"), ("s_e2", "chunk"), ("other", "section")], "span_id string, precision string")
    got = {(r["section"], r["name"]): r["n"] for r in export.export_manifest(example_rows(spark), spans).collect()}
    assert got[("records", "all")] == 4 and got[("split", "validation")] == 0 and got[("split", "train")] == 3
    assert got[("precision", "chunk")] == 2 and got[("precision", "section")] == 0 and got[("document", "d_e3")] == 1


def test_release_files_and_their_check(spark):
    lines = spark.createDataFrame([(f"e{i:03}", "train" if i % 3 else "test", f"line {i}\r") for i in range(40)], "example_id string, split string, line string")
    files = export.release_files(lines, shard_rows=8)
    held = {r["path"]: r["content"] for r in files.collect()}
    assert len(held) > 3 and sorted(x for c in held.values() for x in c.splitlines()) == sorted(f"line {i}" for i in range(40))
    assert all(c.endswith("\n") and "\r\n" not in c for c in held.values())
    records = export.bundle_manifest(files)
    root = export.content_tree(records).first()["content_root"]
    assert root == tree([(p, sha(c)) for p, c in held.items()])
    assert export.verify_bundle(records, files, [], root).count() == 0
    first, second = sorted(held)[:2]
    changed = files.where(F.col("path") != second).withColumn("content", F.when(F.col("path") == first, F.lit("other\n")).otherwise(F.col("content")))
    extra = changed.unionByName(spark.createDataFrame([("notes.txt", "n")], "path string, content string"))
    got = {(r["path"], r["problem"]) for r in export.verify_bundle(records, extra, ["README.md", "notes.txt"], "0" * 64).collect()}
    assert got == {(first, "sha256_mismatch"), (second, "absent"), ("README.md", "missing_required"), ("", "content_root_mismatch")}


def test_budget_stops_at_the_first_limit(spark):
    calls = spark.createDataFrame([(1, 1, 30, 5, 1, "m"), (1, 2, 30, 5, 1, "n"), (1, 3, 30, 5, 1, "m"), (1, 4, 30, 5, 1, "m"), (2, 1, 200, 5, 1, "m")], "job int, at int, cost_micro long, input_tokens long, output_tokens long, model string")
    got = ledger.budget_checks(calls, "job", ["at"], {"cost": 120, "calls": 9}, per_model={"m": 60}).orderBy("job", "at").collect()
    assert [r["exceeded"] for r in got] == [None, None, "model_cost", "cost", "cost"]
    assert [r["spent_model"] for r in got] == [30, 30, 60, 90, 200]
    assert ledger.budget_checks(calls, "job", ["at"], {}).where("exceeded is not null").count() == 0
    price = spark.range(1).select(ledger.job_estimate(F.lit(1500), F.lit(500), F.lit(10), price_in=3.0, price_out=15.0)).first()[0]
    assert price == 0.12


def test_waiting_jobs_come_when_their_time_has_come(spark):
    jobs = spark.createDataFrame([("a", "queued", 3, None), ("b", "queued", 1, 50), ("c", "running", 0, None), ("d", "queued", 2, 9)], "job_id string, state string, created_at int, not_before int")
    jobs = jobs.withColumns({"lease_expires_at": F.lit(99), "queue": F.lit("q")}).where(F.coalesce("not_before", F.lit(10)) <= 10)
    assert [r["job_id"] for r in inspection.next_jobs(jobs, "queue", F.lit(10), "created_at", "job_id").collect()] == ["d"]
    log = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 5, "c")], "example_id string, revision_id int, state string")
    got = inspection.history(log, "example_id", "revision_id", "state").collect()
    assert sorted((r["example_id"], r["revision_id"], r["position"], r["previous_state"] or "") for r in got) == [("x", 1, 1, ""), ("x", 2, 2, "a"), ("y", 5, 1, "")]


def test_privacy_report_has_one_row(spark):
    rows = spark.createDataFrame([(1, "high", 2, ["email", "ssn"]), (2, "clean", 0, []), (3, "low", 0, ["email"])], "doc_id int, classification string, high_confidence int, kinds array<string>")
    got = governance.privacy_report(rows).first()
    assert (got["classified_documents"], got["high_confidence_total"], got["n_blocked"], got["kinds"]) == (3, 2, 1, ["email", "ssn"])
    assert [r["doc_id"] for r in governance.privacy_blocked(rows, "doc_id").collect()] == [1]
    empty = governance.privacy_report(rows.limit(0)).first()
    assert (empty["classified_documents"], empty["high_confidence_total"], empty["kinds"]) == (0, 0, [])
