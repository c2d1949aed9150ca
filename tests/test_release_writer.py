"""Releases on disk: what is written, that it is reproducible, its check, broken writes; comparison of trees."""

import hashlib
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from kilnspark.operators import tree
from kilnspark.sources import release

CARDS = {name: {"name": name, "é": [1, 2]} for name in ("dataset_card", "quality_report", "license_summary", "privacy_summary")}


def lines_of(spark, n=200):
    rows = [(f"e{i:04}", ["train", "train", "test", None][i % 4], json.dumps({"n": i, "t": "é\U0001f600"}, ensure_ascii=False) + ("\r" if i == 5 else "")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "example_id string, split string, line string")


def write(spark, path, lines, **more):
    sources = spark.createDataFrame([(f"s{i}", json.dumps({"source": i})) for i in range(30)], "example_id string, line string")
    return release.write_release(lines, path, version="1.0", project="p", readme="# Données\r\nx\n", cards=CARDS, tables={"sources": sources}, shard_rows=16, **more)


def contents(path):
    return {os.path.relpath(f"{d}/{f}", path): open(f"{d}/{f}", "rb").read() for d, _, names in os.walk(path) for f in names if not f.endswith(".crc")}


def test_release_on_disk(spark, tmp_path):
    rows, lines = lines_of(spark)
    records = write(spark, f"{tmp_path}/r1", lines)
    held = contents(f"{tmp_path}/r1")
    assert {"README.md", "manifest.json", "files.jsonl", *[f"{c}.json" for c in CARDS]} < set(held) and held["README.md"] == "# Données\nx\n".encode()
    for split in ("train", "test", None):
        shards = {p: c for p, c in held.items() if p.startswith(f"data/{split or 'none'}/part-")}
        want = {}
        count = sum(r[1] == split for r in rows) // 16 + 1
        for key, s, line in sorted(r for r in rows if r[1] == split) if split else sorted((r for r in rows if r[1] is None), key=lambda r: r[0]):
            name = f"data/{split or 'none'}/part-{int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) % count:05d}.jsonl"
            want[name] = want.get(name, "") + line.rstrip("\r") + "\n"
        assert {p: c.decode() for p, c in shards.items()} == want and len(shards) > 1
    assert sorted(x for p, c in held.items() if p.startswith("sources/") for x in c.decode().splitlines()) == sorted(json.dumps({"source": i}) for i in range(30))
    told = {r["path"]: (r["size_bytes"], r["sha256"]) for r in records.collect()}
    assert told == {p: (len(c), hashlib.sha256(c).hexdigest()) for p, c in held.items() if p not in ("manifest.json", "files.jsonl")}
    manifest = json.loads(held["manifest.json"])
    assert manifest["split_counts"] == {"train": 100, "test": 50, "none": 50} and manifest["table_counts"] == {"sources": 30}
    assert open(f"{tmp_path}/r1.sha256").read().strip() == hashlib.sha256(held["manifest.json"]).hexdigest()
    assert release.verify_release(spark, f"{tmp_path}/r1").count() == 0
    write(spark, f"{tmp_path}/r2", lines.repartition(7))
    assert contents(f"{tmp_path}/r2") == held
    with pytest.raises(FileExistsError):
        write(spark, f"{tmp_path}/r1", lines)


def test_problems_are_named(spark, tmp_path):
    write(spark, f"{tmp_path}/r", lines_of(spark)[1])
    held = sorted(p for p in contents(f"{tmp_path}/r") if p.startswith("data/train"))

    def problems(change):
        shutil.rmtree(f"{tmp_path}/x", ignore_errors=True)
        shutil.copytree(f"{tmp_path}/r", f"{tmp_path}/x", ignore=shutil.ignore_patterns("*.crc"))
        shutil.copy(f"{tmp_path}/r.sha256", f"{tmp_path}/x.sha256")
        change(f"{tmp_path}/x")
        return {(r["path"], r["problem"]) for r in release.verify_release(spark, f"{tmp_path}/x").collect()}

    def append(name):
        def change(at):
            with open(f"{at}{name}", "ab") as f:
                f.write(b" \n")

        return change

    def edit(**fields):
        def change(at):
            m = json.loads(open(f"{at}/manifest.json").read()) | fields
            raw = json.dumps({k: v for k, v in m.items() if v is not None}).encode()
            open(f"{at}/manifest.json", "wb").write(raw)
            open(f"{at}.sha256", "w").write(hashlib.sha256(raw).hexdigest())

        return change

    assert problems(lambda at: None) == set()
    assert problems(append(f"/{held[0]}")) == {(held[0], "sha256_mismatch")}
    assert problems(lambda at: os.remove(f"{at}/{held[1]}")) == {(held[1], "absent")}
    assert problems(lambda at: os.remove(f"{at}/README.md")) == {("README.md", "absent"), ("README.md", "missing_required")}
    assert problems(append("/extra.txt")) == set()
    assert problems(append("/manifest.json")) == {("manifest.json", "detached_mismatch")}
    assert problems(lambda at: os.remove(f"{at}.sha256")) == {("x.sha256", "detached_missing")}
    assert problems(edit(schema=None)) == {("manifest.json", "schema_missing")}
    assert problems(edit(content_root_sha256="0" * 64)) == {("", "content_root_mismatch")}
    assert problems(edit(content_root_sha256=None)) == {("manifest.json", "content_root_missing")}
    assert problems(edit(bundle_sha256="1")) == {("manifest.json", "self_referential")}
    assert problems(append("/files.jsonl")) == {("files.jsonl", "sha256_mismatch")}
    with pytest.raises(FileNotFoundError):
        release.verify_release(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("step", ["put", "move"])
def test_a_killed_write_leaves_nothing_visible(spark, tmp_path, monkeypatch, step):
    def killed(self, *a):
        if step == "put" or not a[1].endswith(".jsonl"):
            raise KeyboardInterrupt
        return real(self, *a)

    real = release._Folder.move
    monkeypatch.setattr(release._Folder, step, killed)
    with pytest.raises(KeyboardInterrupt):
        write(spark, f"{tmp_path}/r", lines_of(spark)[1])
    assert not os.path.exists(f"{tmp_path}/r") and all(n.startswith(("_", ".", "r.sha256")) for n in os.listdir(tmp_path))
    monkeypatch.undo()
    write(spark, f"{tmp_path}/r", lines_of(spark)[1])
    assert release.verify_release(spark, f"{tmp_path}/r").count() == 0


def test_release_of_nothing(spark, tmp_path):
    release.write_release(lines_of(spark)[1].limit(0), f"{tmp_path}/r", version="1", project="p", readme="", cards=CARDS)
    assert release.verify_release(spark, f"{tmp_path}/r").count() == 0


def test_trees_open_only_what_differs(spark, tmp_path):
    old = spark.range(30_000).select(F.concat(F.lit("f/"), "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    new = old.where("path <> 'f/7'").withColumn("sha256", F.when(F.col("path") == "f/11", "x").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("g", "y")], "path string, sha256 string"))
    levels = tree.levels_for(30_000, 2)
    assert levels == 2 and tree.levels_for(10) == 1
    for name, rows in (("old", old), ("new", new)):
        tree.write_snapshot(rows, f"{tmp_path}/{name}", levels)
    got = {tuple(r) for r in tree.compare_snapshots(spark, f"{tmp_path}/old", f"{tmp_path}/new", levels).collect()}
    assert got == {("f/7", "missing"), ("f/11", "changed"), ("g", "extra")}
    opened = tree.opened_folders(tree.tree_levels(old, levels), tree.tree_levels(new, levels), levels)
    assert [f.count() for f in opened] == [1, 3, 3]  # of 1, 256 and some 24,000 folders
    assert tree.compare_snapshots(spark, f"{tmp_path}/old", f"{tmp_path}/old", levels).count() == 0


def test_restore_copies_only_what_differs(spark, tmp_path):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    backup = spark.createDataFrame([(f"f{i}", f"c{i % 5}") for i in range(50)], "path string, content string")
    place = backup.where("path not in ('f3', 'f4')").withColumn("content", F.when(F.col("path") == "f9", "spoilt").otherwise(F.col("content"))).unionByName(spark.createDataFrame([("new", "n")], backup.schema))
    entries = {n: df.select("path", F.sha2("content", 256).alias("sha256")) for n, df in (("old", backup), ("new", place))}
    for n, df in entries.items():
        tree.write_snapshot(df, f"{tmp_path}/{n}", 1)
    plan = tree.restore_plan(tree.compare_snapshots(spark, f"{tmp_path}/old", f"{tmp_path}/new", 1), entries["old"])
    assert {tuple(r) for r in plan.collect()} == {("f3", "copy", sha("c3")), ("f4", "copy", sha("c4")), ("f9", "copy", sha("c4")), ("new", "delete", None)}
    blobs = backup.select(F.sha2("content", 256).alias("sha256"), "content").distinct()
    assert sorted(map(tuple, tree.restored(place, plan, blobs).collect())) == sorted(map(tuple, backup.collect()))
