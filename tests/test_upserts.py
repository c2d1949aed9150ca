"""Upserts against a dictionary: several deltas, ties, compaction, what is read, broken and concurrent writes."""

import random

import pytest
from pyspark.errors import PySparkException

from kilnspark.sources.upserts import UpsertStore

SCHEMA = "name string, part long, rev long, text string"


def store(spark, path):
    return UpsertStore(spark, str(path), SCHEMA, ["name", "part"], ["rev"], buckets=8)


def read(df):
    return {(r["name"], r["part"]): (r["rev"], r["text"]) for r in df.collect()}


def test_state_follows_the_upserts(spark, tmp_path):
    rng, plain, held = random.Random(1), {}, store(spark, tmp_path / "s")
    assert held.state().count() == 0 and held.compact() == []
    for version in range(5):
        rows = {(rng.choice(["a", "b", None]), rng.randrange(30)): (rng.randrange(4), f"v{version}") for _ in range(40)}
        held.upsert(spark.createDataFrame([(*k, *v) for k, v in rows.items()], SCHEMA))
        for k, v in rows.items():
            if k not in plain or v[0] >= plain[k][0]:  # of equal revisions the later upsert's
                plain[k] = v
        if version in (1, 3):
            before = read(held.state())
            assert held.compact() and read(held.state()) == before
        assert read(held.state()) == plain
    some = [k for k in plain if k[0]][:3]
    assert read(held.lookup(some)) == {k: plain[k] for k in some} and held.lookup([("none", 1)]).count() == 0
    assert read(store(spark, tmp_path / "s").state()) == plain  # opened again


def test_an_update_touches_and_a_look_reads_only_its_buckets(spark, tmp_path):
    held = store(spark, tmp_path / "s")
    held.upsert(spark.createDataFrame([("x", i, 0, "old") for i in range(200)], SCHEMA))
    assert len(held.compact()) == 8
    one = [("x", 5, 1, "new")]
    held.upsert(spark.createDataFrame(one, SCHEMA))
    log = held.log()
    (bucket,) = log["deltas"]["2"]
    assert len(held._places(log, {bucket})) == 2 and len(held._places(log, None)) == 9
    files = held.lookup([("x", 5)]).inputFiles()
    assert len(files) == 2 and all(f"bucket={bucket}/" in f for f in files) and read(held.lookup([("x", 5)])) == {("x", 5): (1, "new")}
    assert held.compact(least=2) == [] and held.compact() == [bucket]
    assert len(held.state().inputFiles()) == 8 and len(held.stale()) == 8 + 1 + 1  # the first delta's, the old bucket, the second delta
    assert read(held.state())["x", 5] == (1, "new")


def test_what_is_not_in_the_log_does_not_count(spark, tmp_path, monkeypatch):
    held = store(spark, tmp_path / "s")
    held.upsert(spark.createDataFrame([("x", 1, 0, "old")], SCHEMA))
    old = held.log()

    def killed(*a, **b):
        raise KeyboardInterrupt

    monkeypatch.setattr(UpsertStore, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        held.upsert(spark.createDataFrame([("x", 1, 1, "lost")], SCHEMA))
    monkeypatch.undo()
    assert read(held.state()) == {("x", 1): (0, "old")}
    held.upsert(spark.createDataFrame([("x", 1, 2, "new")], SCHEMA))  # writes over what the broken one left
    assert read(held.state()) == {("x", 1): (2, "new")}
    with pytest.raises((PySparkException, Exception)):  # an entry of the same number is there
        held._commit(old, deltas={})
    assert read(held.state()) == {("x", 1): (2, "new")}
