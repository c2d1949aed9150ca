"""Stateful streams against the batch operators: shuffled, late and repeated micro-batches, and a start from the checkpoint."""

import random
from types import SimpleNamespace
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilnspark.operators import ledger as batch_ledger
from kilnspark.streaming import events as streams
from kilnspark.streaming import ledger
from kilnspark.streaming.ordered import Leases, Limit, Numbered, Ordered, fold_stream, fold_table

SCHEMA = "event_id long, user_id long, ts timestamp, value long"
BEGIN = datetime(2024, 1, 1)


def made(n=400):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), BEGIN + timedelta(seconds=rng.randrange(4 * n)), rng.randrange(9)) for i in range(n)]
    return [*rows, *[(n + i, i, BEGIN + timedelta(days=2), 0) for i in (1, 2, 3)]]  # the watermark passes all others


def arrivals(rows):
    """Files of micro-batches: nearly in order (within ten minutes), a tenth comes twice."""
    rng = random.Random(9)
    late = sorted(rows + rng.sample(rows[:-3], len(rows) // 10), key=lambda r: r[2] + timedelta(seconds=rng.randrange(500)))
    return [late[i : i + 90] for i in range(0, len(late), 90)]


def put(folder, number, rows):
    frame = pd.DataFrame(rows, columns=["event_id", "user_id", "ts", "value"])
    frame["ts"] = frame["ts"].astype("datetime64[us]").dt.tz_localize("UTC")
    frame.to_parquet(f"{folder}/{number:03}.parquet", index=False)


def run(spark, folder, out, fold, value=None):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    ledger.replay(fold_stream(source, fold, "user_id", value=value, late="10 minutes"), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows")


@pytest.mark.parametrize("name", ["numbered", "leases", "limit"])
def test_stream_equals_batch(spark, tmp_path, name):
    fold = {"numbered": Numbered(), "leases": Leases(40_000), "limit": Limit(3, 60_000)}[name]
    rows, files = made(), arrivals(made())
    (tmp_path / "in").mkdir()
    for i, part in enumerate(files[:3]):
        put(tmp_path / "in", i, part)
    run(spark, tmp_path / "in", tmp_path / "out", fold, "value")
    for i, part in enumerate(files[3:], 3):  # the query is started again from its checkpoint
        put(tmp_path / "in", i, part)
    put(tmp_path / "in", 98, [(9999, 1, BEGIN + timedelta(seconds=1), 5)])  # too late: dropped
    got = run(spark, tmp_path / "in", tmp_path / "out", fold, "value")
    table = spark.createDataFrame(rows, SCHEMA)
    told = [tuple(r) for r in got.collect()]
    want = {tuple(r) for r in fold_table(table, fold, "user_id", value="value").collect()}
    last = {r[0] for r in rows[-3:]}
    if name == "leases":
        assert sorted(told) == sorted(want)
    else:  # the last rows still wait: no row after them moved the watermark on
        assert sorted(told) == sorted(r for r in want if r[1] not in last)


def test_folds_equal_the_batch_operators(spark):
    table = spark.createDataFrame(made(), SCHEMA)
    state = batch_ledger.budget_state(table, "user_id", ["ts", "event_id"], "value", 10**9)
    numbered = batch_ledger.next_sequence(table.limit(0).select("user_id", F.lit(0).alias("sequence")), state, "user_id", ["ts", "event_id"])
    got = fold_table(table, Numbered(), "user_id", value="value")
    assert sorted(map(tuple, got.collect())) == sorted((r["user_id"], r["event_id"], r["sequence"], r["spent"]) for r in numbered.collect())
    ms = lambda c: F.unix_millis(c).alias("x")
    want = streams.sessions(table, gap="40 seconds").select("user_id", ms("session_start"), ms("session_end"), "n").collect()
    leases = fold_table(table, Leases(40_000), "user_id", end_ms=1 << 50)
    assert sorted(map(tuple, leases.collect())) == sorted(map(tuple, want))


def test_limit_by_hand(spark):
    at = lambda s: BEGIN + timedelta(seconds=s)
    rows = [(1, 7, at(0), 0), (2, 7, at(10), 0), (3, 7, at(20), 0), (4, 7, at(59), 0), (5, 7, at(60), 0), (6, 7, at(69), 0), (7, 7, at(70), 0), (8, None, at(1), 0), (9, 7, None, 0)]
    got = {r["event_id"]: r["accepted"] for r in fold_table(spark.createDataFrame(rows, SCHEMA), Limit(2, 60_000), "user_id").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True}
    assert fold_table(spark.createDataFrame([], SCHEMA), Limit(2, 60_000), "user_id").count() == 0


def test_ledger_keeps_each_call_once(spark, tmp_path):
    schema, key = "job long, fingerprint string, cost long", ["job", "fingerprint"]
    write = ledger.ledger_sink(f"{tmp_path}/ledger", schema, key, ["cost"])
    one = spark.createDataFrame([(1, "a", 5), (1, "a", 3), (1, "b", 1), (2, "a", 9)], schema)
    two = spark.createDataFrame([(1, "a", 1), (1, "c", 4)], schema)
    write(one, 0)
    write(two, 1)
    first = sorted(map(tuple, ledger.read_ledger(spark, f"{tmp_path}/ledger", schema).collect()))
    assert first == [(1, "a", 3, 0), (1, "b", 1, 0), (1, "c", 4, 1), (2, "a", 9, 0)]
    write(two, 1)  # a batch that is tried again
    write(one, 2)  # calls that come again
    assert sorted(map(tuple, ledger.read_ledger(spark, f"{tmp_path}/ledger", schema).collect())) == first
    found = ledger.ledger_lookup(spark.createDataFrame([(1, "c"), (3, "a")], "job long, fingerprint string"), ledger.read_ledger(spark, f"{tmp_path}/ledger", schema), key)
    assert sorted(map(tuple, found.collect())) == [(1, "c", True), (3, "a", False)]


def test_waiting_rows_are_one_entry_of_the_state_for_each_call():
    held, timers = [], []
    run = Ordered(Numbered(), "user_id")
    run.waiting = SimpleNamespace(appendValue=held.append)
    run.handle = SimpleNamespace(registerTimer=timers.append)
    part = pd.DataFrame({"event_id": [2**60 + 1, 4], "ms": [9, 5], "value": [-1, 0]})
    assert list(run.handleInputRows((1,), iter([part, part]), None)) == [] and timers == [5]
    assert np.frombuffer(held[0][0], np.int64).tolist() == [2**60 + 1, 9, -1, 4, 5, 0] * 2 and len(held) == 1
