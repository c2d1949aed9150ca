"""Blocked scans against plain loops: one hot key over many blocks, null keys, ties, empty tables."""

from collections import defaultdict

from pyspark.sql import functions as F

from kilnspark.operators.scan import blocks, scan
from kilnspark.operators.shared import Scratch


def _plain(rows):
    out, by = set(), defaultdict(list)
    for key, at, value in rows:
        by[key].append((at, value))
    for key, members in by.items():
        total, before = 0, None
        for n, (at, value) in enumerate(sorted(members), 1):
            total += value or 0
            out.add((key, at, value, n, total, before))
            before = value
    return out


def _scanned(spark, rows):
    df, order = spark.createDataFrame(rows, "k string, at long, v long"), [F.col("at")]
    held = blocks(df, ["k"], order, Scratch(spark))
    return held, scan(held, ["k"], order, number="n", sums={"total": F.col("v")}, lags={"before": F.col("v")}).select("k", "at", "v", "n", "total", "before")


def test_scan_equals_a_loop(spark):
    rows = [("hot", i * 7919 % 3001, i % 13 - 4) for i in range(3001)] + [(f"k{i % 40}", i, None if i % 5 == 0 else i) for i in range(400)] + [(None, i, 1) for i in range(50)]
    held, got = _scanned(spark, rows)
    assert held.where("k = 'hot'").select("__block").distinct().count() > 1
    assert {tuple(r) for r in got.collect()} == _plain(rows)


def test_equal_rows_fill_several_blocks(spark):
    held, got = _scanned(spark, [("a", None, 1)] * 4000)
    assert held.groupBy("__block").count().count() > 1
    assert sorted(r["n"] for r in got.collect()) == sorted(r["total"] for r in got.collect()) == list(range(1, 4001))


def test_empty(spark):
    assert _scanned(spark, [])[1].count() == 0
