"""Usage entries, the preference dimension, lines and layouts on disk."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from kilnspark.operators import export, ledger, preference
from kilnspark.sources import release


def test_usage_entries(spark):
    rows = [
        ('{"input_tokens": 1000, "cached_input_tokens": 400, "output_tokens": 10}', (1000, 400, 10, 2150)),
        ('{"input_tokens": 1000, "prompt_tokens_details": {"cached_tokens": 400}, "output_tokens": 10, "other": 1}', (1000, 400, 10, 2150)),
        ('{"input_tokens": 1000, "cached_input_tokens": 0, "prompt_tokens_details": {"cached_tokens": 7}}', (1000, 7, 0, 2983)),
        ("{}", (0, 0, 0, 0)), (None, (0, 0, 0, 0)), ("no json", (0, 0, 0, 0)),
    ]
    df = spark.createDataFrame([(u,) for u, _ in rows], "u string")
    got = df.select(ledger.ledger_entry(F.col("u"), price_in=3.0, price_out=15.0, price_cached=0.5).alias("e")).select("e.*").collect()
    assert [tuple(r) for r in got] == [w for _, w in rows]
    free = df.select(ledger.ledger_entry(F.col("u")).alias("e")).select("e.cost_micro").distinct().collect()
    assert [r[0] for r in free] == [0]


GOOD = "The valve opens when pressure rises above four bar and closes again once it falls."
BAD = "Pressure opens nothing here when a clerk turns four pipes by hand on Monday morning."
SCHEMA = "id int, topology string, chosen string, rejected string, evidence string, certified struct<verdict:string,codes:array<string>>"


def test_preference_dimension(spark):
    rows = [
        (1, "preference", GOOD, BAD, GOOD, None), (2, "sft", GOOD, BAD, GOOD, None), (3, "preference", GOOD, GOOD, GOOD, None), (4, "preference", "Too short", BAD, "", None),
        (5, "preference", "", BAD, "", None), (6, "preference", GOOD, "## A\n- b\n- c\n# d\n- e [1] [2] !!", GOOD, None), (7, "preference", GOOD, BAD, GOOD, ("review", ["judge_called_tie"])),
        (8, "preference", GOOD, BAD, GOOD, ("invalid", [])), (9, "preference", GOOD, BAD, GOOD, ("valid", [])), (10, "preference", GOOD, GOOD, GOOD, ("review", [])),
    ]
    df = preference.prepare(spark.createDataFrame(rows, SCHEMA))
    score, codes = preference.assess()
    got = {r["id"]: (r["s"], r["c"]) for r in df.select("id", score.alias("s"), codes.alias("c")).collect()}
    assert got[1] == got[9] == (1.0, ["preference_signal_ok"]) and got[2] == (0.0, ["not_preference_topology"])
    assert got[3] == (0.0, ["identical_pair", "no_preference_signal"])
    assert got[4] == (0.0, ["chosen_too_short", "no_preference_signal", "chosen_too_short", *got[4][1][3:]]) and set(got[4][1][3:]) <= {"trivial_style_separation"}
    assert got[5] == (0.0, ["missing_signal", "no_preference_signal", "chosen_empty"])
    assert got[6][0] == 0.0 and got[6][1][-1] == "trivial_style_separation"
    assert got[7] == (0.6, ["judge_called_tie"]) and got[8] == (0.0, ["certified_pair_invalid"])
    assert got[10] == (0.0, ["identical_pair", "no_preference_signal", "certified_pair_review"])


def test_lines_and_layouts_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i:03}", f"line {i}") for i in range(50)], "k string, line string")
    records = {r["path"]: (r["size_bytes"], r["sha256"]) for r in release.write_lines(rows, f"{tmp_path}/a", key="k", shard_rows=10).collect()}
    held = {n: open(f"{tmp_path}/a/{n}", "rb").read() for n in os.listdir(f"{tmp_path}/a") if not n.endswith(".crc")}
    assert len(held) > 2 and records == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in held.items()}
    assert sorted(x for c in held.values() for x in c.decode().splitlines()) == sorted(f"line {i}" for i in range(50))
    assert release.write_lines(rows.limit(0), f"{tmp_path}/none", key="k").count() == 0 and os.path.isdir(f"{tmp_path}/none")
    message = "array<struct<role:string,content:string>>"
    examples = spark.createDataFrame(
        [("e1", [], [("user", "q é")], [("assistant", "a")], ["d"], ["s"], ["c"], "h", "train")],
        f"example_id string, system_messages array<string>, prompt_messages {message}, chosen_messages {message}, source_document_ids array<string>, source_span_ids array<string>, generation_candidate_ids array<string>, content_hash string, split string",
    )
    release.write_format(examples, "sharegpt", f"{tmp_path}/f")
    told = json.loads(open(f"{tmp_path}/f/part-00000.jsonl").read())
    assert list(told) == sorted(told) == sorted(["example_id", "conversations", *export.PROVENANCE])
    assert told["conversations"] == [{"from": "human", "value": "q é"}, {"from": "gpt", "value": "a"}]
