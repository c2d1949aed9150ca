"""Canonical JSON against the standard library over fuzzed Unicode."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from kilnspark.functions.canonical import canonical_json
from kilnspark.operators import export

SCHEMA = "s string, l array<string>, n struct<b:long,a:boolean,`ä`:string,z:array<struct<y:int,x:string>>>, m map<string,array<string>>"


def fuzzed(n):
    rng = random.Random(6)
    ranges = [(0, 32), (32, 128), (34, 35), (92, 93), (127, 256), (256, 0xD800), (0xE000, 0x10000), (0x10000, 0x110000)]
    text = lambda: "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(9)))
    some = lambda make: None if rng.random() < 0.15 else make()
    for _ in range(n):
        inner = lambda: (some(lambda: rng.randrange(-(2**63), 2**63)), rng.random() < 0.5, some(text), [(rng.randrange(9), some(text)) for _ in range(rng.randrange(3))])
        yield some(text), some(lambda: [some(text) for _ in range(rng.randrange(4))]), some(inner), {text(): [some(text)] for _ in range(rng.randrange(4))}


def dumped(r):
    n = r[2] and {"b": r[2][0], "a": r[2][1], "ä": r[2][2], "z": [{"y": y, "x": x} for y, x in r[2][3]]}
    return json.dumps({"s": r[0], "l": r[1], "n": n, "m": r[3]}, sort_keys=True, separators=(",", ":"))


def test_equals_json_dumps(spark):
    sample = list(fuzzed(2000))
    df = spark.createDataFrame(sample, SCHEMA)
    whole = F.struct(*df.columns)
    got = df.select(canonical_json(whole, df.select(whole.alias("x")).schema["x"].dataType).alias("j")).collect()
    assert [r["j"] for r in got] == [dumped(r) for r in sample]


def test_every_unit_is_escaped_as_it_should_be(spark):
    codes = [*range(0, 0x3000, 7), *range(0, 260), 0x2028, 0xD7FF, 0xE000, 0xFFFD, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]
    df = spark.createDataFrame([(chr(c) * 2 + "x" + chr(c),) for c in codes], "s string")
    got = [r["j"] for r in df.select(canonical_json(F.col("s"), df.schema["s"].dataType).alias("j")).collect()]
    assert got == [json.dumps(chr(c) * 2 + "x" + chr(c)) for c in codes]


def test_content_hashes_of_any_text(spark):
    message = "array<struct<role:string,content:string>>"
    odd = 'é "\U0001f600"\\\n\x01'
    row = ("sft", ["sys é"], [("user", odd)], [("assistant", "ß")], [("assistant", "no ")])
    df = spark.createDataFrame([row, ("preference", *row[1:]), ("evaluation", *row[1:]), ("kto", [], [], [], [])], f"topology string, system_messages array<string>, prompt_messages {message}, chosen_messages {message}, rejected_messages {message}")
    sha = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    want = [sha(["sys é", odd, "ß"]), sha({"c": ["ß"], "r": ["no "]}), sha([odd, "ß"]), sha([])]
    assert [r["h"] for r in df.select(export.content_hash().alias("h")).collect()] == want
