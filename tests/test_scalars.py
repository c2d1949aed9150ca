"""Small scalar functions by hand."""

import hashlib
import json

from pyspark.sql import functions as F

from kilnspark.functions import scalars as S
from kilnspark.operators import blocks, export
from kilnspark.sources import intake


def value(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_markdown(spark):
    got = value(spark, S.blocks_to_markdown(blocks.parse_blocks(F.col("t"))), t="## A\ntext\n- item")
    assert got == "## A\n\ntext\n\n- item"
    assert value(spark, S.strip_markdown(F.col("t")), t="# A `b` **c**\n\n\n\n[d](e)") == "A b c\n\nde"


def test_layout_json(spark):
    doc = json.dumps({"main_text": [{"text": "T", "label": "Title"}, {"text": "", "label": "text"}, {"text": "x"}, {"text": "r", "label": "table"}]})
    got = value(spark, S.layout_blocks(F.col("t")), t=doc)
    assert [(b["type"], b["text"], b["element_ref"]) for b in got] == [("heading", "T", "docling#/main_text/0"), ("paragraph", "x", "docling#/main_text/2"), ("table", "r", "docling#/main_text/3")]
    assert value(spark, S.layout_blocks(F.col("t")), t="no json") is None


def test_handles(spark):
    assert value(spark, S.is_handle(F.col("t")), t="a" * 128) and not value(spark, S.is_handle(F.col("t")), t="a" * 129)
    assert not value(spark, S.is_handle(F.col("t")), t="../a") and not value(spark, S.is_handle(F.col("t")), t=None)
    assert value(spark, S.object_key(F.col("a"), F.col("b")), a="x", b="y.z") == "x/y.z" and value(spark, S.object_key(F.col("a"), F.col("b")), a="x", b="") is None


def test_canonical_hash_ignores_order_and_spacing(spark):
    want = hashlib.sha256(b'{"a":"\\u00e9","b":[1,2]}').hexdigest()
    assert value(spark, S.canonical_hash(F.col("t")), t='{"b": [1, 2],  "a": "é"}') == want
    assert value(spark, S.canonical_hash(F.col("t")), t="{") is None


def test_judge_output(spark):
    chatty = 'Sure:\n```json\n[{"claim": "c", "verdict": "entailed", "reason_codes": []}]\n```'
    assert value(spark, S.judged_claims(F.col("t")), t=chatty)[0]["verdict"] == "entailed"
    assert value(spark, S.judge_json(F.col("t")), t="nothing") is None


def test_missing_fields(spark):
    body = json.dumps({"task_family": "f", "messages": [{"role": "assistant", "content": "x"}]})
    assert value(spark, S.missing_fields(F.lit("sft"), F.col("t")), t=body) == ["messages_start"]
    assert value(spark, S.missing_fields(F.lit("preference"), F.col("t")), t=body) == ["chosen_messages", "rejected_messages"]
    assert value(spark, S.missing_fields(F.lit("evaluation"), F.col("t")), t='{"task_family": "f", "question": "q", "reference_answer": "r"}') == []


def test_prompts(spark):
    got = value(spark, S.user_prompt("sft", source_text=F.col("a")), a="TEXT")
    assert "SOURCE MATERIAL:\nTEXT\n\nQUESTION:\n\n\nProvide" in got


def test_folder_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "sub" / "b.txt").write_text("two")
    before = intake.folder_manifest(spark, str(tmp_path)).collect()
    assert {r["path"]: r["sha256"] for r in before} == {"a.txt": hashlib.sha256(b"one").hexdigest(), "sub/b.txt": hashlib.sha256(b"two").hexdigest()}
    (tmp_path / "a.txt").write_text("ONE")
    assert [tuple(r) for r in export.verify(spark.createDataFrame(before), intake.folder_manifest(spark, str(tmp_path))).collect()] == [("a.txt", "changed")]
