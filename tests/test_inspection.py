"""Intake policies, archives, coerced bodies, locations, judges' verdicts and certified pairs on small tables."""

import hashlib
import hmac
import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from kilnspark.functions import scalars
from kilnspark.operators import inspection, judging
from kilnspark.sources import intake, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_urls_that_must_not_be_fetched(spark):
    want = {
        "https://example.org/a": None, "http://example.org/": "scheme", "ftp://example.org": "scheme", "no url": "scheme", None: "scheme", "https:///x": "host",
        "https://metadata.google.internal/": "metadata", "https://169.254.169.254/x": "metadata", "https://192.168.1.1:8080/": "private", "https://172.32.0.1/": None,
        "https://172.31.255.255/": "private", "https://2130706433/": "private", "https://0x7f.1/": "private", "https://127.1/": "private", "https://LOCALHOST/": "private",
        "https://[::1]/": "private", "https://[fe80::1]:1/": "private", "https://[2606:4700::1]/": None, "https://u:p@example.org/": "credentials", "https://@example.org/": None,
    }
    rows = intake.url_problems(spark.createDataFrame([(u,) for u in want], "url string"), "url")
    assert {r["url"]: r["problem"] for r in rows.collect()} == want
    names = ["http://example.org/", "https://a.example.net/", "https://example.com/", "https://badexample.net/"]
    got = intake.url_problems(spark.createDataFrame([(u,) for u in names], "url string"), "url", allowlist=("example.org", "*.example.net"), allow_http=True).collect()
    assert [r["problem"] for r in got] == [None, None, "allowlist", "allowlist"]


def test_local_paths(tmp_path):
    good, root = tmp_path / "in" / "a.txt", [str(tmp_path / "in")]
    good.parent.mkdir()
    good.write_text("x")
    (tmp_path / "in" / "link").symlink_to(good)
    (tmp_path / "out.txt").write_text("x")
    assert intake.check_local_path(str(good), root) is None
    assert intake.check_local_path(str(good) + ";ls", root) == "syntax"
    assert intake.check_local_path(str(tmp_path / "in" / ".." / "out.txt"), root) == "outside"
    assert intake.check_local_path(str(tmp_path / "in" / "link"), root) == "symlink"
    assert intake.check_local_path(str(tmp_path / "in" / "none"), root) == "missing"
    (tmp_path / "in" / "hard").hardlink_to(good)
    assert intake.check_local_path(str(good), root) == "hardlink"


def test_archive_members_and_scanners(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.TXT", "one")
        z.writestr("d/b.exe", "two")
        z.writestr("d/", "")
        z.writestr("d/c.md", "three")
    files = spark.createDataFrame([("ok", buffer.getvalue()), ("no", b"plain")], "name string, content binary")
    assert [(r["name"], r["member"], bytes(r["content"])) for r in intake.archive_members(files).collect()] == [("ok", "a.TXT", b"one"), ("ok", "d/c.md", b"three")]
    assert all(r["malware"] is None for r in intake.scanned(files).collect())
    signs = {"signs": lambda content: F.when(F.contains(content.cast("string"), F.lit("plain")), "plain words")}
    assert {r["name"]: r["malware"] for r in intake.scanned(files, "signs", signs).collect()} == {"ok": None, "no": "plain words"}
    with pytest.raises(ValueError):
        intake.scanned(files, "signs")


def test_quarantine_sees_zero_bytes_at_any_place(spark):
    reason = intake.quarantine_reason(F.lit("a.pdf"), F.lit(3), F.col("c"), F.lit("application/pdf"))
    rows = spark.createDataFrame([(b"\x10\x01\x00",), (b"\x10\x01a",)], "c binary").select(reason.alias("r")).collect()
    assert [r["r"] for r in rows] == ["binary", None]


def test_blobs_are_written_once_and_checked(spark, tmp_path):
    files = spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "content binary")
    assert sinks.write_blobs(files, str(tmp_path / "store")).count() == 2
    stored = sinks.write_blobs(spark.createDataFrame([(b"b",), (b"c",)], "content binary"), str(tmp_path / "store"))
    assert {bytes(r["content"]) for r in stored.collect()} == {b"a", b"b", b"c"} and stored.count() == 3
    assert sinks.damaged_blobs(stored).count() == 0
    bad = stored.withColumn("content", F.when(F.col("content") == F.lit(b"c"), F.lit(b"d")).otherwise(F.col("content")))
    assert [r["sha256"] for r in sinks.damaged_blobs(bad).collect()] == [hashlib.sha256(b"c").hexdigest()]


def test_coerced_bodies(spark):
    bodies = {'[{"role":"assistant","content":"x","name":"n"},{}]': [("assistant", "x", "n"), ("user", "", None)], '{"a":': [("user", "", None)], None: [("user", "", None)], "[]": []}
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", scalars.coerced_messages(F.col("b")).alias("m")).collect()
    assert {r["b"]: [(m["role"], m["content"], m["name"]) for m in r["m"]] for r in rows} == bodies
    got = one(spark, scalars.coerced_evidence(F.lit('[{"span_id":"s"},{"support_type":"partial"}]')).alias("e"), scalars.coerced_evidence(F.lit("none")).alias("n"))
    assert [tuple(e) for e in got["e"]] == [("s", "direct"), ("", "partial")] and got["n"] == []


def test_seeded_ids_settings_and_schemas(spark):
    for seed in ("s", "k" * 70):
        want = str(uuid.UUID(hmac.new(seed.encode(), b"7", hashlib.sha256).hexdigest()[:32]))
        assert one(spark, scalars.seeded_id(seed, F.lit(7)).alias("i"))["i"] == want
    merged = scalars.merged_config({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"c": 3}, "d": [2]})
    assert merged == {"a": {"b": 1, "c": 3}, "d": [2]}
    assert scalars.setting(merged, "a.c") == 3 and scalars.setting(merged, "a.x.y", "none") == "none"
    schema = scalars.output_schema({"split": {}, "question": {"type": "string"}}, ["split", "question"])
    assert schema == {"type": "object", "properties": {"question": {"type": "string"}}, "required": ["question"]}
    assert scalars.schema_hash({"b": 1, "a": 2}) == "schema:" + hashlib.sha256(b'{"a":2,"b":1}').hexdigest()[:16]


def test_prompt_fingerprint_ignores_the_order_of_slots(spark):
    made = [scalars.prompt_fingerprint(F.lit("t"), F.lit("1"), F.lit(s), F.lit("[]")).alias(n) for n, s in (("a", '{"x":1,"y":"é"}'), ("b", '{"y": "é", "x": 1}'))]
    got = one(spark, *made)
    inner = [hashlib.sha256(hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest().encode()).hexdigest() for x in ({"x": 1, "y": "é"}, [])]
    assert got["a"] == got["b"] == hashlib.sha256(f"t:1:{inner[0]}:{inner[1]}".encode()).hexdigest()


def test_locations(spark):
    prov = "array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>"
    rows = spark.createDataFrame([([(3, (1.0, 2.0, 3.0, 4.0, "BOTTOMLEFT")), (1, None), (None, (0.0, 0.0, 0.0, 0.0, None))], ["b", "a"]), (None, None), ([(1, None)], ["a"])], f"p {prov}, r array<string>")
    units = rows.agg(F.collect_list(inspection.block_location(F.col("p"), F.col("r"))).alias("u"))
    first = units.select(F.expr("u[0]").alias("x")).first()["x"]
    assert first["pages"] == [1, 3] and [(b["page"], b["coord_origin"]) for b in first["bboxes"]] == [(3, "BOTTOMLEFT"), (None, "TOPLEFT")]
    merged = units.select(inspection.merged_locations(F.col("u")).alias("m")).first()["m"]
    assert merged["pages"] == [1, 3] and merged["element_refs"] == ["a", "b"] and len(merged["bboxes"]) == 2


def test_next_jobs_take_waiting_and_abandoned_ones(spark):
    rows = [(1, "q", "done", 1, None), (2, "q", "leased", 2, 90), (3, "q", "running", 3, 10), (4, "q", "queued", 4, None), (5, "r", "leased", 1, None), (6, "s", "done", 1, None)]
    jobs = spark.createDataFrame(rows, "id int, queue string, state string, created int, lease_expires_at int")
    assert {r["queue"]: r["id"] for r in inspection.next_jobs(jobs, "queue", F.lit(50), "created").collect()} == {"q": 3, "r": 5}


def test_flow_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "ok boolean, heading_path array<string>, resolved boolean")
    assert list(inspection.flow_metrics(none, none, none).first()) == [0.0, 0.0, 0.0]


def judged(spark, chosen, rejected, *answers):
    pairs = spark.createDataFrame([(1, chosen, rejected)], "pair_id int, chosen string, rejected string")
    runs = spark.createDataFrame([(1, first, a) for first, a in answers], "pair_id int, chosen_first boolean, answer string")
    return judging.certify(pairs, runs).first()


def answer(first, second, preferred, defects_first=(), defects_second=(), confidence=0.8):
    return json.dumps({"first_quality": first, "second_quality": second, "preferred": preferred, "defects_first": list(defects_first), "defects_second": list(defects_second), "confidence": confidence})


def test_certified_pairs(spark):
    a, b = answer(5, 2, "first", (), ["misses_question"]), answer(3, 4, "second", ["omits_requirement"], (), 0.6)
    got = judged(spark, "a good answer", "a poor reply", (True, a), (False, b))
    assert (got["verdict"], got["codes"], got["margin"], got["chosen_absolute"], got["rejected_absolute"], got["confidence"]) == ("valid", [], 2.0, 4.5, 2.5, 0.6)
    assert got["rejected_defects"] == ["misses_question", "omits_requirement"]
    assert judged(spark, "a", " ", (True, a), (False, b))["codes"] == ["missing_answer_text"]
    assert judged(spark, "a", "b", (True, a))["codes"] == ["judge_unavailable"]
    assert judged(spark, "a", "b", (True, a), (False, "no json"))["codes"] == ["judge_output_invalid"]
    assert judged(spark, "A, b", "a b!", (True, a), (False, b))["verdict"] == "invalid"
    tie = judged(spark, "abc", "abd", (True, answer(3, 3, "tie")), (False, answer(4, 3, "tie")))
    assert tie["codes"] == ["judge_called_tie"] and tie["margin"] == 0.5 and tie["verdict"] == "review"
    style = answer(5, 2, "first", (), ["style_only_difference"])
    assert judged(spark, "abc", "abd", (True, style), (False, answer(2, 5, "second", ["style_only_difference"])))["codes"] == ["rejected_defect_not_classified"]


def test_judgements_are_unwrapped_and_held_to_range(spark):
    a, b = answer(5, 2, "first", (), ["misses_question"]), answer(3, 4, "second", ["omits_requirement"], (), 0.6)
    plain = judged(spark, "a good answer", "a poor reply", (True, a), (False, b))
    for wrap in ("```json\n{}\n```", "```\n{}```", "  {}\n", "I think: {} and no more."):
        assert judged(spark, "a good answer", "a poor reply", (True, wrap.format(a)), (False, b)) == plain
    high = judged(spark, "a good answer", "a poor reply", (True, answer(50, -3, "first", (), ["misses_question"], 7)), (False, answer(1, 5, "second", (), (), 9)))
    assert (high["chosen_absolute"], high["rejected_absolute"], high["confidence"]) == (5.0, 1.0, 1.0)
    for bad in (f"[{a}]", '{"first_quality": "x", "second_quality": 2, "preferred": "first"}', a.replace('"first"', '"both"'), a.replace("0.8", '"high"'), "{", ""):
        assert judged(spark, "a", "b", (True, bad), (False, b))["codes"] == ["judge_output_invalid"], bad
    assert judged(spark, "a good answer", "a poor reply", (True, a.replace("5", '"5"')), (False, b)) == plain


def test_model_verdicts_hold_a_judge_to_the_citations(spark):
    text = '```json\n[{"claim_id": "1", "verdict": "entailed", "confidence": -2, "evidence_span_ids": ["x", "s"]}, "odd", {"claim_id": 1, "verdict": "contradicted"}]\n```'
    claims, cited = F.array(F.lit("p"), F.lit("q")), F.array(F.lit("s"))
    got = one(spark, judging.model_verdicts(claims, F.lit(text), cited).alias("v"), judging.model_verdicts(claims, F.lit(None).cast("string"), cited).alias("n"))
    assert [(v["verdict"], v["confidence"], v["spans"], v["codes"]) for v in got["v"]] == [("unverified", 0.0, [], ["judge_no_verdict"]), ("entailed", 0.0, ["s"], [])]
    assert [v["codes"] for v in got["n"]] == [["model_verifier_failed"]] * 2


def test_a_run_is_written_in_the_order_of_its_references(spark, tmp_path):
    rows = spark.range(3)
    counts = sinks.write_graph({"examples": rows, "parsed": rows.limit(2)}, str(tmp_path / "run"))
    assert {r["name"]: r["n_rows"] for r in counts.collect()} == {"parsed": 2, "examples": 3}
    assert intake.read_table(spark, str(tmp_path / "run"), "examples").count() == 3
    with pytest.raises(ValueError):
        sinks.write_graph({"other": rows}, str(tmp_path / "other"))


def test_publication_is_a_dry_run_unless_authorized(spark):
    records = spark.createDataFrame([("a/b.json", 3, "h")], "path string, size_bytes long, sha256 string")
    assert sinks.publication_plan(records, "r").first()["action"] == "dry_run"
    assert tuple(sinks.publication_plan(records, "r/", authorized=True).first()) == ("a/b.json", 3, "h", "r/a/b.json", "upload")
