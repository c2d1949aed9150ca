"""Small scalar functions: markdown, layout JSON, handles, canonical JSON, judge output, prompts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kilnspark.functions.arrow import arrow_udf
from kilnspark.functions.text import strip

HANDLE = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"


def blocks_to_markdown(blocks: Column) -> Column:
    def one(b: Column) -> Column:
        heading = F.concat(F.repeat(F.lit("#"), F.coalesce(b["level"], F.lit(1))), F.lit(" "), b["text"])
        return F.when(b["type"] == "heading", heading).when(b["type"] == "list_item", F.concat(F.lit("- "), b["text"])).otherwise(b["text"])

    return F.array_join(F.transform(blocks, one), "\n\n")


def strip_markdown(x: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(x, "`{1,3}", ""), r"[*_~>{}\[\]()#]", "")
    return strip(F.regexp_replace(plain, r"\n{3,}", "\n\n"))


LAYOUT = "struct<main_text:array<struct<text:string,label:string>>>"


def layout_blocks(document: Column) -> Column:
    """Blocks of a layout parser's JSON: titles and headings, tables, list items, else paragraphs, each with its element reference."""
    items = F.from_json(document, LAYOUT)["main_text"]
    told = F.transform(items, lambda m, i: F.struct(m["text"].alias("text"), F.lower(F.coalesce(m["label"], F.lit("text"))).alias("label"), F.concat(F.lit("docling#/main_text/"), i).alias("ref")))
    kind = lambda m: F.when((m["label"] == "title") | m["label"].startswith("heading"), "heading").when(m["label"].isin("table", "list_item"), m["label"]).otherwise("paragraph")
    return F.transform(F.filter(told, lambda m: F.coalesce(m["text"], F.lit("")) != ""), lambda m: F.struct(kind(m).alias("type"), m["text"].alias("text"), m["ref"].alias("element_ref")))


def needs_ocr(mode: Column, native_chars: Column, engines: Column) -> Column:
    """Whether a page goes to OCR: never when off or without an engine; always when on; in auto below 40 native characters."""
    return F.coalesce((F.size(engines) > 0) & (mode.isin("on", "force_engine") | ((mode == "auto") & (native_chars < 40))), F.lit(False))


def is_handle(x: Column) -> Column:
    return F.coalesce(x.rlike(HANDLE), F.lit(False))


def object_key(*parts: Column) -> Column:
    """Handles joined to a path; null if any is unsafe."""
    safe = is_handle(parts[0])
    for p in parts[1:]:
        safe = safe & is_handle(p)
    return F.when(safe, F.concat_ws("/", *parts))


#: Fields of an example that the generator stamps.
STAMPED = ("chunk_id", "source_document_id", "source_group_id", "split", "topology")


@arrow_udf("string")
def canonical_hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SHA-256 of a JSON text in canonical form (sorted keys, compact, ASCII-escaped); null for text that is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    for texts in batches:
        yield texts.map(one)


def call_fingerprint(messages: Column, model: Column, template_version: Column, sampling: Column, schema_hash: Column, source_hashes: Column) -> Column:
    """Identity of a generation call; the order of sources does not matter."""
    whole = F.struct(messages.alias("messages"), template_version.alias("pt"), model.alias("model"), sampling.alias("sampling"), schema_hash.alias("schema"), F.array_sort(source_hashes).alias("sources"))
    return canonical_hash(F.to_json(whole, {"ignoreNullFields": "false"}))


def prompt_fingerprint(template: Column, version: Column, slots: Column, messages: Column) -> Column:
    """Identity of a rendered prompt: its template, and the hashes of its slots and messages (JSON texts)."""
    hashed = [F.sha2(canonical_hash(x), 256) for x in (slots, messages)]
    return F.sha2(F.concat_ws(":", template, version, *hashed), 256)


def seeded_id(seed: str, n: Column) -> Column:
    """The n-th id of a seed: an HMAC-SHA-256 of the number, its first 32 hex digits in the form of a UUID."""
    key = seed.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ mask for b in key)) for mask in (0x36, 0x5C))
    mac = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(n.cast("string"), "UTF-8")), 256))), 256)
    return F.concat_ws("-", *[F.substring(mac, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def schema_hash(schema: dict) -> str:
    """The short digest of an output schema, whatever the order of its keys."""
    return "schema:" + hashlib.sha256(json.dumps(schema, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def output_schema(fields: dict[str, dict], required: list[str], stamped: tuple[str, ...] = STAMPED) -> dict:
    """The JSON schema that a model has to satisfy; fields that the generator stamps itself are left out."""
    return {"type": "object", "properties": {k: v for k, v in fields.items() if k not in stamped}, "required": [r for r in required if r not in stamped]}


def merged_config(base: dict, over: dict) -> dict:
    """Settings with others laid over them; maps are merged key by key, everything else is replaced."""
    both = {k: merged_config(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}
    return {**base, **both}


def setting(config: dict, path: str, default=None):
    """The value at a dotted path, or the default where a part of the path is missing."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


MESSAGE = "struct<role:string,content:string,name:string,tool_call_id:string>"


def coerced_messages(body: Column) -> Column:
    """Messages from a generated body (a JSON array): a missing role is user, a missing content empty; no list at all is one empty user turn."""
    parsed = F.from_json(body, f"array<{MESSAGE}>")
    filled = F.transform(parsed, lambda m: F.struct(F.coalesce(m["role"], F.lit("user")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), m["name"].alias("name"), m["tool_call_id"].alias("tool_call_id")))
    nothing = F.struct(F.lit("user").alias("role"), F.lit("").alias("content"), F.lit(None).alias("name"), F.lit(None).alias("tool_call_id"))
    return F.coalesce(filled, F.array(nothing).cast(f"array<{MESSAGE}>"))


def coerced_evidence(body: Column) -> Column:
    """Evidence from a generated body (a JSON array): a missing span is empty, a missing support direct; no list at all is none."""
    parsed = F.from_json(body, "array<struct<span_id:string,support_type:string>>")
    filled = F.transform(F.filter(parsed, lambda e: e.isNotNull()), lambda e: F.struct(F.coalesce(e["span_id"], F.lit("")).alias("span_id"), F.coalesce(e["support_type"], F.lit("direct")).alias("support_type")))
    return F.coalesce(filled, F.array().cast("array<struct<span_id:string,support_type:string>>"))


def judge_json(x: Column) -> Column:
    """The JSON array in a judge's chatty answer: from the first `[` to the last `]`, code fences gone; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(x, "```(?:json)?", ""), r"(?s)(\[.*\])", 1), F.lit(""))


VERDICTS = "array<struct<claim:string,verdict:string,reason_codes:array<string>>>"


def judged_claims(x: Column) -> Column:
    return F.from_json(judge_json(x), VERDICTS)


def missing_fields(topology: Column, body: Column) -> Column:
    """Codes for what a generated body (JSON) lacks for its topology; empty if nothing."""
    parsed = F.from_json(body, "struct<task_family:string,messages:array<struct<role:string,content:string>>,prompt_messages:array<struct<role:string,content:string>>,chosen_messages:array<struct<role:string,content:string>>,rejected_messages:array<struct<role:string,content:string>>,question:string,reference_answer:string,evidence:array<struct<span_id:string>>>")
    speaks = lambda c: F.coalesce(F.exists(parsed[c], lambda m: m["role"] == "assistant"), F.lit(False))
    opens = F.coalesce(F.get(parsed["messages"], F.lit(0))["role"].isin("system", "user"), F.lit(False))
    chain, pair, quiz = topology.isin("sft", "kto"), topology == "preference", topology == "evaluation"
    marks = [
        F.when(parsed.isNull() | (parsed["task_family"].isNull()), "task_family"),
        F.when(chain & ~opens, "messages_start"),
        F.when(chain & ~speaks("messages"), "messages_assistant"),
        F.when(pair & ~speaks("chosen_messages"), "chosen_messages"),
        F.when(pair & ~speaks("rejected_messages"), "rejected_messages"),
        F.when(quiz & parsed["question"].isNull(), "question"),
        F.when(quiz & parsed["reference_answer"].isNull(), "reference_answer"),
    ]
    return F.filter(F.array(*marks), lambda m: m.isNotNull())


#: Prompt texts of each topology (one set for all task families).
SYSTEM_PROMPT = (
    "You are a careful, precise domain assistant. Base every answer strictly on the provided source material. Do not add information not supported "
    "by the material. If the material does not contain the answer, say so  explicitly rather than guessing."
)
USER_PROMPTS = {
    "sft": "Given the following source material, answer the question.\n\nSOURCE MATERIAL:\n{source_text}\n\nQUESTION:\n{question}\n\nProvide a concise, well-grounded answer that cites the relevant material.",
    "preference": "Below are two candidate answers to the same question. Choose the more accurate, complete, and faithful-to-source answer.\n\nSOURCE MATERIAL:\n{source_text}\n\nQUESTION:\n{question}\n\nCandidate A:\n{candidate_a}\n\nCandidate B:\n{candidate_b}\n\nProvide your judgment as A or B followed by a one-line reason.",
    "kto": "Given the source material, determine whether the following response is a good or bad answer.\n\nSOURCE MATERIAL:\n{source_text}\n\nRESPONSE:\n{response}\n\nAnswer GOOD or BAD with a one-line reason.",
    "evaluation": "Given the source material, generate a clear, self-contained evaluation question with a reference answer.\n\nSOURCE MATERIAL:\n{source_text}\n\nReturn the question and the reference answer.",
}


def user_prompt(topology: str, **slots: Column) -> Column:
    """A topology's prompt with its slots filled; slots not given are empty."""
    out, rest = [], USER_PROMPTS[topology]
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        out += [F.lit(before), F.coalesce(slots[name], F.lit("")) if name in slots else F.lit("")]
    return F.concat(*out, F.lit(rest))
