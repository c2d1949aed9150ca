"""Training examples: message structs, derivation from conversations and documents, text projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions.text import content_handle, near_miss, sentences

MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def no_messages() -> Column:
    return F.array().cast(MESSAGES)


def from_conversations(conversations: DataFrame) -> DataFrame:
    """One sft example for each conversation: system turns, user turns as prompt, assistant turns as chosen, each in turn order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    grouped = conversations.groupBy("conv_id").agg(turns.alias("turns"))

    def of(role: str) -> Column:
        return F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))

    return grouped.select(
        F.concat(F.lit("conv_"), "conv_id").alias("example_id"),
        F.lit("sft").alias("topology"),
        F.transform(of("system"), lambda m: m["content"]).alias("system_messages"),
        of("user").alias("prompt_messages"),
        of("assistant").alias("chosen_messages"),
        no_messages().alias("rejected_messages"),
        F.transform("turns", lambda t: t["role"]).alias("roles"),
    )


QUESTIONS = {
    "procedure": "What are the key steps to accomplish this task?",
    "troubleshooting": "How should one resolve the issue described in the material?",
    "comparison": "How do the described options compare according to the material?",
}
LEADS = {
    "procedure": "To handle this, follow the steps described: ",
    "troubleshooting": "Based on the material: ",
    "comparison": "A fair comparison based on the evidence: ",
}
FAMILIES = ["factual_explanation", "procedure", "troubleshooting", "comparison"]
TOPOLOGIES = ["sft", "preference", "kto", "evaluation"]


def _by_family(family: Column, table: dict[str, str], otherwise: Column) -> Column:
    out = otherwise
    for name, text in table.items():
        out = F.when(family == name, F.lit(text)).otherwise(out)
    return out


def question(first: Column, family: Column, difficulty: Column) -> Column:
    head = F.substring(first, 1, 180)
    hard = F.concat(F.lit("Explain the underlying reasons and implications of the following, based only on the material: "), head)
    plain = F.concat(F.lit("Based only on the provided material, summarize the key point about: "), head)
    return _by_family(family, QUESTIONS, F.when(difficulty == "advanced", hard).otherwise(plain))


def answer(main: Column, family: Column) -> Column:
    return F.concat(_by_family(family, LEADS, F.lit("According to the provided material: ")), main)


def generate(chunks: DataFrame, *carry: Column) -> DataFrame:
    """The offline generator: examples from chunks (span_id, source_id, text, topology, task_family, difficulty), with columns carried along.

    Chunks without a sentence of twelve characters yield nothing."""
    said = chunks.withColumn("__s", sentences(F.col("text"))).where(F.size("__s") > 0)
    first, second = F.get("__s", F.lit(0)), F.get("__s", F.lit(1))
    pair = F.concat_ws(" ", first, F.coalesce(second, first))
    main = F.when(F.col("topology") == "evaluation", first).when(F.col("topology") == "kto", F.concat_ws(" ", first, second)).otherwise(pair)
    said = said.withColumn("__main", main).withColumn("__first", first)
    asked = question(F.col("__first"), F.col("task_family"), F.col("difficulty"))
    told = answer(F.col("__main"), F.col("task_family"))
    missed = answer(near_miss(F.col("__main")), F.col("task_family"))
    system = F.array(F.lit("You are a careful domain assistant."))
    return said.select(
        content_handle("ex", F.col("span_id"), F.col("topology"), F.col("task_family"), F.col("difficulty")).alias("example_id"),
        "topology",
        "task_family",
        F.when(F.col("topology") == "sft", system).otherwise(F.array().cast("array<string>")).alias("system_messages"),
        F.array(message("user", asked)).alias("prompt_messages"),
        F.array(message("assistant", told)).alias("chosen_messages"),
        F.when(F.col("topology") == "preference", F.array(message("assistant", missed))).otherwise(no_messages()).alias("rejected_messages"),
        F.when(F.col("topology") == "kto", "good").alias("label_or_target"),
        F.array("span_id").alias("source_span_ids"),
        F.array("source_id").alias("source_document_ids"),
        F.array(content_handle("cand", F.col("span_id"), F.col("topology"))).alias("generation_candidate_ids"),
        *carry,
    )


def contents(messages: Column) -> Column:
    return F.transform(messages, lambda m: m["content"])


def assistant_text() -> Column:
    """The first assistant turn of chosen, or of the prompt where chosen is empty; else empty."""
    source = F.when(F.size("chosen_messages") > 0, F.col("chosen_messages")).otherwise(F.col("prompt_messages"))
    return F.coalesce(F.get(F.filter(source, lambda m: m["role"] == "assistant"), F.lit(0))["content"], F.lit(""))


def prompt_text() -> Column:
    every = F.concat("prompt_messages", "chosen_messages", "rejected_messages")
    return F.array_join(contents(F.filter(every, lambda m: m["role"].isin("user", "system"))), " ")


def side_text(column: str) -> Column:
    return F.array_join(contents(F.filter(column, lambda m: m["role"] == "assistant")), "")
