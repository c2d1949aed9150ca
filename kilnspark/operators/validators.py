"""Evidence-scoped validators as columns (score and ordered reason codes) and the decision over them.

Input: examples with evidence_text and unresolved (see evidence.with_evidence). Every score is a double from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions import text as T
from kilnspark.functions.wordlists import ANSWER_REFUSALS, ARTIFACT_REFUSALS, GROUNDING_STOPWORDS
from kilnspark.operators.examples import assistant_text, contents, prompt_text, side_text

#: A dimension is verified from its floor on.
FLOORS = {"grounding": 0.9, "completeness": 0.8, "format": 0.8, "refusal": 0.8, "schema": 0.9, "answerability": 0.8, "semantic_consistency": 0.9, "artifact_resistance": 0.75}
CRITICAL = ["grounding", "schema", "answerability", "instruction_fulfillment", "semantic_consistency"]
POLICY = {"grounding": 0.90, "instruction_fulfillment": 0.80, "overall": 0.82, "preference_signal": 0.70, "artifact_resistance": 0.75}


def status_of(score: Column) -> Column:
    return F.when(score >= 0.8, "accepted").when(score >= 0.5, "review").otherwise("rejected")


def codes(*marks: Column) -> Column:
    """The codes that are not null, in order."""
    return F.filter(F.array(*marks), lambda c: c.isNotNull())


def prepare(examples: DataFrame) -> DataFrame:
    """Adds the texts and token sets that several validators read, each computed once."""
    out = examples.withColumn("answer", assistant_text()).withColumn("prompt", prompt_text())
    answer_set = T.without(T.lexical_set(F.col("answer")), GROUNDING_STOPWORDS)
    prompt_set = T.without(T.lexical_set(F.col("prompt")), GROUNDING_STOPWORDS)
    return out.withColumns({"answer_set": answer_set, "prompt_set": prompt_set, "evidence_set": T.lexical_set(F.col("evidence_text"))})


def _refuses(x: Column) -> Column:
    return T.any_phrase(F.lower(x), ANSWER_REFUSALS)


def grounding() -> tuple[Column, Column]:
    overlap = T.coverage(F.col("answer_set"), F.col("evidence_set"))
    raw = F.greatest(F.lit(0.0), 1.0 - 2.0 * (1.0 - overlap))
    no_answer, no_evidence = F.size("answer_set") == 0, F.size("evidence_set") == 0
    uncited = T.is_blank(F.col("evidence_text"))
    score = F.when(uncited | no_answer | no_evidence, 0.0).otherwise(raw)
    return score, codes(F.when(uncited, "no_cited_evidence").when(no_answer, "empty_answer").when(no_evidence, "no_evidence").when(raw < 0.6, "low_grounding"))


def completeness() -> tuple[Column, Column]:
    ratio = F.greatest(T.word_count(F.col("answer")), F.lit(1)).cast("double") / F.greatest(T.word_count(F.col("prompt")), F.lit(1))
    empty, fits = F.col("answer") == "", ratio.between(0.05, 8.0)
    return F.when(empty, 0.0).when(fits, 1.0).otherwise(0.6), codes(F.when(empty, "empty_answer").when(~fits, "length_out_of_band"))


def format_() -> tuple[Column, Column]:
    blank, long = T.is_blank(F.col("answer")), F.length("answer") > 4000
    return F.when(blank, 0.0).when(long, 0.7).otherwise(1.0), codes(F.when(blank, "empty_assistant").when(long, "overlong"))


def refusal() -> tuple[Column, Column]:
    says, cited = _refuses(F.col("answer")), ~T.is_blank(F.col("evidence_text"))
    return F.when(says & cited, 0.3).otherwise(1.0), codes(F.when(says & cited, "false_refusal").when(says, "legitimate_refusal"))


def schema() -> tuple[Column, Column]:
    has = lambda column: F.exists(column, lambda m: m["role"] == "assistant")
    pair = F.col("topology") == "preference"
    every = F.when(pair, F.concat("prompt_messages", "chosen_messages", "rejected_messages")).otherwise(F.concat("prompt_messages", "chosen_messages"))
    blanks = F.array_repeat(F.lit("empty_content"), F.size(F.filter(contents(every), T.is_blank)))
    of_pair = F.concat(blanks, codes(F.when(~has("chosen_messages"), F.lit("chosen_missing_assistant")), F.when(~has("rejected_messages"), F.lit("rejected_missing_assistant"))))
    first = F.get("prompt_messages", F.lit(0))["role"]
    nothing = (F.size("prompt_messages") == 0) & (F.size("chosen_messages") == 0)
    of_chain = F.concat(
        codes(F.when(nothing, F.lit("no_messages")), F.when(~first.isin("system", "user"), F.lit("bad_first_role")), F.when(~has("chosen_messages"), F.lit("missing_assistant"))),
        blanks,
    )
    cites = F.concat(codes(F.when(F.size("source_span_ids") == 0, F.lit("no_evidence"))), F.array_repeat(F.lit("unresolved_evidence"), F.col("unresolved")))
    failed = F.concat(F.when(pair, of_pair).otherwise(of_chain), cites)
    return F.when(F.size(failed) == 0, 1.0).otherwise(0.0), F.when(F.size(failed) == 0, F.array(F.lit("schema_ok"))).otherwise(failed)


def answerability() -> tuple[Column, Column]:
    uncited, says = T.is_blank(F.col("evidence_text")), _refuses(F.col("answer"))
    could = (T.coverage(F.col("prompt_set"), F.col("evidence_set")) >= 0.2) & (F.size("evidence_set") > 0)
    score = F.when(uncited, 0.0).when(says & could, 0.3).otherwise(1.0)
    return score, codes(F.when(uncited, "no_evidence_for_answer").when(says & could, "false_refusal").when(says, "legitimate_refusal").otherwise("answerable"))


def artifact_resistance() -> tuple[Column, Column]:
    """Penalties in tenths are summed as whole numbers, so the score needs no rounding."""
    injected = F.size(T.injection_hits(F.concat_ws("\n", "answer", "prompt"))) > 0
    pair = F.col("topology") == "preference"
    chosen, rejected = side_text("chosen_messages"), side_text("rejected_messages")
    band = pair & ~T.length_ratio(chosen, rejected).between(0.80, 1.25)
    trivial = pair & (T.separability(chosen, rejected) > 0.2)
    empty = (F.col("topology") == "sft") & T.is_blank(F.col("answer"))
    refusing = T.any_phrase(F.lower("answer"), ARTIFACT_REFUSALS) & (F.size(T.injection_hits(F.col("prompt"))) == 0) & (F.col("prompt") != "") & (F.size("source_span_ids") > 0)
    parts = [(injected, 4, "injection_marker"), (band, 2, "length_band_violation"), (trivial, 3, "trivial_separation"), (empty, 5, "empty_assistant"), (refusing, 2, "possible_false_refusal")]
    lost = sum((F.when(c, n).otherwise(0) for c, n, _ in parts), F.lit(0))
    return F.greatest(F.lit(0), 10 - lost).cast("double") / 10, codes(*[F.when(c, F.lit(name)) for c, _, name in parts])


NATIVE = {
    "grounding": grounding,
    "completeness": completeness,
    "format": format_,
    "refusal": refusal,
    "schema": schema,
    "answerability": answerability,
    "artifact_resistance": artifact_resistance,
}


def assess(prepared: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Adds <name>_score and <name>_codes for the named validators."""
    out = {}
    for name in names or list(NATIVE):
        score, reasons = NATIVE[name]()
        out |= {f"{name}_score": score, f"{name}_codes": reasons}
    return prepared.withColumns(out)


def decide(assessed: DataFrame, dimensions: list[str]) -> DataFrame:
    """Adds overall_score, status and reason_codes from the dimensions' <name>_score and <name>_codes.

    Completeness also stands for instruction fulfilment (and so counts twice). A preference example without a preference
    signal gets the score 0, unverified. A failed critical dimension rejects; a missing one sends to review; else the policy
    accepts or sends to review."""
    score = {d: F.col(f"{d}_score") for d in dimensions}
    floor = {d: FLOORS.get(d, 0.8) for d in dimensions}
    if "instruction_fulfillment" not in score and "completeness" in score:
        score["instruction_fulfillment"], floor["instruction_fulfillment"] = score["completeness"], floor["completeness"]
    pair = F.col("topology") == "preference"
    added = pair if "preference_signal" not in score else F.lit(False)
    total = sum(list(score.values())[1:], list(score.values())[0])
    overall = total / (F.lit(len(score)) + added.cast("int"))
    failed = {d: score[d] < floor[d] for d in CRITICAL if d in score}
    missing = [d for d in CRITICAL if d not in score]
    signal = score.get("preference_signal", F.lit(0.0))
    short = [(d, (score[d] if d in score else F.lit(0.0)) < POLICY[d]) for d in ("grounding", "instruction_fulfillment")]
    short += [("overall", F.round(overall, 4) < POLICY["overall"]), ("preference_signal", pair & (signal < POLICY["preference_signal"]))]
    short += [("artifact_resistance", score.get("artifact_resistance", F.lit(0.0)) < POLICY["artifact_resistance"])]
    floors = {"overall": "0.82", "grounding": "0.9", "instruction_fulfillment": "0.8", "preference_signal": "0.7", "artifact_resistance": "0.75"}
    below = codes(*[F.when(c, F.lit(f"{d}<{floors[d]}")) for d, c in short])
    any_failed = sum((c.cast("int") for c in failed.values()), F.lit(0)) > 0
    status = F.when(any_failed, "rejected").when(F.lit(bool(missing)), "review").when(F.size(below) == 0, "accepted").otherwise("review")
    critical = codes(*[F.when(c, F.lit(f"critical_failed:{d}")) for d, c in failed.items()])
    unverified = F.when(any_failed, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(f"critical_unverified:{d}") for d in missing]).cast("array<string>"))
    own = F.concat(*[F.when(status_of(F.col(f"{d}_score")) != "accepted", F.col(f"{d}_codes")).otherwise(F.array().cast("array<string>")) for d in dimensions])
    return assessed.withColumns({"overall_score": overall, "status": status}).withColumn("reason_codes", F.concat(F.array_distinct(F.concat(F.array(F.col("status")), own)), below, critical, unverified))


def long_form(assessed: DataFrame, dimensions: list[str], key: str = "example_id") -> DataFrame:
    """(key, topology, validator_name, status, verify_state, score): one row for each example and dimension, and the decision as `overall`."""
    one = [F.struct(F.lit(d).alias("validator_name"), F.col(f"{d}_score").alias("score"), status_of(F.col(f"{d}_score")).alias("status"), F.when(F.col(f"{d}_score") >= FLOORS[d], "verified").otherwise("failed").alias("verify_state")) for d in dimensions]
    if "overall_score" in assessed.columns:
        one.append(F.struct(F.lit("overall").alias("validator_name"), F.col("overall_score").alias("score"), F.col("status").alias("status"), F.when(F.col("status") == "accepted", "verified").otherwise("failed").alias("verify_state")))
    return assessed.select(key, "topology", F.explode(F.array(*one)).alias("a")).select(key, "topology", "a.*")
