"""What judges answered, given as tables: verdicts on claims, verdicts of two verifiers together, certified preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions.scalars import judge_json

#: A judge's verdicts and what they count as; defects of an answer, the last of them no real one.
VERDICTS = {"entailed": "entailed", "contradicted": "contradicted", "insufficient_evidence": "insufficient", "unverified": "unverified"}
DEFECTS = [
    "unsupported_claim", "contradicts_evidence", "omits_requirement", "factually_incorrect_number_or_unit", "incoherent_or_off_topic",
    "misses_question", "fabricates_source", "style_only_difference",
]
#: Codes that make a pair invalid, and codes that send it to review.
INVALID = ["chosen_below_absolute_floor", "identical_content"]
REVIEW = [
    "judge_order_disagreement", "insufficient_preference_margin", "length_signature", "rejected_defect_not_classified", "both_answers_good",
    "both_answers_bad", "judge_called_tie",
]
ASSESSMENT = "struct<claim:string,verdict:string,confidence:double,spans:array<string>,codes:array<string>>"
_ITEM = "struct<claim_id:string,verdict:string,confidence:string,evidence_span_ids:array<string>,reason_codes:array<string>>"
_RUN = "struct<first_quality:string,second_quality:string,preferred:string,defects_first:array<string>,defects_second:array<string>,confidence:string>"


def _texts(*items: str) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def model_verdicts(claims: Column, answer: Column, cited: Column, *, most_codes: int = 6) -> Column:
    """An assessment of each claim from a judge's answer (a JSON array whose claim_id counts from 0).

    The first item of a claim counts; spans that the example doesn't cite go, as do those of claims that aren't entailed; confidences are held
    to 0..1. Claims the judge left out, and all claims of an unreadable answer, are unverified."""
    items = F.transform(F.from_json(judge_json(answer), "array<string>"), lambda x: F.from_json(x, _ITEM))  # one by one: an odd item spoils no other
    names = F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair])

    def assessment(claim: Column, verdict: Column, confidence: Column, spans: Column, codes: Column) -> Column:
        parts = {"claim": claim, "verdict": verdict, "confidence": confidence, "spans": spans, "codes": codes}
        return F.struct(*[c.alias(n) for n, c in parts.items()]).cast(ASSESSMENT)

    def unverified(claim: Column, code: str) -> Column:
        return assessment(claim, F.lit("unverified"), F.lit(0.0), _texts(), _texts(code))

    def one(claim: Column, at: Column) -> Column:
        item = F.get(F.filter(items, lambda i: i["claim_id"].try_cast("int") == at), F.lit(0))
        verdict = F.coalesce(names[item["verdict"]], F.lit("unverified"))
        sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(item["confidence"].try_cast("double"), F.lit(0.0))))
        spans = F.filter(F.coalesce(item["evidence_span_ids"], _texts()), lambda s: F.array_contains(cited, s))
        codes = F.slice(F.coalesce(item["reason_codes"], _texts()), 1, most_codes)
        judged = assessment(claim, verdict, sure, F.when(verdict == "entailed", spans).otherwise(_texts()), codes)
        return F.when(items.isNull(), unverified(claim, "model_verifier_failed")).when(item.isNull(), unverified(claim, "judge_no_verdict")).otherwise(judged)

    return F.transform(claims, one)


def open_claims(deterministic: Column) -> Column:
    """The claims that a judge gets to see: those that the deterministic verifier doesn't contradict."""
    return F.transform(F.filter(deterministic, lambda d: d["verdict"] != "contradicted"), lambda d: d["claim"])


def composite_verdicts(deterministic: Column, model: Column) -> Column:
    """A deterministic contradiction is final; otherwise the judge's assessment of the same claim, where there is one."""

    def one(d: Column) -> Column:
        judged = F.get(F.filter(model, lambda m: m["claim"] == d["claim"]), F.lit(0))
        return F.when(d["verdict"] == "contradicted", d).otherwise(F.coalesce(judged, d))

    return F.transform(deterministic, one)


def judge_object(x: Column) -> Column:
    """The JSON object in a judge's answer: the answer itself without code fences, or what lies between its first and last brace; null if
    there is none, or if the answer is JSON of another kind."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^```[a-zA-Z]*\n?", ""), r"\n?```$", ""))
    other = F.get_json_object(bare, "$").isNotNull() & ~bare.startswith("{")
    return F.when(~other, F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")))


def _within(number: Column, least: float, most: float) -> Column:
    """A number held to a range; null if it is none."""
    value = number.try_cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(least), F.least(F.lit(most), value)))


def certify(pairs: DataFrame, judgements: DataFrame, key: str = "pair_id", *, least_margin: float = 0.5) -> DataFrame:
    """(key, verdict, codes, margin, order_consistent, chosen_absolute, rejected_absolute, rejected_defects, confidence) of each pair
    (chosen, rejected) from its two judgements (key, chosen_first, answer: a JSON object).

    Only a pair that both orders prefer, by the margin, for a real defect of the other side, is valid. Without one of the judgements, with an
    unreadable one or an empty side it stays in review. Answers may be fenced or chatty; qualities are held to 1 to 5, confidence to 0 to 1. A run that calls a tie gives its first quality to the chosen side in either order."""
    parsed = judgements.select(key, "chosen_first", F.from_json(judge_object(F.col("answer")), _RUN).alias("p"))
    held = {c: _within(F.col(f"p.{c}"), least, most) for c, least, most in (("first_quality", 1.0, 5.0), ("second_quality", 1.0, 5.0), ("confidence", 0.0, 1.0))}
    parsed = parsed.withColumns({f"__{c}": v for c, v in held.items()})
    readable = F.col("__confidence").isNotNull() | F.col("p.confidence").isNull()
    whole = F.col("p.preferred").isin("first", "second", "tie") & F.col("__first_quality").isNotNull() & F.col("__second_quality").isNotNull() & readable
    as_shown = F.col("chosen_first") | (F.col("p.preferred") == "tie")
    run = F.struct(
        F.coalesce(whole, F.lit(False)).alias("whole"),
        F.when(as_shown, F.col("__first_quality")).otherwise(F.col("__second_quality")).alias("chosen"),
        F.when(as_shown, F.col("__second_quality")).otherwise(F.col("__first_quality")).alias("rejected"),
        F.when(F.col("p.preferred") != "tie", (F.col("p.preferred") == "first") == F.col("chosen_first")).alias("prefers"),
        F.coalesce(F.when(F.col("chosen_first"), F.col("p.defects_second")).otherwise(F.col("p.defects_first")), _texts()).alias("defects"),
        F.coalesce(F.col("__confidence"), F.lit(0.0)).alias("confidence"),
    )
    runs = parsed.groupBy(key).agg(F.max(F.when(F.col("chosen_first"), run)).alias("a"), F.max(F.when(~F.col("chosen_first"), run)).alias("b"))
    rows = pairs.select(key, "chosen", "rejected").join(runs, key, "left")

    gap = ((F.col("a.chosen") - F.col("a.rejected")) + (F.col("b.chosen") - F.col("b.rejected"))) / 2
    rows = rows.withColumns(
        {
            "gap": gap,
            "order_consistent": F.coalesce(F.col("a.prefers") == F.col("b.prefers"), F.lit(False)),
            "chosen_absolute": F.bround((F.col("a.chosen") + F.col("b.chosen")) / 2, 3),
            "rejected_absolute": F.bround((F.col("a.rejected") + F.col("b.rejected")) / 2, 3),
            "rejected_defects": F.array_sort(F.array_intersect(F.array_union("a.defects", "b.defects"), _texts(*DEFECTS))),
        }
    )
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))
    ratio = F.length("chosen") / F.greatest(F.lit(1), F.length("rejected"))
    real = F.exists("rejected_defects", lambda d: d != "style_only_difference")
    marks = [
        F.when(F.col("a.prefers").isNull() | F.col("b.prefers").isNull(), "judge_called_tie").when(~F.col("order_consistent"), "judge_order_disagreement"),
        F.when(F.abs("gap") < least_margin, "insufficient_preference_margin"),
        F.when(~ratio.between(0.5, 2.0), "length_signature"),
        F.when(plain("chosen") == plain("rejected"), "identical_content"),
        F.when((F.col("gap") > 0) & F.col("order_consistent") & ~real, "rejected_defect_not_classified"),
        F.when(F.col("chosen_absolute") < 3.0, "chosen_below_absolute_floor"),
        F.when((F.col("rejected_absolute") >= 4.0) & (F.col("gap") > 0), "both_answers_good"),
        F.when((F.col("chosen_absolute") <= 2.0) & (F.col("rejected_absolute") <= 2.0), "both_answers_bad"),
    ]
    empty = F.coalesce(F.trim("chosen") == "", F.lit(True)) | F.coalesce(F.trim("rejected") == "", F.lit(True))
    codes = (
        F.when(empty, _texts("missing_answer_text"))
        .when(F.col("a").isNull() | F.col("b").isNull(), _texts("judge_unavailable"))
        .when(~(F.col("a.whole") & F.col("b.whole")), _texts("judge_output_invalid"))
        .otherwise(F.filter(F.array(*marks), lambda m: m.isNotNull()))
    )
    rows = rows.withColumn("codes", codes)
    judged = ~F.arrays_overlap("codes", _texts("missing_answer_text", "judge_unavailable", "judge_output_invalid"))
    verdict = (
        F.when(~judged, "review").when(F.arrays_overlap("codes", _texts(*INVALID)), "invalid").when(F.arrays_overlap("codes", _texts(*REVIEW)), "review")
        .when((F.col("gap") > 0) & F.col("order_consistent"), "valid").otherwise("review")
    )
    numbers = [F.when(judged, c).alias(n) for n, c in (("margin", F.bround("gap", 3)), ("chosen_absolute", F.col("chosen_absolute")), ("rejected_absolute", F.col("rejected_absolute")))]
    confidence = F.when(judged, F.bround(F.least("a.confidence", "b.confidence"), 4)).alias("confidence")
    return rows.select(key, verdict.alias("verdict"), "codes", *numbers, (judged & F.col("order_consistent")).alias("order_consistent"), F.when(judged, F.col("rejected_defects")).alias("rejected_defects"), confidence)
