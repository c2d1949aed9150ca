"""Preference-pair checks as structs (verdict, code, value); the code's number stays a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions import text as T
from kilnspark.functions.wordlists import CHOSEN_BOILERPLATE_PATTERNS, PREFERENCE_STOPWORDS


def verdict(kind: str, code: str | None = None, value: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("verdict"), F.lit(code).cast("string").alias("code"), (F.lit(None) if value is None else value).cast("double").alias("value"))


def _missing(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")


def tokens(x: Column) -> Column:
    return T.content_tokens(F.coalesce(x, F.lit("")), PREFERENCE_STOPWORDS, least=2)


def prepare(pairs: DataFrame) -> DataFrame:
    """pairs: chosen, rejected, evidence (texts). Adds token sets and similarities; the one Python step is the character ratio."""
    out = pairs.withColumns({"c_set": tokens(F.col("chosen")), "r_set": tokens(F.col("rejected")), "e_set": tokens(F.col("evidence"))})
    return out.withColumns({"token_similarity": T.jaccard(F.col("c_set"), F.col("r_set")), "char_similarity": T.similar_characters(T.collapsed(F.coalesce("chosen", F.lit(""))), T.collapsed(F.coalesce("rejected", F.lit(""))))})


def identical() -> Column:
    near = F.greatest("token_similarity", "char_similarity")
    same = T.collapsed(F.col("chosen")) == T.collapsed(F.col("rejected"))
    return (
        F.when(_missing(F.col("chosen"), F.col("rejected")), verdict("review", "missing_preference_text"))
        .when(same, verdict("invalid", "identical_pair"))
        .when(near > 0.85, verdict("invalid", "near_duplicate_pair", near))
        .otherwise(verdict("valid"))
    )


def absolute_quality() -> Column:
    chosen = F.coalesce("chosen", F.lit(""))
    framed = F.lit(False)
    for p in CHOSEN_BOILERPLATE_PATTERNS:
        framed = framed | T.strip(chosen).rlike("(?i)" + p)
    count = T.word_count(chosen)
    return (
        F.when(T.is_blank(chosen), verdict("invalid", "chosen_empty"))
        .when(framed, verdict("invalid", "chosen_boilerplate_only"))
        .when(count < 5, verdict("invalid", "chosen_too_short", count))
        .otherwise(verdict("valid"))
    )


def _grounded() -> tuple[Column, Column]:
    return T.coverage(F.col("c_set"), F.col("e_set")), T.coverage(F.col("r_set"), F.col("e_set"))


def both_wrong() -> Column:
    c, r = _grounded()
    no_evidence = F.coalesce("evidence", F.lit("")) == ""
    return F.when(_missing(F.col("chosen"), F.col("rejected")), verdict("review", "missing_text")).when(~no_evidence & (c < 0.3) & (r < 0.3), verdict("invalid", "both_wrong", c)).otherwise(verdict("valid"))


def both_correct() -> Column:
    c, r = _grounded()
    known = (F.coalesce("evidence", F.lit("")) != "") & (F.size("e_set") > 0)
    both = known & (c > 0.3) & (r > 0.3) & (F.col("token_similarity") < 0.85)
    return F.when(_missing(F.col("chosen"), F.col("rejected")), verdict("review", "missing_text")).when(both, verdict("invalid", "both_correct", c)).otherwise(verdict("valid"))


def style_shortcut() -> Column:
    ratio = T.word_count(F.col("chosen")).cast("double") / F.greatest(T.word_count(F.col("rejected")), F.lit(1))
    covered = T.coverage(F.col("r_set"), F.col("c_set"))
    return (
        F.when(_missing(F.col("chosen"), F.col("rejected")), verdict("review", "missing_text"))
        .when((covered > 0.7) & (ratio > 2.0), verdict("review", "verbosity_preference", ratio))
        .when((F.col("token_similarity") > 0.7) & (ratio > 1.5), verdict("review", "verbosity_preference_mild", ratio))
        .otherwise(verdict("valid"))
    )


def order_sensitive() -> Column:
    close = F.col("token_similarity") > 0.7
    return F.when(_missing(F.col("chosen"), F.col("rejected")), verdict("review", "missing_text")).when(close, verdict("review", "order_sensitive", F.col("token_similarity"))).otherwise(verdict("valid"))


def signal() -> Column:
    """struct(verdict, codes): an invalid pair or an invalid chosen side ends the check; style and order only ask for review."""
    i, a, s, o = identical(), absolute_quality(), style_shortcut(), order_sensitive()

    def out(kind: Column, of: Column) -> Column:
        return F.struct(kind.alias("verdict"), F.filter(of, lambda c: c.isNotNull()).alias("codes"))

    review = (s["verdict"] == "review") | (o["verdict"] == "review")
    return (
        F.when(_missing(F.col("chosen"), F.col("rejected")), out(F.lit("invalid"), F.array(F.lit("missing_signal"))))
        .when(i["verdict"] == "invalid", out(F.lit("invalid"), F.array(i["code"])))
        .when(a["verdict"] == "invalid", out(F.lit("invalid"), F.array(a["code"])))
        .otherwise(out(F.when(review, "review").otherwise("valid"), F.array(s["code"], o["code"])))
    )


def assess() -> tuple[Column, Column]:
    """(score, codes) of the preference dimension of prepared pairs with their topology: 0 if anything is wrong, style that alone tells the sides
    apart included. A certified judgement, where there is one (certified: struct(verdict, codes) or null), can only lower it."""
    s, a = signal(), absolute_quality()
    both = (F.coalesce("chosen", F.lit("")) != "") & (F.coalesce("rejected", F.lit("")) != "")
    trivial = both & (T.separability(F.col("chosen"), F.col("rejected")) > 0.2)
    some = lambda c, x: F.when(c, x).otherwise(F.array().cast("array<string>"))
    bad = s["verdict"] == "invalid"
    reasons = F.concat(some(s["verdict"] != "valid", s["codes"]), some(bad, F.array(F.lit("no_preference_signal"))), some(a["verdict"] == "invalid", F.array(a["code"])), some(trivial, F.array(F.lit("trivial_style_separation"))))
    score = F.when(F.size(reasons) > 0, 0.0).when(s["verdict"] == "review", 0.6).otherwise(1.0)
    judged = F.col("certified.verdict")
    lowered = F.when(judged == "invalid", 0.0).when(judged == "review", F.least(score, F.lit(0.6))).otherwise(score)
    told = F.when(F.size("certified.codes") > 0, F.col("certified.codes")).otherwise(F.array(F.concat(F.lit("certified_pair_"), judged)))
    whole = F.concat(reasons, some(judged.isin("invalid", "review"), told))
    pair = F.col("topology") == "preference"
    codes = F.when(~pair, F.array(F.lit("not_preference_topology"))).when(F.size(whole) > 0, whole).otherwise(F.array(F.lit("preference_signal_ok")))
    return F.when(pair, lowered).otherwise(0.0), codes


def reconcile(judgements: DataFrame, *, margin: float = 0.5) -> DataFrame:
    """Two judgements of a pair, one for each order (pair_id, side_order ab/ba, score_a, score_b), to one verdict.

    Valid only if both orders prefer chosen (a) by the margin; review if they disagree or the margin is small; invalid if both prefer b."""
    gap = F.col("score_a") - F.col("score_b")
    wide = judgements.groupBy("pair_id").agg(F.max(F.when(F.col("side_order") == "ab", gap)).alias("ab"), F.max(F.when(F.col("side_order") == "ba", gap)).alias("ba"))
    out = F.when(F.col("ab").isNull() | F.col("ba").isNull(), "review").when((F.col("ab") >= margin) & (F.col("ba") >= margin), "valid").when((F.col("ab") < 0) & (F.col("ba") < 0), "invalid").otherwise("review")
    return wide.withColumn("verdict", out).withColumn("consistent", F.coalesce(F.signum("ab") == F.signum("ba"), F.lit(False)))
