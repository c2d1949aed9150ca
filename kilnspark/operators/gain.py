"""Information gain of an answer over its prompt and heading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions import text as T
from kilnspark.functions.wordlists import COMPARISON_MARKERS, DISCLAIMER_PATTERNS, FRAMING_WORDS, GAIN_SEVERITY, GAIN_STOPWORDS, METALINGUISTIC_WORDS


def assess(df: DataFrame, answer: str = "answer", prompt: str = "prompt", heading: str = "heading", task: str = "task_type") -> DataFrame:
    """Adds gain_codes (ordered), gain_score and the measures behind them. Texts must not be null."""
    a = T.strip(F.col(answer))
    # each token set is a column of its own, so that no rule computes it again
    out = df.withColumns({"g_tokens": T.ascii_tokens(a), "g_bare": T.strip_boilerplate(a)})
    out = out.withColumns({"g_set": T.without(F.col("g_tokens"), GAIN_STOPWORDS), "g_prompt": T.content_tokens(F.col(prompt), GAIN_STOPWORDS), "g_heading": T.content_tokens(T.strip(F.col(heading)), GAIN_STOPWORDS), "g_bare_tokens": T.ascii_tokens(F.col("g_bare"))})
    n = F.size("g_tokens")
    out = out.withColumns(
        {
            "repetition": T.repetition_ratio(F.col("g_tokens")),
            "unique_ratio": F.size(F.array_distinct("g_tokens")).cast("double") / F.greatest(n, F.lit(1)),
            "prompt_similarity": T.jaccard(F.col("g_set"), F.col("g_prompt")),
            "heading_similarity": T.jaccard(F.col("g_set"), F.col("g_heading")),
            "meta_ratio": F.size(F.filter("g_tokens", lambda t: t.isin(METALINGUISTIC_WORDS))).cast("double") / F.greatest(n, F.lit(1)),
        }
    )
    framing = (F.col("g_bare") == "") | (F.size(T.without(F.col("g_bare_tokens"), FRAMING_WORDS)) == 0)
    general = [
        F.when((n > 0) & (F.col("repetition") > 0.85), "high_repetition"),
        F.when(F.col("heading_similarity") > 0.85, "heading_echo"),
        F.when(F.col("prompt_similarity") > 0.85, "prompt_echo"),
        F.when(framing, "boilerplate_only"),
        F.when((n >= 5) & (F.col("unique_ratio") < 0.3), "low_unique_token_ratio"),
        F.when((n >= 8) & (F.col("meta_ratio") > 0.35), "circular_reasoning"),
    ]
    out = out.withColumn("g_general", F.filter(F.array(*general), lambda c: c.isNotNull()))
    content_size = F.when(F.col("g_bare") == "", n).otherwise(F.size("g_bare_tokens"))
    compares = reduce(lambda x, y: x | y, [F.lower(a).contains(m) for m in COMPARISON_MARKERS])
    own = (
        F.when((F.col(task) == "factual_explanation") & (content_size < 5), "insufficient_content_for_explanation")
        .when((F.col(task) == "comparison") & ~compares, "missing_comparison_dimension")
        .when((F.col(task) == "summarization") & (n > F.size(T.ascii_tokens(F.col(prompt))) * F.lit(1.2)), "summary_not_condensed")
    )
    disclaims = reduce(lambda x, y: x | y, [a.rlike("(?i)" + p) for p in DISCLAIMER_PATTERNS])
    codes = (
        F.when(a == "", F.array(F.lit("empty_answer")))
        .when(disclaims, F.array(F.lit("disclaimer_only")))
        .when((F.size("g_general") == 0) & own.isNotNull(), F.array(own))
        .otherwise(F.col("g_general"))
    )
    severity = F.create_map(*[F.lit(x) for pair in GAIN_SEVERITY.items() for x in pair])
    out = out.withColumn("gain_codes", codes)
    score = F.coalesce(F.array_min(F.transform("gain_codes", lambda c: F.coalesce(severity[c], F.lit(0.5)))), F.lit(1.0))
    return out.withColumn("gain_score", score).drop("g_tokens", "g_bare", "g_set", "g_prompt", "g_heading", "g_bare_tokens", "g_general")


def score_of(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in GAIN_SEVERITY.items() for x in pair])[code]
