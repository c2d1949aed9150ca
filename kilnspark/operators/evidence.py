"""Cited evidence: one join of examples with spans that all validators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_evidence(examples: DataFrame, spans: DataFrame, key: str = "example_id") -> DataFrame:
    """Adds evidence_text (cited spans' texts in citation order, joined by blanks) and unresolved (cited ids without a span).

    spans: span_id, span_text. Examples without citations have the empty text and 0."""
    cited = examples.select(key, F.posexplode("source_span_ids").alias("pos", "span_id"))
    found = cited.join(spans.select("span_id", "span_text"), "span_id", "left")
    per = found.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("span_text").isNotNull(), F.struct("pos", "span_text")))), lambda s: s["span_text"]), " ").alias("evidence_text"),
        F.count_if(F.col("span_text").isNull()).cast("int").alias("unresolved"),
    )
    return examples.join(per, key, "left").fillna({"evidence_text": "", "unresolved": 0})
