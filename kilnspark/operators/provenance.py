"""Span precision, provenance checks, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions.wordlists import SPAN_PRECISIONS


def precision() -> Column:
    """What a span's own columns support: page_number, bounding_boxes, page_start, page_end, section_path, quoted_text, element_reference."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return (
        F.when(F.col("page_number").isNotNull() & (F.coalesce(F.size("bounding_boxes"), F.lit(0)) > 0), "exact_bbox")
        .when(F.col("page_number").isNotNull(), "exact_page")
        .when(F.col("page_start").isNotNull() & F.col("page_end").isNotNull(), "page_range")
        .when(filled("section_path"), "section")
        .when(filled("quoted_text") | filled("element_reference"), "chunk")
        .otherwise("unknown")
    )


def at_least(actual: Column, claimed: Column) -> Column:
    order = F.create_map(*[F.lit(x) for i, p in enumerate(SPAN_PRECISIONS) for x in (p, len(SPAN_PRECISIONS) - 1 - i)])
    return F.coalesce(order[actual], F.lit(0)) >= F.coalesce(order[claimed], F.lit(0))


def precision_histogram(spans: DataFrame) -> DataFrame:
    """Counts of every precision, zeros included."""
    domain = spans.sparkSession.createDataFrame([(p,) for p in SPAN_PRECISIONS], "precision string")
    return F.broadcast(domain).join(spans.groupBy("precision").agg(F.count("*").alias("n")), "precision", "left").select("precision", F.coalesce("n", F.lit(0)).alias("n"))


def missing_minimum(require_evidence: bool = True) -> Column:
    """What an example lacks to be traceable, in order."""
    marks = [
        F.when(F.size("source_document_ids") == 0, "source_document_ids"),
        F.when(F.lit(require_evidence) & (F.size("source_span_ids") == 0), "source_span_ids"),
        F.when(F.coalesce("content_hash", F.lit("")) == "", "content_hash"),
        F.when(F.size("generation_candidate_ids") == 0, "generation_candidate_ids"),
        F.when(~F.coalesce(F.col("quality_status").isin("accepted", "review"), F.lit(False)), "quality_status_not_reviewable"),
    ]
    return F.filter(F.array(*marks), lambda m: m.isNotNull())


def hash_mismatches(examples: DataFrame, content_hash: Column) -> DataFrame:
    """(example_id, violation, reference) of examples whose stored content_hash is not the one recomputed from their contents."""
    changed = examples.where(~F.col("content_hash").eqNullSafe(content_hash))
    return changed.select("example_id", F.lit("content_hash_mismatch").alias("violation"), F.col("content_hash").alias("reference"))


def violations(examples: DataFrame, sources: DataFrame, spans: DataFrame, candidates: DataFrame) -> DataFrame:
    """(example_id, violation, reference) for every broken link; empty (with `hash_mismatches` empty too) means that the export may go on.

    sources: source_document_id, project_id. spans: span_id, source_document_id. candidates: candidate_id, project_id."""

    def cited(column: str) -> DataFrame:
        return examples.select("example_id", "project_id", "source_document_ids", F.explode(column).alias("reference"))

    empty = examples.select("example_id", F.explode(F.filter(F.array(*[F.when(F.size(c) == 0, F.concat(F.lit("empty:"), F.lit(c))) for c in ("source_document_ids", "source_span_ids", "generation_candidate_ids")]), lambda m: m.isNotNull())).alias("violation"), F.lit(None).cast("string").alias("reference"))
    docs = cited("source_document_ids").join(sources.select(F.col("source_document_id").alias("reference"), F.col("project_id").alias("owner")), "reference", "left")
    docs = docs.withColumn("violation", F.when(F.col("owner").isNull(), "unresolvable_source").when(F.col("owner") != F.col("project_id"), "cross_project_source"))
    span = cited("source_span_ids").join(spans.select(F.col("span_id").alias("reference"), F.col("source_document_id").alias("owner")), "reference", "left")
    span = span.withColumn("violation", F.when(F.col("owner").isNull(), "unresolvable_span").when(~F.array_contains("source_document_ids", F.col("owner")), "span_outside_cited_sources"))
    made = cited("generation_candidate_ids").join(candidates.select(F.col("candidate_id").alias("reference"), F.col("project_id").alias("owner")), "reference", "left")
    made = made.withColumn("violation", F.when(F.col("owner").isNull() | (F.col("owner") != F.col("project_id")), "unresolvable_candidate"))
    broken = [d.where("violation is not null").select("example_id", "violation", "reference") for d in (docs, span, made)]
    return empty.unionByName(broken[0]).unionByName(broken[1]).unionByName(broken[2])


def lineage(examples: DataFrame, spans: DataFrame) -> DataFrame:
    """(example_id, n_cited, n_resolved): how much of each example's evidence resolves."""
    cited = examples.select("example_id", F.explode("source_span_ids").alias("span_id")).join(spans.select("span_id", F.lit(1).alias("hit")), "span_id", "left")
    return cited.groupBy("example_id").agg(F.count("*").alias("n_cited"), F.count("hit").alias("n_resolved"))
