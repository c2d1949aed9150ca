"""The curation flow as one lazy plan: documents to chunks, split, generated examples, validated decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.functions import claims
from kilnspark.functions.text import content_handle
from kilnspark.operators import blocks, examples, report, split, validators

DIMENSIONS = [*validators.NATIVE, "semantic_consistency"]


def chunk_spans(documents: DataFrame) -> DataFrame:
    """(span_id, source_id, group_key, split, text): one span for each chunk; the group's split is propagated, never drawn again."""
    grouped = split.grouped_random(documents.select("doc_id", "text", F.col("source").alias("group_key")), F.col("group_key"))
    cut = blocks.chunks(grouped, "doc_id", "text", carry=("group_key", "split")).withColumnRenamed("main_text", "text")
    handle = content_handle("sp", F.col("doc_id").cast("string"), F.col("ordinal").cast("string"), F.col("text"))
    return cut.select(handle.alias("span_id"), F.concat(F.lit("doc_"), "doc_id").alias("source_id"), "group_key", "split", "text")


def validate(rows: DataFrame) -> DataFrame:
    """Decisions over examples that have evidence_text and unresolved."""
    ready = validators.assess(validators.prepare(rows))
    ready = ready.withColumn("verified_claims", claims.verify_claims(F.col("answer"), F.col("evidence_text")))
    score, codes = claims.consistency(F.col("answer"), F.col("evidence_text"), F.col("verified_claims"))
    return validators.decide(ready.withColumn("semantic_consistency_score", score).withColumn("semantic_consistency_codes", codes), DIMENSIONS)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = chunk_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    turn = F.pmod(F.xxhash64("span_id"), F.lit(4)).cast("int")
    planned = spans.withColumn("topology", F.get(F.array(*[F.lit(t) for t in examples.TOPOLOGIES]), turn)).withColumn("task_family", F.lit("factual_explanation")).withColumn("difficulty", F.lit("intermediate"))
    # a generated example cites just the span that it was made from, so its evidence is carried along: the flow needs no shuffle
    return validate(examples.generate(planned, F.col("text").alias("evidence_text"), F.lit(0).alias("unresolved"), F.col("split")))


def curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, topology, status, overall_score, reasons) of every generated example; none is dropped."""
    return decisions(spark, sf_dir).select("example_id", "topology", "status", "overall_score", F.array_join("reason_codes", ",").alias("reasons"))


def curation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.quality_report(validators.long_form(decisions(spark, sf_dir), DIMENSIONS).where("validator_name <> 'overall'"))
