"""The corpus pipeline: quality classifier, toxicity, SimHash near-dedup, secret scans, best-fit packing over `documents`.

Each stage gets what its predecessor kept, written as Parquet and read again. All but the last return the columns of
`documents`; the last returns the packed pieces. A result has no more partitions than a table should have files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kilnspark.llm import neardup, packing, quality, secrets, toxicity
from kilnspark.llm.common import few_files, materialize, pick, text_or_empty


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a quality score of 0.3 or more."""
    model = quality.train(pick(docs, doc_id="long", text="string"), _labels(spark, sf_dir))
    return few_files(docs.where(quality.scorer(model)(text_or_empty().cast("string")) >= quality.THRESHOLD))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a toxicity score below 0.5."""
    model = toxicity.train(pick(docs, doc_id="long", text="string"), _labels(spark, sf_dir))
    return few_files(docs.where(toxicity.scorer(model)(text_or_empty().cast("string")) < 0.5))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more)."""
    return few_files(neardup.keep_one(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with secrets masked."""
    return few_files(secrets.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return few_files(packing.packing_report(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Trained models and tokenizers can't be expressed in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
