"""Licences, personal data and the publication gate."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions.arrow import arrow_udf
from kilnspark.functions.text import strip
from kilnspark.functions.wordlists import INTAKE_LICENSES, REPORT_LICENSES


def intake_license(declared: Column) -> Column:
    """allowed, review, blocked or unknown of a declared licence at intake."""
    d = F.lower(strip(declared))
    open_ = d.startswith("public domain") | d.contains("cc0") | d.isin(INTAKE_LICENSES["allowed"])
    return F.when(declared.isNull() | (declared == "") | d.isin(INTAKE_LICENSES["unknown"]), "unknown").when(open_, "allowed").when(d.isin(INTAKE_LICENSES["blocked"]), "blocked").otherwise("review")


def report_license(declared: Column) -> Column:
    """The report's own, differing rule: any allowed name inside the text allows it, unless it is exactly a blocked one."""
    d = F.lower(strip(declared))
    inside = F.exists(F.array(*[F.lit(x) for x in REPORT_LICENSES["allowed"]]), lambda name: F.contains(d, name))
    return F.when(declared.isNull() | (declared == ""), "review").when(d.isin(REPORT_LICENSES["blocked"]), "blocked").when(d.isin(REPORT_LICENSES["allowed"]) | inside, "allowed").otherwise("review")


#: Patterns by kind, words that make a finding near them sure, kinds that are sure by themselves.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d[ -]?){13,19}\b",
    "phone": r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
CONTEXT = r"\b(email|phone|ssn|social security|credit card|card number|address|telephone|contact)\b"
SURE = ("email", "ssn", "credit_card")
FINDINGS = "array<struct<kind:string,snippet:string,confidence:string,position:int>>"
#: Wherever a pattern matches (in Python's sense of digits and spaces) this one does: each is cut to its core, without edges.
POSSIBLE = r"(?U)@|\d{3}-\d{2}-\d{4}|(?:\d[ -]?){13}|\d{3}\)?[-.\s\x1C-\x1F]?\d{3}[-.\s\x1C-\x1F]?\d{4}|(?:\d{1,3}\.){3}\d"
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
_NEARBY = re.compile(CONTEXT, re.IGNORECASE)


def luhn(digits: str) -> bool:
    """The Luhn checksum; only lengths 13, 15, 16 and 19 are checked, any other passes."""
    if len(digits) not in (13, 15, 16, 19):
        return True
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def find_personal_data(text: str | None) -> list[tuple[str, str, str, int]]:
    """(kind, snippet, confidence, position), kinds in their fixed order."""
    found = []
    for kind, pattern in _COMPILED.items():
        for m in pattern.finditer(text or ""):
            snippet = m.group().strip()
            if kind == "ipv4" and any(int(p) > 255 for p in snippet.split(".")):
                continue
            if kind == "credit_card" and not luhn("".join(c for c in snippet if c.isdigit())):
                continue
            sure = len(snippet) > 6 and (kind in SURE or _NEARBY.search(text[max(0, m.start() - 40) : m.end() + 40]))
            found.append((kind, snippet, "high" if sure else "medium", m.start()))
    return found


@arrow_udf(FINDINGS)
def _scan_candidates(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: [dict(zip(("kind", "snippet", "confidence", "position"), f, strict=True)) for f in find_personal_data(t)])


def scan_personal_data(text: Column) -> Column:
    """The findings of every text. Texts in which no kind is possible stay in the JVM: Python gets a null for them."""
    return _scan_candidates(F.when(text.rlike(POSSIBLE), text))


def native_counts(text: Column) -> dict[str, Column]:
    """Counts of the two kinds that need no check beyond their pattern."""
    return {f"n_{k}": F.regexp_count(text, F.lit(PATTERNS[k])) for k in ("email", "ssn")}


def classify(findings: Column) -> Column:
    """clean, low, moderate or high."""
    sure = F.size(F.filter(findings, lambda f: f["confidence"] == "high"))
    grave = F.exists(findings, lambda f: f["kind"].isin("ssn", "credit_card"))
    return F.when((sure >= 2) | grave, "high").when(sure == 1, "moderate").when(F.size(findings) > 0, "low").otherwise("clean")


def privacy(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, classification, high_confidence, kinds)."""
    out = documents.select(key, scan_personal_data(F.col(text)).alias("findings"))
    return out.select(key, classify(F.col("findings")).alias("classification"), F.size(F.filter("findings", lambda f: f["confidence"] == "high")).alias("high_confidence"), F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["kind"]))).alias("kinds"))


def privacy_report(classified: DataFrame) -> DataFrame:
    """One row: documents, findings of high confidence, the kinds seen (sorted; there are five), how many documents are blocked."""
    kinds = classified.select(F.explode_outer("kinds").alias("kind")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    rows = classified.agg(F.count("*").alias("classified_documents"), F.coalesce(F.sum("high_confidence"), F.lit(0)).cast("long").alias("high_confidence_total"), F.count_if(F.col("classification") == "high").alias("n_blocked"))
    return rows.crossJoin(kinds)


def privacy_blocked(classified: DataFrame, key: str) -> DataFrame:
    """The documents that the report blocks, as rows."""
    return classified.where(F.col("classification") == "high").select(key)


def license_summary(statuses: DataFrame) -> DataFrame:
    """One row: counts and the status that governs (blocked, then review, else allowed)."""
    n = {s: F.count_if(F.col("license_status") == s) for s in ("allowed", "review", "blocked")}
    governs = F.when(n["blocked"] > 0, "blocked").when(n["review"] > 0, "review").otherwise("allowed")
    return statuses.agg(governs.alias("status"), F.count("*").alias("count"), *[c.alias(s) for s, c in n.items()])


def publication_gate(sources: DataFrame) -> DataFrame:
    """One row from license_status and classification of each source: allowed, unresolved, status, reason."""
    approved = (F.col("license_status") == "allowed") & (F.col("classification") != "high")
    rows = sources.agg(F.count_if(~approved).alias("unresolved"), *[F.count_if(F.col("license_status") == s).alias(s) for s in ("review", "blocked")])
    status = F.when(F.col("blocked") > 0, "blocked").when(F.col("review") > 0, "review").otherwise("allowed")
    reason = (
        F.when((status == "allowed") & (F.col("unresolved") == 0), "all sources approved for redistribution, no blocked or high-confidence-PII source")
        .when(F.col("blocked") > 0, F.concat("blocked", F.lit(" source(s) license-blocked")))
        .when(F.col("review") > 0, F.concat("review", F.lit(" source(s) pending license/redistribution review")))
        .otherwise(F.concat("unresolved", F.lit(" source(s) not approved for public release")))
    )
    return rows.select(((status == "allowed") & (F.col("unresolved") == 0)).alias("allowed"), "unresolved", status.alias("status"), reason.alias("reason"))
