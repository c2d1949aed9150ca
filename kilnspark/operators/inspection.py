"""What one looks at between stages: sources with their records, counts, estimates, run comparisons, histories, jobs to take, locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.operators.governance import classify, report_license, scan_personal_data
from kilnspark.operators.scan import BLOCK, blocks, scan
from kilnspark.operators.shared import Scratch

#: States of jobs that wait, and of jobs whose worker may have died.
WAITING, HELD = ["queued", "retry_wait"], ["leased", "running"]


def license_records(sources: DataFrame, key: str, declared: str, text: str, reviewer: str = "automatic-policy") -> DataFrame:
    """The licence record of each source: status, redistribution, reviewer, privacy class, and whether it may be released."""
    status = report_license(F.col(declared))
    rows = sources.select(key, F.col(declared).alias("declared_license"), status.alias("license_status"), classify(scan_personal_data(F.col(text))).alias("privacy"))
    allowed = F.col("license_status") == "allowed"
    return rows.select("*", F.when(allowed, "approved-for-redistribution").otherwise("undecided").alias("redistribution"), F.lit(reviewer).alias("reviewer"), (allowed & (F.col("privacy") != "high")).alias("approved_for_public_release"))


def with_records(sources: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Sources with their licence records; one without a record is in review, not scanned and not approved."""
    own = records.select(key, "license_status", "privacy", "approved_for_public_release")
    defaults = {"license_status": F.lit("review"), "privacy": F.lit("no_preflight_scan"), "approved_for_public_release": F.lit(False)}
    return sources.join(own, key, "left").withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def run_deltas(runs: DataFrame, pairs: DataFrame, key: str, *measures: str) -> DataFrame:
    """(a, b, delta_*) for each pair of runs (a, b): b's measures less a's, nulls counting as zero. A pair of an unknown run is left out."""
    for side in ("a", "b"):
        pairs = pairs.join(runs.select(F.col(key).alias(side), *[F.coalesce(F.col(m), F.lit(0)).alias(f"{m}_{side}") for m in measures]), side)
    return pairs.select("a", "b", *[(F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"delta_{m}") for m in measures])


def filtered_counts(df: DataFrame, by: str, **filters: Column) -> DataFrame:
    """All rows, and the rows of each named filter, by a column."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in filters.items()])


def flow_metrics(parsed: DataFrame, chunks: DataFrame, examples: DataFrame) -> DataFrame:
    """One row of rates, 0 where there are no rows: documents parsed (ok), chunks below a heading (heading_path), examples resolved (resolved)."""

    def rate(df: DataFrame, condition: Column, name: str) -> DataFrame:
        return df.agg(F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("int")), F.lit(0.0)).alias(name))

    parts = [rate(parsed, F.col("ok"), "parse_success_rate"), rate(chunks, F.size("heading_path") > 0, "chunk_heading_coverage"), rate(examples, F.col("resolved"), "lineage_resolution_rate")]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # three rows of one


def run_medians(runs: DataFrame, by: str, *measures: str) -> DataFrame:
    """The exact median of each measure over a group's runs."""
    return runs.groupBy(by).agg(*[F.median(m).alias(f"median_{m}") for m in measures])


def run_estimate(sources: DataFrame, project: str, size: str, *, paid: bool = False) -> DataFrame:
    """Sources, bytes and the tokens that a run over each project will take: four bytes a token in, a quarter of that out."""
    rows = sources.groupBy(project).agg(F.count("*").alias("source_count"), F.coalesce(F.sum(size), F.lit(0)).alias("source_bytes"))
    tokens = F.ceil(F.col("source_bytes") / 4)
    calls = F.col("source_count") if paid else F.lit(0).cast("long")
    return rows.select("*", tokens.alias("est_input_tokens"), F.floor(tokens / 4).alias("est_output_tokens"), calls.alias("paid_calls"))


def history(log: DataFrame, key: str, revision: str, state: str) -> DataFrame:
    """Each key's revisions in order: position from 1, and the state before (null for the first)."""
    order = [F.col(revision)]
    held = blocks(log, [key], order, Scratch(log.sparkSession), "history")
    return scan(held, [key], order, number="position", lags={"previous_state": F.col(state)}).drop(BLOCK)


def eligible(now: Column) -> Column:
    """A job that a worker may take: it waits, or the lease of its worker has run out or was never given."""
    over = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now)
    return F.col("state").isin(WAITING) | (F.col("state").isin(HELD) & over)


def next_jobs(jobs: DataFrame, queue: str, now: Column, *order: str) -> DataFrame:
    """The oldest eligible job of each queue: a minimum, so that no queue is sorted. Taking it is the caller's transaction."""
    columns = [c for c in jobs.columns if c not in order and c != queue]
    first = F.min(F.struct(*order, *columns)).alias("j")
    return jobs.where(eligible(now)).groupBy(queue).agg(first).select(queue, "j.*")


def preview(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """The first rows in an order; the limit is the caller's."""
    return df.orderBy(*order).limit(rows)


LOCATION = "struct<pages:array<int>,bboxes:array<struct<page:int,left:double,top:double,right:double,bottom:double,coord_origin:string,coord_system:string>>,element_refs:array<string>>"


def block_location(prov: Column, refs: Column) -> Column:
    """A block's location from its parser's provenance, array<struct<page_no:int,bbox:struct<l,t,r,b,coord_origin>>>, and references. Pages
    are sorted and distinct; 0 and null are no page. Without provenance all lists are empty: no page is made up."""
    page = lambda p: F.when(p["page_no"] != 0, p["page_no"])
    given = F.coalesce(prov, F.array().cast("array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>"))

    def box(p: Column) -> Column:
        sides = [p["bbox"][s].alias(name) for s, name in (("l", "left"), ("t", "top"), ("r", "right"), ("b", "bottom"))]
        origin = F.when(p["bbox"]["coord_origin"] != "", p["bbox"]["coord_origin"])
        return F.struct(page(p).alias("page"), *sides, F.coalesce(origin, F.lit("TOPLEFT")).alias("coord_origin"), F.lit("page").alias("coord_system"))

    pages = F.array_sort(F.array_distinct(F.filter(F.transform(given, page), lambda n: n.isNotNull())))
    boxes = F.transform(F.filter(given, lambda p: p["bbox"].isNotNull()), box)
    return F.struct(pages.alias("pages"), boxes.alias("bboxes"), F.coalesce(refs, F.array().cast("array<string>")).alias("element_refs")).cast(LOCATION)


def merged_locations(locations: Column) -> Column:
    """A chunk's location from those of its units (an array, in order): pages and references sorted and distinct, boxes one after another."""
    every = lambda name: F.flatten(F.transform(locations, lambda u: u[name]))
    return F.struct(F.array_sort(F.array_distinct(every("pages"))).alias("pages"), every("bboxes").alias("bboxes"), F.array_sort(F.array_distinct(every("element_refs"))).alias("element_refs"))


def verify_metadata(state: Column, verify: Column, codes: Column) -> Column:
    """An assessment as its example keeps it: the state of each dimension but the overall one, and the critical codes."""
    return F.struct(
        state.alias("verify_state"),
        F.map_filter(F.coalesce(verify, F.create_map().cast("map<string,string>")), lambda k, _: k != "overall").alias("per_dimension"),
        F.filter(codes, lambda c: c.startswith("critical_unverified")).alias("critical_unverified"),
        F.filter(codes, lambda c: c.startswith("critical_failed")).alias("critical_failed"),
    )


def structured_mode(supported: Column, prefer_native: Column) -> Column:
    """How structured output is asked for: the provider's JSON schema, constrained decoding, or JSON in the prompt."""
    return F.when(supported & prefer_native, "native_jsonschema").when(supported, "constrained_decoding").otherwise("json_in_prompt")
