"""Quality reports and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_report(assessments: DataFrame) -> DataFrame:
    """All sub-reports in one pass: (section, name, status) counts with scores in thousandths, by grouping sets.

    Sections: status (all rows), validator (without `overall`), topology, overall."""
    milli = F.round(F.col("score") * 1000).cast("long")
    keyed = assessments.select("validator_name", "status", F.coalesce("topology", F.lit("unknown")).alias("topology"), milli.alias("milli"))
    sets = keyed.groupingSets([["status"], ["validator_name"], ["validator_name", "status"], ["topology"], ["topology", "status"], []], "validator_name", "status", "topology").agg(
        F.count("*").alias("n"), F.sum("milli").alias("milli_sum"), F.grouping_id().alias("g")
    )
    section = F.when(F.col("g") == 7, "total").when(F.col("g") == 5, "status").when(F.col("g").isin(2 + 1, 1), "validator").otherwise("topology")
    return sets.select(section.alias("section"), F.coalesce("validator_name", "topology", F.lit("all")).alias("name"), F.coalesce("status", F.lit("all")).alias("status"), "n", "milli_sum")


def acceptance(assessments: DataFrame) -> DataFrame:
    """One row: totals, accepted, acceptance_rate, mean of the overall scores."""
    return assessments.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        (F.count_if(F.col("status") == "accepted").cast("double") / F.greatest(F.count("*"), F.lit(1))).alias("acceptance_rate"),
        F.count_if(F.col("validator_name") == "overall").alias("n_overall"),
    )


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a rate; 0 and 0 for no trials."""
    p = hits.cast("double") / F.nullif(n, F.lit(0))
    width = 1 + z * z / F.nullif(n, F.lit(0))
    centre = p + z * z / (2 * F.nullif(n, F.lit(0)))
    spread = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + z * z / (4 * F.nullif(n, F.lit(0)) * F.nullif(n, F.lit(0))))
    return F.coalesce(F.greatest(F.lit(0.0), (centre - spread) / width), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), (centre + spread) / width), F.lit(0.0))
