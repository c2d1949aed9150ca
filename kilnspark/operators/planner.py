"""Generation plans: Hamilton apportionment over topology, family and difficulty; round-robin; top-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Default weights.
TOPOLOGY = {"sft": 0.6, "preference": 0.2, "kto": 0.1, "evaluation": 0.1}
DIFFICULTY = {"basic": 0.3, "intermediate": 0.5, "advanced": 0.2}


def _shares(weights: dict[str, float]) -> list[tuple[int, str, float]]:
    total = sum(weights.values()) or 1.0
    return [(i, k, v / total) for i, (k, v) in enumerate(weights.items())]


def allocate(spark: SparkSession, families: dict[str, float], total: int, *, topology: dict[str, float] | None = None, difficulty: dict[str, float] | None = None, maximum: int | None = None) -> DataFrame:
    """(ix, topology, task_family, difficulty, per_chunk): whole counts that sum to the total, largest remainders first.

    The plan has one row for each combination of three short weight lists, made in the driver, so it never grows with the data."""
    total = min(total, maximum) if maximum is not None else total
    levels = _shares(difficulty or DIFFICULTY)
    cells = [
        ((i * len(families) + j) * len(levels) + k, t, f, d, a * b * c)
        for i, t, a in _shares(topology or TOPOLOGY) for j, f, b in _shares(families) for k, d, c in levels if a * b * c > 0
    ]
    cells = spark.createDataFrame(cells, "ix int, topology string, task_family string, difficulty string, weight double").coalesce(1)
    cells = cells.withColumn("exact", F.lit(total) * F.col("weight")).withColumn("whole", F.floor("exact"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("whole")), F.desc("weight"), "ix"))
    left = F.lit(total) - F.sum("whole").over(Window.partitionBy())
    return cells.withColumn("per_chunk", F.col("whole") + (rank <= left).cast("int")).where("per_chunk > 0").select("ix", "topology", "task_family", "difficulty", F.col("per_chunk").cast("int"))


def round_robin(specs: DataFrame, chunks: DataFrame, ordinal: str, chunk_count: int) -> DataFrame:
    """One row for each planned example: specs in turn over the chunks, each spec from the first chunk on.

    The planned examples are a range of numbers, cut into tasks like any range; a running sum over the specs (a plan's few rows, in
    the driver) says whose a number is."""
    rows = specs.collect()
    starts, total = [], 0
    for r in rows:
        starts.append(total)
        total += r["per_chunk"]
    at = sum(((F.col("id") >= F.lit(a)).cast("int") for a in starts), F.lit(0))
    first = F.get(F.array(*[F.lit(a).cast("long") for a in starts]), at - 1) if starts else F.lit(0).cast("long")
    slots = specs.sparkSession.range(total).select(at.alias("__spec"), (F.col("id") - first).alias("slot"))
    named = specs.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], f"__spec int, {specs.schema.simpleString()[7:-1].replace(':', ' ')}")
    dealt = slots.join(F.broadcast(named), "__spec").drop("__spec").withColumn(ordinal, F.col("slot") % chunk_count)
    return dealt.join(chunks, ordinal)


def top_up(specs: DataFrame, *, target: int, validated: int, planned: int, maximum: int | None = None) -> DataFrame:
    """Additional examples for each spec: the shortfall (within the room under the maximum) shared by the specs' counts, half to even."""
    short = max(0, target - validated)
    more = min(short, max(0, maximum - planned)) if maximum is not None else short
    share = F.bround(F.lit(float(more)) * (F.col("per_chunk") / F.sum("per_chunk").over(Window.partitionBy())))
    return specs.withColumn("additional", share.cast("int")).where("additional > 0").select("ix", "topology", "task_family", "difficulty", "additional")
