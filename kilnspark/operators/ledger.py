"""Cost ledgers, budgets, event sequences, rate limits and job states over event tables.

What runs along a job or a principal is a blocked scan: one job may hold any share of the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions.wordlists import JOB_TRANSITIONS
from kilnspark.operators.scan import BLOCK, blocks, scan
from kilnspark.operators.shared import Scratch


def call_cost(input_tokens: Column, cached: Column, output_tokens: Column, *, price_in: float, price_out: float, price_cached: float | None = None) -> Column:
    """US dollars of a call, in whole millionths (a long), so that sums do not depend on their order."""
    i, c, o = (F.greatest(F.lit(0), x) for x in (input_tokens, cached, output_tokens))
    fresh = i * F.lit(price_in) if price_cached is None else c * F.lit(price_cached) + (i - c) * F.lit(price_in)
    return F.round(fresh + o * F.lit(price_out)).cast("long")


def _along(rows: DataFrame, key: list[str], order: list[str], **what) -> DataFrame:
    """`scan` over the rows in blocks of their own."""
    columns = [F.col(c) for c in order]
    return scan(blocks(rows, key, columns, Scratch(rows.sparkSession), "ledger"), key, columns, **what).drop(BLOCK)


USAGE = "struct<input_tokens:long,cached_input_tokens:long,output_tokens:long,prompt_tokens_details:struct<cached_tokens:long>>"


def ledger_entry(usage: Column, *, price_in: float = 0.0, price_out: float = 0.0, price_cached: float | None = None) -> Column:
    """struct(input_tokens, cached_input_tokens, output_tokens, cost_micro) of a provider's usage (JSON text): missing counts are 0, and cached
    tokens are taken from either of the two places in which providers tell them. Prices are for a million tokens."""
    told = F.from_json(usage, USAGE)
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    given, nested = count(told["cached_input_tokens"]), count(told["prompt_tokens_details"]["cached_tokens"])
    i, c, o = count(told["input_tokens"]), F.when(given != 0, given).otherwise(nested), count(told["output_tokens"])
    return F.struct(i.alias("input_tokens"), c.alias("cached_input_tokens"), o.alias("output_tokens"), call_cost(i, c, o, price_in=price_in, price_out=price_out, price_cached=price_cached).alias("cost_micro"))


def budget_state(events: DataFrame, job: str, order: list[str], cost: str, limit: int) -> DataFrame:
    """Adds spent (running, in each job) and over (the limit is reached)."""
    return _along(events, [job], order, sums={"spent": F.col(cost)}).withColumn("over", F.col("spent") >= limit)


def first_over(state: DataFrame, job: str, order: str) -> DataFrame:
    """The event of each job at which its budget is reached first."""
    return state.where("over").groupBy(job).agg(F.min(order).alias("paused_at"), F.min("spent").alias("spent"))


def next_sequence(existing: DataFrame, new: DataFrame, job: str, order: list[str]) -> DataFrame:
    """New events with sequence numbers that go on after each job's largest."""
    last = existing.groupBy(job).agg(F.max("sequence").alias("__last"))
    return _along(new, [job], order, number="__n").join(last, job, "left").withColumn("sequence", F.coalesce("__last", F.lit(0)) + F.col("__n")).drop("__last", "__n")


def sliding_count(events: DataFrame, principal: str, seconds: Column, window: int) -> DataFrame:
    """Adds in_window: the principal's events in the last `window` seconds, this one included, one exactly that old not; those without a time
    count one another.

    Events are counted by second; each second adds its count when it comes and takes it away when it has gone, so the count is a running sum."""
    timed = events.withColumn("__s", seconds.cast("long"))
    counts = timed.groupBy(principal, "__s").agg(F.count("*").alias("__n"))
    gone = counts.select(principal, (F.col("__s") + window).alias("__s"), (-F.col("__n")).alias("__n"))
    moves = counts.unionByName(gone).where("__s is not null").groupBy(principal, "__s").agg(F.sum("__n").alias("__n"))
    running = _along(moves, [principal], ["__s"], sums={"in_window": F.col("__n")}).drop("__n")
    every = running.unionByName(counts.where("__s is null").withColumnRenamed("__n", "in_window")).select(F.col(principal).alias("__p"), F.col("__s").alias("__t"), "in_window")
    met = timed.join(every, F.col(principal).eqNullSafe(F.col("__p")) & F.col("__s").eqNullSafe(F.col("__t")))
    return met.drop("__p", "__s", "__t")


def invalid_transitions(states: DataFrame, job: str, order: list[str], state: str) -> DataFrame:
    """State changes that the job machine does not allow."""
    allowed = F.create_map(*[x for k, v in JOB_TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    moved = _along(states, [job], order, lags={"from_state": F.col(state)}).where("from_state is not null")
    return moved.where(~F.coalesce(F.array_contains(allowed[F.col("from_state")], F.col(state)), F.lit(False)))


def backoff_cap(attempt: Column, *, base: float = 1.0, multiplier: float = 2.0, most: float = 60.0) -> Column:
    """The upper end of the jittered delay before a retry."""
    return F.least(F.lit(base) * F.pow(F.lit(multiplier), F.greatest(attempt, F.lit(0))), F.lit(most))


def failure_class(name: Column) -> Column:
    low = F.lower(name)
    short = low.contains("timeout") | low.contains("ratelimit") | low.contains("rate_limit") | low.contains("connection")
    return F.when(low == "budgetexceedederror", "budget_exhausted").when(low == "policyblockerror", "policy_block").when(low == "providererror", "provider").when(short, "transient").otherwise("worker_failure")


#: Limits in the order in which they are looked at, and what each is compared with.
LIMITS = ("cost", "calls", "input_tokens", "output_tokens")


def budget_checks(calls: DataFrame, job: str, order: list[str], limits: dict[str, int], *, per_model: dict[str, int] | None = None, per_stage: dict[str, int] | None = None) -> DataFrame:
    """Adds the running spent_* of each job (cost in millionths, calls, tokens; cost by model and by stage too) and exceeded: the first limit
    that is reached after the call, or null. Limits are inclusive; those that are not given do not count."""
    spent = {f"spent_{c}": F.lit(1).cast("long") if c == "calls" else F.col("cost_micro" if c == "cost" else c) for c in LIMITS}
    out = _along(calls, [job], order, sums=spent)
    checks = [F.when(F.col(f"spent_{c}") >= limits[c], c) for c in LIMITS if c in limits]
    for name, caps in (("model", per_model), ("stage", per_stage)):
        if caps:
            cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
            out = _along(out, [job, name], order, sums={f"spent_{name}": F.col("cost_micro")})
            checks.append(F.when(F.col(f"spent_{name}") >= cap[F.col(name)], f"{name}_cost"))
    return out.withColumn("exceeded", F.coalesce(*checks) if checks else F.lit(None).cast("string"))


def job_estimate(tokens_in: Column, tokens_out: Column, calls: Column, *, price_in: float, price_out: float) -> Column:
    """US dollars of a job by prices for a million tokens, to six places."""
    one = tokens_in / F.lit(1_000_000) * F.lit(price_in) + tokens_out / F.lit(1_000_000) * F.lit(price_out)
    return F.round(one * calls, 6)
