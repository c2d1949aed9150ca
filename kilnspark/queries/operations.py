"""Queries over events, labels, orders and plans: ledgers, budgets, job states, revisions, versions, pages, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.functions.wordlists import JOB_TRANSITIONS
from kilnspark.operators import ledger, lifecycle, planner, report, split
from kilnspark.queries.common import longs, sql_hash_ratio, sql_list, sql_split_case, table
from kilnspark.sources import sinks
from kilnspark.streaming import events as stream


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a job (the user): tokens and cost from their value."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    tokens = F.floor(F.col("value") * 10).cast("long")
    cached = F.floor(tokens / 4).cast("long")
    rows = rows.withColumns({"input_tokens": tokens, "cached_tokens": cached, "output_tokens": F.floor(tokens / 2).cast("long")})
    return rows.withColumn("cost_micro", ledger.call_cost(F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens"), price_in=3.0, price_out=15.0, price_cached=0.5))


SQL_EVENTS = """c0 AS (SELECT event_id, ts, user_id, event_type, floor(value * 10)::BIGINT AS input_tokens FROM events),
    c1 AS (SELECT *, input_tokens // 4 AS cached_tokens, input_tokens // 2 AS output_tokens FROM c0),
    c AS (SELECT *, round(cached_tokens * 0.5::DOUBLE + (input_tokens - cached_tokens) * 3.0::DOUBLE + output_tokens * 15.0::DOUBLE)::BIGINT AS cost_micro FROM c1)"""


def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "input_tokens", "cached_tokens", "output_tokens", "cost_micro")


def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger entries of usages as different providers tell them: cached tokens in either place or none, and nothing at all."""
    rows, k = _events(spark, sf_dir), F.col("event_id") % 5
    parts = [F.concat(F.lit('"input_tokens": '), "input_tokens"), F.concat(F.lit('"output_tokens": '), "output_tokens")]
    cached = F.when(k == 1, F.concat(F.lit('"cached_input_tokens": '), "cached_tokens")).when(k == 2, F.concat(F.lit('"prompt_tokens_details": {"cached_tokens": '), "cached_tokens", F.lit("}")))
    usage = F.when(k == 4, F.lit(None).cast("string")).otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *parts, cached), F.lit("}")))
    return rows.select("event_id", ledger.ledger_entry(usage, price_in=3.0, price_out=15.0, price_cached=0.5).alias("e")).select("event_id", "e.*")


def ledger_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost_micro"), F.lit(0)).alias("cost_micro"), F.sum("input_tokens").alias("input_tokens"))


def budget_running_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = ledger.budget_state(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "cost_micro", 400_000)
    return state.select("event_id", "user_id", "spent", "over")


def budget_first_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = ledger.budget_state(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "cost_micro", 400_000)
    return ledger.first_over(state, "user_id", "ts").select("user_id", F.date_format("paused_at", "yyyy-MM-dd HH:mm:ss").alias("paused_at"), "spent")


def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the second half of the month go on numbering after those of the first."""
    rows = _events(spark, sf_dir)
    early = rows.where("ts < timestamp_ntz'2024-01-16 00:00:00'")
    first = ledger.next_sequence(early.limit(0).select("user_id", F.lit(0).alias("sequence")), early, "user_id", ["ts", "event_id"])
    late = ledger.next_sequence(first, rows.where("ts >= timestamp_ntz'2024-01-16 00:00:00'"), "user_id", ["ts", "event_id"])
    return longs(first.unionByName(late).select("event_id", "user_id", "sequence"))


def rate_limit_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return ledger.sliding_count(rows, "user_id", F.unix_seconds(F.col("ts").cast("timestamp")), 3600 * 6).select("event_id", "user_id", "in_window")


STATES = list(JOB_TRANSITIONS)


def _state() -> Column:
    return F.get(F.array(*[F.lit(s) for s in STATES]), (F.col("event_id") * 7 % 10).cast("int"))


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", _state().alias("state"))
    return ledger.invalid_transitions(rows, "user_id", ["ts", "event_id"], "state").select("event_id", "user_id", "from_state", "state")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("name"), F.col("input_tokens").alias("value"))
    return sinks.metrics_text(rows)


def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of 50 after a cursor: the limit is the feature."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return rows.where("event_id > 1000").orderBy("event_id").limit(51)


def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream.rate_windows(table(spark, sf_dir, "events"), every="1 day")
    return rows.select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream.sessions(table(spark, sf_dir, "events"), gap="6 hours")
    return rows.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as review decisions: two revisions of each example, the second decided by the labels."""
    rows = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    decision = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "approve").otherwise("needs_work")
    return rows.select("doc_id", F.concat(F.lit("ex_"), "doc_id").alias("example_id"), decision.alias("decision"))


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision 1 of every example, and 2 of every third."""
    rows = _labels(spark, sf_dir)
    return rows.select("example_id", F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("revision_id"), lifecycle.review_state(F.col("decision")).alias("review_state"))


def revisions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(lifecycle.latest(_revisions(spark, sf_dir), "example_id", [F.col("revision_id")]).select("example_id", "revision_id", "review_state"))


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    reviews = _labels(spark, sf_dir).select("example_id", F.lit(1).alias("base_revision"), "decision")
    return lifecycle.apply_reviews(_revisions(spark, sf_dir), reviews)


def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of a project (the customer)."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("created_at"))
    chain = lifecycle.version_chain(rows, "project_id", ["created_at", "version_id"])
    return longs(chain.select("project_id", "version_id", F.coalesce("parent_version_id", F.lit(-1)).alias("parent_version_id"), "version_no"))


def accepted_page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of 25 accepted examples below a cursor: the limit is the feature."""
    rows = _labels(spark, sf_dir).where("decision = 'approve'").select("doc_id", "example_id")
    return lifecycle.keyset_page(rows, "doc_id", 500, 25)


def wilson_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a plain rule (text of 200 characters or more) takes a document for good, against the quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") >= 200).alias("taken"))
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")
    n = rows.agg(
        F.count_if((F.col("quality") == 0) & F.col("taken")).alias("false_accepts"), F.count_if(F.col("quality") == 0).alias("negatives"),
        F.count_if((F.col("quality") == 1) & ~F.col("taken")).alias("false_rejects"), F.count_if(F.col("quality") == 1).alias("positives"),
    )
    low, high = report.wilson(F.col("false_accepts"), F.col("negatives"))
    return n.select("*", F.round(low, 9).alias("accept_low"), F.round(high, 9).alias("accept_high"))


FAMILIES = {"factual_explanation": 0.5, "procedure": 0.3, "comparison": 0.2}


def plan_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(planner.allocate(spark, FAMILIES, table(spark, sf_dir, "documents").count()))


def plan_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each planned example with the document that it is generated from; the plan holds as many examples as there are documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = docs.count()
    ordinals = split.with_position(docs, [F.col("doc_id")], F.floor(F.col("doc_id") / 4096), "ordinal", F.floor(F.col("doc_id") / (1 << 24)))
    plan = planner.round_robin(planner.allocate(spark, FAMILIES, n), ordinals, "ordinal", n)
    return longs(plan.select("topology", "task_family", "difficulty", "slot", "doc_id"))


def plan_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").count()
    return longs(planner.top_up(planner.allocate(spark, FAMILIES, n), target=2 * n, validated=n // 2, planned=n, maximum=2 * n))


def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of documents as a corpus of its own: split counts by document and the gate's verdict."""
    rows = split.grouped_random(table(spark, sf_dir, "documents").select("doc_id", "source"), F.col("doc_id").cast("string"))
    per = rows.groupBy("source").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")])
    gate = split.release_gate(F.col("train"), F.col("validation"), F.col("test"), F.lit(1), F.lit(False))
    return per.withColumn("g", gate).select("source", "train", "validation", "test", "g.ok", "g.gate", F.array_join(split.small_corpus_splits(F.col("train")), ",").alias("small_corpus"))


def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 9).alias("attempt"), "event_type")
    return rows.select("event_id", ledger.backoff_cap(F.col("attempt")).alias("delay_cap"), ledger.failure_class(F.col("event_type")).alias("failure"))


QUERIES = {
    "call_costs": call_costs,
    "ledger_cost": ledger_cost,
    "usage_ledger": usage_ledger,
    "budget_running_cut": budget_running_cut,
    "budget_first_over": budget_first_over,
    "event_sequence": event_sequence,
    "rate_limit_sliding": rate_limit_sliding,
    "job_transitions": job_transitions,
    "metrics_text": metrics,
    "event_page": event_page,
    "rate_windows": rate_windows,
    "sessions": sessions,
    "revisions_latest": revisions_latest,
    "review_revisions": lambda s, d: longs(_reviews(s, d)[0]),
    "review_conflicts": lambda s, d: longs(_reviews(s, d)[1]),
    "version_chain": version_chain,
    "accepted_page_keyset": accepted_page_keyset,
    "wilson_rates": wilson_rates,
    "plan_allocation": plan_allocation,
    "plan_round_robin": plan_round_robin,
    "plan_top_up": plan_top_up,
    "release_gate": release_gate,
    "retry_backoff": backoff,
}

_LABELS = "l AS (SELECT doc_id, 'ex_' || doc_id AS example_id, CASE WHEN max(toxic) = 1 THEN 'reject' WHEN max(quality) = 1 THEN 'approve' ELSE 'needs_work' END AS decision FROM labels GROUP BY 1)"
_REVIEW_STATE = "CASE decision WHEN 'approve' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'review' END"
_RUNNING = f"WITH {SQL_EVENTS}, r AS (SELECT event_id, ts, user_id, sum(cost_micro) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM c)"
_STATE = f"({sql_list(STATES)})[event_id * 7 % 10 + 1]"
_ALLOWED = " OR ".join(f"(p = '{k}' AND state IN ({', '.join(repr(s) for s in v)}))" for k, v in JOB_TRANSITIONS.items() if v)


def _weights(name: str, weights: dict[str, float]) -> str:
    total = sum(weights.values())
    return f"{name}(i, k, w) AS (VALUES " + ", ".join(f"({i}, '{k}', {v!r}::DOUBLE / {total!r}::DOUBLE)" for i, (k, v) in enumerate(weights.items())) + ")"


_PLAN = f"""WITH {_weights('t', planner.TOPOLOGY)}, {_weights('f', FAMILIES)}, {_weights('d', planner.DIFFICULTY)}, n AS (SELECT count(*) AS n FROM documents),
    x AS (SELECT ((t.i * 3 + f.i) * 3 + d.i)::BIGINT AS ix, t.k AS topology, f.k AS task_family, d.k AS difficulty, t.w * f.w * d.w AS weight, n.n AS total, n.n * (t.w * f.w * d.w) AS exact FROM t, f, d, n),
    y AS (SELECT *, floor(exact)::BIGINT AS whole, row_number() OVER (ORDER BY exact - floor(exact) DESC, weight DESC, ix) AS r, total - sum(floor(exact)) OVER () AS spare FROM x),
    plan AS (SELECT ix, topology, task_family, difficulty, whole + CASE WHEN r <= spare THEN 1 ELSE 0 END AS per_chunk, total FROM y WHERE whole + CASE WHEN r <= spare THEN 1 ELSE 0 END > 0)"""

ORACLES = {
    "call_costs": f"WITH {SQL_EVENTS} SELECT event_id, input_tokens, cached_tokens, output_tokens, cost_micro FROM c",
    "usage_ledger": f"""WITH {SQL_EVENTS}, u AS (SELECT event_id, CASE event_id % 5 WHEN 4 THEN 0 ELSE input_tokens END AS i, CASE WHEN event_id % 5 IN (1, 2) THEN cached_tokens ELSE 0 END AS k, CASE event_id % 5 WHEN 4 THEN 0 ELSE output_tokens END AS o FROM c)
        SELECT event_id, i AS input_tokens, k AS cached_input_tokens, o AS output_tokens, round(k * 0.5::DOUBLE + (i - k) * 3.0::DOUBLE + o * 15.0::DOUBLE)::BIGINT AS cost_micro FROM u""",
    "ledger_cost": f"WITH {SQL_EVENTS} SELECT user_id, event_type, count(*) AS calls, sum(cost_micro)::BIGINT AS cost_micro, sum(input_tokens)::BIGINT AS input_tokens FROM c GROUP BY ALL",
    "budget_running_cut": f"{_RUNNING} SELECT event_id, user_id, spent, spent >= 400000 AS over FROM r",
    "budget_first_over": f"{_RUNNING} SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS paused_at, min(spent) AS spent FROM r WHERE spent >= 400000 GROUP BY 1",
    "event_sequence": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events",
    "rate_limit_sliding": "WITH s AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s FROM events) SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW) AS in_window FROM s",
    "job_transitions": f"WITH s AS (SELECT event_id, user_id, {_STATE} AS state, ts FROM events), m AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM s) SELECT event_id, user_id, p AS from_state, state FROM m WHERE p IS NOT NULL AND NOT ({_ALLOWED})",
    "metrics_text": f"WITH {SQL_EVENTS}, a AS (SELECT event_type AS n, count(*) AS k, sum(input_tokens)::BIGINT AS t FROM c GROUP BY 1) SELECT n || '_count ' || k AS value FROM a UNION ALL SELECT n || '_sum ' || t FROM a",
    "event_page": "SELECT event_id, user_id, event_type FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 51",
    "rate_windows": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL",
    "sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
    "revisions_latest": f"WITH {_LABELS} SELECT example_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS revision_id, {_REVIEW_STATE} AS review_state FROM l",
    "review_revisions": f"WITH {_LABELS} SELECT example_id, 2::BIGINT AS revision_id, 1::BIGINT AS parent_revision_id, {_REVIEW_STATE} AS review_state FROM l WHERE doc_id % 3 <> 0",
    "review_conflicts": f"WITH {_LABELS} SELECT example_id, 1::BIGINT AS base_revision, 2::BIGINT AS latest FROM l WHERE doc_id % 3 = 0",
    "version_chain": "SELECT o_custkey AS project_id, o_orderkey AS version_id, coalesce(lag(o_orderkey) OVER w, -1) AS parent_version_id, row_number() OVER w AS version_no FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "accepted_page_keyset": f"WITH {_LABELS} SELECT doc_id, example_id FROM l WHERE decision = 'approve' AND doc_id < 500 ORDER BY doc_id DESC LIMIT 26",
    "wilson_rates": """WITH r AS (SELECT quality, length(text) >= 200 AS taken FROM labels JOIN documents USING (doc_id)),
        n AS (SELECT count(*) FILTER (quality = 0 AND taken) AS false_accepts, count(*) FILTER (quality = 0) AS negatives, count(*) FILTER (quality = 1 AND NOT taken) AS false_rejects, count(*) FILTER (quality = 1) AS positives FROM r),
        w AS (SELECT *, false_accepts::DOUBLE / negatives AS p, 1.96::DOUBLE * 1.96::DOUBLE AS z2 FROM n),
        v AS (SELECT *, p + z2 / (2 * negatives) AS c, 1.96::DOUBLE * sqrt(p * (1 - p) / negatives + z2 / (4 * negatives * negatives)) AS s FROM w)
        SELECT false_accepts, negatives, false_rejects, positives, round(greatest(0, (c - s) / (1 + z2 / negatives)), 9) AS accept_low, round(least(1, (c + s) / (1 + z2 / negatives)), 9) AS accept_high FROM v""",
    "plan_allocation": f"{_PLAN} SELECT ix, topology, task_family, difficulty, per_chunk FROM plan",
    "plan_round_robin": f"{_PLAN}, s AS (SELECT topology, task_family, difficulty, unnest(range(per_chunk)) AS slot FROM plan), o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents) SELECT topology, task_family, difficulty, slot, doc_id FROM s JOIN o ON o.ordinal = slot",
    "plan_top_up": f"{_PLAN}, a AS (SELECT *, round_even((total + 0.0)::DOUBLE * (per_chunk::DOUBLE / sum(per_chunk) OVER ()), 0)::BIGINT AS additional FROM plan) SELECT ix, topology, task_family, difficulty, additional FROM a WHERE additional > 0",
    "release_gate": f"""WITH s AS (SELECT source, {sql_split_case(sql_hash_ratio('doc_id::VARCHAR'))} AS split FROM documents), n AS (SELECT source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM s GROUP BY 1)
        SELECT *, train > 0 AND (validation > 0 OR test > 0) AS ok, CASE WHEN train <= 0 THEN 'train_required' WHEN validation <= 0 AND test <= 0 THEN 'small_corpus_policy' ELSE 'ok' END AS gate, CASE WHEN train <= 1 THEN 'train' WHEN train = 2 THEN 'train,validation' ELSE 'train,validation,test' END AS small_corpus FROM n""",
    "retry_backoff": "SELECT event_id, least(pow(2.0::DOUBLE, event_id % 9), 60.0::DOUBLE) AS delay_cap, 'worker_failure' AS failure FROM events",
}
