"""Event tables replayed as streams: ordered folds over state, limiter decisions, the call ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.operators.shared import shared_dir
from kilnspark.queries.common import table
from kilnspark.queries.operations import SQL_EVENTS, _events
from kilnspark.streaming import ledger
from kilnspark.streaming.ordered import Fold, Leases, Limit, Numbered, fold_stream, fold_table

DAY = 24 * 3600 * 1000
LIMIT = Limit(2, DAY // 4)


def _replayed(spark: SparkSession, sf_dir: str, fold: Fold, value: str | None = None) -> DataFrame:
    """All events as one finished stream; what still waits when it ends is what the table's end leaves open."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    out = fold_stream(source, fold, "user_id", value=value, late="0 seconds")
    ledger.replay(out, f"{path}/rows", f"{path}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


def stream_event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers of each user's events and what their values add up to, from a stream."""
    return _replayed(spark, sf_dir, Numbered(), "value")


def _times(rows: DataFrame) -> DataFrame:
    at = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd HH:mm:ss").alias(c.removesuffix("_ms"))
    return rows.select("user_id", at("leased_ms"), at("lapsed_ms"), "n")


def stream_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases of six hours that had lapsed when the last event came, from a stream."""
    return _times(_replayed(spark, sf_dir, Leases(DAY // 4)))


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a limit of two in six hours accepts, refused ones not counting, from a stream."""
    return _replayed(spark, sf_dir, LIMIT)


def rate_limit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions over the table."""
    return fold_table(table(spark, sf_dir, "events"), LIMIT, "user_id")


CALL = "user_id long, fingerprint string, event_id long, cost_micro long"


def call_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a stream of calls, each fingerprint of a user once: the events of a type that spend the same."""
    path = f"{shared_dir(spark)}/calls-{uuid.uuid4().hex}"
    calls = _events(spark, sf_dir)
    print_ = F.sha2(F.concat_ws(":", "event_type", "cost_micro"), 256)
    sink = ledger.ledger_sink(path, CALL, ["user_id", "fingerprint"], ["event_id"])
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    ids = source.select(F.col("event_id"))  # the stream names the calls, their costs are those of the table

    def write(batch: DataFrame, batch_id: int) -> None:
        told = batch.join(calls, "event_id").select(F.col("user_id").cast("long"), print_.alias("fingerprint"), F.col("event_id").cast("long"), F.col("cost_micro").cast("long"))
        sink(told, batch_id)
        sink(told, batch_id)  # a batch that is tried again changes nothing

    ids.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ledger.read_ledger(spark, path, CALL).drop("batch")


QUERIES = {
    "stream_event_ledger": stream_event_ledger,
    "stream_leases": stream_leases,
    "stream_rate_limit": stream_rate_limit,
    "rate_limit_decisions": rate_limit_decisions,
    "call_ledger": call_ledger,
}

_LIMITED = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT user_id, event_id, k, true AS accepted, [ms] AS stamps FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.event_id, e.k, len(list_filter(f.stamps, lambda s: s > e.ms - 21600000)) < 2,
            CASE WHEN len(list_filter(f.stamps, lambda s: s > e.ms - 21600000)) < 2 THEN list_append(list_filter(f.stamps, lambda s: s > e.ms - 21600000), e.ms) ELSE list_filter(f.stamps, lambda s: s > e.ms - 21600000) END
            FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, event_id, accepted FROM f"""

ORACLES = {
    "stream_event_ledger": "SELECT user_id, event_id, row_number() OVER w AS sequence, (sum(trunc(value)::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "stream_leases": """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), l AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOURS AS z, count(*) AS n FROM s GROUP BY user_id, k)
        SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS leased, strftime(z, '%Y-%m-%d %H:%M:%S') AS lapsed, n FROM l WHERE epoch_ms(z) < (SELECT epoch_ms(max(ts)) FROM events)""",
    "stream_rate_limit": _LIMITED,
    "rate_limit_decisions": _LIMITED,
    "call_ledger": f"WITH {SQL_EVENTS} SELECT user_id, sha256(event_type || ':' || cost_micro) AS fingerprint, min(event_id) AS event_id, arg_min(cost_micro, event_id) AS cost_micro FROM c GROUP BY 1, 2",
}
