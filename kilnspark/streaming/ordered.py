"""Stateful folds over event streams that come late, out of order and more than once.

Rows of a key wait in its state until the watermark has passed their time; then they are folded in the order of (time, id), each once. So a fold
gives what the same fold gives over the whole table sorted, however micro-batches cut and shuffle it, as long as rows come within the
watermark's delay (later ones are dropped by Spark, and a repeated row is late once its first copy was folded). State and timers are
in the state store, so a query that is started again from its checkpoint goes on where it stopped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Waiting rows (event_id, ms, value) of one micro-batch, as long numbers side by side: one entry of the state for each call.
WAITING = "events binary"


class Fold:
    """What happens to a key's rows, in order. State is a tuple of the types in `state`, rows given back have the columns of `output`."""

    state, output = "", ""

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, event_id: int, ms: int, value: int) -> tuple[tuple, list[tuple]]:
        """The state after a row, and the rows that it gives."""
        raise NotImplementedError

    def passed(self, state: tuple, ms: int) -> tuple[tuple, list[tuple]]:
        """What happens when the time ms has passed without a row at or before it."""
        return state, []

    def due(self, state: tuple) -> int | None:
        """When `passed` is to be called next, if no row comes."""
        return None


class Numbered(Fold):
    """Sequence numbers from 1, and what has been spent."""

    state, output = "sequence long, spent long", "event_id long, sequence long, spent long"

    def start(self) -> tuple:
        return 0, 0

    def step(self, state: tuple, event_id: int, ms: int, value: int) -> tuple[tuple, list[tuple]]:
        now = (state[0] + 1, state[1] + value)
        return now, [(event_id, *now)]


class Leases(Fold):
    """Leases that lapse when more than `gap` milliseconds go by without a row: their first time, end and rows, once they have lapsed."""

    state, output = "since long, until long, rows long", "leased_ms long, lapsed_ms long, n long"

    def __init__(self, gap: int):
        self.gap = gap

    def start(self) -> tuple:
        return 0, 0, 0

    def step(self, state: tuple, event_id: int, ms: int, value: int) -> tuple[tuple, list[tuple]]:
        state, over = self.passed(state, ms)
        return (state[0] if state[2] else ms, ms + self.gap, state[2] + 1), over

    def passed(self, state: tuple, ms: int) -> tuple[tuple, list[tuple]]:
        return ((0, 0, 0), [state]) if state[2] and state[1] < ms else (state, [])

    def due(self, state: tuple) -> int | None:
        return state[1] + 1 if state[2] else None


class Limit(Fold):
    """At most `most` accepted rows in any `window` milliseconds; a row exactly that old has gone, a refused one is not remembered."""

    state, output = "stamps array<long>", "event_id long, accepted boolean"

    def __init__(self, most: int, window: int):
        self.most, self.window = most, window

    def start(self) -> tuple:
        return ([],)

    def step(self, state: tuple, event_id: int, ms: int, value: int) -> tuple[tuple, list[tuple]]:
        live = [s for s in state[0] if s > ms - self.window]
        accepted = len(live) < self.most
        return ([*live, ms] if accepted else live,), [(event_id, accepted)]


def _ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(set(rows), key=lambda r: (r[1], r[0]))


class Ordered(StatefulProcessor):
    """Runs a fold over (key, event_id, ms, value)."""

    def __init__(self, fold: Fold, key: str):
        self.fold, self.key = fold, key
        self.names = [c.split()[0] for c in fold.output.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.reached = handle.getValueState("reached", self.fold.state)

    def _frames(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame({self.key: [key[0]] * len(rows), **dict(zip(self.names, map(list, zip(*rows, strict=True)), strict=True))})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = np.concatenate([np.column_stack([part[c].to_numpy(np.int64) for c in ("event_id", "ms", "value")]) for part in rows])
        self.waiting.appendValue((new.tobytes(),))
        self.handle.registerTimer(int(new[:, 1].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        held = [np.frombuffer(r[0], np.int64).reshape(-1, 3) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = _ordered(list(map(tuple, np.concatenate(held).tolist()))) if held else []
        state = tuple(self.reached.get()) if self.reached.exists() else self.fold.start()
        out: list[tuple] = []
        for row in rows:
            if row[1] <= upto:
                state, given = self.fold.step(state, *row)
                out += given
        state, given = self.fold.passed(state, upto)
        self.reached.update(state)
        rest = [r for r in rows if r[1] > upto]
        self.waiting.clear()
        if rest:
            self.waiting.put([(np.array(rest, np.int64).tobytes(),)])
        again = min([ms for _, ms, _ in rest[:1]] + [t for t in (self.fold.due(state),) if t is not None], default=None)
        if again is not None and again > upto:
            self.handle.registerTimer(again)
        yield from self._frames(key, out + given)

    def close(self) -> None:
        pass


def prepared(events: DataFrame, key: str, time: str, event_id: str, value: str | None) -> DataFrame:
    """(key, event_id, ms, value, ts) of events; those without a key, time or id take no part."""
    ts = F.col(time).cast("timestamp")
    worth = F.coalesce(F.col(value).cast("long"), F.lit(0)) if value else F.lit(0)
    out = events.select(F.col(key), F.col(event_id).cast("long").alias("event_id"), F.unix_millis(ts).alias("ms"), worth.cast("long").alias("value"), ts.alias("ts"))
    return out.dropna(subset=[key, "event_id", "ms"])


def fold_stream(events: DataFrame, fold: Fold, key: str, *, time: str = "ts", event_id: str = "event_id", value: str | None = None, late: str = "10 minutes") -> DataFrame:
    """The rows that a fold gives over a stream of events, in append mode."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = prepared(events, key, time, event_id, value).withWatermark("ts", late)
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Ordered(fold, key), outputStructType=f"{key} {kind}, {fold.output}", outputMode="Append", timeMode="EventTime")


def fold_table(events: DataFrame, fold: Fold, key: str, *, time: str = "ts", event_id: str = "event_id", value: str | None = None, end_ms: int | None = None) -> DataFrame:
    """The rows that a fold gives over a table: each key's rows stream through one task in order; nothing but the fold's state is held.

    end_ms: the time that has passed when the table ends (none: the fold's own rows only)."""
    rows = prepared(events, key, time, event_id, value).drop("ts").distinct()
    kind, names = dict(rows.dtypes)[key], [c.split()[0] for c in fold.output.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, began = None, None, False

        def ended() -> list[tuple]:
            return [(now, *g) for g in fold.passed(state, end_ms)[1]] if began and end_ms is not None else []

        for batch in batches:
            out: list[tuple] = []
            for k, i, ms, v in zip(batch[key].tolist(), batch["event_id"].tolist(), batch["ms"].tolist(), batch["value"].tolist(), strict=True):
                if not began or k != now:
                    out += ended()
                    now, state, began = k, fold.start(), True
                state, given = fold.step(state, i, ms, v)
                out += [(now, *g) for g in given]
            yield pd.DataFrame(out, columns=[key, *names])
        yield pd.DataFrame(ended(), columns=[key, *names])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, "ms", "event_id").mapInPandas(run, f"{key} {kind}, {fold.output}")
