"""State machines on Spark's keyed state with timers: keys in flight, and rings of events.

Both keep their state per key in the RocksDB store, which `rocks` chooses for a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

OFFER, NEXT, COMPLETE = "offer", "next", "complete"


def rocks(df: DataFrame) -> DataFrame:
    """The state store that keyed state with timers and lists needs."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df


class _Flight(StatefulProcessor):
    def __init__(self, order: str, remember_s: int | None, columns: list[str]):
        self.order, self.ttl, self.columns = order, None if remember_s is None else remember_s * 1000, columns

    def init(self, handle) -> None:
        self.queued = handle.getValueState("queued", "v boolean")
        self.done = handle.getValueState("done", "v boolean", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        queued, done = self.queued.exists(), self.done.exists()
        was, keep = (queued, done), []
        for kind in batch["kind"]:
            keep.append(kind == OFFER and not queued and not done)
            queued = (queued or keep[-1]) and kind != NEXT
            done = done or kind == COMPLETE
        if queued and not was[0]:
            self.queued.update((True,))
        elif was[0] and not queued:
            self.queued.clear()
        if done and (not was[1] or (batch["kind"] == COMPLETE).any()):
            self.done.update((True,))
        if any(keep):
            yield batch[keep][self.columns]

    def close(self) -> None:
        pass


def admitted(offers: DataFrame, outcomes: DataFrame, key: list[str], order: str, remember_s: int | None = None) -> DataFrame:
    """Offers that are taken up: of a key that is neither queued nor done.

    outcomes: key, order, kind. `next` hands a queued key to a worker, after which it may be offered again; `complete` says that it was
    published, and only that makes it done. A job that fails is offered anew. remember_s: how long a done key is remembered.
    Rows of a micro-batch are worked off in their order, offers and outcomes together; state is one key's two flags.
    """
    columns = [*key, order]
    both = offers.select(*columns, F.lit(OFFER).alias("kind")).unionByName(outcomes.select(*columns, "kind"))
    out = StructType([f for f in both.schema if f.name != "kind"])
    return rocks(both).groupBy(*key).transformWithStateInPandas(_Flight(order, remember_s, columns), out, "append", "None" if remember_s is None else "ProcessingTime")


class _Ring(StatefulProcessor):
    def __init__(self, within: list[str], order: str, by: list[str], kinds: StructType, capacity: int, drain_ms: int):
        self.within, self.order, self.by, self.kinds, self.capacity, self.drain_ms = within, order, by, kinds, capacity, drain_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", StructType([*self.kinds, StructField("count", LongType())]))
        self.dropped = handle.getValueState("dropped", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [list(r) for r in self.held.get()] if self.held.exists() else []
        fresh, lost = not held, 0
        for values in pd.concat(list(rows)).sort_values(self.order, kind="stable")[[self.order, *self.by]].itertuples(index=False):
            at, same = values[0], [None if pd.isna(x) else x for x in values[1:]]
            if held and held[-1][1:-1] == same:
                held[-1][-1] += 1
                continue
            held.append([getattr(at, "item", lambda at=at: at)(), *same, 1])
            if len(held) > self.capacity:
                held.pop(0)
                lost += 1
        self.held.put([tuple(r) for r in held])
        if lost:
            self.dropped.update((lost + (self.dropped.get()[0] if self.dropped.exists() else 0),))
        if fresh:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.drain_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.held.get()]
        lost = self.dropped.get()[0] if self.dropped.exists() else 0
        self.held.clear()
        self.dropped.clear()
        if held:
            rows = pd.DataFrame(held, columns=[self.order, *self.by, "count"])
            for name, value in zip(self.within, key):
                rows[name] = value
            rows["dropped"] = [lost] + [0] * (len(held) - 1)
            yield rows[[*self.within, self.order, *self.by, "count", "dropped"]]

    def close(self) -> None:
        pass


def ring(events: DataFrame, within: list[str], order: str, by: list[str], capacity: int = 256, drain_ms: int = 5_000) -> DataFrame:
    """A ring of events per group: an event like the last one raises its count, a ring beyond its capacity loses its oldest, and a timer
    that starts with a ring's first event drains it, last run included. dropped: events that were lost, on a drain's first row."""
    kinds = StructType([events.schema[order], *(StructField(c, StringType()) for c in by)])
    out = StructType([*(events.schema[c] for c in within), *kinds, StructField("count", LongType()), StructField("dropped", LongType())])
    rows = events.select(*within, order, *(F.col(c).cast("string").alias(c) for c in by))
    return rocks(rows).groupBy(*within).transformWithStateInPandas(_Ring(within, order, by, kinds, capacity, drain_ms), out, "append", "ProcessingTime")
