"""The stateful operators over streams, on Spark's state store.

Each is a state machine over rows of one key in order; `tests` hold a stream's result against the batch operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _stateful(df: DataFrame, keys: list[str], step, out: str, state: str) -> DataFrame:
    return df.groupBy(*keys).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(by, kind="stable")


def dedup(df: DataFrame, key: str, order: str, within: str, remembered: int = 4096) -> DataFrame:
    """First offers per queue (`within`), against the last `remembered` keys taken."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = list(state.get[0]) if state.exists else []
        known, keep = set(taken), []
        rows = _ordered(batches, [order])
        for k in rows[key].astype(str):
            keep.append(k not in known)
            if keep[-1]:
                taken.append(k)
                known.add(k)
                if len(taken) > remembered:
                    known.discard(taken.pop(0))
        state.update((taken,))
        yield rows[keep][[within, key, order]]

    schema = df.select(within, key, order).schema
    return _stateful(df, [within], step, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema), "taken array<string>")


def sequence(df: DataFrame, session: str, order: str, prompt_id: str, arrival: str | None = None) -> DataFrame:
    """Per session: a 1-based number of each row, and the latest prompt id at or before it.

    Rows of equal order come by their `arrival`, a text, else as they are read; rows without an order come last.
    """
    kinds = dict(df.dtypes)
    # Integers travel as text: in pandas a null would make floats of its batch's, which are not exact beyond 2^53.
    whole = [c for c in (session, order) if kinds[c] in ("tinyint", "smallint", "int", "bigint")]
    number = int if order in whole else lambda o: o

    def place(row: tuple) -> tuple:
        o, at, _ = row
        return (True, 0, at) if o is None or o != o else (False, number(o), at)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        rows = sorted((row for b in batches for row in zip(b[order], b[arrival] if arrival else [""] * len(b), b[prompt_id])), key=place)
        prompts = []
        for *_, p in rows:
            last = p if isinstance(p, str) and p else last
            prompts.append(last)
        state.update((n + len(rows), last))
        yield pd.DataFrame({session: group[0], order: [o for o, *_ in rows], "event_sequence": range(n + 1, n + len(rows) + 1), "last_prompt_id": prompts})

    sent = df.select(*(F.col(c).cast("string").alias(c) if c in whole else c for c in (session, order)), prompt_id, *([arrival] if arrival else []))
    sent_kinds = dict(sent.dtypes)
    got = _stateful(sent, [session], step, f"{session} {sent_kinds[session]}, {order} {sent_kinds[order]}, event_sequence long, last_prompt_id string", "n long, last string")
    return got.select(*(F.col(c).cast(kinds[c]).alias(c) for c in (session, order)), "event_sequence", "last_prompt_id")


def sustained(df: DataFrame, key: str, ts: str, value: str, threshold: float, window_s: float) -> DataFrame:
    """Severity changes and recoveries of a value over a threshold, per key."""
    names = {4: "critical", 2: "error", 1: "warn"}

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, level = state.get if state.exists else (None, "")
        out = []
        for t, v in _ordered(batches, [ts])[[ts, value]].itertuples(index=False):
            at = t.value / 1e9
            if v is not None and v > threshold:
                since = at if since is None else since
                now = next((n for f, n in names.items() if at - since >= f * window_s), "")
                if now and now != level:
                    level = now
                    out.append((group[0], t, v, level, False))
            else:
                if level:
                    out.append((group[0], t, v, level, True))
                since, level = None, ""
        state.update((since, level))
        yield pd.DataFrame(out, columns=[key, ts, value, "severity", "recovered"])

    kinds = dict(df.dtypes)
    return _stateful(df, [key], step, f"{key} {kinds[key]}, {ts} timestamp, {value} double, severity string, recovered boolean", "since double, level string")


def gauges(df: DataFrame, key: str, ts: str, value: str, interval_s: float) -> DataFrame:
    """Gauges at the first sample and then whenever the interval has passed since the last."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, [])
        held, out = list(held), []
        for t, v in _ordered(batches, [ts])[[ts, value]].itertuples(index=False):
            at = t.value / 1e9
            held.append((at, float(v)))
            if last is None or at - last >= interval_s:
                s = pd.Series([x for _, x in held])
                out.append((group[0], t, s.min(), s.max(), s.mean(), s.std(ddof=0), s.iloc[-1], len(s), held[-1][0] - held[0][0]))
                last, held = at, []
        state.update((last, held))
        yield pd.DataFrame(out, columns=[key, ts, "min", "max", "mean", "std", "last", "n", "window_s"])

    kinds = dict(df.dtypes)
    return _stateful(df, [key], step, f"{key} {kinds[key]}, {ts} timestamp, min double, max double, mean double, std double, last double, n long, window_s double", "last double, held array<struct<at:double,v:double>>")


def runs(df: DataFrame, within: str, order: str, code: str) -> DataFrame:
    """Adjacent equal codes of a stream as runs; a run leaves when the next begins."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None, None, 0]
        out = []
        for o, c in _ordered(batches, [order])[[order, code]].itertuples(index=False):
            if held[2] and held[1] == c:
                held[2] += 1
            else:
                if held[2]:
                    out.append((group[0], held[0], held[1], held[2]))
                held = [o, c, 1]
        state.update(tuple(held))
        yield pd.DataFrame(out, columns=[within, order, code, "count"])

    kinds = dict(df.dtypes)
    return _stateful(df, [within], step, f"{within} {kinds[within]}, {order} {kinds[order]}, {code} string, count long", f"o {kinds[order]}, c string, n long")


def length_state(df: DataFrame, key: str, words: str) -> DataFrame:
    """Count, mean and M2 of word counts per key, after each batch."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for batch in batches:  # each joined to what is known, none held
            w = batch[words][batch[words] > 0].astype("float64")
            if len(w):
                d, total = w.mean() - mean, n + len(w)
                mean, m2 = mean + d * len(w) / total, m2 + ((w - w.mean()) ** 2).sum() + d * d * n * len(w) / total
                n = total
        state.update((int(n), float(mean), float(m2)))
        yield pd.DataFrame({key: [group[0]], "n": [n], "mean": [mean], "m2": [m2]})

    kinds = dict(df.dtypes)
    return _stateful(df, [key], step, f"{key} {kinds[key]}, n long, mean double, m2 double", "n long, mean double, m2 double")


def deliver(df: DataFrame, path: str, checkpoint: str, settle=None):
    """At-least-once delivery by batch: published rows append, and `settle(batch, id)` books attempts and quarantine."""
    from ..sources.sinks import assert_no_raw_text

    def batch(rows: DataFrame, batch_id: int) -> None:
        assert_no_raw_text(rows)
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if settle:  # over what was written: the batch itself is not worked out again
            settle(rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/batch={batch_id}"), batch_id)

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
