"""Client events: gates, redaction, run coalescing, sustained thresholds and gauges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, vocab
from ..functions import text as T
from . import ordered


def rank(severity) -> Column:
    """Position in the order of severities; -1 for unknown ones."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, vocab.SEVERITIES)), T.col(severity)).cast("int") - 1, F.lit(-1))


def gate(events: DataFrame, floor: str = "info", rate: float = 1.0, enabled: bool = True, key: str = "event_id") -> DataFrame:
    """Master switch, severity floor (exempt codes pass) and sampling by a hash of the key, so that reruns agree."""
    if not enabled:
        return events.limit(0)
    ok = F.col("code").isin(vocab.EXEMPT_CODES) | (rank("severity") >= vocab.SEVERITIES.index(floor))
    kept = events.where(ok)
    return kept if rate >= 1 else kept.where(scalars.hash_share(key) < rate)


def telemetry_sources(events: DataFrame, allowed: list[str] | None = None, source: str = "source") -> DataFrame:
    """Events of sources on the allow-list; None: the usual one, an empty list: no limit."""
    listed = vocab.TELEMETRY_SOURCES if allowed is None else allowed
    return events.where(F.col(source).isin(listed)) if listed else events


def redact(events: DataFrame, fields: str = "fields") -> DataFrame:
    return events.withColumn(fields, T.redact_map(fields))


def coalesce_runs(events: DataFrame, within: list[str], order: list[str], by: list[str]) -> DataFrame:
    """Adjacent events that agree in `by` become one: the first's columns, and how many."""
    w = Window.partitionBy(*within).orderBy(*order)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    rows = events.withColumn("_new", F.when(same & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    kept = [c for c in events.columns if c not in within]
    first = rows.groupBy(*within, "_run").agg(F.min(F.struct(*order, *[c for c in kept if c not in order])).alias("_f"), F.count("*").alias("count"))
    return first.select(*within, *(F.col(f"_f.{c}").alias(c) for c in kept), "count")


def newest(events: DataFrame, within: list[str], order: list[str], n: int) -> DataFrame:
    """A ring's content: the newest n of each group."""
    w = Window.partitionBy(*within).orderBy(*(F.desc(c) for c in order))
    return events.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n).drop("_at")


def sustained(samples: DataFrame, within: list[str], ts: str, tie: str, value: str, threshold: float, window_s: float) -> DataFrame:
    """Severity changes of a value strictly above a threshold for 1, 2 or 4 windows, and recoveries with the peak severity."""
    w = Window.partitionBy(*within).orderBy(ts, tie)
    rows = samples.withColumn("_over", F.coalesce(F.col(value) > threshold, F.lit(False)))
    rows = rows.withColumn("_new", (F.col("_over") != F.lag("_over", 1, False).over(w)).cast("int")).withColumn("_island", F.sum("_new").over(w))
    island = Window.partitionBy(*within, "_island").orderBy(ts, tie)
    elapsed = (F.unix_micros(ts) - F.unix_micros(F.min(ts).over(island))) / 1e6
    rows = rows.withColumn("elapsed_s", F.when(F.col("_over"), elapsed)).withColumn("severity", F.when(F.col("_over"), scalars.severity_of("elapsed_s", window_s)))
    rows = rows.withColumn("_before", F.lag("severity").over(w))
    rose = F.col("severity").isNotNull() & ~F.col("severity").eqNullSafe(F.col("_before"))
    fell = F.col("_before").isNotNull() & F.col("severity").isNull()
    out = rows.where(rose | fell).withColumn("recovered", fell)
    return out.select(*within, ts, tie, value, F.coalesce("severity", "_before").alias("severity"), "recovered")


def gauges(samples: DataFrame, within: list[str], ts: str, tie: str, value: str, interval_s: int) -> DataFrame:
    """Min, max, mean, population deviation, last and count of fixed windows."""
    return (
        samples.groupBy(*within, F.floor(F.unix_micros(ts) / (interval_s * 1_000_000)).alias("window_id"))
        .agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max_by(value, F.struct(ts, tie)).alias("last"), F.count(value).alias("n"), ((F.max(F.unix_micros(ts)) - F.min(F.unix_micros(ts))) / 1e6).alias("window_s"))
    )


def triggered_gauges(samples: DataFrame, within: str, ts: str, tie: str, value: str, interval_s: float) -> DataFrame:
    """Gauges by the data's own rule: at a group's first sample, and at each that comes the interval or more after the last gauge.

    Groups are sorted and folded with a state of one window's sums, batch by batch, so a long series is never held."""
    rows = samples.select(within, F.unix_micros(ts).alias("_t"), F.col(value).cast("double").alias("_v"), tie).where("_v is not null")
    rows = rows.repartition(within).sortWithinPartitions(within, "_t", tie).select(within, "_t", "_v")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last, first, held = None, None, None, []
        for batch in batches:
            out = []
            for g, t, v in batch.itertuples(index=False):
                if g != group:
                    group, last, held = g, None, []
                if not held:
                    first, held = t, [v, v, 0.0, 0.0, 0]
                n = held[4] + 1
                d = v - held[2]
                mean = held[2] + d / n
                held = [min(held[0], v), max(held[1], v), mean, held[3] + d * (v - mean), n]
                if last is None or t - last >= interval_s * 1e6:
                    out.append((g, t, held[0], held[1], mean, (held[3] / n) ** 0.5, v, n, (t - first) / 1e6))
                    last, held = t, []
            yield pd.DataFrame(out, columns=[within, "at_us", "min", "max", "mean", "std", "last", "n", "window_s"])

    return rows.mapInPandas(fold, f"{within} {dict(samples.dtypes)[within]}, at_us long, min double, max double, mean double, std double, last double, n long, window_s double")


def metric_groups(points: DataFrame, most: int = 10_000) -> DataFrame:
    """points: name, pos, value. Rows of at most `most` points of a metric, in order and numbered (part); metrics keep the order of first sight."""
    placed = ordered.ranked(points, ["name"], ["pos"]).withColumn("part", F.floor((F.col("_at") - 1) / most))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"])
    return placed.groupBy("name", "part").agg(F.min("pos").alias("first_pos"), listed.alias("points"), F.sum("value").alias("total"))


def usage_points(lines: DataFrame) -> DataFrame:
    """Assistant lines (line: JSON) to metric points; lines without usage go, cache metrics only if positive."""
    path = "$.message.usage."
    got = lambda k: F.expr(f"try_cast(get_json_object(line, '{path}{k}') as bigint)")
    rows = lines.where((F.get_json_object("line", "$.type") == "assistant") & F.get_json_object("line", "$.message.usage").isNotNull())
    names = [("input", "input_tokens", True), ("output", "output_tokens", True), ("cache_read", "cache_read_input_tokens", False), ("cache_write", "cache_creation_input_tokens", False)]
    points = F.array(*(F.struct(F.lit(f"tokens.{n}").alias("name"), F.coalesce(got(k), F.lit(0)).alias("value"), F.lit(always).alias("always")) for n, k, always in names))
    rows = rows.select(*lines.columns, F.posexplode(points).alias("pos", "p"))
    return rows.where("p.always or p.value > 0").select(*(c for c in lines.columns if c != "line"), "pos", "p.name", "p.value")


def envelope(events: DataFrame, batch: list[str], most: int = 10_000) -> DataFrame:
    """JSON documents of at most `most` events of a batch, in order of time and numbered (part)."""
    placed = ordered.ranked(events, batch, ["ts", "code", "severity"]).withColumn("part", F.floor((F.col("_at") - 1) / most))
    return placed.groupBy(*batch, "part").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("ts", "code", "severity"))).alias("events"))).alias("body"), F.count("*").alias("n_events"))
