"""Sinks. No schema here holds a column of raw text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rfc3339
from ..operators.sensitivity import blank_text

RAW = {"text", "prompt", "line", "recent_prompts", "content", "message"}


def assert_no_raw_text(df: DataFrame) -> None:
    """Refuses a frame with a top-level column of raw text."""
    if found := RAW & set(df.columns):
        raise ValueError(f"raw text must not leave: {sorted(found)}")


def published(profiles: DataFrame, allow_entity_text: bool = False, ts: str = "ts") -> DataFrame:
    """Profiles in wire form: one JSON document per row, entity text blank unless allowed."""
    assert_no_raw_text(profiles)
    rows = profiles
    if "entities" in rows.columns:
        rows = rows.withColumn("entities", blank_text("entities", allow_entity_text))
    if ts in rows.columns:
        rows = rows.withColumn(ts, rfc3339(ts))
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def publish(profiles: DataFrame, path: str, **how) -> None:
    published(profiles, **how).write.mode("append").text(path)


def quarantine(rows: DataFrame, path: str, again: bool = False) -> None:
    """Sets rows aside; again: in place of what an earlier try has left at the path."""
    assert_no_raw_text(rows)
    rows.write.mode("overwrite" if again else "append").parquet(path)


def attributes(names: dict[str, str]):
    """OTLP attributes of non-empty columns: array of (key, value)."""
    each = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value"))) for k, c in names.items()]
    return F.array_compact(F.array(*each))


def exported(points: DataFrame, names: dict[str, str]) -> DataFrame:
    """Points (name, value) with their attributes as JSON documents."""
    assert_no_raw_text(points)
    return points.select(F.to_json(F.struct("name", F.col("value").cast("string").alias("value"), attributes(names).alias("attributes"))).alias("value"))


def export(points: DataFrame, names: dict[str, str], path: str) -> bool:
    """Writes points as far as it can: a failure is logged and told, and stops nothing."""
    import logging

    rows = exported(points, names)
    try:
        rows.write.mode("append").text(path)
        return True
    except Exception:  # noqa: BLE001  telemetry must not end what it tells of
        logging.getLogger(__name__).warning("points were not exported", exc_info=True)
        return False
