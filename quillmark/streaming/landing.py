"""Streams brought to an end: what has arrived is worked off and landed as a table."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch


def landed(stream: DataFrame, name: str) -> DataFrame:
    """All that the stream's source holds now, through its state, into Parquet; offsets and state are checkpointed beside it."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, f"stream-{name}")
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def drained(stream: DataFrame, name: str, wait_s: float = 600.0) -> DataFrame:
    """As `landed` for a stream whose state leaves by timers: ends when the source is read and no state is left."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, f"stream-{name}")
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").start()
    try:
        end = time.monotonic() + wait_s
        while not empty(q):
            if q.exception() or time.monotonic() > end:
                raise RuntimeError(f"{name}: state is left: {q.exception()}")
            time.sleep(0.2)
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def empty(query) -> bool:
    """Whether a running query's last batch had no rows to read (its timers go on without) and has left no state."""
    last = query.lastProgress
    return bool(last) and not last["numInputRows"] and sum(s["numRowsTotal"] for s in last["stateOperators"]) == 0


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A stream's path must be a folder unless it is a pattern; this one matches the table alone.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def arrival() -> Column:
    """Where a row of a table's stream stands in the table: by file, then by row, as a text in that order."""
    return F.concat("_metadata.file_path", F.lit("#"), F.lpad(F.col("_metadata.row_index").cast("string"), 19, "0"))
