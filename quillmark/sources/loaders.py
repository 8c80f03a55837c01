"""Batch sources: transcript folders, corpora, legacy spools and publication."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tail import SCHEMA, TranscriptTail


def extra_roots(spec: str) -> list[tuple[str, str]]:
    """`source:dir,source:dir`, split at the first colon; blank and malformed entries go."""
    out = []
    for entry in spec.split(","):
        source, colon, path = entry.strip().partition(":")
        if colon and source.strip() and path.strip():
            out.append((source.strip(), path.strip()))
    return out


def roots(home: str, patterns: dict[str, list[str]], spec: str = "") -> list[tuple[str, str]]:
    """(source, folder) of every pattern below a home that matches a folder, then the extra ones."""
    found = [(s, p) for s, globs in patterns.items() for g in globs for p in sorted(glob.glob(os.path.join(home, g))) if os.path.isdir(p)]
    return found + [(s, p) for s, p in extra_roots(spec) if os.path.isdir(p)]


def transcript_lines(spark: SparkSession, folders: list[tuple[str, str]]) -> DataFrame:
    """source, path, off (byte offset, as the stream has it), line of all *.jsonl below the mounted folders; a last line without its end waits."""
    spark.dataSource.register(TranscriptTail)
    out = None
    for source, folder in folders:
        rows = spark.read.format(TranscriptTail.name()).option("source", source).load(folder)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labelled rows as JSON lines; one malformed line fails the load, blank ones are passed over."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def legacy_spool(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """One record per file, *.json and settled *.json.tmp: those that decode, and the rest for quarantine (broken .tmp files go)."""
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    files = files.where(F.col("path").rlike(r"\.json(\.tmp)?$"))
    rows = files.withColumn("_d", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("_d").isNotNull() & F.col("_d._bad").isNull()
    return rows.where(ok).select("path", "_d.*").drop("_bad"), rows.where(~ok & ~F.endswith("path", F.lit(".tmp"))).select("path", "value")


def stranded(spark: SparkSession, folder: str) -> DataFrame:
    """Files left of an old spool."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).agg(F.count("*").alias("stranded"))


def hidden_sources(files: DataFrame, seen: DataFrame, now, hours: int = 24) -> DataFrame:
    """files: source, modified. Sources used within the window of which nothing was captured (seen: source)."""
    used = files.groupBy("source").agg(F.max("modified").alias("newest")).where(F.col("newest") >= F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours"))
    return used.join(seen.select("source").distinct(), "source", "left_anti")


def synthetic_load(spark: SparkSession, n: int, seed: int = 7, sizes: tuple[int, ...] = (200, 1000, 5000, 15000, 20000)) -> DataFrame:
    """Seeded request payloads of given lengths and three kinds."""
    i = F.col("id")
    word = F.concat(F.lit("w"), F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(997)).cast("string"), F.lit(" "))
    size = F.element_at(F.array(*map(F.lit, sizes)), (i % len(sizes) + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("classify", "entities", "extract"))), (i % 3 + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("request_id"), kind.alias("kind"), F.left(F.repeat(word, F.lit(max(sizes))), size).alias("text"))
