"""Shards by proportional stratified interleaving (law `rows`).

Rows are shuffled by a seeded hash and ranked within their source; a row's fraction is (rank - 1/2) / size of its source.
In the order of fractions every stretch holds each source in its share, so cutting it into equal runs makes shards whose
counts differ by one at most and whose mixture is the corpus's.

Ranks are exact and need no sort in one task: rows are counted in narrow buckets of the sort key, the counts of earlier
buckets are summed, and a row's rank is that sum and its place within its bucket. Hash buckets even out a hot source.

Defined results: a null source is a source of its own; a null text has no bytes; repeated rows keep a place each; rows with
a null doc_id are shuffled by their text; rows equal in doc_id, text crc and size may change places with each other; texts of any
length are only measured; an empty table gives no rows. Equal texts are not kept together: with counts at most one apart a large
group fits no shard. Other columns than doc_id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows that a bucket of the sort key should hold, and buckets that are summed as one.
PER_BUCKET, RUN = 1_000, 1_000


def _ranked(rows: DataFrame, within: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """1-based rank by (bucket, order) within the given columns; buckets ascend with the order.

    Counts of buckets are summed in two steps, within runs of RUN buckets and over the runs, so that the one window without
    a partition sees a row per RUN * PER_BUCKET rows."""
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(*within, "_bucket").agg(F.count("*").alias("_n")).withColumn("_run", F.floor(F.col("_bucket") / RUN).cast("long"))
    inner = Window.partitionBy(*within, "_run").orderBy("_bucket")
    counts = counts.withColumn("_before", F.sum("_n").over(inner) - F.col("_n"))
    runs = counts.groupBy(*within, "_run").agg(F.sum("_n").alias("_m"))
    outer = (Window.partitionBy(*within) if within else Window.partitionBy()).orderBy("_run")
    runs = runs.withColumn("_first", F.sum("_m").over(outer) - F.col("_m")).drop("_m")
    counts = counts.join(runs, [*within, "_run"]).select(*within, "_bucket", (F.col("_before") + F.col("_first")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(*order))
    return rows.withColumn("_place", place).join(counts, [*within, "_bucket"]).withColumn(out, F.col("_before") + F.col("_place")).drop("_bucket", "_place", "_before")


def shards(docs: DataFrame, n: int = 24, seed: str = "interleave") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("source").isNull().alias("no_source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    # 52 bits of a digest: the same shuffle on every engine.
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_crc32").cast("string")))
    rows = rows.withColumn("_h", F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("long"))
    rows = materialize(rows, "shard-rows")
    total = rows.count()
    buckets = max(1, total // PER_BUCKET)
    strata = ["source", "no_source"]
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("_size"))
    ties = ["doc_id", "text_crc32", "size"]
    within = _ranked(rows, strata, F.floor(F.col("_h") * F.lit(float(buckets)) / F.lit(float(1 << 52))).cast("long"), ["_h", *ties], "_rank")
    within = within.join(sizes, strata).withColumn("_fraction", (F.col("_rank") - 0.5) / F.col("_size"))
    within = materialize(within, "shard-ranks")
    placed = _ranked(within, [], F.least(F.floor(F.col("_fraction") * buckets).cast("long"), F.lit(buckets - 1)), ["_fraction", *strata, "_rank"], "_at")
    # The first total % n shards hold one row more.
    low, more = divmod(total, n)
    at, edge = F.col("_at") - 1, more * (low + 1)
    shard = F.when(at < edge, F.floor(at / (low + 1))).otherwise(more + F.floor((at - edge) / max(low, 1)))
    slot = F.when(at < edge, at % (low + 1)).otherwise((at - edge) % max(low, 1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.when(~F.col("no_source"), F.col("source")).alias("source"),
    )
