"""Ordered folds whose groups may be of any size: chunks, a pass over their summaries, and windows within chunks.

Rows are dealt by ranges of (group, order), so a group is cut into chunks of about CHUNK rows wherever it is long. What a fold needs of
the rows before a chunk is a sum of the chunks' own summaries (counts, bytes), or a composition of them (an average with decay is an affine
map of what came before); summaries are as few as chunks. Only windows within a chunk sort rows. A table of one chunk is not dealt.

`order` should tell rows of a group apart: equal ones are not cut, and are taken as they come.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..scratch import written

#: Rows of a chunk.
CHUNK = 250_000


@dataclass(frozen=True)
class Chunks:
    """rows have `_chunk`, numbered in the order of (by, order); one: there is but one chunk."""

    rows: DataFrame
    by: list[str]
    order: list[str]
    one: bool

    def window(self, descending: bool = False) -> WindowSpec:
        """Over the rows of a group within a chunk."""
        return Window.partitionBy(*self.by, "_chunk").orderBy(*((F.desc(c) for c in self.order) if descending else self.order))

    def summed(self, aggs: dict[str, Column]) -> DataFrame:
        """by, _chunk, and an aggregate of each chunk's part of a group."""
        return self.rows.groupBy(*self.by, "_chunk").agg(*(v.alias(k) for k, v in aggs.items()))

    def joined(self, per: DataFrame) -> DataFrame:
        """The rows with what `per` (by, _chunk, ...) says of their chunk's part of a group."""
        keys = [*self.by, "_chunk"]
        named = per.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return self.rows.join(named, same).drop(*(f"_k{i}" for i in range(len(keys))))

    def outside(self, aggs: dict[str, Column], later: bool = False, total: bool = False) -> DataFrame:
        """The rows with the sum of each aggregate over the chunks before (or after) theirs, as `_<name>`; total: over all of the group, too,
        as `_all_<name>`."""
        if self.one and not total:
            return self.rows.withColumns({f"_{k}": F.lit(0).cast("long") for k in aggs})
        group = Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(0))
        upto = group.orderBy(F.desc("_chunk") if later else F.col("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        per = self.summed(aggs)
        sums = [F.coalesce(F.sum(k).over(upto), F.lit(0)).alias(f"_{k}") for k in aggs] + ([F.sum(k).over(group).alias(f"_all_{k}") for k in aggs] if total else [])
        return self.joined(per.select(*self.by, "_chunk", *sums))


def chunks(rows: DataFrame, by: list[str], order: list[str], size: int | None = None) -> Chunks:
    size, n = size or CHUNK, rows.count()
    if n <= size:
        return Chunks(rows.withColumn("_chunk", F.lit(0)), by, order, True)
    dealt = rows.repartitionByRange(-(-n // size), *by, *order).withColumn("_chunk", F.spark_partition_id())
    return Chunks(written(dealt, "chunks"), by, order, False)


def ranked(rows: DataFrame, by: list[str], order: list[str], size: int | None = None, newest: bool = False, total: bool = False) -> DataFrame:
    """rows with `_at`, their 1-based place in their group (from the newest); total: and `_n`, the group's size."""
    cut = chunks(rows, by, order, size)
    out = cut.outside({"c": F.count("*")}, later=newest, total=total)
    out = out.withColumn("_at", F.row_number().over(cut.window(newest)) + F.col("_c"))
    return (out.withColumn("_n", F.col("_all_c")).drop("_all_c") if total else out).drop("_c", "_chunk")


def newer_sums(rows: DataFrame, by: list[str], order: list[str], value: str, size: int | None = None) -> DataFrame:
    """rows with `_sum`: the value's sum over a row and all newer ones of its group."""
    cut = chunks(rows, by, order, size)
    within = cut.window(descending=True).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.outside({"s": F.sum(value)}, later=True).withColumn("_sum", F.sum(value).over(within) + F.col("_s")).drop("_s", "_chunk")


def halves(rows: DataFrame, by: list[str], order: list[str], value: str, size: int | None = None) -> DataFrame:
    """by, early, late: the value's mean over the first n // 2 rows of a group, and over the others. Ranks are taken in the one chunk alone
    that the middle lies in."""
    cut = chunks(rows, by, order, size)
    per = cut.summed({"c": F.count("*"), "s": F.sum(F.col(value).cast("double")), "v": F.count(value)})
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("c").over(group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before).withColumn("_half", F.floor(F.sum("c").over(group) / 2))
    first, last = F.col("_before") + F.col("c") <= F.col("_half"), F.col("_before") >= F.col("_half")
    aside = per.where(first | last).select(*by, last.alias("late"), "s", "v")
    middle = cut.joined(per.where(~(first | last)).select(*by, "_chunk", "_before", "_half"))
    middle = middle.withColumn("late", F.row_number().over(cut.window()) + F.col("_before") > F.col("_half"))
    parts = middle.groupBy(*by, "late").agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("v"))
    mean = lambda late: F.sum(F.when(F.col("late") == late, F.col("s"))) / F.nullif(F.sum(F.when(F.col("late") == late, F.col("v"))), F.lit(0))
    return aside.unionByName(parts).groupBy(*by).agg(mean(False).alias("early"), mean(True).alias("late"))


def decayed(rows: DataFrame, by: list[str], order: list[str], value: str, alpha: float, size: int | None = None) -> DataFrame:
    """by, mean: the last exponentially weighted mean of each group, seeded by its first value; nulls are left out.

    A chunk of m rows takes the mean v that it finds to (1 - alpha)^m v + b, where b is the chunk's own weighted sum; the seed is
    what the first chunk finds."""
    rows = rows.select(*by, *order, F.col(value).cast("double").alias("_v")).where("_v is not null")
    cut = chunks(rows, by, order, size)
    back = F.row_number().over(cut.window(descending=True)) - 1
    weighted = cut.rows.withColumn("_b", F.lit(alpha) * F.pow(F.lit(1.0 - alpha), back) * F.col("_v"))
    per = weighted.groupBy(*by, "_chunk").agg(F.count("*").alias("m"), F.sum("_b").alias("b"), F.min_by("_v", F.struct(*order)).alias("x"))
    maps = F.array_sort(F.collect_list(F.struct("_chunk", "m", "b", "x")))  # as many as a group has chunks
    step = lambda v, c: F.pow(F.lit(1.0 - alpha), c["m"]) * v + c["b"]
    return per.groupBy(*by).agg(maps.alias("_maps")).select(*by, F.aggregate("_maps", F.col("_maps")[0]["x"], step).alias("mean"))
