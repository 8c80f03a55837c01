"""Length statistics and time series of load."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from . import ordered


def length_stats(docs: DataFrame, by: list[str], text: str = "text", floor: int = 512, ceiling: int = 768, warm: int = 200) -> DataFrame:
    """Count, mean and sample deviation of word counts above 0, and the adaptive cap: the ceiling until warm."""
    floor = min(floor, ceiling)
    rows = docs.select(*by, words(text).alias("_w")).where("_w > 0")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_w").alias("mean"), F.stddev_samp("_w").alias("std"))
    cap = F.least(F.greatest(F.round(F.col("mean") + 2 * F.coalesce("std", F.lit(0.0))), F.lit(float(floor))), F.lit(float(ceiling)))
    return out.withColumn("cap", F.when(F.col("n") < warm, ceiling).otherwise(cap).cast("int"))


def slope(rows: DataFrame, by: list[str], x: str, y: str, scale: float = 60.0) -> DataFrame:
    """Least-squares slope, 0 where there is none."""
    return rows.groupBy(*by).agg((F.coalesce(F.regr_slope(y, x), F.lit(0.0)) * scale).alias("slope"))


def trimmed(rows: DataFrame, by: list[str], order: list[str], share: float, chunk: int | None = None) -> DataFrame:
    """Without the leading int(n * share) samples."""
    return ordered.ranked(rows, by, order, chunk, total=True).where(F.col("_at") > F.floor(F.col("_n") * share)).drop("_at", "_n")


def half_growth(rows: DataFrame, by: list[str], order: list[str], value: str, chunk: int | None = None) -> DataFrame:
    """Mean of the second half less mean of the first, split at n // 2; 0 for fewer than two."""
    return ordered.halves(rows, by, order, value, chunk).select(*by, F.coalesce(F.col("late") - F.col("early"), F.lit(0.0)).alias("growth"))


def non_increasing(rows: DataFrame, by: list[str], order: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_ok", F.coalesce(F.col(value) <= before * (1 + tolerance), F.lit(True))).groupBy(*by).agg(F.bool_and("_ok").alias("non_increasing"))


def ewma(rows: DataFrame, by: list[str], order: list[str], value: str, alpha: float = 0.3, chunk: int | None = None) -> DataFrame:
    """The last exponentially weighted mean of each group; the first sample seeds it."""
    return ordered.decayed(rows, by, order, value, alpha, chunk).withColumnRenamed("mean", "ewma")


def peaks(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("peak", F.max(value).over(upto))


def role_sums(samples: DataFrame, by: list[str], role: str, value: str) -> DataFrame:
    """Sums per role as a map, and their total."""
    per = samples.groupBy(*by, role).agg(F.sum(value).alias("_v"))
    return per.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(role, "_v")))).alias("by_role"), F.sum("_v").alias("total"))


def status_counts(rows: DataFrame, by: list[str], status: str, seconds: float) -> DataFrame:
    """Requests by status, and successes per second."""
    return rows.groupBy(*by).agg(F.count("*").alias("submitted"), F.count_if(F.col(status) == 200).alias("completed"), F.count_if(F.col(status).isin(429, 503)).alias("shed"), (F.count_if(F.col(status) == 200) / seconds).alias("per_second"))


def counter_delta(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Growth of a monotone counter since the last report."""
    before = F.lag(value, 1, 0).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("delta", F.col(value) - before)


def leaders(rows: DataFrame, by: list[str], value: str, name: str, tie) -> DataFrame:
    """The member of largest value of each group, and that value; among equals the one of largest tie."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(name, F.struct(F.col(value), tie)).alias(f"top_{name}"), F.max(value).alias("top_value"))
