"""Metrics of predictions against gold rows. Each keeps its own convention for empty denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(hit: Column, of: Column, empty: float) -> Column:
    return F.coalesce(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(empty))


def accuracy(rows: DataFrame, gold: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Right over labelled; 1 if nothing is labelled."""
    ok = F.coalesce(F.col(gold), F.lit("")) != ""
    return rows.groupBy(*(by or [])).agg(_share(F.col(gold) == F.col(pred), ok, 1.0).alias("accuracy"), F.count_if(ok).alias("considered"))


def recall(rows: DataFrame, gold: str, pred: str, none: str = "none") -> DataFrame:
    """Exact class among the sensitive; 1 if nothing is."""
    ok = ~F.coalesce(F.col(gold), F.lit("")).isin("", none)
    return rows.agg(_share(F.col(gold) == F.col(pred), ok, 1.0).alias("recall"))


def leakage(rows: DataFrame, cls: str = "c1") -> DataFrame:
    """Of one confound class: predicted functions that differ, and predicted tasks that differ where labelled; over all of the class."""
    c = F.col("class") == cls
    task = (F.coalesce("task_type", F.lit("")) != "") & (F.col("task_type") != F.col("pred_task_type"))
    return rows.agg(_share(F.col("function_guess") != F.col("pred_function_guess"), c, 0.0).alias("function_leakage"), _share(task, c, 0.0).alias("task_leakage"))


def false_rate(rows: DataFrame, cls: str, pred: str, value: str, name: str) -> DataFrame:
    """Of one class, the share predicted as `value`; 0 if the class is empty."""
    return rows.agg(_share(F.col(pred) == value, F.col("class") == cls, 0.0).alias(name))


def error_over_facets(rows: DataFrame, facets: dict[str, str], cls: str = "s1") -> DataFrame:
    """Errors over all labelled (row, facet) pairs of a class."""
    pairs = F.explode(F.array(*(F.struct(F.col(g).alias("gold"), F.col(p).alias("pred")) for g, p in facets.items())))
    each = rows.where(F.col("class") == cls).select(pairs.alias("x")).where(F.coalesce("x.gold", F.lit("")) != "")
    return each.agg(F.coalesce(F.avg((F.col("x.gold") != F.coalesce("x.pred", F.lit(""))).cast("double")), F.lit(0.0)).alias("error_rate"))


def secret_rates(rows: DataFrame, gold: str, pred: str, positive, decoy: Column) -> DataFrame:
    return rows.agg(_share(F.col(pred) == positive, F.col(gold) == positive, 0.0).alias("secret_recall"), _share(F.col(pred) == positive, decoy, 0.0).alias("false_positive_rate"))


def by_group(rows: DataFrame, group: str, right: Column, none: str = "(none)") -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit(none)).alias(group)).agg(F.count_if(right).alias("correct"), F.count("*").alias("total"))


def positional(gold: DataFrame, pred: DataFrame, order: str) -> DataFrame:
    """Row by row in the order of each, as far as the shorter goes. Ranks come from counts of ordered partitions, so no task sorts all."""

    def placed(df: DataFrame, name: str) -> DataFrame:
        rows = df.withColumnRenamed(order, f"{name}_{order}").repartitionByRange(F.col(f"{name}_{order}")).sortWithinPartitions(f"{name}_{order}")
        rows = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
        sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
        first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))  # a row per partition
        return rows.join(first, "_part").withColumn("row_id", F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_first")

    return placed(gold, "gold").join(placed(pred, "pred"), "row_id")


def calibration(rows: DataFrame, gold: str, pred: str, confidence: str, bins: int = 10) -> DataFrame:
    """Bins of equal width, the top one closed, a missing confidence 0; empty bins are left out."""
    c = F.coalesce(F.col(confidence), F.lit(0.0))
    at = F.greatest(F.least(F.floor(c * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    kept = rows.where(F.coalesce(F.col(gold), F.lit("")) != "")
    return kept.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(c).alias("confidence"), F.avg((F.col(gold) == F.coalesce(F.col(pred), F.lit(""))).cast("double")).alias("accuracy"))


def expected_error(bins: DataFrame) -> DataFrame:
    return bins.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n"), F.lit(0.0)).alias("ece"))
