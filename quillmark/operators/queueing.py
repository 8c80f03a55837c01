"""Work queues as tables: keyed upsert, dedup, byte budgets, retries and paging."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

KEY = ["source", "scheme", "id"]


def keyed(rows: DataFrame) -> DataFrame:
    """An empty id becomes a unique one."""
    return rows.withColumn("id", F.coalesce(F.nullif(F.col("id"), F.lit("")), F.expr("uuid()")))


def upsert_latest(rows: DataFrame, key: list[str], order: str, position: str) -> DataFrame:
    """The latest body of each key at the position where the key was first seen."""
    rest = [c for c in rows.columns if c not in key and c != position]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_l"), F.min(position).alias(position))
    return latest.select(*key, position, *(F.col(f"_l.{c}").alias(c) for c in rest))


def dedup_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first offer of each key; min_by needs one pass and no sort."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_f")).select(*key, *(F.col(f"_f.{c}").alias(c) for c in rest))


def admit(offers: DataFrame, busy: DataFrame, key: list[str]) -> DataFrame:
    """Offers whose key is neither in flight nor recently completed."""
    return offers.join(busy.select(*key).distinct(), key, "left_anti")


def last_completed(done: DataFrame, within: list[str], order: list[str], n: int = 4096, chunk: int | None = None) -> DataFrame:
    return ordered.ranked(done, within, order, chunk, newest=True).where(F.col("_at") <= n).drop("_at")


def evict(rows: DataFrame, within: list[str], position: str, n_bytes: str, limit: int, chunk: int | None = None) -> DataFrame:
    """The newest rows of each queue that fit the budget together; oldest go first, a row beyond the budget alone is refused."""
    return ordered.newer_sums(rows.where(F.col(n_bytes) <= limit), within, [position], n_bytes, chunk).where(F.col("_sum") <= limit).drop("_sum")


def evict_batches(rows: DataFrame, within: list[str], position: str, n_bytes: str, limit: int, batch: int = 16, chunk: int | None = None) -> DataFrame:
    """Eviction in whole batches of the oldest until what is left fits."""
    ok = ordered.ranked(rows.where(F.col(n_bytes) <= limit), within, [position], chunk).withColumn("_batch", F.floor((F.col("_at") - 1) / batch)).drop("_at")
    per = ok.groupBy(*within, "_batch").agg(F.sum(n_bytes).alias("_b"))
    left = ordered.newer_sums(per, within, ["_batch"], "_b", chunk).where(F.col("_sum") <= limit).select(*within, "_batch")
    left = left.toDF(*(f"_k{i}" for i in range(len(within) + 1)))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*within, "_batch"])))
    return ok.join(left, same, "left_semi").drop("_batch")


def stats(rows: DataFrame, within: list[str], ts_s: str, n_bytes: str, now_s: float) -> DataFrame:
    """Depth, bytes and age of the oldest; zero where a queue is empty."""
    return rows.groupBy(*within).agg(F.count("*").alias("depth"), F.coalesce(F.sum(n_bytes), F.lit(0)).alias("bytes"), F.coalesce(F.lit(now_s) - F.min(ts_s), F.lit(0.0)).alias("oldest_s"))


def set_digest(rows: DataFrame, column: str) -> DataFrame:
    """One text for a set, whatever the order and number of its members."""
    return rows.agg(F.array_join(F.array_sort(F.collect_set(column)), ",").alias("digest"))


def drained(rows: DataFrame, outcomes: DataFrame, position: str, body: str, schema: str, n: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One drain of a spool: what is still to do, page by page from the oldest; what stays; what is set aside.

    outcomes: position, ok. Settled rows go, failed ones stay, undecodable ones are set aside whatever became of them."""
    good, poison = decoded(rows, body, schema)
    settled = outcomes.where("ok").select(position)
    left = good.join(settled, position, "left_anti").drop("decoded")
    return page(left, position, -1, n), left, poison


def page(rows: DataFrame, position: str, after: int, n: int = 100) -> DataFrame:
    """Keyset paging."""
    return rows.where(F.col(position) > after).orderBy(position).limit(n)


def settle(attempts: DataFrame, key: list[str], most: int = 4) -> DataFrame:
    """attempts: key, at, ok. Attempts since the last success and what becomes of the key: done, again or quarantine."""
    w = Window.partitionBy(*key).orderBy("at")
    rows = attempts.withColumn("_since", F.sum(F.col("ok").cast("int")).over(w))
    last = rows.groupBy(*key).agg(F.max_by("ok", "at").alias("_ok"), F.max("_since").alias("_s"))
    failed = rows.where("not ok").groupBy(*key, "_since").agg(F.count("*").alias("_n"))
    out = last.join(failed, [*(last[k] == failed[k] for k in key), last["_s"] == failed["_since"]], "left")
    n = F.coalesce("_n", F.lit(0))
    return out.select(*(last[k] for k in key), F.when(F.col("_ok"), 0).otherwise(n).cast("long").alias("attempts"), F.when(F.col("_ok"), "done").when(n >= most, "quarantine").otherwise("again").alias("state"))


def decoded(rows: DataFrame, body: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON body reads, and those that go to quarantine (with a safe file name)."""
    from ..functions.text import safe_name

    tried = rows.withColumn("_d", F.from_json(body, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("_d").isNotNull() & F.col("_d._bad").isNull()
    return tried.where(ok).withColumn("decoded", F.col("_d").dropFields("_bad")).drop("_d"), tried.where(~ok).drop("_d").withColumn("file", F.concat(safe_name("id"), F.lit(".json")))
