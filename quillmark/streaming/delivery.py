"""Delivery of a stream with a ledger of attempts.

Each round offers the rows of a batch together with all that the round before could not deliver, and writes what became of them, once,
to the ledger below `folder`. A round is named by its batch, so a batch that is run again after a crash finds its round done, or writes
it anew in place of the unfinished one. Publishing is part of the job that writes the round: at least once, in tasks.

A key's attempts are counted over rounds. What fails for good, and what fails `most` times, goes to the dead letters; sweeps go on
without new rows. A spool of limited size loses its oldest rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import queueing
from ..sources import sinks

DONE, AGAIN, DEAD, DROPPED = "done", "again", "quarantine", "dropped"


@dataclass(frozen=True)
class Delivery:
    """folder: where the ledger lies; key: names a row; order: of two rows of a key the later counts, and the oldest are lost first.

    publish: takes rows with their attempt's number (`attempt`, from 1) and gives a status for each, as HTTP does; it runs in tasks. A batch
    for which it raises counts as one that may be tried again. keep: rows that may wait at a time (None: all).
    """

    folder: str
    key: tuple[str, ...]
    order: str
    publish: Callable[[pd.DataFrame], list[int]]
    most: int = 4
    keep: int | None = None

    # -- the ledger

    def _fs(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def rounds(self, spark: SparkSession) -> list[str]:
        """Names of the rounds that are done, in order."""
        fs, path = self._fs(spark), spark._jvm.org.apache.hadoop.fs.Path
        root = path(f"{self.folder}/ledger")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(n.split("=", 1)[1] for n in names if n.startswith("round=") and fs.exists(path(root, f"{n}/_SUCCESS")))

    def ledger(self, spark: SparkSession) -> DataFrame:
        """Every attempt: the row, `attempt`, `status`, `state` and `round`."""
        return spark.read.option("basePath", f"{self.folder}/ledger").parquet(*(f"{self.folder}/ledger/round={n}" for n in self.rounds(spark)))

    def pending(self, spark: SparkSession, before: str) -> DataFrame | None:
        """What the last round before this name left to do."""
        done = [n for n in self.rounds(spark) if n < before]
        return spark.read.parquet(f"{self.folder}/ledger/round={done[-1]}").where(F.col("state") == AGAIN).drop("status", "state") if done else None

    def settled(self, spark: SparkSession) -> DataFrame:
        """key, attempts, state: of each key as it stands after its last round."""
        last = self.ledger(spark).groupBy(*self.key).agg(F.max_by(F.struct("attempt", "state"), "round").alias("l"))
        return last.select(*self.key, F.col("l.attempt").cast("long").alias("attempts"), F.col("l.state").alias("state"))

    def dead_letters(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/dead").drop("round")

    # -- rounds

    def _offered(self, new: DataFrame | None, left: DataFrame | None) -> DataFrame:
        """New rows and those left, one of each key: the later row, with the attempts that the key has had."""
        names = [c for c in (new if new is not None else left).columns if c != "attempt"]
        parts = [] if new is None else [new.select(*names, F.lit(0).alias("attempt"), F.lit(1).alias("_new"))]
        parts += [] if left is None else [left.select(*names, "attempt", F.lit(0).alias("_new"))]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        rest = [c for c in names if c not in self.key]
        one = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct("_new", self.order)).alias("_r"), F.max("attempt").alias("attempt"))
        return one.select(*self.key, *(F.col(f"_r.{c}").alias(c) for c in rest), "attempt")

    def run(self, spark: SparkSession, new: DataFrame | None, name: str) -> None:
        """One round. A round that is done already is left as it is; what follows from it is written again."""
        path = f"{self.folder}/ledger/round={name}"
        if name not in self.rounds(spark):
            if new is not None:
                sinks.assert_no_raw_text(new)
            offered = self._offered(new, self.pending(spark, name))
            lost = None
            if self.keep is not None:
                spool = f"{self.folder}/spool/round={name}"  # written, so that what is kept and what is lost are cut from the same rows
                offered.write.mode("overwrite").parquet(spool)
                offered = spark.read.schema(offered.schema).parquet(spool)
                kept = queueing.evict(offered.withColumn("_one", F.lit(1).cast("long")), [], self.order, "_one", self.keep).drop("_one")
                lost = offered.join(kept.select(*self.key), list(self.key), "left_anti").withColumns({"status": F.lit(0), "state": F.lit(DROPPED)})
                offered = kept
            tried = self._tried(offered.withColumn("attempt", F.col("attempt") + 1))
            (tried if lost is None else tried.unionByName(lost.select(*tried.columns))).write.mode("overwrite").parquet(path)
        dead = spark.read.parquet(path).where(F.col("state") == DEAD)
        sinks.quarantine(dead, f"{self.folder}/dead/round={name}", again=True)

    def _tried(self, rows: DataFrame) -> DataFrame:
        publish = self.publish

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                try:
                    status = publish(batch)
                except Exception:  # noqa: BLE001  whatever it was, it may pass
                    status = [0] * len(batch)
                yield batch.assign(status=pd.Series(list(status), index=batch.index, dtype="int32"))

        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", status int"
        tried = rows.mapInPandas(task, ddl)
        transient = scalars.transient("status") | (F.col("status") == 0)
        state = F.when(F.col("status").between(200, 299), DONE).when(transient & (F.col("attempt") < self.most), AGAIN).otherwise(DEAD)
        return tried.withColumn("state", state)

    def stream(self, rows: DataFrame, checkpoint: str):
        """A writer that makes each batch a round."""
        return rows.writeStream.foreachBatch(lambda batch, i: self.run(batch.sparkSession, batch, f"{i:012d}")).option("checkpointLocation", checkpoint)

    def sweep(self, spark: SparkSession, most: int | None = None) -> int:
        """Offers what is left, round by round, until nothing is (or `most` rounds). A later batch's round sorts after its sweeps."""
        n = 0
        while most is None or n < most:
            done = self.rounds(spark)
            if not done or self.pending(spark, done[-1] + "~").isEmpty():
                break
            base, _, at = done[-1].partition("-")
            self.run(spark, None, f"{base}-{int(at or 0) + 1:06d}")
            n += 1
        return n
