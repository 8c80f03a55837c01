from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.operators import events, queueing
from quillmark.streaming import processors
from quillmark.streaming.delivery import Delivery
from quillmark.streaming.landing import empty


def flaky(batch: pd.DataFrame) -> list[int]:
    """Row i needs i % 6 + 1 attempts; two are refused for good; one makes the whole batch fail once."""
    if ((batch["id"] == 8) & (batch["attempt"] == 1)).any():
        raise OSError("down")
    return [400 if i in (3, 14) else 200 if a >= i % 6 + 1 else 503 for i, a in zip(batch["id"], batch["attempt"])]


def folder_stream(spark, path, schema, per_batch=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_delivery_over_restarts_is_the_batch_ledger(spark, tmp_path):
    schema, source = "id long, at long, masked string", str(tmp_path / "in")
    to = Delivery(str(tmp_path / "to"), ("id",), "at", flaky)

    def run():
        to.stream(folder_stream(spark, source, schema), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)

    put(spark, [(i, i, "a") for i in range(10)], schema, source)
    run()
    put(spark, [(i, i, "b") for i in range(10, 20)] + [(1, 50, "later")], schema, source)

    class Crash(Exception):
        pass

    def dies(rows, i):
        to.run(spark, rows, f"{i:012d}")
        raise Crash

    with pytest.raises(Exception):  # the round is written, the batch is not: it comes again after the restart
        folder_stream(spark, source, schema).writeStream.foreachBatch(dies).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    assert len(to.rounds(spark)) == 2
    (tmp_path / "to/ledger/round=000000000002").mkdir()  # what a round that never ended leaves
    (tmp_path / "to/ledger/round=000000000002/part-0.parquet").write_text("half")
    run()
    assert to.rounds(spark) == ["000000000000", "000000000001"]
    put(spark, [(30, 60, "c")], schema, source)
    run()
    assert to.sweep(spark) > 1 and to.sweep(spark) == 0
    log = to.ledger(spark)
    assert log.groupBy("id", "attempt").count().where("count > 1").isEmpty(), "an attempt stands once, whatever came again"
    settled = {r.id: (r.attempts, r.state) for r in to.settled(spark).collect()}
    want = {}
    for i in [*range(20), 30]:
        need = max(i % 6 + 1, 2 if i < 10 else 1)  # the first batch failed as a whole
        want[i] = (2 if i == 3 else 1, "quarantine") if i in (3, 14) else (need, "done") if need <= 4 else (4, "quarantine")
    assert settled == want
    batch = queueing.settle(log.where("status <> 400").select("id", F.col("attempt").alias("at"), (F.col("state") == "done").alias("ok")), ["id"])
    assert {r.id: r.state for r in batch.collect() if r.id not in (3, 14)} == {i: s for i, (_, s) in settled.items() if i not in (3, 14)}
    dead = {r.id: r.masked for r in to.dead_letters(spark).collect()}
    assert set(dead) == {i for i, (_, s) in want.items() if s == "quarantine"} and log.where("id = 1 and masked = 'later'").count() == 1


def test_a_full_spool_loses_its_oldest(spark, tmp_path):
    to = Delivery(str(tmp_path / "to"), ("id",), "at", lambda b: [503] * len(b), keep=5)
    to.run(spark, spark.createDataFrame([(i, 100 - i) for i in range(8)], "id long, at long"), "0")
    to.run(spark, spark.createDataFrame([(20, 200)], "id long, at long"), "1")
    got = {r.id: (r.state, r.attempts) for r in to.settled(spark).collect()}
    assert {i for i, (s, _) in got.items() if s == "dropped"} == {4, 5, 6, 7} and got[20] == ("again", 1) and got[0] == ("again", 2)
    with pytest.raises(ValueError):
        to.run(spark, spark.createDataFrame([("x", 1, "raw")], "id string, at long, text string"), "2")


def model(rows):
    """Offers of one key at a time, as a queue takes them."""
    queued, done, out = set(), set(), []
    for key, at, kind in rows:
        if kind == "offer" and key not in queued | done:
            queued.add(key)
            out.append((key, at))
        elif kind == "next":
            queued.discard(key)
        elif kind == "complete":
            done.add(key)
    return out


def test_keys_in_flight(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"k{rng.randrange(12)}", i, rng.choices(["offer", "next", "complete"], [6, 4, 0.6])[0]) for i in range(240)]
    offers, outcomes = str(tmp_path / "offers"), str(tmp_path / "outcomes")
    for lo in range(0, 240, 80):  # failures and completions come between offers, over several batches
        put(spark, [(k, i) for k, i, x in rows[lo : lo + 80] if x == "offer"], "k string, i int", offers)
        put(spark, [(k, i, x) for k, i, x in rows[lo : lo + 80] if x != "offer"], "k string, i int, kind string", outcomes)
        got = processors.admitted(folder_stream(spark, offers, "k string, i int", 9), folder_stream(spark, outcomes, "k string, i int, kind string", 9), ["k"], "i")
        q = got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)  # and the query starts anew from its state each time
    found = sorted(((r.k, r.i) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda x: x[1])
    assert found == model(rows) and 30 < len(found) < 110


def test_rings_drain_with_their_last_run(spark, tmp_path):
    schema = "host string, i int, code string, severity string"
    codes = "aabbbacccdddddaab"
    rows = [("h", i, c, "info" if c != "c" else None) for i, c in enumerate(codes)] + [("g", 100, "a", "warn")]
    source = str(tmp_path / "in")
    put(spark, rows[:9], schema, source)
    put(spark, rows[9:], schema, source)
    stream = processors.ring(folder_stream(spark, source, schema), ["host"], "i", ["code", "severity"], capacity=3, drain_ms=6_000)
    q = stream.writeStream.format("memory").queryName("rings").option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(600):
        if empty(q) or q.exception():
            break
        q.awaitTermination(0.2)
    q.stop()
    df = spark.createDataFrame(rows, schema)
    runs = events.coalesce_runs(df, ["host"], ["i"], ["code", "severity"])
    want = events.newest(runs, ["host"], ["i"], 3).select("host", "i", "code", "severity", "count").collect()
    got = spark.table("rings").collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(tuple(r) for r in want)
    assert sum(r.dropped for r in got) == runs.count() - len(want)
