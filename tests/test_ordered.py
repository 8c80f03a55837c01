"""Ordered folds over few long groups, cut into chunks: as over one window, whatever the chunks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import loadstats, ordered, queueing


@pytest.fixture(scope="module")
def rows(spark):
    """One group of nearly all rows, small ones, a null one; null and negative values."""
    rng = random.Random(2)
    made = [("a" if i % 9 else rng.choice(["b", "c", None, "d"]), i * 37 % 1009, None if i % 31 == 0 else rng.uniform(-5, 20), rng.randint(1, 30)) for i in range(1009)]
    made.append(("alone", 5000, 3.0, 7))
    return made, spark.createDataFrame(made, "k string, i long, v double, n long").repartition(7)


def groups(made):
    out = {}
    for r in sorted(made, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("size", [40, 333, 10**6])
def test_chunks_of_any_size(rows, size):
    made, df = rows
    got = {r.k: r.ewma for r in loadstats.ewma(df, ["k"], ["i"], "v", 0.3, size).collect()}
    grown = {r.k: r.growth for r in loadstats.half_growth(df, ["k"], ["i"], "v", size).collect()}
    for k, g in groups(made).items():
        mean, values = None, [r[2] for r in g]
        for v in (v for v in values if v is not None):
            mean = v if mean is None else 0.3 * v + 0.7 * mean
        assert got[k] == pytest.approx(mean, abs=1e-9)
        early, late = ([v for v in part if v is not None] for part in (values[: len(g) // 2], values[len(g) // 2 :]))
        assert grown[k] == pytest.approx(sum(late) / len(late) - sum(early) / len(early) if early and late else 0.0, abs=1e-9)
    kept = {r.i for r in queueing.evict(df, ["k"], "i", "n", 900, size).collect()}
    batched = {r.i for r in queueing.evict_batches(df, ["k"], "i", "n", 900, 16, size).collect()}
    done = {r.i for r in queueing.last_completed(df, ["k"], ["i"], 50, size).collect()}
    left = {r.i for r in loadstats.trimmed(df, ["k"], ["i"], 0.25, size).collect()}
    for g in groups(made).values():
        mine = {r[1] for r in g}
        total, want = 0, set()
        for r in reversed(g):
            total += r[3]
            if total > 900:
                break
            want.add(r[1])
        assert kept & mine == want
        parts = [g[a : a + 16] for a in range(0, len(g), 16)]
        while sum(r[3] for p in parts for r in p) > 900:
            parts.pop(0)
        assert batched & mine == {r[1] for p in parts for r in p}
        assert done & mine == {r[1] for r in g[-50:]} and left & mine == {r[1] for r in g[int(len(g) * 0.25) :]}
    one = {r.i for r in queueing.evict(df, [], "i", "n", 3000, size).collect()}
    total, want = 0, set()
    for r in sorted(made, key=lambda r: -r[1]):
        total += r[3]
        if total > 3000:
            break
        want.add(r[1])
    assert one == want


def test_no_task_holds_more_than_a_chunk(spark):
    df = spark.range(20_000).selectExpr("1 as k", "id as i", "cast(id % 7 as double) as v")
    cut = ordered.chunks(df, ["k"], ["i"], 1_000)
    sizes = [r["count"] for r in cut.rows.groupBy("_chunk").count().collect()]
    assert not cut.one and len(sizes) >= 15 and max(sizes) < 2_000 and sum(sizes) == 20_000
    per = cut.summed({"lo": F.min("i"), "hi": F.max("i")}).orderBy("_chunk").collect()
    assert all(a.hi < b.lo for a, b in zip(per, per[1:]))


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, i long, v double, n long")
    assert loadstats.ewma(none, ["k"], ["i"], "v").count() == loadstats.half_growth(none, ["k"], ["i"], "v").count() == queueing.evict(none, ["k"], "i", "n", 9).count() == 0
