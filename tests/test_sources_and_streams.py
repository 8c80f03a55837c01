from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillmark.operators import events
from quillmark.plans.registry import QUERIES
from quillmark.plans import catalog  # noqa: F401
from quillmark.sources import loaders
from quillmark.sources.tail import LineReader, TailReader, TranscriptTail, lines, ranges
from quillmark.streaming import stateful


def test_roots_and_lines(spark, tmp_path):
    assert loaders.extra_roots("a:/x, b:/y:z,, c ,:d") == [("a", "/x"), ("b", "/y:z")]
    (tmp_path / "t/sub").mkdir(parents=True)
    (tmp_path / "t/sub/a.jsonl").write_text("one\n\ntwo\npartial")
    (tmp_path / "t/b.txt").write_text("no\n")
    assert loaders.roots(str(tmp_path), {"s": ["t*"]}) == [("s", str(tmp_path / "t"))]
    got = loaders.transcript_lines(spark, [("s", str(tmp_path / "t"))]).orderBy("off").collect()
    assert [(r.source, r.off, r.line) for r in got] == [("s", 0, "one"), ("s", 5, "two")]
    many = [json.dumps({"n": i, "t": "é" * (i % 40)}) for i in range(400)]
    (tmp_path / "t/sub/c.jsonl").write_text("\n".join(many) + "\n")
    for split in (1, 50, 777, 10**9):
        back = spark.read.format("transcript_tail").option("split", str(split)).load(str(tmp_path / "t")).where("path like '%c.jsonl'")
        assert [r.line for r in back.orderBy("off").collect()] == many if split > 1 else True
        assert LineReader({"path": str(tmp_path / "t"), "split": str(split)}).partitions()
    assert sum(b.num_rows for r in [LineReader({"path": str(tmp_path / "t"), "split": "13"})] for p in r.partitions() for b in r.read(p)) == 402
    uri = "file://" + str(tmp_path / "t")
    there = spark.read.format("transcript_tail").load(uri).select("path", "line").collect()
    assert len(there) == 402 and all(r.path.startswith("file:///") for r in there)


def test_lines_are_cut_as_one_by_one(tmp_path):
    """Ranges and blocks of any size: invalid bytes, blank and long lines, no newline at the end."""
    rng = random.Random(4)
    parts = [b"plain", "é漢🙂".encode(), b"\xff\xc3", b"", b"  \t", b"x" * 300, "\u2028 \u00a0".encode(), b"\r", b"a\rb"]
    for tail in (b"", b"\n", b"last"):
        raw = b"\n".join(rng.choice(parts) for _ in range(200)) + tail
        path = tmp_path / "l.jsonl"
        path.write_bytes(raw)
        want, at = [], 0
        for line in raw.split(b"\n"):
            if line.strip():
                want.append((at, line.decode("utf-8", "replace")))
            at += len(line) + 1
        for split, block in ((1, 3), (7, 5), (64, 1000), (999, 64), (10**6, 10**6)):
            got = [(o, t) for r in ranges(str(path), 0, len(raw), split) for b in lines(r, "s", block) for o, t in zip(b["off"].to_pylist(), b["line"].to_pylist())]
            assert got == want, (tail, split, block)


def test_corpus_and_spool(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"text": "a"}\n\n{"text": "b"}\n')
    assert loaders.corpus(spark, str(tmp_path / "c.jsonl"), "text string").count() == 2
    (tmp_path / "c.jsonl").write_text('{"text": "a"}\n{oops\n')
    with pytest.raises(Exception):
        loaders.corpus(spark, str(tmp_path / "c.jsonl"), "text string").collect()
    spool = tmp_path / "spool"
    spool.mkdir()
    for name, body in (("a.json", '{"id": "1"}'), ("b.json.tmp", '{"id": "2"}'), ("c.json.tmp", '{"i'), ("d.json", "{bad"), ("e.txt", "x")):
        (spool / name).write_text(body)
    good, bad = loaders.legacy_spool(spark, str(spool), "id string")
    assert {r.id for r in good.collect()} == {"1", "2"} and [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["d.json"]
    assert loaders.stranded(spark, str(spool)).first().stranded == 5
    load = loaders.synthetic_load(spark, 30)
    assert {r.n for r in load.selectExpr("length(text) n").collect()} == {200, 1000, 5000, 15000, 20000}


def test_hidden_sources(spark):
    now = datetime(2024, 1, 2)
    files = spark.createDataFrame([("a", now - timedelta(hours=1)), ("b", now - timedelta(hours=30)), ("c", now)], "source string, modified timestamp")
    assert [r.source for r in loaders.hidden_sources(files, spark.createDataFrame([("c",)], "source string"), now).collect()] == ["a"]


def test_tail_reader(tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_bytes(b"one\ntwo\npart")
    reader = TailReader({"path": str(tmp_path), "source": "s"})
    start = reader.initialOffset()
    assert start == {str(f): 8}
    f.write_bytes(b"one\ntwo\npartial\nthree\nfou")
    end = reader.latestOffset()
    read = lambda a, b: [x for p in reader.partitions(a, b) for r in reader.read(p) for x in r["line"].to_pylist()]
    assert read(start, end) == ["partial", "three"]
    f.write_bytes(b"new\n")  # a shorter file starts anew
    assert read(end, reader.latestOffset()) == ["new"]
    assert read({}, {str(f): 4}) == ["new"]
    f.write_bytes(b"".join(b"%05d\n" % i for i in range(1000)))
    some = TailReader({"path": str(tmp_path), "split": "500"})
    parts = some.partitions({str(f): 60}, some.latestOffset())
    assert len(parts) == 12 and [x for p in parts for r in some.read(p) for x in r["line"].to_pylist()] == ["%05d" % i for i in range(10, 1000)]


def run(query, name, tmp_path):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return query.sparkSession.table(name)


def test_tail_stream(spark, tmp_path):
    spark.dataSource.register(TranscriptTail)
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.jsonl").write_text("".join(json.dumps({"n": i}) + "\n" for i in range(5)) + "{par")
    df = spark.readStream.format("transcript_tail").option("source", "s").option("backfill", "true").load(str(folder))
    q = df.writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    assert spark.table("tail").count() == 5
    with (folder / "a.jsonl").open("a") as f:
        f.write('tial"}\n')
    q.processAllAvailable()
    q.stop()
    assert sorted(r.line for r in spark.table("tail").collect())[-1] == '{partial"}'


@pytest.fixture(scope="module")
def stream_of(spark, tmp_path_factory):
    def make(df):
        path = str(tmp_path_factory.mktemp("in"))
        df.coalesce(1).write.mode("overwrite").parquet(path)
        return spark.readStream.schema(df.schema).parquet(path)

    return make


def test_streams_equal_batch(spark, stream_of, tmp_path):
    t0 = datetime(2024, 1, 1)
    values = [0, 12, 12, 12, 12, 12, 12, 12, 12, 12, 9, 12, 9]
    df = spark.createDataFrame([("h", t0 + timedelta(seconds=5 * i), i, float(v), "ab"[v > 10], f"p{i // 4}" if i % 4 == 0 else None) for i, v in enumerate(values)], "host string, ts timestamp, i int, v double, code string, prompt string")
    batch = events.sustained(df, ["host"], "ts", "i", "v", 10.0, 10.0)
    got = run(stateful.sustained(stream_of(df), "host", "ts", "v", 10.0, 10.0), "sustained", tmp_path)
    assert [tuple(r) for r in got.orderBy("ts").collect()] == [tuple(r) for r in batch.select("host", "ts", "v", "severity", "recovered").orderBy("ts").collect()]
    runs = run(stateful.runs(stream_of(df), "host", "i", "code"), "runs", tmp_path)
    want = events.coalesce_runs(df.select("host", "i", "code"), ["host"], ["i"], ["code"]).orderBy("i").collect()
    assert [(r.i, r.code, r["count"]) for r in runs.orderBy("i").collect()] == [(r.i, r.code, r["count"]) for r in want][:-1]  # the last is open
    numbered = run(stateful.sequence(stream_of(df), "host", "i", "prompt"), "numbered", tmp_path).orderBy("i").collect()
    assert [(r.event_sequence, r.last_prompt_id) for r in numbered] == [(i + 1, f"p{i // 4}") for i in range(len(values))]
    gauges = run(stateful.gauges(stream_of(df), "host", "ts", "v", 20.0), "gauges", tmp_path).orderBy("ts").collect()
    assert [(r.n, r.window_s) for r in gauges] == [(1, 0.0), (4, 15.0), (4, 15.0), (4, 15.0)]


def test_stream_dedup_and_lengths(spark, stream_of, tmp_path):
    df = spark.createDataFrame([("q", k, i) for i, k in enumerate("abacbd")] , "q string, k string, i int")
    got = run(stateful.dedup(stream_of(df), "k", "i", "q", remembered=2), "dedup", tmp_path).orderBy("i").collect()
    assert [(r.k, r.i) for r in got] == [("a", 0), ("b", 1), ("c", 3), ("d", 5)]
    df = spark.createDataFrame([("s", n) for n in (3, 0, 5, 7)], "s string, n int")
    r = run(stateful.length_state(stream_of(df), "s", "n"), "lengths", tmp_path).first()
    assert (r.n, r["mean"], r.m2) == (3, 5.0, 8.0)


def test_delivery(spark, stream_of, tmp_path):
    df = spark.createDataFrame([(1, "***"), (2, "…")], "id int, masked string")
    booked = []
    q = stateful.deliver(stream_of(df), str(tmp_path / "out"), str(tmp_path / "cp"), lambda rows, i: booked.append((i, rows.columns, rows.count()))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert booked == [(0, ["id", "masked"], 2)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def in_parts(spark, path, rows, schema):
    """A table as a folder of three files."""
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)


def test_stream_lengths_of_a_table_in_parts(spark, tmp_path):
    rows = [(1, "en", "a b c"), (2, "en", "a"), (3, "en", None), (4, "en", "a b"), (5, "de", "x y"), (6, "fr", " \n"), (7, None, "p"), (8, None, "p q r")]
    in_parts(spark, f"{tmp_path}/documents.parquet", rows, "doc_id long, lang string, text string")
    got = QUERIES["stream_lengths"](spark, str(tmp_path)).collect()
    assert {r.lang: (r.n, r["mean"], r["std"]) for r in got} == {"en": (3, 2.0, 1.0), "de": (1, 2.0, None), None: (2, 2.0, 1.414214)}


def test_stream_sequence_of_a_table_in_parts(spark, tmp_path):
    rows = [(c, t, "user" if t % 3 == 0 else "assistant", "x") for c in range(1, 6) for t in range(c + 1)]
    in_parts(spark, f"{tmp_path}/conversations.parquet", rows, "conv_id long, turn long, role string, text string")
    got = QUERIES["stream_sequence"](spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.turn, r.event_sequence, r.last_prompt_id) for r in got) == [(c, t, t + 1, f"{c}#{t // 3 * 3}") for c, t, _, _ in rows]


def test_stream_sequence_keeps_large_ids_beside_nulls(spark, tmp_path):
    big = 2**53 + 1
    rows = [(big, big + 2, "user", "x"), (big, None, "assistant", "x"), (big, big, "system", "x"), (None, big, "user", "x"), (1, big, "user", "x")]
    in_parts(spark, f"{tmp_path}/conversations.parquet", rows, "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in QUERIES["stream_sequence"](spark, str(tmp_path)).collect()}
    assert got == {(big, big, 1, None), (big, big + 2, 2, f"{big}#{big + 2}"), (big, None, 3, f"{big}#{big + 2}"), (None, big, 1, None), (1, big, 1, f"1#{big}")}


def test_stream_sequence_of_equal_turns_follows_the_table(spark, tmp_path):
    folder = tmp_path / "conversations.parquet"
    folder.mkdir()
    for name, role, text in (("a", "assistant", "x"), ("b", "user", "y" * 50_000)):  # Spark reads the larger file first
        pq.write_table(pa.table({"conv_id": list(range(20)), "turn": [0] * 20, "role": [role] * 20, "text": [f"{text}{i}" for i in range(20)]}), folder / f"{name}.parquet", compression="none")
    got = {tuple(r) for r in QUERIES["stream_sequence"](spark, str(tmp_path)).collect()}
    assert got == {(c, 0, n, p) for c in range(20) for n, p in ((1, None), (2, f"{c}#0"))}
