from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import transcripts
from quillmark.streaming.settings import Holder, Settings, enriched


def document(*words, **more):
    listed = {f"p{i}": {"key": f"p{i}", "kind": "multi_label", "labels": [{"id": w.upper(), "text": w}], "cls_threshold": 0.1} for i, w in enumerate(words)}
    return json.dumps({"enrichment_schema": {"passes": listed | more}, "include_entity_text": True, "client_telemetry": {"enabled": True, "min_severity": "error", "sample_rate": None}})


def test_passes_change_between_batches(spark, tmp_path):
    at, source, out, told = tmp_path / "now.json", str(tmp_path / "in"), str(tmp_path / "out"), []
    none = F.lit("")
    meta = F.struct(*(none.alias(k) for k in ("repo", "branch", "project", "tool")), F.array().cast("array<string>").alias("recent_prompts"))
    docs = spark.createDataFrame([(1, "web", "alpha beta please run"), (2, "web", "ok")], "id int, source string, text string").withColumn("meta", meta)

    def run(i):
        docs.withColumn("id", F.col("id") + 10 * i).coalesce(1).write.mode("append").parquet(source)
        holder = Holder(str(at), str(tmp_path / "good.json"), reported=told[-1] if told else "")
        stream = spark.readStream.schema(docs.schema).parquet(source)
        write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")
        enriched(stream, holder, write, reject=lambda k, why: told.append(f"{k}:{why}")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)

    odd = {"odd": {"key": "odd", "kind": "tree", "labels": [{"id": "x"}]}, "domain": {"key": "domain", "kind": "entity"}, "sys": {"key": "sys", "kind": "entity", "is_system": True}}
    at.write_text(document("alpha", **odd))
    run(0)
    at.write_text("{half")
    run(1)  # the last good one holds, over a restart
    at.write_text(document("beta", "alpha", **odd))
    run(2)
    at.unlink()
    run(3)
    got = {r.id: r for r in spark.read.option("mergeSchema", "true").parquet(out).select("id", "status", "settings_version", F.to_json("custom").alias("custom")).collect()}
    versions = [got[1 + 10 * i].settings_version for i in range(4)]
    assert versions[0] == versions[1] != versions[2] == versions[3] and got[2].status == "gated"
    labels = [{k: [x["label"] for x in v["labels"]] for k, v in json.loads(got[1 + 10 * i].custom).items()} for i in range(4)]
    assert labels[:2] == [{"p0": ["ALPHA"]}] * 2 and labels[2:] == [{"p0": ["BETA"], "p1": ["ALPHA"]}] * 2
    assert told == ["odd:unknown kind tree"], "the same rejects are told once"


def test_a_document_is_read_as_stated(spark):
    more = {"e": {"key": "e", "kind": "entity", "labels": [{"label": "email", "description": "an address"}]}, "c": {"key": "c", "kind": "single_label", "condition_on": "domain", "labels_by_cond": {"legal": [{"id": "a", "text": "A"}]}, "version": "4"}, "h": {"key": "h", "kind": "single_label", "title": "T", "labels": [{"id": "x", "text": "X", "description": "hint"}, {"id": "y"}]}}
    s = Settings.parse(document("w", **more))
    by = {p.key: p for p in s.customs}
    assert by["e"].labels == (("email", "an address"),) and by["c"].subsets == (("legal", (("a", "A"),)),) and by["c"].version == "4" and by["h"].descriptions == (("X", "hint"),) and by["h"].title == "T"
    assert by["p0"].threshold == 0.1 and s.include_entity_text and s.telemetry == {"enabled": True, "min_severity": "error"}
    assert Settings.parse("  " + document("w", **more) + "\n").version == s.version and Settings.parse("{}").customs == ()
    df = spark.createDataFrame([(1, "x", "info"), (2, "x", "error")], "event_id int, code string, severity string")
    assert [r.event_id for r in s.gated(df).collect()] == [2]
    with pytest.raises(Exception):
        Settings.parse("[]")


CASES = [
    ({"a": "/home/u/x.json", "n": 5, "f": 1.5, "b": True, "none": None, "l": [1, 2], "deep": {"deep": {"s": "one two three four", "n": -1, "l": ["x"], "d": {"p": "C:\\\\x\\\\y z"}}}}, {"a": "x.json", "n": 5, "f": 1.5, "b": True, "deep": {"deep": {"s": "<redacted>", "n": -1, "d": {"p": "<redacted>"}}}}),
    ({"s": "5", "t": "true", "e": "", "c": "a\tb", "z": "a\u200bb", "rel": "a/b"}, {"s": "5", "t": "true", "e": "", "c": "<redacted>", "z": "<redacted>", "rel": "a/b"}),
    ({}, {}), ({"m": {}}, {"m": {}}), ({"l": [{"a": 1}]}, {}),
]


def test_nested_redaction(spark):
    texts = [json.dumps(x) for x, _ in CASES] + [None, "", "[1]", "3", "{bad", '"x"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    got = {r.i: json.loads(r.o) for r in df.select("i", T.redact_json("j").alias("o")).collect()}
    assert [got[i] for i in range(len(texts))] == [want for _, want in CASES] + [{}] * 6
    deep = "x y z w"
    for _ in range(12):
        deep = {"k": deep, "n": 1}
    out = json.loads(spark.createDataFrame([(json.dumps(deep),)], "j string").select(T.redact_json("j").alias("o")).first().o)
    for _ in range(12):
        assert out["n"] == 1
        out = out["k"]
    assert out == "<redacted>"
    cut = spark.createDataFrame([('{"a":{"b":{"c":1}},"x":2}',)], "j string").select(T.redact_json("j", 2).alias("o")).first().o
    assert json.loads(cut) == {"a": {}, "x": 2}


def test_both_kinds_of_ids(spark):
    rec = lambda i, text, kind="user": json.dumps({"type": kind, "id": i, "content": text})
    lines = [json.dumps({"sessionId": "s"}), rec("u1", "first"), rec("m", "answer", "gemini"), rec("u2", [{"text": "sec"}, {"text": "ond"}]), rec("u1", "again"), rec("", "no id"), json.dumps({"$set": {"id": "u9"}})]
    prompts = transcripts.dialect_c(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "path string, off int, line string"))
    ids = ["s########0", "other########1", "u1", "u2", "s########9", "s########x", "u9", "m", "a########b########2", "inline"]
    jobs = spark.createDataFrame([("f", x, "typed" if x == "inline" else "", i) for i, x in enumerate(ids)] + [("g", "u1", None, 50)], "path string, prompt_id string, inline_text string, n int")
    got = {r.n: r.text for r in transcripts.resolve(jobs, prompts).collect()}
    assert got == {0: "first", 1: "second", 2: "first", 3: "second", 8: "again", 9: "typed"}
    said = [{"type": "user", "uuid": "x", "message": {"content": "early"}}, {"type": "user", "promptId": "p", "uuid": "y", "isSidechain": True, "message": {"content": "aside"}}, {"type": "assistant", "uuid": "z", "message": {"content": "no"}}]
    df = spark.createDataFrame([("f", i, json.dumps(x)) for i, x in enumerate(said)], "path string, off int, line string")
    assert [(r.prompt_id, r.text) for r in transcripts.dialect_a(df, context=True).orderBy("off").collect()] == [("x", "early"), ("p", "aside")] and transcripts.dialect_a(df).count() == 0
