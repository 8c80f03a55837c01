from __future__ import annotations

from collections import Counter

import numpy as np

import corpus_pipeline
from quillmark.llm import quality

from .data import documents, frame
from .test_pairs_and_spans import benchmark, brute_components, brute_hits, brute_repeats
from .test_files_and_places import whole_ids


def test_pipeline_is_the_brute_force(spark, tmp_path, monkeypatch):
    rows = [r for r in documents(9) if r[0] is not None]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    frame(spark, rows, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int("%" not in (r[1] or "")), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = benchmark(rows)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # The learned rules by themselves; what follows them by brute force.
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in quality.score(docs.select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/labels.parquet"), ["doc_id"]).collect() if r.predicted}
    kept = [r for r in rows if r[0] in good]
    least = {d: c for d, _, c in brute_components(kept)}
    kept = [r for r in kept if least[r[0]] == r[0]]
    texts = {d: (t if not gone else left) for (d, n, gone, left), (_, t) in zip(brute_repeats(kept), sorted(((r[0], r[1]) for r in kept), key=repr)) if not gone or gone < n}
    kept = [(d, t) for d, t in texts.items()]
    dirty = {d for d, *_, bad in brute_hits(kept, items) if bad}
    want = Counter()
    for d, t in kept:
        if d not in dirty:
            ids = np.array([*whole_ids(t), 0], "<u4").tobytes()
            want.update((d, k, ids[8192 * k : 8192 * k + 8192]) for k in range(-(-len(ids) // 8192)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, bytes(r.ids)) for r in got) == want
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns and dict(stage.dtypes) == dict(docs.dtypes), name


def test_pipeline_of_nothing(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
