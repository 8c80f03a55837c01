"""Texts longer than a slice: each operator takes them whole."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, infill, jaccard, repeats, sharding, toxicity
from quillmark.llm.common import SLICE_BYTES

from .data import frame


@pytest.fixture(scope="module")
def docs(spark):
    """A long text, a near copy of it, one that ends with a passage of it, short ones."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}x" for _ in range(1_100_000)]
    near = list(words)
    for i in range(0, len(near), 1000):
        near[i] = "changed"
    tail = ["lead", "in", *words[-60:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(tail)), (4, "short one"), (5, None)]
    assert len(rows[0][1]) > SLICE_BYTES
    return words, rows, frame(spark, [(d, t, "en", "s", 0) for d, t in rows]).coalesce(1).cache()


def test_jaccard(docs):
    words, _, df = docs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    shingles = len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert got[1] == (shingles, 1) and got[2][1] == 1 and got[3] == (58, 3) and got[4] == (1, 4) and got[5] == (0, 5)


def test_repeats(docs):
    words, rows, df = docs
    got = {r.doc_id: (r._n_words, r._n_removed) for r in repeats.remove(df).select("doc_id", "_n_words", "_n_removed").collect()}
    # Every word of the near copy that lies in an unchanged run of a window or more goes; runs are 999 words long.
    assert got[1] == (len(words), 0) and got[2] == (len(words), len(words) - 1100) and got[3] == (62, 60) and got[4] == (2, 0) and got[5] == (0, 0)


def test_decontamination(spark, docs):
    words, _, df = docs
    items = spark.createDataFrame([(7, " ".join(words[500_000:500_020])), (8, "no such words anywhere at all " * 3)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.judged(decontaminate.spans(df.select("doc_id", "text"), items)).select("doc_id", "n_words", "n_hit", "n_items").collect()}
    assert got[1] == (len(words), 20, 1) and got[2][1:] == (19, 1) and got[3] == (62, 0, 0) and got[5] == (0, 0, 0)


def test_scores_shards_and_cuts(docs):
    words, rows, df = docs
    lexicon = toxicity.Lexicon({toxicity.fold(words[-1])[0]: 2.0}, (), (0.0, 1.0, 1.0))
    got = {r.doc_id: r for r in toxicity.score(df, lexicon, ["doc_id"]).collect()}
    assert got[1].n_words == len(words) and got[1].n_terms >= 1 and got[3].n_terms == 1 and 0 <= got[1].score <= 1
    sizes = {r.doc_id: r.size for r in sharding.shards(df, 2).collect()}
    assert sizes == {d: len((t or "").encode()) + 8 for d, t in rows}
    made = infill.transformed(df.select("doc_id", "text")).select("doc_id", "_n", F.sha2(infill.restored(), 256).alias("back"))
    for r in made.collect():
        text = dict(rows)[r.doc_id] or ""
        assert r.back == hashlib.sha256(text.encode()).hexdigest() and (r.doc_id != 4 or r._n == 3)
