from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.llm import infill

from .data import documents, frame


def expected(doc_id, text, seed=1, plain=10, spm=20, marks=infill.MARKS):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    p, s, m = marks
    if not text or any(x in text for x in marks) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    out = f"{s}{suffix}{p}{prefix}{m}{middle}" if h[3] % 100 < spm else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return n, "spm" if out.startswith(s) else "psm", len(prefix), len(middle), out


def rows():
    rng = random.Random(8)
    out = [(d, t) for d, t, *_ in documents()]
    out += [(900 + i, "".join(rng.choice(["a", "Bc", "é", "漢", "🙂", " ", "\n", "\0", "<", "S>", "<S", "P>", "1", "İ"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    out += [(2000, "x<P>y"), (2001, "<M>"), (2002, "<"), (2003, "A" * 5000), (2004, "é" * 3000 + "ab " * 4000), (None, "no id"), (None, None), (2002, "<")]
    return out


@pytest.mark.parametrize("how", [{}, {"seed": 7, "plain": 0, "spm": 50}, {"plain": 0, "spm": 100, "marks": ("[pre]", "{suf}", "(mid)")}])
def test_every_row_is_the_brute_force(spark, how):
    docs = frame(spark, [(d, t, "en", "s", 0) for d, t in rows()], extra=True)
    got = infill.transformed(docs, **how).withColumn("back", infill.restored(marks=how.get("marks", infill.MARKS)))
    assert {"score", "lang", "text", "_kept"} <= set(got.columns)
    found = [(r.doc_id, r.text, (r._n, r._form, r._prefix_chars, r._middle_chars, r._output), r.back) for r in got.collect()]
    assert len(found) == len(rows())
    for doc_id, text, made, back in found:
        assert made == expected(doc_id, text, **how)
        assert back == (text or "")
    assert {f[2][1] for f in found} >= {"plain", "spm"}


def test_long_text_over_chunks(monkeypatch):
    monkeypatch.setattr(infill, "CHUNK", 64)
    rng = random.Random(1)
    texts = ["".join(rng.choice(["word", "é", " ", "漢"]) for _ in range(rng.choice([0, 3, 700]))) for _ in range(40)]
    h = np.array([rng.randrange(1 << 32) for _ in texts]), np.array([rng.randrange(1 << 32) for _ in texts])
    got = infill.cuts(pa.array(texts), *h)
    for i, t in enumerate(texts):
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        a, b = sorted(int(x[i]) % (len(tokens) + 1) for x in h)
        assert [int(got[k][i]) for k in got] == [len(tokens), len("".join(tokens[:a]).encode()), len("".join(tokens[a:b]).encode()), len("".join(tokens[:a])), len("".join(tokens[a:b]))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=1500))
def test_rank_and_select(bits):
    held = infill.Bits(len(bits), iter([np.array(bits, bool)]))
    ones = [i for i, b in enumerate(bits) if b]
    assert held.rank(np.arange(len(bits) + 1)).tolist() == np.concatenate([[0], np.cumsum(bits)]).astype(int).tolist()
    assert held.select(np.arange(len(ones))).tolist() == ones


def test_clashing_columns_empty_table_and_marks(spark):
    docs = frame(spark, [])
    assert infill.transformed(docs).count() == 0
    clash = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string").withColumn("_N", F.lit("x")).withColumn("_output", F.lit(3))
    assert infill.transformed(clash).columns == ["doc_id", "text", *infill.NEW]
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.transformed(docs, marks=marks)
