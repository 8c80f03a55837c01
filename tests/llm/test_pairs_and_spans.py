from __future__ import annotations

import itertools
import re

import pytest
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, jaccard, repeats
from quillmark.llm.components import components

from .data import documents, frame, lower, split


def brute_components(rows):
    sets = []
    for d, t, *_ in rows:
        w = split(lower(t))
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    rows_root = list(range(len(sets)))

    def top(i):
        while rows_root[i] != i:
            i = rows_root[i]
        return i

    for (i, (a, x)), (j, (b, y)) in itertools.combinations(enumerate(sets), 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
            i, j = top(i), top(j)
            rows_root[max(i, j)] = min(i, j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least[top(i)] if d is not None else None) for i, (d, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize("seed, shuffled", [(3, False), (11, False), (3, True)])
def test_jaccard_join_is_the_brute_force(spark, monkeypatch, seed, shuffled):
    rows = documents(seed)
    if shuffled:  # as with very many sets and pairs: shuffled joins, several blocks
        monkeypatch.setattr(jaccard, "BROADCAST_SETS", 0)
        monkeypatch.setattr(jaccard, "BLOCK_PAIRS", 5)
    got = jaccard.near_duplicates(frame(spark, rows, extra=True), 5).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)


def test_jaccard_large_group_of_near_copies(spark):
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        near = list(base)
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(near), "en", "s", 1))
    got = jaccard.near_duplicates(frame(spark, rows), 5).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)


def test_jaccard_a_shingle_of_every_document(spark):
    import random

    from quillmark.llm.common import joined

    rng = random.Random(7)
    rows = [(i, " ".join(["the same five words here", *(f"u{rng.randrange(10**9)}" for _ in range(20))]), "en", "s", 1) for i in range(300)]
    rows += [(1000 + i, "the same five words here " + " ".join(f"n{k}" for k in range(30)) + f" z{i}" * (i % 2), "en", "s", 1) for i in range(40)]
    df = frame(spark, rows).coalesce(2)
    got = jaccard.near_duplicates(df, 5).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)
    # The shared shingle travels once per slice, not once per document.
    sent = df.select("doc_id", "text").mapInArrow(jaccard._pack_documents(5, 4), jaccard._PACKED).where("kind = 0").toArrow()
    assert len(joined(sent["c"], "<u4")) + len(joined(sent["d"], "<u4")) < 300 * 20 + 300 * 6 and len(joined(sent["d"], "<u4")) > 0


@pytest.mark.parametrize("shared", [False, True])
def test_jaccard_one_row_of_each_component(spark, shared):
    rows = [r for r in documents(3) if shared or r[0] is not None]
    if not shared:
        rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    else:
        rows += [(8, "another text under the id of a copy, unlike all others there are", "de", "x", 1)] * 3
    got = [tuple(r) for r in jaccard.representatives(frame(spark, rows), 5).collect()]
    sets = {}
    for d, t, *_ in rows:
        w = split(lower(t))
        sets[d, t] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    listed = sorted({(d, t) for d, t, *_ in rows if d is not None and sets[d, t]})
    groups, todo = [], set(listed)
    while todo:
        group, edge = set(), {min(todo)}
        while edge:
            group |= edge
            edge = {y for y in todo - group for x in edge if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
        todo -= group
        groups.append(group)
    kept = [(r[0], r[1]) for r in got if r[0] is not None and sets[r[0], r[1]]]
    assert len(kept) == len(groups) and all(sum(k in g for k in kept) == 1 and min(d for d, _ in g) == next(k[0] for k in kept if k in g) for g in groups)
    rest = [r for r in rows if r[0] is None or not sets[r[0], r[1]]]
    assert sorted((r for r in got if r[0] is None or not sets[r[0], r[1]]), key=repr) == sorted(rest, key=repr)


def test_jaccard_empty(spark):
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (2, 1), (10, 5)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: 1, 10: 1, 9: 8} | {101 + i: 100 for i in range(30)}


def brute_repeats(rows, n=50):
    listed = [(d, split(t)) for d, t, *_ in rows]
    first: dict = {}
    for d, w in listed:
        for i in range(len(w) - n + 1):
            if d is not None:
                k = tuple(w[i : i + n])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in listed:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [3, 11])
def test_repeats_are_the_brute_force(spark, seed):
    rows = documents(seed)
    got = repeats.remove(frame(spark, rows).select("doc_id", "text")).collect()
    assert sorted(((r.doc_id, r._n_words, r._n_removed, r._kept) for r in got), key=repr) == brute_repeats(rows)
    for r in got:
        assert sum(s.end - s.start for s in r._spans) == r._n_removed


def test_repeats_split_the_suffixes_before_a_frequent_line(spark):
    import random
    from collections import Counter

    import numpy as np

    rng = random.Random(4)
    line = [f"l{i}" for i in range(40)]  # shorter than a window, so the windows differ
    tail = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join([*(f"a{rng.randrange(10**9)}" for _ in range(60)), *line, *(f"b{rng.randrange(10**9)}" for _ in range(60)), *(tail if i % 100 == 0 else [])])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts, sent, runs = 16, {}, {}
    for most in (100, repeats.HEAVY):
        heavy = repeats._heavy(docs, 50, parts * repeats.BUCKETS, most)
        assert heavy.any() == (most == 100) and len(heavy) == -(-parts * repeats.BUCKETS // 8)
        got = docs.mapInArrow(repeats._send(50, parts, spark.sparkContext.broadcast(heavy)), repeats.RUNS).where("kind = 0").collect()
        sent[most] = Counter()
        for r in got:
            sent[most][r.part] += int(np.frombuffer(r.lengths, "<u4").sum())
        runs[most] = sorted({tuple(r) for r in repeats.repeated_spans(docs, heavy=most).selectExpr("doc_id", "row_key", "explode(sequence(start, end - 1)) as word").collect()})
    assert sum(sent[100].values()) == sum(sent[repeats.HEAVY].values())
    mean = sum(sent[100].values()) / parts
    assert max(sent[100].values()) < 1.5 * mean < max(sent[repeats.HEAVY].values())
    assert runs[100] == runs[repeats.HEAVY] and len(runs[100]) == 3 * 60


@pytest.mark.parametrize("depth", [1, 5, 50])
def test_nodes_are_equal_words(depth):
    import random

    import numpy as np
    import pyarrow as pa

    from quillmark.llm.common import Words

    rng = random.Random(depth)
    texts = [" ".join(rng.choice("ab" if depth == 5 else ["x", "é", "long-word"]) for _ in range(rng.randint(depth, 130))) for _ in range(6)]
    texts += [texts[0], " ".join(["z"] * 120), "y " + texts[1]]
    words, listed = Words(pa.array(texts), lower=False), [split(t) for t in texts]
    at = np.array([int(words.off[r]) + i for r, w in enumerate(listed) for i in range(len(w) - depth + 1) if (r + i) % 3])
    flat = [x for w in listed for x in w]
    got: dict = {}
    for i, node in zip(at.tolist(), repeats.nodes(words, at, depth).tolist()):
        got.setdefault(node, set()).add(tuple(flat[i : i + depth]))
    assert all(len(v) == 1 for v in got.values()) and len(got) == len(set().union(*got.values()))


def test_repeats_replace_clashing_columns(spark):
    rows = documents(3)
    got = repeats.remove(frame(spark, rows, extra=True).withColumn("_doc", F.lit("clash")))
    assert dict(got.dtypes)["_kept"] == "string" and got.columns.count("_found") == 0 and got.where("n_words = 'clash' and part = 'clash'").count() == len(rows)
    assert sorted(((r.doc_id, r._n_words, r._n_removed, r._kept) for r in got.collect()), key=repr) == brute_repeats(rows)


def test_repeats_empty(spark):
    assert repeats.remove(frame(spark, []).select("doc_id", "text")).count() == 0


def brute_hits(rows, items, n=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows: dict = {}
    for item, t in items:
        w = find(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for d, t, *_ in rows:
        w, found = find(t), set()
        gone = [False] * len(w)
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    found |= windows[tuple(w[i : i + k])]
                    gone[i : i + k] = [True] * k
        out.append((d, len(w), sum(gone), ",".join(sorted(found)), sum(gone) > 0 and 20 * sum(gone) >= len(w)))
    return sorted(out, key=repr)


def benchmark(rows):
    texts = [t for _, t, *_ in rows if t]
    long = split(texts[-5])
    return [(1, " ".join(long[3:25])), (2, " ".join(long[3:25]).upper()), (3, "one two THREE"), (4, "one"), (5, None), (6, ""), (None, "one"), (7, texts[5]), (8, "no such words stand anywhere in here at all really not one of them")]


@pytest.mark.parametrize("block", [200_000, 300])
def test_decontamination_is_the_brute_force(spark, monkeypatch, block):
    rows = documents()
    # One item is a whole long document, so that windows fill several blocks; shingles are counted in several passes.
    items = [*benchmark(rows), (9, next(t for _, t, *_ in rows if t and len(t) > 20_000)[:9_000])]
    if block == 300:
        monkeypatch.setattr(decontaminate, "TOKENS", 500)
        assert spark.createDataFrame(items, "item_id long, text string").transform(decontaminate.windows).count() > 3 * block
    found = decontaminate.judged(decontaminate.spans(frame(spark, rows, extra=True), spark.createDataFrame(items, "item_id long, text string"), block=block)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(sorted(r["items"])), r.contaminated) for r in found), key=repr)
    assert got == brute_hits(rows, items)


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.spans(frame(spark, documents()).select("doc_id", "text"), none).where("size(items) > 0").count() == 0
    assert decontaminate.spans(frame(spark, []).select("doc_id", "text"), none).count() == 0
