from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import centroids, neardup_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def unit(x):
    return x / np.linalg.norm(x)


def groups(seed: int = 5, sizes=(2, 2, 3, 5, 40, 150), alone: int = 250, dim: int = 64):
    """Rows with groups of near copies about a base, two groups with a bridge, exact copies, and all that must link with nothing."""
    rng = np.random.default_rng(seed)
    rows = []

    def add(v, label):
        rows.append((len(rows), None if v is None else [None if x is None else float(x) for x in v], label))

    for k, n in enumerate(sizes):
        base = unit(rng.standard_normal(dim))
        for _ in range(n):
            add(unit(base + unit(rng.standard_normal(dim)) * rng.uniform(0.02, 0.2)), k % 3)
    a = unit(rng.standard_normal(dim))
    b = unit(rng.standard_normal(dim))
    for t in np.linspace(0, 1, 9):  # a chain: neighbours are linked, ends are not
        add(unit((1 - t) * a + t * b), 1)
    same = unit(rng.standard_normal(dim))
    for k in range(30):
        add(same * (1 + k % 3), 2)
    add(same, 0)  # another label
    add(same, None)
    for _ in range(alone):
        add(unit(rng.standard_normal(dim)), int(rng.integers(3)))
    add(None, 1), add([], 1), add([0.0] * dim, 1), add([*same[:-1], None], 2), add([*same[:-1], math.nan], 2), add([*same[:-1], math.inf], 2)
    add(same[:8], 2), add(unit(same[:8]), 2), add(same * 1e30, 2), add(same * 1e-30, 2)
    rng.shuffle(rows)
    return rows


def brute(rows, threshold=0.93):
    """Links and least reachable ids, by all pairs."""
    ok = [(i, r, np.array(r[1], np.float64)) for i, r in enumerate(rows) if r[0] is not None and r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, (i, r, x) in enumerate(ok):
        for j, s, y in ok[p + 1 :]:
            if r[2] == s[2] and len(x) == len(y) and (x / np.abs(x).max()) @ (y / np.abs(y).max()) / np.linalg.norm(x / np.abs(x).max()) / np.linalg.norm(y / np.abs(y).max()) >= threshold:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r, _ in ok:
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], n[i], least.get(find(i), r[0])) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("small", [512, 16])
def test_links_are_the_brute_force(spark, small):
    rows = groups() + [(3, [1.0] * 64, 1), (3, [1.0] * 64, 1), (None, [1.0] * 64, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("rid", "root", "n", "part", "vec", "kept", "dim"):
        df = df.withColumn(c, F.lit("clash"))
    found = neardup_vectors.near_duplicates(df, window=24, recall=0.999, small=small)
    assert dict(found.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    got = found.collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_narrow_windows_miss_no_link_of_what_they_join(spark):
    rows = groups(seed=9, sizes=(300, 2, 2, 2, 4), alone=400)
    found = {r.vec_id: r for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), window=8, recall=0.97).collect()}
    want = brute(rows)
    assert all(found[v].n_links <= n for v, n, _ in want)
    assert sum(found[v].n_links for v, n, _ in want) >= 0.95 * sum(n for _, n, _ in want)


def test_ranges_of_any_size_are_one_order(spark):
    """The union over ranges of a few vectors each is the window over the whole order."""
    rows = [(i, v, label) for i, v, label in groups(seed=3, sizes=(60, 60), alone=0) if v and len(v) == 64 and label is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    vectors = spark.createDataFrame([(i, i, str(label), 64, np.array(v, np.float64).tobytes(), [i * 7919 % 101]) for i, v, label in rows], "rid long, vec_id long, label string, dim int, vec binary, keys array<long>")
    window, seen = 10, {}
    for parts in (1, 40):
        pairs = set()
        for t in neardup_vectors.one_pass(vectors, 0, parts, window, 0.93):
            pairs |= {(r.a.rid, r.b.rid) for r in t.where("a is not null").collect()}
        root = {i: i for i, *_ in rows}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[find(a)] = find(b)
        parted = {}
        for i in root:
            parted.setdefault(find(i), set()).add(i)
        seen[parts] = sorted(map(sorted, parted.values()))
    assert seen[1] == seen[40] and max(map(len, seen[1])) > window


def test_passes_follow_the_largest_group():
    need = [neardup_vectors.passes_needed(n, 128, 0.93, 0.97) for n in (0, 100, 5_000, 10**6, 10**9)]
    assert need == sorted(need) and need[0] == 1 and need[-1] > 4 * need[2]


def test_no_vectors(spark):
    assert neardup_vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(1, None, 1), (2, [1.0, 2.0], None), (3, [1.0, 2.0], 4)], SCHEMA)
    assert sorted(tuple(r) for r in neardup_vectors.near_duplicates(only).collect()) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def lloyd(rows, k, rounds, dim, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(scale * x) <= centroids.LIMIT for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0))[:k]
    c = [v for _, v in first]

    def assign():
        return [min((sum((p - q) ** 2 for p, q in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, a) in zip(kept, at) if a == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    inertia = [sum(d for d, a in at if a == j) for j in range(len(c))]
    return sorted(((i, a, d, inertia[a], sum(inertia), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), (d, a) in zip(kept, at)), key=repr)


@pytest.mark.parametrize(("k", "rounds", "dim", "scale"), [(40, 5, 64, 256.0), (7, 4, 2, 8.0), (1, 2, 2, 3.0), (2, 3, 2, 50_000.0), (900, 1, 2, 16.0)])
def test_clusters_are_a_full_scan(spark, k, rounds, dim, scale):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((9, dim)) * 2
    rows = [(i, [float(np.float32(x)) for x in base[i % 9] + rng.standard_normal(dim) * 0.3], 0) for i in range(400)]
    if dim == 2:  # small integers: equal distances are frequent
        rows = [(i, [float(x) for x in rng.integers(-3, 4, 2) / 4], 0) for i in range(400)]
    rows += [(0, rows[0][1], 1), (0, rows[0][1], 1), (None, rows[1][1], 2), (1001, None, 0), (1002, [1.0] * (dim + 1), 0), (1003, [None] + [1.0] * (dim - 1), 0), (1004, [math.inf] + [0.0] * (dim - 1), 0), (1005, [math.nan] + [0.0] * (dim - 1), 0), (1006, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumn("cluster", F.lit("clash")).withColumn("c", F.lit("clash"))
    found = centroids.cluster(df, k, rounds, dim, scale, 2)
    got = centroids.described(found)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(rows, k, rounds, dim, scale, 2)
    if k == 40:  # the bounds save scans: after the first round fewer vectors are measured against all
        assert found.depths[-1].get(0, 0) > 0 and all(sum(d.values()) == 403 for d in found.depths)


def test_large_integers_are_exact(spark):
    rows = [(i, [float((i * 37 % 11) * 1000.0), -float(i * 500)], 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in centroids.described(centroids.cluster(df, 5, 3, 2, 256.0)).collect()), key=repr) == lloyd(rows, 5, 3, 2, 256.0, 2)


def test_bounds_certify_only_what_a_scan_says():
    rng = np.random.default_rng(7)
    x = rng.integers(-6, 7, (500, 3))
    c = rng.integers(-6, 7, (16, 3))
    state, b = centroids.scanned(x, c, 4), 4
    for _ in range(12):
        new = c + rng.integers(-1, 2, c.shape)
        state, depth = centroids.moved(x, new, np.sqrt(centroids.pairwise(new, c)) * (1 + centroids.EPS), state, b)
        c = new
        assert (state.a == np.argsort(centroids.squared(x, c), axis=1, kind="stable")[:, 0]).all()
        assert depth.max() <= state.near.shape[1] + 1
        b = max(2, b - 1)


def test_no_clusters(spark):
    assert centroids.described(centroids.cluster(spark.createDataFrame([], SCHEMA))).collect() == []
