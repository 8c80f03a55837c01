"""Centroid clustering with Drake's adaptive bounds.

Vectors are integers, floor(scale * x), so distances, sums and centroids are exact and do not depend on how rows are dealt.

Every vector keeps, beside its centroid, an upper bound of the distance to it, lower bounds of its `b` next nearest centroids in their
order, and one remainder bound for all others. When centroids have moved, the upper bound grows by its centroid's step, each lower one
shrinks by its own centroid's, the remainder by the longest step of all; a bound then holds for its rank and all further ones. A vector
whose upper bound lies below its first lower one stays, without a distance. Otherwise the first rank whose bound lies above it tells
how many candidates are measured and put in order anew; if not even the remainder does, all centroids are measured again. Bounds are
rounded outwards and equal ones certify nothing, so ties go to the smaller number, as by a full scan.

`b` adapts: it starts at a quarter of the centroids and shrinks, to an eighth at least, to the ranks that nearly all vectors needed.

A round is one pass without a shuffle: a task reads vectors with their bounds, writes them back, and writes one row of counts and sums
for each centroid, which Spark sums. The driver holds centroids alone (k * dim integers). State lies in the shared folder, so a lost
executor costs its tasks and no round.

Defined results: vectors that are null, of another length, or with null or non-finite components, or beyond 2**27 after scaling (their
squared distance may not fit a long), are left out; with fewer vectors than k there are as many centroids as vectors; a null vec_id is
hashed as no digits; rows of equal hash are taken in the order of vec_id, then of their integers; repeated rows are vectors of their own;
an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

LIMIT = 1 << 27
#: Outward rounding of bounds, far above what a sum or root of doubles loses.
EPS = 1e-12

_VECTORS = "vec_id long, vec binary"
_STATE = _VECTORS + ", a int, u double, near binary, low binary, d long, c int, n long, sums array<long>"
_STATE_ARROW = pa.schema([("vec_id", pa.int64()), ("vec", pa.binary()), ("a", pa.int32()), ("u", pa.float64()), ("near", pa.binary()), ("low", pa.binary()), ("d", pa.int64()), ("c", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _integers(dim: int, scale: float):
    def task(batches):
        for batch in (b.slice(k, 4096) for b in batches for k in range(0, b.num_rows, 4096)):
            column = batch.column("embedding")
            off = np.asarray(column.offsets, dtype=np.int64)
            values = column.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False).astype(np.float64)
            fits = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(off) == dim)
            rows = np.flatnonzero(fits)
            x = np.floor(values[(off[:-1] - off[0])[rows][:, None] + np.arange(dim)] * scale)
            with np.errstate(invalid="ignore"):
                ok = (np.abs(x) <= LIMIT).all(axis=1)  # NaN is not
            rows, x = rows[ok], x[ok].astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "vec"])

    return task


def _stack(column: pa.Array, kind: str, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), wide)


def _bytes(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([v.tobytes() for v in np.ascontiguousarray(x, kind)], pa.binary())


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances, exactly: by one product of doubles where every sum stays below 2**53, else in integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)).astype(np.int64)
    return np.stack([pairwise(x, np.broadcast_to(v, x.shape)) for v in c], axis=1) if len(x) else np.zeros((0, len(c)), np.int64)


def pairwise(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The squared distance of each row of x to the same row of c."""
    d = x.astype(np.int64) - c
    return (d * d).sum(axis=1)


@dataclass
class Bounds:
    """The state of a batch of vectors: centroid, upper bound, the next centroids, and their lower bounds with the remainder's at last."""

    a: np.ndarray
    u: np.ndarray
    near: np.ndarray
    low: np.ndarray


def scanned(x: np.ndarray, c: np.ndarray, b: int) -> Bounds:
    """All distances; equal ones in the order of the centroids' numbers."""
    d = squared(x, c)
    order = np.argsort(d, axis=1, kind="stable")
    ranked = np.sqrt(np.take_along_axis(d, order, 1)[:, : b + 2])
    low = np.full((len(x), b + 1), np.inf)
    low[:, : ranked.shape[1] - 1] = ranked[:, 1:] * (1 - EPS)
    return Bounds(order[:, 0], ranked[:, 0] * (1 + EPS), order[:, 1 : b + 1], low)


def moved(x: np.ndarray, c: np.ndarray, steps: np.ndarray, old: Bounds, b: int) -> tuple[Bounds, np.ndarray]:
    """The state after centroids moved to c by `steps`, with b lower bounds, and how many ranks each vector needed (b + 1: all)."""
    b = min(b, old.near.shape[1])
    a, u, near = old.a.copy(), (old.u + steps[old.a]) * (1 + EPS), old.near.copy()
    low = np.concatenate([old.low[:, :-1] - steps[near], old.low[:, -1:] - steps.max(initial=0)], axis=1)
    low = _outward(low * np.where(low > 0, 1 - EPS, 1 + EPS))
    near, low = near[:, :b], low[:, : b + 1]  # a bound holds for all further ranks, so the last one kept is the remainder
    near, low = np.ascontiguousarray(near), np.ascontiguousarray(low)
    open_ = np.flatnonzero(u >= low[:, 0])
    u[open_] = np.sqrt(pairwise(x[open_], c[a[open_]])) * (1 + EPS)
    above = u[:, None] < low
    depth = np.where(above.any(axis=1), above.argmax(axis=1), b + 1)
    for j in range(1, b + 1):  # the candidates of a rank are measured; all others are further than the upper bound
        rows = np.flatnonzero(depth == j)
        if not len(rows):
            continue
        some = np.concatenate([a[rows, None], near[rows, :j]], axis=1)
        d = np.stack([pairwise(x[rows], c[some[:, t]]) for t in range(j + 1)], axis=1)
        order = np.lexsort((some, d), axis=1)
        some, d = np.take_along_axis(some, order, 1), np.sqrt(np.take_along_axis(d, order, 1))
        a[rows], u[rows] = some[:, 0], d[:, 0] * (1 + EPS)
        near[rows, :j], low[rows, :j] = some[:, 1:], d[:, 1:] * (1 - EPS)
    rows = np.flatnonzero(depth == b + 1)
    if len(rows):
        new = scanned(x[rows], c, b)
        a[rows], u[rows], near[rows], low[rows] = new.a, new.u, new.near, new.low
    return Bounds(a, u, near, _outward(low)), depth


def _outward(low: np.ndarray) -> np.ndarray:
    """Each bound at most those of further ranks."""
    return np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]


def _round(c: np.ndarray, steps: np.ndarray | None, b: int, held: int, last: bool):
    """One assignment of a task's vectors. held: lower bounds that the state has; last: with distances, and inertia for sums."""
    k, dim = c.shape

    def task(batches):
        n, sums, depths = np.zeros(k, np.int64), np.zeros((k, 1 if last else dim), np.int64), np.zeros(b + 2, np.int64)
        for batch in (x.slice(i, 8192) for x in batches for i in range(0, x.num_rows, 8192)):
            x = _stack(batch.column("vec"), "<i4", dim)
            if steps is None:
                state, depth = scanned(x, c, b), np.full(len(x), b + 1)
            else:
                old = Bounds(batch.column("a").to_numpy(), batch.column("u").to_numpy(), _stack(batch.column("near"), "<i4", held), _stack(batch.column("low"), "<f8", held + 1))
                state, depth = moved(x, c, steps, old, b)
            depths += np.bincount(depth, minlength=b + 2)
            n += np.bincount(state.a, minlength=k)
            d = pairwise(x, c[state.a]) if last else None
            np.add.at(sums, state.a, d[:, None] if last else x.astype(np.int64))
            none = pa.nulls(len(x))
            rest = [none, none] if last else [_bytes(state.near, "<i4"), _bytes(state.low, "<f8")]
            made = [batch.column("vec_id"), none if last else batch.column("vec"), pa.array(state.a, pa.int32()), pa.array(state.u), *rest, pa.array(d) if last else none, none, none, none]
            yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(made, _STATE_ARROW)], schema=_STATE_ARROW)
        some = np.flatnonzero(n)
        counts = [(int(j), int(n[j]), sums[j].tolist()) for j in some] + [(-1 - j, int(m), None) for j, m in enumerate(depths) if m]
        if counts:
            columns = dict(zip(("c", "n", "sums"), zip(*counts)))
            yield pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * len(counts)), f.type) for f in _STATE_ARROW], schema=_STATE_ARROW)

    return task


def _totals(state: DataFrame, width: int) -> tuple[dict[int, tuple[int, list[int]]], dict[int, int]]:
    """Counts and sums of each centroid, and how many vectors needed each depth."""
    added = [F.sum(F.col("sums")[i]) for i in range(width)]
    rows = state.where("c is not null").groupBy("c").agg(F.sum("n").alias("n"), F.array(*added).alias("sums")).collect()
    return {r.c: (r.n, r.sums) for r in rows if r.c >= 0}, {-1 - r.c: r.n for r in rows if r.c < 0}


def adapted(depths: dict[int, int], b: int, k: int) -> int:
    """The next number of lower bounds: the ranks within which all but a hundredth of the vectors that some bound certified were told."""
    told = [depths.get(j, 0) for j in range(b + 1)]
    total, least = sum(told), max(1, k // 8)
    if not total:
        return b
    enough = next(j for j in range(b + 1) if 100 * sum(told[: j + 1]) >= 99 * total)
    return min(b, max(least, enough))


@dataclass
class Clustering:
    """vectors: vec_id, cluster, distance. centroids: as integers. inertia: of each centroid. depths: of each round, by ranks needed."""

    vectors: DataFrame
    centroids: np.ndarray
    inertia: list[int]
    depths: list[dict[int, int]]


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: int = 2) -> Clustering:
    """rows: vec_id, embedding (array of numbers). Centroids start as the k vectors of least sha256 of `seed:vec_id`; each round assigns
    all vectors to the nearest and moves centroids to the floor of their mean; empty ones stay. A last assignment follows."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = materialize(rows.where(F.size("embedding") == dim).mapInArrow(_integers(dim, scale), _VECTORS), "integer-vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(key.alias("h"), "vec_id", "vec").orderBy("h", "vec_id", "vec").limit(k).collect()
    c = np.array([np.frombuffer(r.vec, "<i4") for r in first], np.int64).reshape(len(first), dim)
    k, state, steps, depths = len(first), vectors, None, []
    b = held = min(max(1, k // 4), max(0, k - 1))
    for at in range(rounds + 1 if k else 0):
        last = at == rounds
        columns = ["vec_id", "vec"] if steps is None else ["vec_id", "vec", "a", "u", "near", "low"]
        before, state = state, materialize(state.where("vec is not null").select(*columns).mapInArrow(_round(c, steps, b, held, last), _STATE), f"bounds-{at}")
        release(before)
        total, needed = _totals(state, 1 if last else dim)
        depths.append(needed)
        if last:
            inertia = [total[j][1][0] if j in total else 0 for j in range(k)]
            return Clustering(state.where("c is null").select("vec_id", F.col("a").alias("cluster"), F.col("d").alias("distance")), c, inertia, depths)
        new = np.array([[s // total[j][0] for s in total[j][1]] if j in total else c[j].tolist() for j in range(k)], np.int64)
        steps = np.sqrt(pairwise(new, c)) * (1 + EPS)
        held = b
        if at:
            b = adapted(needed, b, k)
        c = new
    return Clustering(vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), c, [], depths)


def described(found: Clustering) -> DataFrame:
    """vec_id, cluster, distance, with the inertia of the cluster and of all, and a digest of the centroid. Joins k rows."""
    made = [(j, found.inertia[j], sum(found.inertia), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for j, v in enumerate(found.centroids.tolist())]
    each = found.vectors.sparkSession.createDataFrame(made, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.vectors.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
