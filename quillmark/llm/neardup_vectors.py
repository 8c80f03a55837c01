"""Near-duplicate vectors by sorted projection passes.

Each pass puts the vectors of a group (equal label, equal length) in the lexicographic order of concatenated random hashes (signs of
projections on random directions), compares each vector with the next `window` ones, verifies the cosine in double precision, and
keeps a forest of what it found. The links of all passes are joined into components. Inside a component the links of every vector are
then counted in full, so window and passes decide only whether a component is found whole, never how many links a vector has in it.

* The order is global: vectors are dealt by ranges of (group, hash), each task sorts its range and works through it in a stream, and
  the first and last `window` vectors of each range meet again in a small second step. A group, a hash or a set of copies of any size
  is cut by position; no task holds it.
* Two near vectors stand side by side if their leading hashes agree down to `window` vectors, so the number of passes follows the size of
  the largest group: as many as a pair at the threshold needs to be compared with probability `recall`. More similar pairs need fewer.
* Counting: components of at most SMALL vectors are compared whole, packed many to a task. In larger ones all vectors within half the
  threshold's angle of the component's mean direction are pairwise linked (triangle inequality), so they are counted, not
  compared; the others are compared with all in blocks. No row stands for a pair.

Defined results: a vector that is null, empty or zero, or holds null or non-finite components, links with nothing, and so does one with a
null label or vec_id; such rows are kept, and their component is their vec_id. Vectors of different lengths are never linked. Rows
that share a vec_id are vectors of their own; of a component's rows those with the least vec_id are kept. An empty table gives
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, fragments, materialize, release, slices
from .components import components

#: Signs in one hash; vectors compared at a time within a range.
SIGNS, RUN = 64, 512
#: Bytes of vectors that a kernel works on at a time.
HELD = 8 << 20
#: Vectors of a component that are compared whole; also the side of a block in larger ones.
SMALL = 512
#: Below this two cosines, or two angles, are not told apart: what lies nearer to a bound is compared, not inferred.
MARGIN = 1e-9

_PREPARED = "rid long, vec_id long, label string, dim int, vec binary, keys array<long>"


def units(vecs: list[bytes]) -> np.ndarray:
    """Vectors of one length as rows of length 1. Scaled first, so that neither large nor small components leave the range."""
    x = np.frombuffer(b"".join(vecs)).reshape(len(vecs), -1)
    return _scaled(x)


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _directions(dim: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * SIGNS))


def _prepare(passes: int, seed: int):
    """Valid vectors as bytes, with one concatenated hash per pass; as signed integers in the order of their bits."""

    def task(batches):
        made: dict[int, np.ndarray] = {}
        for batch in (b.slice(k, 4096) for b in batches for k in range(0, b.num_rows, 4096)):
            column = batch.column("embedding")
            off = np.asarray(column.offsets, dtype=np.int64)
            values = column.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False).astype(np.float64)
            off = off - off[0]
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # a null component reads as NaN
            size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(off), 0)
            size = np.where(bad[off[1:]] > bad[off[:-1]], 0, size)
            for dim in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == dim)
                held = values[off[rows][:, None] + np.arange(dim)]
                some = held.any(axis=1)
                rows, held = rows[some], held[some]
                if not len(rows):
                    continue
                if dim not in made:
                    made[dim] = _directions(dim, passes, seed)
                signs = _scaled(held) @ made[dim] > 0
                keys = np.packbits(signs, axis=1, bitorder="big").view(">u8").astype(U64) ^ U64(1 << 63)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, passes, dtype=np.int32), pa.array(keys.view(np.int64).reshape(-1)))
                at = pa.array(rows)
                vec = pa.array([x.tobytes() for x in held], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("rid", "vec_id", "label")), pa.array(np.full(len(rows), dim, np.int32)), vec, lists], ["rid", "vec_id", "label", "dim", "vec", "keys"])

    return task


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links between 0..n-1: each node with the least node of its component, where that is another."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    some = np.flatnonzero(root != np.arange(n))
    return some, root[some]


def near(x: np.ndarray, group: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, at most window apart and of one group, whose cosine reaches the threshold. x: unit vectors in order."""
    found = []
    for lo in range(0, len(x), RUN):
        to = min(len(x), lo + RUN + window)
        i, j = np.nonzero(x[lo : lo + RUN] @ x[lo:to].T >= threshold)
        ok = (j > i) & (j - i <= window) & (group[lo + i] == group[lo + j])
        found.append((lo + i[ok], lo + j[ok]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _links(rows: list[tuple], window: int, threshold: float) -> tuple[list, list]:
    """rows: (vec_id, rid, label, dim, vec) in order. Links as nodes (vec_id, rid); a vector of another group ends a run of groups."""
    a, b = [], []
    at = 0
    while at < len(rows):  # runs of one length
        to = at
        while to < len(rows) and rows[to][3] == rows[at][3]:
            to += 1
        run = rows[at:to]
        _, group = np.unique([r[2] for r in run], return_inverse=True)
        i, j = near(units([r[4] for r in run]), group, window, threshold)
        some, root = _forest(i, j, len(run))
        a += [run[k][:2] for k in some.tolist()]
        b += [run[k][:2] for k in root.tolist()]
        at = to
    return a, b


_NODE = pa.struct([("vec_id", pa.int64()), ("rid", pa.int64())])
_PASS = "a struct<vec_id:long,rid:long>, b struct<vec_id:long,rid:long>, part int, place long, n long, vec_id long, rid long, label string, dim int, vec binary"
_PASS_ARROW = pa.schema([("a", _NODE), ("b", _NODE), ("part", pa.int32()), ("place", pa.int64()), ("n", pa.int64()), ("vec_id", pa.int64()), ("rid", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("vec", pa.binary())])


def _batch(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in _PASS_ARROW], schema=_PASS_ARROW)


def _walk(window: int, threshold: float):
    """A sorted range as a stream: its links; its first and last `window` vectors with their places; its number of vectors."""

    def task(batches):
        from pyspark import TaskContext

        part, place, held = TaskContext.get().partitionId(), 0, []
        last: list[tuple] = []
        for batch in (x for b in batches for x in slices(b, "vec", HELD)):
            new = list(zip(*(batch.column(c).to_pylist() for c in ("vec_id", "rid", "label", "dim", "vec"))))
            edge = [(place + k, *r) for k, r in enumerate(new[: max(0, window - place)])]
            if edge:
                yield _batch(dict(zip(("place", "vec_id", "rid", "label", "dim", "vec"), zip(*edge))) | {"part": [part] * len(edge)})
            last = (last + [(place + k, *r) for k, r in enumerate(new)][-window:])[-window:]
            place += len(new)
            rows = held + new
            a, b = _links(rows, window, threshold)
            if a:
                yield _batch({"a": [dict(zip(("vec_id", "rid"), x)) for x in a], "b": [dict(zip(("vec_id", "rid"), x)) for x in b]})
            held = rows[-window:]
        rest = [r for r in last if r[0] >= window]  # the others are out already
        if rest:
            yield _batch(dict(zip(("place", "vec_id", "rid", "label", "dim", "vec"), zip(*rest))) | {"part": [part] * len(rest)})
        if place:
            yield _batch({"part": [part], "n": [place]})

    return task


def _seam(window: int, threshold: float):
    """The vectors about the end of a range: links across it."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        a, b = _links(list(zip(*(rows[c].to_pylist() for c in ("vec_id", "rid", "label", "dim", "vec")))), window, threshold)
        return pa.table({c: pa.array([dict(zip(("vec_id", "rid"), x)) for x in v], _NODE) for c, v in (("a", a), ("b", b))})

    return task


def one_pass(vectors: DataFrame, which: int, parts: int, window: int, threshold: float) -> list[DataFrame]:
    """Links found in one order; tables."""
    order = ["label", "dim", F.col("keys")[which].alias("key"), "rid"]
    rows = vectors.select("vec_id", "rid", "label", "dim", "vec", order[2])
    dealt = rows.repartitionByRange(parts, "label", "dim", "key", "rid").sortWithinPartitions("label", "dim", "key", "rid")
    walked = materialize(dealt.drop("key").mapInArrow(_walk(window, threshold), _PASS), "projection-pass")
    # Where each range begins among all: a number for each task, not for each vector.
    sizes = sorted((r.part, r.n) for r in walked.where("n is not null").select("part", "n").toLocalIterator())
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist() if sizes else [0]
    if len(sizes) < 2:
        return [walked]
    known = walked.sparkSession.createDataFrame([(p, starts[i], starts[1:-1][max(0, i - window) : i + window + 1]) for i, (p, _) in enumerate(sizes)], "part int, start long, ends array<long>")
    edge = walked.where("place is not null").select("part", "place", "vec_id", "rid", "label", "dim", "vec").join(F.broadcast(known), "part")
    edge = edge.withColumn("at", F.col("start") + F.col("place"))
    edge = edge.withColumn("end", F.explode(F.filter("ends", lambda e: (F.col("at") >= e - window) & (F.col("at") < e + window)))).drop("start", "ends", "part", "place")
    seams = edge.groupBy("end").applyInArrow(_seam(window, threshold), "a struct<vec_id:long,rid:long>, b struct<vec_id:long,rid:long>")
    return [walked, materialize(seams, "projection-seams")]


def passes_needed(largest: int, window: int, threshold: float, recall: float) -> int:
    """Passes after which a pair at the threshold has stood side by side in at least one with probability `recall`."""
    signs = max(0.0, math.log2(max(1, largest) / window))
    together = (1 - math.acos(threshold) / math.pi) ** signs
    return 1 if together >= recall else math.ceil(math.log(1 - recall) / math.log1p(-together))


def _count_small(threshold: float):
    """Whole components: the links of each vector, itself left out."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("root")
        root = np.array(rows["root"].combine_chunks().field("rid"))
        vec, n = rows["vec"].to_pylist(), np.zeros(len(root), np.int64)
        head = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
        for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(root)]):
            x = units(vec[lo:hi])
            for k in range(0, hi - lo, RUN):
                linked = x[k : k + RUN] @ x.T >= threshold
                linked[np.arange(len(linked)), k + np.arange(len(linked))] = False
                n[lo + k : lo + k + len(linked)] = linked.sum(axis=1)
        return pa.table({"rid": rows["rid"], "n": pa.array(n)})

    return task


def _sums(batches):
    """Per component and task: the sum of its unit vectors."""
    for batch in batches:
        root, vec = np.array(batch.column("root").field("rid")), batch.column("vec").to_pylist()
        known, of = np.unique(root, return_inverse=True)
        for k, r in enumerate(known.tolist()):
            yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([units([vec[i] for i in np.flatnonzero(of == k).tolist()]).sum(axis=0)])], ["root_rid", "sums"])


def _near_hub(threshold: float):
    """Whether a vector is so near its component's mean direction that it is linked with all that are."""
    least = math.cos(math.acos(threshold) / 2) + MARGIN

    def task(batches):
        for batch in batches:
            out = []
            for v, hub in zip(batch.column("vec").to_pylist(), batch.column("hub").to_pylist()):
                h = np.array(hub)
                size = math.sqrt(float(h @ h))
                out.append(bool(size > 0 and float(units([v])[0] @ h) / size >= least))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "root_rid", "vec", "m")), pa.array(out)], ["rid", "root_rid", "vec", "m", "core"])

    return task


def _count_block(threshold: float):
    """A block of vectors away from the hub against a block of all: links of the former, and of the hub's own among the latter."""

    def task(key: tuple, loose: pa.Table, every: pa.Table) -> pa.Table:
        if not len(loose) or not len(every):
            return pa.table({"rid": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        x, y = (units(t["vec"].to_pylist()) for t in (loose, every))
        a, b, core = loose["rid"].to_numpy(), every["rid"].to_numpy(), every["core"].to_numpy(zero_copy_only=False)
        n, back = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for k in range(0, len(a), RUN):
            linked = (x[k : k + RUN] @ y.T >= threshold) & (a[k : k + RUN, None] != b)
            n[k : k + RUN] = linked.sum(axis=1)
            back += linked.sum(axis=0)
        return pa.table({"rid": np.concatenate([a, b[core]]), "n": np.concatenate([n, back[core]])})

    return task


def count_links(vectors: DataFrame, roots: DataFrame, threshold: float, small: int = SMALL) -> DataFrame:
    """rid, root (vec_id and rid), n: the links of each vector that has any. roots: node, root of `components`."""
    named = roots.select(F.col("node.rid").alias("rid"), "root").unionByName(roots.select(F.col("root.rid").alias("rid"), "root").distinct())
    members = materialize(vectors.select("rid", "vec").join(named, "rid"), "component-members")
    sizes = members.groupBy("root").agg(F.count("*").alias("m"))
    big = materialize(sizes.where(F.col("m") > small), "large-components")
    whole = members.join(big, "root", "left_anti") if not big.isEmpty() else members
    n_bytes = members.agg(F.sum(F.octet_length("vec"))).first()[0] or 0
    parts = fragments(n_bytes, vectors.sparkSession, 16 << 20)
    dealt = whole.select("rid", "root", "vec", F.pmod(F.xxhash64("root"), F.lit(parts)).alias("part"))
    counted = dealt.groupBy("part").applyInArrow(_count_small(threshold), "rid long, n long")
    if not big.isEmpty():
        counted = counted.unionByName(_count_large(materialize(members.join(big, "root"), "large-members"), threshold, small))
    return materialize(counted.join(named, "rid"), "link-counts")


def _count_large(members: DataFrame, threshold: float, side: int) -> DataFrame:
    """As _count_small for components of any size. members: rid, root, vec, m."""
    sums = materialize(members.select("root", "vec").mapInArrow(_sums, "root_rid long, sums array<double>"), "component-sums")
    by_place = sums.select("root_rid", F.posexplode("sums")).groupBy("root_rid", "pos").agg(F.sum("col").alias("s"))
    hubs = by_place.groupBy("root_rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("hub"))
    hubs = materialize(hubs, "component-hubs")
    # Plain tables on both sides, so that the join may split a component of very many vectors.
    flat_ = materialize(members.select("rid", F.col("root.rid").alias("root_rid"), "vec", "m"), "large-vectors")
    judged = materialize(flat_.join(hubs, "root_rid").mapInArrow(_near_hub(threshold), "rid long, root_rid long, vec binary, m long, core boolean"), "hub-members")
    cores = materialize(judged.groupBy("root_rid").agg(F.sum(F.col("core").cast("long")).alias("n_core"), F.sum((~F.col("core")).cast("long")).alias("n_loose")), "hub-counts")
    inside = judged.where("core").select("rid", "root_rid").join(cores, "root_rid").select("rid", (F.col("n_core") - 1).alias("n"))
    n_a, n_l = F.ceil(F.col("m") / side).cast("int"), F.ceil(F.col("n_loose") / side).cast("int")
    known = judged.join(cores.where("n_loose > 0"), "root_rid").withColumns({"_a": F.pmod(F.xxhash64("rid"), n_a).cast("int"), "_l": F.pmod(F.xxhash64("rid", F.lit(1)), n_l).cast("int"), "_na": n_a, "_nl": n_l})
    loose = known.where("not core").select("root_rid", "rid", "vec", F.col("_l").alias("l"), F.explode(F.sequence(F.lit(0), F.col("_na") - 1)).alias("a"))
    loose = materialize(loose, "loose-blocks")
    every = known.select("root_rid", "rid", "vec", "core", F.col("_a").alias("a"), F.explode(F.sequence(F.lit(0), F.col("_nl") - 1)).alias("l"))
    keys = ["root_rid", "l", "a"]
    met = loose.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(_count_block(threshold), "rid long, n long")
    return inside.unionByName(met).groupBy("rid").agg(F.sum("n").alias("n"))


def near_duplicates(rows: DataFrame, threshold: float = 0.93, window: int = 128, recall: float = 0.97, passes: int | None = None, seed: int = 12, small: int = SMALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `rows` (vec_id, embedding: array of numbers, label).

    recall: wanted share of pairs at the threshold itself that stand side by side in some pass; passes: their number, if it is to be given.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    # Written once, so that a row's own number stays whatever is computed again.
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "vector-rows")
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    largest = usable.groupBy("label", F.size("embedding")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    passes = passes or passes_needed(largest, window, threshold, recall)
    vectors = materialize(usable.mapInArrow(_prepare(passes, seed), _PREPARED), "vectors")
    parts = fragments(vectors.agg(F.sum(F.octet_length("vec"))).first()[0] or 0, spark)
    tables = [t for k in range(passes) for t in one_pass(vectors, k, parts, window, threshold)]
    links = None
    for t in tables:
        found = t.where("a is not null").select("a", "b")
        links = found if links is None else links.unionByName(found)
    roots = components(links)
    release(*tables)
    counted = count_links(vectors, roots, threshold, small)
    release(vectors)
    out = rows.select("rid", "vec_id").join(counted.select("rid", "root", "n"), "rid", "left")
    component = F.coalesce("root.vec_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

