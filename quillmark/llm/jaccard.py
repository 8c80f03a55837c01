"""N-gram Jaccard join by vertical partitioning.

Documents are sets of hashed n-gram shingles. The global order of n-grams is cut into fragments; a document's segments in
the fragments travel apart, overlaps are counted fragment by fragment, and the counts are summed per pair of documents.

The steps, all exact:

1. Every document's n-grams go to their fragments, packed by batch. A fragment counts for each document the n-grams that
   no other set has. Sets that are equal count as one (by digest), so copies meet nobody. An n-gram that two sets of a slice of
   text share is known to be shared, and goes on once for the slice, so a frequent one fills no fragment.
2. A set of n n-grams of which more than n/5 are its own cannot reach a Jaccard similarity of 0.8 with any other; the sums
   per set leave few sets. (Fragments compare 32 bits here; a false match only keeps a set that could have gone.)
3. Only the sets left are built again, with 64-bit n-grams. They are put in order of rarity; the first n - ceil(0.8 n) + 1
   of each, less its own n-grams, are its postings. Similar sets share a posting within the bounds of length and position.
4. Sets that are neighbours in a posting list are counted first; their links make components. Then postings that still
   hold sets of two components give the pairs of different components that bitmaps of their n-grams do not tell apart, and those
   are counted too. Pairs within a component cannot change it, so a large group of near copies needs no expansion into all its pairs.
5. Counting: pairs are dealt into blocks, whose number follows the pairs, and within a block the segments of its sets meet
   per fragment, of which there is a fixed number; partial overlaps are summed per pair and held against the threshold. So what is
   shuffled follows the pairs and their sets, and not pairs times a number that grows.

Long posting lists are dealt by salts in step 4; rarity and the joins on n-grams are left to Spark's aggregates and skewed joins,
so no task holds one n-gram's list. Sets and n-grams are told by 64 bits; counts are exact but for their collisions.

Defined results: a document without words has an empty set, links with nothing and is a component of its own; fewer words
than n make one n-gram of the whole; a row with a null doc_id has its count, no component and no part in links; rows that
share a doc_id are joined each by itself; repeated rows are one set; a text longer than a slice is one slice; an empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import K3, U64, Words, blob, fragments, joined, materialize, mix, ragged, release, scaled, slices, text_bytes
from .components import components

#: Fragments of the n-gram order in which pairs are counted; n-grams that a fragment of a block holds at most, and pairs of a block.
FRAGMENTS, FRAGMENT_GRAMS, BLOCK_PAIRS = 16, 2_000_000, 2_000_000
#: A posting list's sets per salt.
SALTED = 512
#: Rounds in which a set meets sets of other components, and how many of them per posting.
SAMPLED, REACH = 1, 24
#: N-grams before a posting that are looked at so that a pair is made once; a pair made twice is counted once.
EARLIER = 64
#: Bits of a set's bitmap.
BITS = 1024
#: Sets that may be broadcast by their 16 bytes each; with more, the join is shuffled.
BROADCAST_SETS = 500_000


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, ascending; offsets; a digest of each row's set (0: empty)."""
    words = Words(column, lower=True)
    h = words.hashes()
    g, fits = words.grams(h, n)
    size = np.diff(words.off)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    off = np.concatenate([[0], np.cumsum(count)])
    grams = np.zeros(off[-1], U64)
    long = size >= n
    grams[ragged(off[:-1][long], count[long])] = g[fits]
    for i in np.flatnonzero((size > 0) & (size < n)).tolist():
        value = 0
        for w in h[words.off[i] : words.off[i + 1]].tolist():
            value = (value * int(K3) + w) & 0xFFFFFFFFFFFFFFFF
        grams[off[i]] = mix(np.array([value ^ int(size[i])], U64))[0]
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[off[:-1][count > 0]] = True
    before = np.concatenate([[0], np.cumsum(new)])
    grams, off = grams[new], before[off]
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(grams * K3))])
    n_grams = np.diff(off)
    digest = mix((total[off[1:]] - total[off[:-1]]) ^ (n_grams.astype(U64) << U64(40)))
    return grams, off, np.where(n_grams > 0, np.maximum(digest, U64(1)), U64(0))


def _runs(part: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries (given in row order) sorted by part: their order, and the part, row and length of each run."""
    order = np.argsort(part.astype(np.int32), kind="stable")
    p, r = part[order], row[order]
    head = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (r[1:] != r[:-1])])) if len(p) else np.zeros(0, np.int64)
    return order, p[head], r[head], np.diff(np.append(head, len(p)))


def _cut(part: np.ndarray):
    """(part, from, to) of the runs of an ascending array."""
    if not len(part):
        return
    head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    yield from zip(part[head].tolist(), head.tolist(), [*head[1:].tolist(), len(part)])


_PACKED = "part int, kind int, a binary, b binary, c binary, d binary"
_PACKED_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _PACKED_ARROW)], schema=_PACKED_ARROW)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)] if rows else [], _PACKED_ARROW)


def _pack_documents(n: int, parts: int):
    def task(batches):
        for batch in batches:
            for run in slices(batch):
                grams, off, sets = shingle_sets(run.column("text"), n)
                ids = run.column("doc_id")
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                doc = ids.fill_null(0).to_numpy()
                size = np.diff(off)
                sets[missing] = 0
                rows = []
                if len(doc):  # documents themselves are dealt by slice, whatever their sets
                    some = int(mix(np.array([len(grams)], U64) ^ U64(int(doc[0]) & 0xFFFFFFFFFFFFFFFF))[0] % U64(parts))
                    rows.append((parts + some, 1, blob(doc, "<i8"), blob(size, "<u4"), blob(sets, "<u8"), blob(missing, "u1")))
                _, first = np.unique(sets, return_index=True)
                once = np.sort(first[sets[first] != 0])
                entry = ragged(off[:-1][once], size[once])
                of = np.repeat(once, size[once])
                by = np.argsort(grams[entry], kind="stable")
                g = grams[entry][by]
                same = np.zeros(len(g) + 1, bool)
                same[1:-1] = g[1:] == g[:-1]
                shared = np.zeros(len(g), bool)
                shared[by] = same[1:] | same[:-1]
                alone, of = grams[entry][~shared], of[~shared]
                order, part, row, length = _runs(scaled(alone, parts), of)
                low = alone[order].astype(np.uint32)
                ends = np.concatenate([[0], np.cumsum(length)])
                for p, a, b in _cut(part):
                    rows.append((p, 0, blob(sets[row[a:b]], "<u8"), blob(length[a:b], "<u4"), blob(low[ends[a] : ends[b]], "<u4"), None))
                twice = g[same[1:] & ~same[:-1]]  # ascending, so in the order of fragments
                for p, a, b in _cut(scaled(twice, parts)):
                    rows.append((p, 0, None, None, None, blob(twice[a:b].astype(np.uint32), "<u4")))
                if rows:
                    yield _batch(rows)

    return task


def _count_own(parts: int):
    """Per fragment: for each set, the n-grams that only it has, to the ranges of sets."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() >= parts:
            return rows
        sets, length, grams = joined(rows["a"], "<u8"), joined(rows["b"], "<u4").astype(np.int64), joined(rows["c"], "<u4")
        _, first = np.unique(sets, return_index=True)
        if len(first) < len(sets):
            keep = np.zeros(len(sets), bool)
            keep[first] = True
            grams = grams[np.repeat(keep, length)]
            sets, length = sets[keep], length[keep]
        shared = np.unique(joined(rows["d"], "<u4"))
        every = np.concatenate([grams, shared, shared])
        order = np.argsort(every, kind="stable")
        g = every[order]
        same = np.zeros(len(g) + 1, bool)
        same[1:-1] = g[1:] == g[:-1]
        own = np.zeros(len(g), np.int64)
        own[order] = ~(same[1:] | same[:-1])
        alone = np.add.reduceat(own[: len(grams)], np.cumsum(length) - length) if len(length) else np.zeros(0, np.int64)
        sets, alone = sets[alone > 0], alone[alone > 0]
        where = scaled(sets, parts)
        by = np.argsort(where, kind="stable")
        return _table([(p, 0, blob(sets[by[a:b]], "<u8"), blob(alone[by[a:b]], "<u4"), None, None) for p, a, b in _cut(where[by])])

    return task


def _own_sums(key: tuple, rows: pa.Table) -> pa.Table:
    """Per range of sets: how many n-grams are a set's own."""
    sets, alone = joined(rows["a"], "<i8"), joined(rows["b"], "<u4").astype(np.int64)
    known, at = np.unique(sets, return_inverse=True)
    return pa.table({"set": known, "own": np.bincount(at, weights=alone, minlength=len(known)).astype(np.int64)})


def _unpacked(batches):
    """The documents with their sets, a row each."""
    for batch in batches:
        for i in range(batch.num_rows):
            doc, size, sets, missing = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in zip("abcd", ("<i8", "<u4", "<i8", "u1")))
            yield pa.RecordBatch.from_arrays([pa.array(doc, mask=missing.astype(bool)), pa.array(size.astype(np.int64)), pa.array(sets)], ["doc_id", "n_shingles", "set"])


def _sets_left(n: int):
    def task(batches):
        for batch in batches:
            for run in slices(batch):
                grams, off, sets = shingle_sets(run.column("text"), n)
                ok = np.flatnonzero(sets == run.column("set").to_numpy().view(U64))
                values = [blob(grams[off[i] : off[i + 1]], "<u8") for i in ok.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(sets[ok].view(np.int64)), pa.array(np.diff(off)[ok]), pa.array(values, pa.binary())], ["set", "n", "grams"])

    return task


def _pack_sets(parts: int):
    """Sets (with a block of pairs) to rows per fragment: sets, sizes, lengths of the segments, n-grams."""

    def task(batches):
        for batch in batches:
            sets, n = batch.column("set").to_numpy().view(U64), batch.column("n").to_numpy()
            block = batch.column("block").to_numpy()
            step = max(1, int(500_000 / max(1, n.mean()))) if len(n) else 1
            for lo in range(0, len(sets), step):
                hi = min(len(sets), lo + step)
                grams = joined(pa.chunked_array([batch.column("grams").slice(lo, hi - lo)]), "<u8")
                of = np.repeat(np.arange(lo, hi), n[lo:hi])
                order, part, row, length = _runs(scaled(grams, parts) + block[of] * parts, of)
                grams = grams[order]
                ends = np.concatenate([[0], np.cumsum(length)])
                yield _batch([(p, 0, blob(sets[row[a:b]], "<u8"), blob(n[row[a:b]], "<u4"), blob(length[a:b], "<u4"), blob(grams[ends[a] : ends[b]], "<u8")) for p, a, b in _cut(part)])

    return task


def _exploded(batches):
    """A row per n-gram of each set."""
    for batch in batches:
        n = batch.column("n").to_numpy()
        sets = batch.column("set").to_numpy()
        step = max(1, int(500_000 / max(1, n.mean()))) if len(n) else 1
        for lo in range(0, len(n), step):
            at = slice(lo, lo + step)
            grams = joined(pa.chunked_array([batch.column("grams").slice(lo, step)]), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sets[at], n[at])), pa.array(np.repeat(n[at], n[at])), pa.array(grams)], ["set", "n", "gram"])


def _postings(sets: DataFrame) -> DataFrame:
    """gram, set, n, pos, df: each set's n-grams in order of rarity, as far as a similar set must share one."""
    each = sets.select("set", "n", "grams").mapInArrow(_exploded, "set long, n long, gram long")
    df = materialize(each.groupBy("gram").agg(F.count("*").alias("df")).where("df >= 2"), "gram-counts")
    order = Window.partitionBy("set").orderBy("df", "gram")
    ranked = each.join(df, "gram").withColumn("_at", F.row_number().over(order)).withColumn("_shared", F.count("*").over(Window.partitionBy("set")))
    ranked = ranked.withColumn("pos", F.col("_at") - 1 + F.col("n") - F.col("_shared"))  # its own n-grams are the rarest
    kept = ranked.where((F.col("pos") <= F.col("n") - F.floor((4 * F.col("n") + 4) / 5)) & (5 * F.col("_shared") >= 4 * F.col("n")))
    return kept.select("gram", "set", "n", "pos", "df")


def _possible(a: str, b: str):
    """The bounds of length and position for two sets that share an n-gram."""
    na, pa_, nb, pb = F.col(f"{a}n"), F.col(f"{a}pos"), F.col(f"{b}n"), F.col(f"{b}pos")
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (9 * F.least(na - pa_, nb - pb) >= 4 * (na + nb))


def _pack_pairs(batches):
    for batch in batches:
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        a, b = batch.column("a").to_numpy()[order], batch.column("b").to_numpy()[order]
        for p, lo, hi in _cut(block[order]):
            yield _batch([(p, 0, blob(a[lo:hi], "<i8"), blob(b[lo:hi], "<i8"), None, None)])


def _overlaps(parts: int):
    """Per fragment and block of pairs: the partial overlap of each pair, to the ranges of pairs."""

    def task(key: tuple, segments: pa.Table, pairs: pa.Table) -> pa.Table:
        if not len(segments) or not len(pairs):
            return _table([])
        sets, n, length, grams = joined(segments["a"], "<u8").view(np.int64), joined(segments["b"], "<u4").astype(np.int64), joined(segments["c"], "<u4").astype(np.int64), joined(segments["d"], "<u8")
        start = np.cumsum(length) - length
        by = np.argsort(sets)
        kinds, code = np.unique(grams, return_inverse=True)
        keys = np.repeat(np.arange(len(sets)), length) * len(kinds) + code  # ascending: segments are
        a, b = joined(pairs["a"], "<i8"), joined(pairs["b"], "<i8")
        x, y = (by[np.minimum(np.searchsorted(sets, v, sorter=by), len(by) - 1)] for v in (a, b))
        here = (sets[x] == a) & (sets[y] == b)
        a, b, x, y = a[here], b[here], x[here], y[here]
        swap = length[x] > length[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        count = np.zeros(len(a), np.int64)
        ends = np.cumsum(length[x])
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2_000_000, "right")))
            size = length[x[lo:hi]]
            want = code[ragged(start[x[lo:hi]], size)] + np.repeat(y[lo:hi], size) * len(kinds)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            count[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), size), weights=keys[at] == want, minlength=hi - lo)
            lo = hi
        some = count > 0
        a, b, count, both = a[some], b[some], count[some], (n[x] + n[y])[some]
        where = scaled(mix(a.view(U64) ^ mix(b.view(U64))), parts)
        by = np.argsort(where, kind="stable")
        return _table([(p, 0, blob(a[by[i:j]], "<i8"), blob(b[by[i:j]], "<i8"), blob(count[by[i:j]], "<u4"), blob(both[by[i:j]], "<u4")) for p, i, j in _cut(where[by])])

    return task


def _linked(percent: int):
    def task(key: tuple, rows: pa.Table) -> pa.Table:
        a, b, count, both = joined(rows["a"], "<i8"), joined(rows["b"], "<i8"), joined(rows["c"], "<u4").astype(np.int64), joined(rows["d"], "<u4").astype(np.int64)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        total, both = np.add.reduceat(count[order], head), both[order][head]
        ok = 100 * total >= percent * (both - total)
        return pa.table({"a": a[head][ok], "b": b[head][ok]})

    return task


def _pair(x: str, y: str) -> list:
    """A pair of sets in order, and the n-grams of the two."""
    a, b = F.col(f"{x}set"), F.col(f"{y}set")
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (F.col(f"{x}n") + F.col(f"{y}n")).alias("both")]


def count_pairs(sets: DataFrame, pairs: DataFrame, parts: int = FRAGMENTS) -> DataFrame:
    """The pairs (a, b; both: n-grams of the two) of sets whose overlaps, counted by fragment and summed, reach the threshold."""
    made = pairs = materialize(pairs.distinct(), "pairs")
    n_pairs, grams = pairs.agg(F.count("*"), F.coalesce(F.sum("both"), F.lit(0))).first()
    blocks = max(1, -(-n_pairs // BLOCK_PAIRS), -(-grams // (parts * FRAGMENT_GRAMS)))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)))
    used = pairs.select(F.col("a").alias("set"), "block").unionByName(pairs.select(F.col("b").alias("set"), "block")).distinct()
    segments = used.join(sets, "set").select("set", "n", "grams", "block").mapInArrow(_pack_sets(parts), _PACKED)
    packed = pairs.mapInArrow(_pack_pairs, _PACKED).withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    packed = packed.select((F.col("part") * parts + F.col("_f")).cast("int").alias("part"), "kind", "a", "b", "c", "d")
    partial = segments.groupBy("part").cogroup(packed.groupBy("part")).applyInArrow(_overlaps(parts * blocks), _PACKED)
    links = materialize(partial.groupBy("part").applyInArrow(_linked(80), "a long, b long"), "links")
    release(made)
    return links


def _bitmaps(sets: DataFrame) -> DataFrame:
    """set, bits: a bitmap of its n-grams' hashes."""

    def task(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            for lo in range(0, len(n), 2_000):
                size = n[lo : lo + 2_000]
                at = (mix(joined(pa.chunked_array([batch.column("grams").slice(lo, 2_000)]), "<u8") * K3) % U64(BITS)).astype(np.int64)
                bits = np.zeros((len(size), BITS), bool)
                bits[np.repeat(np.arange(len(size)), size), at] = True
                packed = np.packbits(bits, axis=1, bitorder="little").view("<i8")
                rows = pa.ListArray.from_arrays(np.arange(0, (len(size) + 1) * (BITS // 64), BITS // 64, dtype=np.int32), pa.array(packed.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("set").slice(lo, 2_000), rows], ["set", "bits"])

    return sets.select("set", "n", "grams").mapInArrow(task, "set long, bits array<long>")


def _mixed(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Postings of n-grams that sets of two components or more hold, with their components."""
    named = postings.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    mixed = named.groupBy("gram").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("gram")
    mixed = materialize(mixed, "mixed-grams")  # both sides of the join are then plain exchanges, which a skewed join splits
    return named.join(mixed, "gram").select("gram", "set", "n", "pos", "df", "root")


def near_duplicates(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id: least doc_id that links of a Jaccard similarity of 0.8 or more lead to."""
    return grouped(docs, n).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, n: int = 5) -> DataFrame:
    """Of docs, with all columns, one row of each component: that of least doc_id, of several with it that of least set, of repeated
    ones any. Rows with a null doc_id, and those without words, stay."""
    found = materialize(grouped(docs, n), "near-duplicates")
    shared = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    surplus = found.where("component_id < doc_id").select("doc_id").distinct()
    if shared.isEmpty():
        return docs.join(surplus, "doc_id", "left_anti").select(*docs.columns)
    # An id of several rows does not tell which of them to keep: those rows are told by their sets.
    shared = materialize(shared, "shared-ids")
    plain = docs.join(surplus.unionByName(shared).distinct(), "doc_id", "left_anti").select(*docs.columns)
    best = found.where("set <> 0").groupBy("root").agg(F.min(F.struct("doc_id", "set")).alias("b")).select("b.doc_id", F.col("b.set").alias("_set"))
    rows = docs.join(shared, "doc_id", "left_semi").select(*docs.columns)
    names = rows.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _set long"

    def task(batches):
        for batch in batches:
            for run in slices(batch):
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in names), pa.array(shingle_sets(run.column("text"), n)[2].view(np.int64))], [*names, "_set"])

    rows = materialize(rows.mapInArrow(task, ddl), "shared-rows")
    kept = rows.join(best, ["doc_id", "_set"], "left_semi").dropDuplicates(["doc_id", "_set"])
    return plain.unionByName(kept.select(*names)).unionByName(rows.where("_set = 0").select(*names))


def grouped(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, set, root (a set of the component; null without words) and component_id of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = fragments(text_bytes(docs), spark)
    packed = materialize(docs.mapInArrow(_pack_documents(n, parts), _PACKED).groupBy("part").applyInArrow(_count_own(parts), _PACKED), "own-grams")
    known = materialize(packed.where("kind = 1").mapInArrow(_unpacked, "doc_id long, n_shingles long, set long"), "document-sets")
    own = packed.where("kind = 0").groupBy("part").applyInArrow(_own_sums, "set long, own long")
    judged = known.where("set <> 0").groupBy("set").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")).join(own, "set", "left")
    judged = materialize(judged.withColumn("alive", 5 * (F.col("n") - F.coalesce("own", F.lit(0))) >= 4 * F.col("n")).select("set", "rep", "n", "alive"), "judged-sets")
    release(packed)
    left = judged.where("alive").select(F.col("rep").alias("doc_id"), "set")
    n_left = left.count()
    if not n_left:
        target = judged.select("set", F.col("set").alias("root"), F.col("rep").alias("_least"))
        return _named(known, target)
    chosen = docs.join(F.broadcast(left) if n_left <= BROADCAST_SETS else left, "doc_id")
    sets = materialize(chosen.mapInArrow(_sets_left(n), "set long, n long, grams binary"), "sets")
    if sets.count() > n_left:  # rows that share a doc_id
        sets = materialize(sets.dropDuplicates(["set"]), "sets")
    postings = materialize(_postings(sets), "postings")
    salt = F.pmod(F.xxhash64("set"), F.ceil(F.col("df") / SALTED))
    order = Window.partitionBy("gram", "_salt").orderBy("n", F.xxhash64("gram", "set"))
    ahead = postings.withColumn("_salt", salt).select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("set", "n", "pos")))
    pairs = ahead.where(F.col("next_set").isNotNull() & _possible("", "next_"))
    links = count_pairs(sets, pairs.select(*_pair("", "next_")))
    roots = components(links)
    # Sets that their neighbours did not link meet a few random sets of other components, then all that bounds leave.
    for round_ in range(SAMPLED):
        named = _mixed(postings, roots)
        salt = F.pmod(F.xxhash64("set", F.lit(round_)), F.ceil(F.col("df") / SALTED))
        order = Window.partitionBy("gram", "_salt").orderBy(F.xxhash64("gram", "set", F.lit(round_)))
        ahead = named.withColumn("_salt", salt)
        reach = F.array(*(F.struct(*(F.lead(c, k).over(order).alias(c) for c in ("set", "n", "pos", "root"))) for k in range(1, REACH + 1)))
        ahead = ahead.withColumn("_ahead", reach).select("*", F.explode("_ahead").alias("y")).where("y.root <> root")
        ahead = ahead.select("set", "n", "pos", *(F.col(f"y.{c}").alias(f"next_{c}") for c in ("set", "n", "pos"))).where(_possible("", "next_"))
        more = count_pairs(sets, ahead.select(*_pair("", "next_")))
        if not more.count():
            break
        links = links.unionByName(more)
        roots = components(links)
    # A pair is made at the first n-gram that both share; the last EARLIER n-grams before a posting tell (nearly) all others.
    before = Window.partitionBy("set").orderBy("pos").rowsBetween(-EARLIER, -1)
    named = _mixed(postings, roots).withColumn("earlier", F.collect_list("gram").over(before)).join(_bitmaps(sets), "set")
    named = materialize(named, "mixed-postings")
    x = named.select("gram", *(F.col(c).alias(f"x_{c}") for c in ("set", "n", "pos", "root", "earlier", "bits")))
    y = named.select("gram", *(F.col(c).alias(f"y_{c}") for c in ("set", "n", "pos", "root", "earlier", "bits")))
    # Sets differ by at least the bits in which their bitmaps do, and similar ones by no more than a ninth of their n-grams.
    apart = sum((F.bit_count(F.col("x_bits")[i].bitwiseXOR(F.col("y_bits")[i])) for i in range(BITS // 64)), F.lit(0))
    fits = (F.col("x_root") < F.col("y_root")) & _possible("x_", "y_") & (9 * apart <= F.col("x_n") + F.col("y_n")) & ~F.arrays_overlap("x_earlier", "y_earlier")
    pairs = x.join(y, (x["gram"] == y["gram"]) & fits)
    more = count_pairs(sets, pairs.select(*_pair("x_", "y_")))
    if more.count():
        roots = components(links.unionByName(more))
    # From sets to documents: the least document of the sets of a component.
    rooted = judged.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("_least"))
    return _named(known, rooted.join(least, "root").select("set", "root", "_least"))


def _named(known: DataFrame, target: DataFrame) -> DataFrame:
    """Documents with the least document of their set's component; one without a set is its own."""
    target = materialize(target, "component-roots")  # so that the join may split the copies of one set
    out = known.where("set <> 0").join(target, "set", "left").select("doc_id", "n_shingles", "set", "root", "_least")
    out = out.unionByName(known.where("set = 0").select("doc_id", "n_shingles", "set", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("_least")))
    return out.select("doc_id", "n_shingles", "set", "root", F.when(F.col("doc_id").isNotNull(), F.coalesce("_least", "doc_id")).alias("component_id"))
