"""Substring deduplication by prefix-partitioned suffix trees.

Every suffix of a document's words that has at least `window` words belongs to the group of its prefix. Prefixes are of
variable length: a suffix's ends with the run of GRAM words, among those in its first `window` words, whose hash is least.
Suffixes of equal first `window` words have equal prefixes, so they meet in one group, and neighbouring suffixes mostly share
their run, so they travel as one stretch of words. Suffixes are counted by ranges of prefixes first; in a range of more than HEAVY,
as around a line that very many documents hold, prefixes are lengthened to the whole window, so that groups are of memory size.

A group's subtree is held as its sorted suffixes: ranks of 1, 2, 4, ... words are doubled up to the window (over exact word
codes, not hashes), and equal ranks at that depth are the suffixes below one internal node. A node with suffixes of two documents
lies on a maximal repeat; joining a document's windows at such nodes gives the repeats' spans. A hash of each window tells
beforehand which suffixes are alone and need no sorting; it decides nothing else.

A word is removed if it lies in a window that also starts in a document of smaller doc_id. A task first judges its own slice
of text the same way: of the suffixes below a node only those of its least document go on, the others are already known to be
repeats. So a passage that a third of all documents share sends one window per slice, and of a lengthened prefix one per task.

Defined results: a null text has no words; documents of fewer words than a window keep all; a row with a null doc_id keeps
all and removes nothing elsewhere; rows that share a doc_id never remove each other's words; repeated rows are judged each by itself; a
text longer than a slice is one slice; an empty table gives no rows. A column of a name that the result has itself is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import K1, K2, U64, Words, blob, fragments, joined, materialize, mix, ragged, scaled, slices, text_bytes

WINDOW, GRAM = 50, 5
#: Text that a task judges at a time, and text behind a group; its suffixes carry three times that text.
SLICE, GROUP = 4 << 20, 5 << 20
#: Ranges of prefixes in a group, and suffixes in one beyond which prefixes are whole windows (twice the mean of full groups).
BUCKETS, HEAVY = 8, 1 << 18
#: Lengthened prefixes that a task remembers before it starts afresh: bounds memory, never results.
REMEMBERED = 50_000
_RUNS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("rows", pa.binary()), ("starts", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
RUNS = "part int, kind int, docs binary, rows binary, starts binary, lengths binary, words binary"
SPANS = "doc_id long, row_key long, start long, end long"
OWN = ("_n_words", "_n_removed", "_kept", "_spans", "_found", "_doc")


def _row_keys(h: np.ndarray, off: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Tells rows that share a doc_id by their words."""
    place = np.arange(len(h)) - np.repeat(off[:-1], np.diff(off))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ (place.astype(U64) * K2)))])
    return mix((total[off[1:]] - total[off[:-1]]) ^ (doc.view(U64) * K1))


def _prefix_ends(m: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Of each suffix at `at`, where its least run of GRAM words starts; m: hashes of runs. Equal hashes: the first of them."""
    w = window - GRAM + 1
    n = -(-len(m) // w) * w
    value = np.full(n, np.iinfo(np.uint64).max, U64)
    value[: len(m)] = (mix(m * K2) & U64(0xFFFFFFFF00000000)) | np.arange(len(m), dtype=U64)
    blocks = value.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(back[at], ahead[at + w - 1]) & U64(0xFFFFFFFF)).astype(np.int64)


def nodes(words: Words, at: np.ndarray, depth: int) -> np.ndarray:
    """The tree node at `depth` of each suffix at `at` (of at least depth words): equal numbers for equal words, ascending as they sort."""
    cover = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + depth, -1)
    inside = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    place = np.zeros(len(words.start), np.int64)
    place[inside] = np.arange(len(inside))
    start, size = words.start[inside], (words.end - words.start)[inside]
    cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    listed = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(words.raw[ragged(start, size)].tobytes())])
    rank = listed.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def after(r: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([r[by:], np.zeros(min(by, len(r)), np.int64)])

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)

    at, found, done, length = place[at], None, 0, 1
    while True:
        if depth & length:
            part = after(rank, done)[at]
            found, done = part if found is None else paired(found, part), done + length
        if 2 * length > depth:
            return found
        rank, length = paired(rank, after(rank, length)), 2 * length


def _repeats(words: Words, g: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Which suffixes also stand in a document of smaller id. g: hashes of windows; doc: of each suffix."""
    out = np.zeros(len(at), bool)
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    some = np.sort(order[same[1:] | same[:-1]])  # the others are leaves
    if len(some):
        node = nodes(words, at[some], window)
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc[some])
        out[some] = doc[some] > least[node]
    return out


def _thinned(run: pa.RecordBatch, window: int, judged: bool = True):
    """Of a slice with a suffix of a window: words, ids, row keys; of suffixes of rows with an id: word, row, prefix hash, window hash, known repeat (none if not judged); else None."""
    words = Words(run.column("text"), lower=False)
    h = words.hashes()
    if len(h) < window:
        return None
    ids = run.column("doc_id")
    doc, missing = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
    g, fits = words.grams(h, window)
    at = np.flatnonzero(fits)
    row = words.row()[at]
    at, row = at[~missing[row]], row[~missing[row]]
    if not len(at):
        return None
    m, _ = words.grams(h, GRAM)
    prefix = mix(m[_prefix_ends(m, at, window)] * K1)
    return words, doc, _row_keys(h, words.off, doc), at, row, prefix, g[at], _repeats(words, g[at], at, doc[row], window) if judged else np.zeros(len(at), bool)


def _count(window: int, buckets: int):
    """Different windows of each slice by range of prefixes: about as many suffixes as it sends."""

    def task(batches):
        for batch in batches:
            for run in slices(batch, limit=SLICE):
                got = _thinned(run, window, judged=False)
                if got is not None:
                    *_, prefix, g, _ = got
                    where, n = np.unique(scaled(prefix[np.unique(g, return_index=True)[1]], buckets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(n, pa.int64())], ["bucket", "n"])

    return task


def _heavy(docs: DataFrame, window: int, buckets: int, most: int) -> np.ndarray:
    """Which ranges have more than `most` suffixes: a bit for each range, of which there is one for each GROUP / BUCKETS bytes of text."""
    counts = docs.mapInArrow(_count(window, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    long = counts.where(F.col("n") > most).select((F.col("bucket") + 1).alias("b"))
    blocks = long.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    bits = np.zeros(-(-buckets // 8), np.uint8)
    for r in blocks.toLocalIterator():  # a block of 32768 ranges at a time
        at = (r.k - 1) * 4096
        part = np.frombuffer(r.bits, np.uint8)[: len(bits) - at]
        bits[at : at + len(part)] = part
    return bits


def _marked(bits: np.ndarray, where: np.ndarray) -> np.ndarray:
    return (bits[where >> 3] >> (where & 7).astype(np.uint8) & 1).astype(bool)


def _send(window: int, parts: int, heavy):
    """Stretches of suffixes to their groups, with their words; known repeats as spans. heavy: the bits of `_heavy`, broadcast."""

    def task(batches):
        import zstandard

        pack, sent = zstandard.ZstdCompressor(level=1).compress, {}
        for batch in batches:
            for run in slices(batch, limit=SLICE):
                got = _thinned(run, window)
                if got is None:
                    continue
                words, doc, keys, at, row, prefix, g, known = got
                lengthened = _marked(heavy.value, scaled(prefix, parts * BUCKETS))
                raw = words.raw.tobytes() if lengthened.any() else b""
                for i in np.flatnonzero(lengthened & ~known).tolist():
                    text, d = raw[words.start[at[i]] : words.end[at[i] + window - 1]], int(doc[row[i]])
                    before = sent.get(text, d)
                    known[i] = before < d
                    if d <= before:
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent[text] = d
                part = np.where(known, parts, scaled(np.where(lengthened, mix(g * K1), prefix), parts))
                # Neighbouring suffixes of one document and group are one stretch.
                first = np.concatenate([[True], (part[1:] != part[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])
                start = np.flatnonzero(first)
                length = np.diff(np.append(start, len(at)))
                by = np.argsort(part[start].astype(np.int32), kind="stable")
                start, length = start[by], length[by]
                own, p = row[start], part[start]
                begin = at[start] - words.off[own]
                cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                out = []
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(p)]):
                    done = p[a] == parts
                    where = parts + int(mix(keys[own[a : a + 1]])[0] % U64(parts)) if done else int(p[a])
                    text = None
                    if not done:
                        each = ragged(at[start[a:b]], length[a:b] + window - 1)
                        text = pack(_kept_by(words, each).tobytes())
                    out.append((where, int(done), blob(doc[own[a:b]], "<i8"), blob(keys[own[a:b]], "<u8"), blob(begin[a:b], "<u4"), blob(length[a:b], "<u4"), text))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _RUNS)], schema=_RUNS)

    return task


def _kept_by(words: Words, which: np.ndarray) -> np.ndarray:
    """The bytes of the given words, a space after each."""
    start, size = words.start[which], (words.end - words.start)[which]
    at = np.cumsum(size + 1) - size - 1
    text = np.full(int(size.sum()) + len(size), 32, np.uint8)
    text[ragged(at, size)] = words.raw[ragged(start, size)]
    return text


def _judge(window: int):
    """Per group: the spans at nodes of depth `window` that a smaller document also has."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        import zstandard

        docs, keys, starts, lengths = joined(rows["docs"], "<i8"), joined(rows["rows"], "<i8"), joined(rows["starts"], "<u4").astype(np.int64), joined(rows["lengths"], "<u4").astype(np.int64)
        if rows["kind"][0].as_py():
            return pa.Table.from_arrays([pa.array(docs), pa.array(keys), pa.array(starts), pa.array(starts + lengths - 1 + window)], schema=_SPANS)
        unpack = zstandard.ZstdDecompressor().decompress
        text = b"".join(unpack(x) for x in rows["words"].to_pylist())
        words = Words(pa.Array.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, len(text)], np.int64).tobytes()), pa.py_buffer(text)]).view(pa.large_string()), lower=False)
        g, _ = words.grams(words.hashes(), window)
        room = lengths + window - 1
        at = ragged(np.cumsum(room) - room, lengths)
        of = np.repeat(np.arange(len(docs)), lengths)
        hit = np.flatnonzero(_repeats(words, g[at], at, docs[of], window))
        if not len(hit):
            return _SPANS.empty_table()
        new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])])
        a, b = hit[new], hit[np.append(new[1:], True)]
        r = of[a]
        begin = starts[r] - (np.cumsum(lengths) - lengths)[r]
        return pa.Table.from_arrays([pa.array(docs[r]), pa.array(keys[r]), pa.array(begin + a), pa.array(begin + b + window)], schema=_SPANS)

    return task


def repeated_spans(docs: DataFrame, window: int = WINDOW, heavy: int = HEAVY) -> DataFrame:
    """doc_id, row_key and spans [start, end) in words that repeat a window of a document of smaller doc_id; spans may overlap."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = fragments(text_bytes(docs), docs.sparkSession, GROUP)
    long = docs.sparkSession.sparkContext.broadcast(_heavy(docs, window, parts * BUCKETS, heavy))
    return docs.mapInArrow(_send(window, parts, long), RUNS).groupBy("part").applyInArrow(_judge(window), SPANS)


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of docs, with _n_words, _n_removed, _kept (the words left, by single spaces) and _spans (merged)."""
    docs = docs.drop(*OWN)
    spans = repeated_spans(docs, window).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("row_key", "start", "end")).alias("_found"))
    spans = materialize(spans, "repeat-spans")  # so that the join may split rows of one id
    known = docs.where("doc_id is not null")
    both = known.join(spans, F.col("doc_id").cast("long") == F.col("_doc"), "left").drop("_doc")
    both = both.unionByName(docs.where("doc_id is null").withColumn("_found", F.lit(None).cast(both.schema["_found"].dataType)))
    names = docs.columns
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _n_words long, _n_removed long, _kept string, _spans array<struct<start:bigint,end:bigint>>"

    def task(batches):
        for batch in batches:
            for run in slices(batch, limit=SLICE):
                words = Words(run.column("text"), lower=False)
                found = run.column("_found")
                keys = None
                gone = np.zeros(len(words.start), bool)
                spans = []
                for i in range(run.num_rows):
                    mine: list[dict] = []
                    if found[i].is_valid:
                        if keys is None:
                            keys = _row_keys(words.hashes(), words.off, run.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy()).view(np.int64)
                        each = found[i].values
                        ok = each.field("row_key").to_numpy() == keys[i]
                        a, b = each.field("start").to_numpy()[ok], each.field("end").to_numpy()[ok]
                        if len(a):
                            n = int(words.off[i + 1] - words.off[i])
                            edge = np.zeros(n + 1, np.int64)
                            np.add.at(edge, a, 1)
                            np.add.at(edge, b, -1)
                            hit = np.cumsum(edge)[:n] > 0
                            gone[words.off[i] : words.off[i + 1]] = hit
                            turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                            mine = [{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2])]
                    spans.append(mine)
                text, off = _kept(words, ~gone)
                removed = np.concatenate([[0], np.cumsum(gone)])[words.off]
                kept = pa.Array.from_buffers(pa.large_string(), run.num_rows, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(text.tobytes())]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in names), pa.array(np.diff(words.off)), pa.array(np.diff(removed)), kept, pa.array(spans, span)], [*names, "_n_words", "_n_removed", "_kept", "_spans"])

    return both.mapInArrow(task, ddl)


def _kept(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the kept words of each row by single spaces, and n+1 offsets."""
    row = words.row()[keep]
    start, size = words.start[keep], (words.end - words.start)[keep]
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    room = size + ~last  # a space after each but the last of its row
    at = np.cumsum(room) - room
    text = np.full(int(room.sum()), 32, np.uint8)
    text[ragged(at, size)] = words.raw[ragged(start, size)]
    per = np.bincount(row, weights=room, minlength=len(words.off) - 1) if len(row) else np.zeros(len(words.off) - 1)
    return text, np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
