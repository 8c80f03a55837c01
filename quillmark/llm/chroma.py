"""Chroma audio fingerprints of a media column.

PCM recordings (16-bit mono, a binary column) are cut into overlapping frames; a frame's spectrum is folded into twelve
pitch classes. Over the integral image of frames and classes, sixteen rectangular filters compare areas; each value falls
between three fitted thresholds and gives two Gray-coded bits, so a frame becomes one 32-bit integer.

Recordings align by equal pairs of integers: the matches of two recordings are counted by offset, the fullest offset is taken, and
the share of differing bits over the overlap there decides. A pair that stands several times in a recording counts at its first place,
and one of twice the same integer (silence, a held note) tells no place and is no key, so recordings of long silence do not meet frame
by frame. Recordings with equal fingerprints are one class in the search, so copies are not expanded into pairs; no candidate is
capped. A key that many recordings share is a skewed join key, which is split by the adaptive join, and counts are summed before
they are shuffled. `search` finds pairs with `least_hits` common keys; `exhaustive` tries every offset of every pair and misses none.

Defined results: null audio, or fewer samples than a frame, has an empty fingerprint and matches nothing; an odd last byte
is dropped; silence has all values 0; a fingerprint of any length matches its own class; rows that share an id are recordings of their
own with that id; of offsets with equal hits the least shift is taken; a recording of any length is fingerprinted whole, one at a time;
an empty table gives no rows. Thresholds are fitted on every frame of every recording, by counts of values to the nearest 1 / GRID;
every recording is indexed. Other columns than those named are ignored, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

RATE, FRAME, HOP = 1024, 256, 64
#: Frames between the two integers of a key.
APART = 4
LOW_HZ, HIGH_HZ = 100.0, 480.0
#: Steps per unit in which filter values are counted, and a bound of these: they are less than log(1 + 8 * sqrt(6)).
GRID, REACH = 4096, 4
PRINTS = "rec_id long, n_samples long, prints array<int>"


def _filters() -> list[tuple[int, int, int, int]]:
    """Kind, lowest class, classes and frames of each filter, by rule."""
    out = []
    for i in range(16):
        tall = 2 + 2 * (i % 3)
        out.append((1 + i % 5, (5 * i) % (13 - tall), tall, (4, 6, 8)[i % 3]))
    return out


WIDEST = max(f[3] for f in _filters())


@lru_cache(1)
def _fold() -> np.ndarray:
    """Spectrum bins to pitch classes."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12))
    for b, f in enumerate(hz):
        if LOW_HZ <= f <= HIGH_HZ:
            note = 12 * np.log2(f / 440.0)
            low = int(np.floor(note))
            out[b, low % 12] += 1 - (note - low)
            out[b, (low + 1) % 12] += note - low
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class frames of a recording, each of unit length or zero."""
    n = (len(samples) - FRAME) // HOP + 1 if len(samples) >= FRAME else 0
    if n <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.as_strided(samples, (n, FRAME), (HOP * samples.strides[0], samples.strides[0]))
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    out = power @ _fold()
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-12), 0.0)


def values(image: np.ndarray) -> np.ndarray:
    """Filter values at each frame that the widest filter fits, from the integral image."""
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros((0, 16))
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return total[at + t1, y1] - total[at + t0, y1] - total[at + t1, y0] + total[at + t0, y0]

    out = np.zeros((n, 16))
    for i, (kind, y, tall, wide) in enumerate(_filters()):
        whole, h, w = area(0, wide, y, y + tall), tall // 2, wide // 2
        if kind == 1:  # lower against upper classes
            part = area(0, wide, y, y + h)
        elif kind == 2:  # earlier against later frames
            part = area(0, w, y, y + tall)
        elif kind == 3:  # crosswise quarters
            part = area(0, w, y, y + h) + area(w, wide, y + h, y + tall)
        elif kind == 4:  # the middle classes against the rest
            part = area(0, wide, y + tall // 4, y + tall - tall // 4) if tall > 3 else area(0, wide, y, y + 1)
        else:  # the middle frames against the rest
            part = area(wide // 4, wide - wide // 4, y, y + tall)
        out[:, i] = np.log((1 + part) / (1 + whole - part))
    return out


def prints(audio: bytes | None, thresholds: np.ndarray) -> np.ndarray:
    """Packed integers of a recording; thresholds: three ascending values per filter."""
    raw = audio or b""
    found = values(chroma(np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float64)))
    level = (found[:, :, None] > thresholds[None]).sum(axis=2)
    gray = np.array([0, 1, 3, 2], np.uint32)[level]
    return (gray << (2 * np.arange(16, dtype=np.uint32))).sum(axis=1, dtype=np.uint64).astype(np.uint32).view(np.int32)


def fit(media: DataFrame) -> np.ndarray:
    """Quartiles of each filter over every frame of every recording, of values to the nearest 1 / GRID. A task holds counts, not values."""

    def task(batches):
        counts = np.zeros((16, 2 * REACH * GRID + 1), np.int64)
        for batch in batches:
            for a in batch.column("audio"):
                raw = a.as_py() or b""
                at = np.rint(GRID * values(chroma(np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float64)))).astype(np.int64)
                np.add.at(counts, (np.arange(16), at + REACH * GRID), 1)
        i, at = counts.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array((at - REACH * GRID) / GRID), pa.array(counts[i, at])], ["i", "x", "n"])

    counted = media.select("audio").mapInArrow(task, "i long, x double, n long").groupBy("i", "x").agg(F.sum("n").alias("n"))
    cuts = counted.groupBy("i").agg(F.percentile("x", [0.25, 0.5, 0.75], F.col("n")).alias("q")).collect()  # 16 rows
    out = np.tile([-0.1, 0.0, 0.1], (16, 1))
    for r in cuts:
        out[r.i] = r.q
    return out


def fingerprints(media: DataFrame, thresholds: np.ndarray) -> DataFrame:
    """media: rec_id, audio. The packed integers of every recording."""

    def task(batches):
        for batch in batches:
            audio = batch.column("audio")
            got = [prints(a.as_py(), thresholds).tolist() for a in audio]
            size = [(len(a.as_py()) // 2 if a.is_valid else 0) for a in audio]
            yield pa.RecordBatch.from_arrays([batch.column("rec_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(got, pa.list_(pa.int32()))], ["rec_id", "n_samples", "prints"])

    return media.select("rec_id", "audio").mapInArrow(task, PRINTS)


def _classes(found: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints (cls, match_id, match_size, prints), and the queries' (query_id, q)."""
    found = found.where("rec_id is not null and size(prints) > 0").withColumn("cls", F.xxhash64("prints"))
    classes = materialize(found.groupBy("cls").agg(F.min("rec_id").alias("match_id"), F.count("*").alias("match_size"), F.first("prints").alias("prints")), "chroma-classes")
    asked = materialize(found.join(queries, "rec_id", "left_semi").select(F.col("rec_id").alias("query_id"), F.col("cls").alias("q")).distinct(), "chroma-queries")
    return classes, asked


def keyed(rows: DataFrame, c: str, p: str) -> DataFrame:
    """The keys of classes (cls, prints): an integer and the one APART frames on, whose samples it does not share, as one number."""

    def task(batches):
        for batch in batches:
            flat, cut = np.asarray(batch.column("prints").flatten()).view(np.uint32).astype(np.uint64), np.asarray(batch.column("prints").offsets)
            cut, cls = cut - cut[0], batch.column("cls").to_numpy()
            for lo in range(0, batch.num_rows, 2_000):
                ids, keys, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in range(lo, min(lo + 2_000, batch.num_rows)):
                    x = flat[cut[i] : cut[i + 1]]
                    key, at = np.unique((x[:-APART] << np.uint64(32)) | x[APART:], return_index=True)
                    tells = (key >> np.uint64(32)) != (key & np.uint64(0xFFFFFFFF))
                    ids.append(np.full(int(tells.sum()), cls[i]))
                    keys.append(key[tells].view(np.int64))
                    places.append(at[tells])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (ids, places, keys)], [c, p, "key"])

    return rows.select("cls", "prints").mapInArrow(task, f"{c} long, {p} long, key long")


def search(found: DataFrame, queries: DataFrame, least_hits: int = 3, most_error: float = 0.15, least_overlap: int = 20) -> DataFrame:
    """queries: rec_id of recordings in `found`. Returns query_id, match_id (least id of a class of equal fingerprints),
    match_size, offset (frames that the match lies ahead), n_hits, bit_error, and the classes of both (see `members`)."""
    classes, asked = _classes(found, queries)
    wanted = asked.select(F.col("q").alias("cls")).distinct()
    index = keyed(classes, "c", "p")
    probe = keyed(classes.join(wanted, "cls", "left_semi"), "q", "o")
    hits = probe.join(index, "key").where("q <> c").groupBy("q", "c", (F.col("o") - F.col("p")).alias("offset")).agg(F.count("*").alias("n_hits"))
    best = hits.where(F.col("n_hits") >= least_hits).groupBy("q", "c").agg(F.max(F.struct("n_hits", -F.abs("offset"), "offset")).alias("b"))
    best = best.select("q", "c", "b.n_hits", F.col("b.offset").cast("int").alias("offset"))
    a, b = classes.select(F.col("cls").alias("q"), F.col("prints").alias("qp")), classes.select(F.col("cls").alias("c"), "match_id", "match_size", F.col("prints").alias("cp"))
    both = best.join(a, "q").join(b, "c")
    start_q, start_c = F.greatest("offset", F.lit(0)), F.greatest(-F.col("offset"), F.lit(0))
    n = F.least(F.size("qp") - start_q, F.size("cp") - start_c)
    both = both.withColumn("overlap", n).where(F.col("overlap") >= least_overlap)
    both = both.withColumn("wrong", F.zip_with(F.slice("qp", start_q + 1, F.col("overlap")), F.slice("cp", start_c + 1, F.col("overlap")), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))))
    both = both.withColumn("bit_error", F.aggregate("wrong", F.lit(0), lambda s, x: s + x) / (32.0 * F.col("overlap"))).where(F.col("bit_error") <= most_error)
    both = both.select("q", "c", "match_id", "match_size", "offset", "n_hits", "bit_error")
    # Its own class is a query's match whatever its length.
    own = classes.join(wanted, "cls", "left_semi").select(F.col("cls").alias("q"), F.col("cls").alias("c"), "match_id", "match_size", F.lit(0).alias("offset"), F.size("prints").cast("long").alias("n_hits"), F.lit(0.0).alias("bit_error"))
    return asked.join(both.unionByName(own), "q").select("query_id", "match_id", "match_size", "offset", "n_hits", "bit_error", F.col("q").alias("query_class"), F.col("c").alias("match_class"))


def exhaustive(found: DataFrame, queries: DataFrame, most_error: float = 0.15, least_overlap: int = 20, block: int = 200) -> DataFrame:
    """Every pair that `search` could find at any offset: the queries' classes, `block` at a time, are tried against every class.
    query_id, match_id, match_size, offset, bit_error, query_class, match_class. It costs queries x recordings x offsets."""
    spark = found.sparkSession
    classes, asked = _classes(found, queries)
    wanted = materialize(classes.join(asked.select(F.col("q").alias("cls")).distinct(), "cls", "left_semi"), "chroma-wanted")
    blocks, out = max(1, -(-wanted.count() // block)), None
    for b in range(blocks):
        state = spark.sparkContext.broadcast(wanted.where(F.pmod(F.xxhash64("cls"), F.lit(blocks)) == b).select("cls", "prints").toArrow())

        def task(batches, state=state):
            names = state.value["cls"].to_pylist()
            listed = [np.array(p, np.int64).astype(np.uint32) for p in state.value["prints"].to_pylist()]
            size = np.array([len(p) for p in listed], np.int64)
            q = np.zeros((len(listed), int(size.max(initial=0))), np.uint32)
            for i, p in enumerate(listed):
                q[i, : len(p)] = p
            for batch in batches:
                rows = []
                for cls, prints_ in zip(batch.column("cls").to_pylist(), batch.column("prints").to_pylist()):
                    c = np.array(prints_, np.int64).astype(np.uint32)
                    error, best = np.full(len(listed), 2.0), np.zeros(len(listed), np.int64)
                    for off in range(least_overlap - len(c), q.shape[1] - least_overlap + 1):
                        a, z = max(off, 0), max(-off, 0)
                        width = min(q.shape[1] - a, len(c) - z)
                        n = np.minimum(size - a, width)
                        wrong = np.bitwise_count(q[:, a : a + width] ^ c[z : z + width]) * (np.arange(width) < n[:, None])
                        e = np.where(n >= least_overlap, wrong.sum(axis=1) / (32.0 * np.maximum(n, 1)), 2.0)
                        better = e < error
                        error[better], best[better] = e[better], off
                    rows += [(names[i], cls, int(best[i]), float(error[i])) for i in np.flatnonzero(error <= most_error).tolist() if names[i] != cls]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows)], ["q", "c", "offset", "bit_error"])

        got = materialize(classes.select("cls", "prints").mapInArrow(task, "q long, c long, offset long, bit_error double"), "chroma-tried")
        state.destroy()
        out = got if out is None else out.unionByName(got)
    own = wanted.select(F.col("cls").alias("q"), F.col("cls").alias("c"), F.lit(0).cast("long").alias("offset"), F.lit(0.0).alias("bit_error"))
    both = out.unionByName(own).join(classes.select(F.col("cls").alias("c"), "match_id", "match_size"), "c")
    return asked.join(both, "q").select("query_id", "match_id", "match_size", "offset", "bit_error", F.col("q").alias("query_class"), F.col("c").alias("match_class"))


def members(found: DataFrame) -> DataFrame:
    """The class of equal fingerprints of every recording; null where it takes no part in the search."""
    return found.select("rec_id", F.when(F.col("rec_id").isNotNull() & (F.size("prints") > 0), F.xxhash64("prints")).alias("class"))


def aligned(found: DataFrame, queries: DataFrame) -> DataFrame:
    """The whole result as rows of two kinds: `pair`, a query and a class that it aligns with, and `member`, a recording and its class."""
    pairs = search(found, queries).select(F.lit("pair").alias("kind"), F.col("query_id").alias("rec_id"), F.col("query_class").alias("class"), "match_class", "match_id", "match_size", "offset", "n_hits", "bit_error")
    return pairs.unionByName(members(found).withColumn("kind", F.lit("member")), allowMissingColumns=True)


def summary(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per query: the classes and recordings that it aligns with, itself included, and the nearest of the others."""
    other = F.col("match_id") != F.col("query_id")
    nearest = F.min(F.when(other, F.struct("bit_error", "match_id", "offset")))
    per = pairs.groupBy("query_id").agg(F.count("*").alias("n_classes"), F.sum("match_size").alias("n_recordings"), nearest.alias("_n"))
    out = queries.select(F.col("rec_id").alias("query_id")).join(per, "query_id", "left")
    return out.select("query_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_classes", "n_recordings")), F.col("_n.match_id").alias("nearest_id"), F.col("_n.offset").alias("offset"), F.col("_n.bit_error").alias("bit_error"))


# -- a media table to run on -----------------------------------------------------------------------


def tune(vector, lead: int) -> bytes:
    """A vector as a melody: a note per component, its pitch by the component's value, after `lead` silent notes."""
    v = np.nan_to_num(np.asarray(vector if vector is not None else [], np.float64))
    note = (5 * np.clip(np.round(v / 0.125), -4, 4)) % 24
    hz = 110.0 * 2 ** (np.repeat(note, HOP) / 12)
    wave = 9000 * np.sin(2 * np.pi * np.cumsum(hz) / RATE)
    return np.concatenate([np.zeros(lead * HOP), wave]).astype("<i2").tobytes()


def media_of(embeddings: DataFrame) -> DataFrame:
    """A media table (rec_id, audio) rendered from vectors: similar vectors sound alike, with starts that differ."""

    def task(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = part.column("vec_id")
                audio = [tune(v.as_py(), (i.as_py() or 0) % 5) if v.is_valid else None for i, v in zip(ids, part.column("embedding"))]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(audio, pa.binary())], ["rec_id", "audio"])

    return embeddings.select("vec_id", "embedding").mapInArrow(task, "rec_id long, audio binary")
