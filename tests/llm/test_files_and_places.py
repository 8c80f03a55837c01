from __future__ import annotations

import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import packing, sharding, token_files, warc
from quillmark.llm.common import SLICE_BYTES, scratch
from quillmark.llm.tokens import Encoder, tokenizer_path

from .data import documents, frame


def whole_ids(text):
    return Encoder.at(tokenizer_path()).whole.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_library_s():
    rng = random.Random(1)
    letters = "aAbé ÉßÜñ.,!$%'s0 9\n\t<|>́中  àÀ×÷İΣσς\x1c "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a<|endoftext|>b", "<|ENDOFTEXT|>", None, "don't we'll ab.,cd", ""]
    encoder = Encoder(tokenizer_path())
    for at in range(0, len(texts), 300):
        ids, off = encoder.encode(pa.array(texts[at : at + 300], pa.string()))
        for i, t in enumerate(texts[at : at + 300]):
            assert ids[off[i] : off[i + 1]].tolist() == whole_ids(t), repr(t)


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    ids = np.random.default_rng(0).integers(0, 2**32, 1001, dtype=np.uint64).astype("<u4")
    assert (token_files.from_planes(token_files.to_planes(ids, bits), len(ids)) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_round_trip(spark, bits):
    rows = documents()
    got = token_files.read(token_files.write(frame(spark, rows, extra=True), scratch(spark, "t"), bits=bits)).collect()
    ordered = sorted(got, key=lambda r: (r.start, r.n_tokens))
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    want = Counter((d, len(whole_ids(t)) + 1, zlib.crc32(np.array([*whole_ids(t), 1], "<u4").tobytes())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert token_files.write_and_read(frame(spark, [])).count() == 0


def test_packing(spark):
    rows = documents()
    got = packing.pack(packing.pieces(frame(spark, rows, extra=True), 64), 64, group=40).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    for d, t, *_ in rows:
        ids = np.array([*whole_ids(t), 0], "<u4").tobytes()
        cut = [(k, 64 * k, min(64, len(ids) // 4 - 64 * k), ids[256 * k : 256 * k + 256]) for k in range(-(-len(ids) // 256))]
        assert all(c in by_doc[d] for c in cut)
    assert len(got) == sum(-(-(len(whole_ids(t)) + 1) // 64) for _, t, *_ in rows)
    assert len(by_sequence) <= 1.03 * sum(r.length for r in got) / 64 + 2
    assert packing.pack(packing.pieces(frame(spark, [])), 64).count() == 0


def test_packing_deals_rows_of_no_id(spark):
    from pyspark.sql import functions as F

    # 100,000 pieces without an id, and columns of the names that the result has itself.
    items = spark.range(100_000, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("length"), F.lit("x").alias("offset"), F.lit("y").alias("filled"))
    got = packing.pack(items, 2048)
    assert dict(got.dtypes)["offset"] == "bigint" and "filled" not in got.columns
    rows = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("k")).collect()
    assert sum(r.k for r in rows) == 100_000 and all(r.n == r.end <= 2048 for r in rows)
    assert len(rows) <= 1.01 * sum(r.n for r in rows) / 2048 + 2
    groups = {r.sequence_id >> 28 for r in rows if r.sequence_id >> 56 == 0}
    assert len(groups) > 20


def test_texts_longer_than_a_slice(spark):
    rng = random.Random(8)
    rows = [(1, " ".join(f"w{rng.randrange(5000)}" for _ in range(1_600_000)), None, None, None), (2, "short one", None, None, None), (3, None, None, None, None)]
    assert len(rows[0][1]) > SLICE_BYTES
    df = frame(spark, rows).coalesce(1)
    ids = np.array([*whole_ids(rows[0][1]), 0], "<u4").tobytes()
    got = {(r.doc_id, r.piece): bytes(r.ids) for r in packing.pieces(df, 64).collect()}  # more pieces than leave at once
    assert len(got) > 2 * packing.BATCH and b"".join(got[1, k] for k in range(-(-len(ids) // 256))) == ids
    back = {r.doc_id: r.n_tokens for r in token_files.write_and_read(df).collect()}
    assert back[1] == len(ids) // 4 and back[3] == 1


def test_sum_of_squares_places_greedily():
    rng = random.Random(2)
    lengths = np.array([rng.randint(1, 20) for _ in range(300)])
    capacity, gaps, out = 20, Counter(), packing.place(lengths, 20)
    room: dict[int, int] = {}
    for s, b in zip(lengths.tolist(), out.tolist()):
        def cost(g, s=s):
            c = Counter(gaps)
            if g < capacity:
                c[g] -= 1
            c[g - s] += 1
            return sum(v * v for k, v in c.items() if 0 < k < capacity)

        options = [g for g in gaps if gaps[g] > 0 and g >= s] + [capacity]
        g = room.get(b, capacity)
        assert cost(g) == min(map(cost, options))
        if g < capacity:
            gaps[g] -= 1
        room[b] = g - s
        if g > s:
            gaps[g - s] += 1


def test_shards(spark):
    rows = documents() + [(1000 + i, f"t{i}", "en", "hot", 1) for i in range(400)]
    got = sharding.shards(frame(spark, rows), 24).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
        # Each source's share of a run is right to within one row, so a source is off by no more than there are sources.
        assert abs(sum(r.source == "hot" for r in got if r.shard == s) - 400 * sizes[s] / len(rows)) <= len({r.source for r in got})
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    again = sharding.shards(frame(spark, rows[::-1]), 24).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in got) == Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in again)
    assert sharding.shards(frame(spark, [])).count() == 0 and sharding.shards(frame(spark, rows[:5])).count() == 5


def test_shards_are_the_plain_order(spark):
    """Against ranks, fractions and cuts made over the whole list at once."""
    rows = [(d, t, a, s, n) for d, t, a, s, n in documents(5)] + [(2000 + i, f"t{i % 7}", "en", "hot", 1) for i in range(1500)]
    n, listed = 7, []
    for d, t, _, source, _ in rows:
        crc = zlib.crc32((t or "").encode())
        key = str(d) if d is not None else f"text {crc}"
        listed.append((source or "", source is None, int(hashlib.md5(f"interleave:{key}".encode()).hexdigest()[:13], 16), (d is not None, d or 0), crc, len((t or "").encode()) + 8))
    per = defaultdict(list)
    for r in sorted(listed):
        per[r[:2]].append(r)
    order = sorted(((k + 0.5) / len(v), *source, k + 1, r) for source, v in per.items() for k, r in enumerate(v))
    low, more = divmod(len(order), n)
    cut = [s for s in range(n) for _ in range(low + (s < more))]
    want = Counter((r[3][1] if r[3][0] else None, r[4], shard) for (*_, r), shard in zip(order, cut))
    got = sharding.shards(frame(spark, rows, extra=True).drop("source_"), n).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard) for r in got) == want


def brute_warc(pages):
    payloads = [(p, (h or "").encode()) for p, _, h in pages]
    first: dict = {}
    for p, b in payloads:
        if p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, b in payloads:
        again = len(b) >= 100 and b in first and (p is None or first[b] < p)
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return Counter(out)


def test_warc_round_trip(spark):
    big = "<p>é" * 700_000
    pages = [(1, "http://a/", big), (2, "http://a/2", big), (3, None, None), (4, "u\r\nX: y", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "y" * 100), (8, "u", "y" * 100), (9, "u", "\r\n\r\nWARC/1.1\r\n"), (9, "u", "y" * 100), (9, "u", "y" * 100), (None, "u", "y" * 100), (None, "u", "q" * 300), (None, None, "q" * 300), (None, None, big + "x"), (None, "u", None)]
    pages += [(100 + i, "u", "z" * 200) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.write_and_read(df).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute_warc(pages)
    chunks = warc.read(warc.write(df.where("page_id < 3"), scratch(spark, "w"))).where("page_id = 1").orderBy("chunk").collect()
    assert len(chunks) == 4 and max(c.size for c in chunks) <= warc.CHUNK and b"".join(bytes(c.payload) for c in chunks) == big.encode()
    assert [c.digest for c in chunks] == [hashlib.sha256(big.encode()[: warc.CHUNK * (k + 1)]).hexdigest() for k in range(4)]
    assert warc.write_and_read(df.limit(0)).count() == 0


def test_warc_many_pages_without_an_id(spark):
    rows = [(None, f"u{i}", "same payload " * 20) for i in range(400)] + [(5, "u", "same payload " * 20), (9, "u", "x")]
    got = warc.write_and_read(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == {(None, "revisit", 5): 400, (5, "response", None): 1, (9, "response", None): 1}


def member(raw: bytes) -> bytes:
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def test_warc_refuses_a_torn_record():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\nabc\r\n\r\n"
    whole = member(one % 3)
    assert [d for *_, d, _ in warc.records(io.BytesIO(whole * 2))] == [b"abc", b"abc"]
    for torn in (member(one % 10), member(one % 2), whole + whole[: len(whole) // 2], whole + whole[:-1], whole + member(b"WARC/1.1\r\nWARC-Ty")):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(torn)))


def test_warc_refuses_a_file_with_fewer_records(spark):
    from pyspark.sql import functions as F

    files = warc.write(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string").coalesce(1), scratch(spark, "w"))
    assert warc.read(files).count() == 2
    with pytest.raises(Exception, match="records of"):
        warc.read(files.withColumn("n_records", F.col("n_records") + 1)).count()
