"""Token-id files by plane shuffling.

A file holds blocks of at most BLOCK ids. A block's little-endian 32-bit ids are transposed into four byte planes (or 32
bit planes) and each plane is compressed with zstandard by itself: the high planes of small ids are nearly constant. At
the end stand the document table, the chunk index (place, ids and plane sizes of each block), its length and a magic.

`write` sorts documents by doc_id over range partitions, so the files ascend from one to the next, and each task streams
its partition into one file block by block. A file is written under an attempt's own name and then moved, so a lost or
repeated task leaves one whole file. `read` decodes block by block; no task ever holds a whole file's ids.

Defined results: a null text is empty; every document ends with `end_id` if one is given; rows with a null doc_id come
first; rows that share a doc_id keep an entry each, in the order of their texts' hashes, so that starts are the same in every run; a text
longer than a slice is tokenized by itself; an empty table makes no documents. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, slices
from .tokens import Encoder, tokenizer_path

MAGIC = b"QMTOKENS"
BLOCK = 1 << 16
FILE_SCHEMA = "part int, path string, n_docs long, n_tokens long"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    planes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if not bits:
        return [p.tobytes() for p in planes]
    return [np.packbits((p >> b) & 1).tobytes() for p in planes for b in range(8)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bit = [np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes]
    return np.stack([sum(bit[8 * k + b] << b for b in range(8)).astype(np.uint8) for k in range(4)], axis=1).reshape(-1).view("<u4")


class PlaneWriter:
    def __init__(self, out, bits: bool = False, level: int = 1):
        import zstandard

        self.out, self.bits, self.at, self.index = out, bits, 0, []
        self.pack, self.rest, self.held = zstandard.ZstdCompressor(level=level).compress, [], 0
        self.n_ids = 0

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, ids: np.ndarray) -> None:
        self.index.append([self.at, len(ids), [self._put(self.pack(p)) for p in to_planes(ids, self.bits)]])

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= BLOCK:
            whole = np.concatenate(self.rest)
            full = len(whole) // BLOCK * BLOCK
            for k in range(0, full, BLOCK):
                self._block(whole[k : k + BLOCK])
            self.rest, self.held = [whole[full:].copy()], len(whole) - full

    def close(self, docs: np.ndarray) -> None:
        """docs: rows of doc_id, whether it is null, and number of ids."""
        if self.held:
            self._block(np.concatenate(self.rest))
        table = [self.at, self._put(self.pack(np.ascontiguousarray(docs, "<i8").tobytes()))]
        index = self.pack(json.dumps({"block": BLOCK, "docs": table, "blocks": self.index}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)


class PlaneReader:
    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        end = file.size()
        size, magic = struct.unpack("<Q8s", file.read_at(16, end - 16))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.meta = json.loads(self.unpack(file.read_at(size, end - 16 - size)))

    def docs(self) -> np.ndarray:
        at, size = self.meta["docs"]
        return np.frombuffer(self.unpack(self.file.read_at(size, at)), "<i8").reshape(-1, 3)

    def blocks(self):
        for at, n, sizes in self.meta["blocks"]:
            raw = self.file.read_at(sum(sizes), at)
            cut = np.concatenate([[0], np.cumsum(sizes)])
            yield from_planes([self.unpack(raw[a:b]) for a, b in zip(cut[:-1], cut[1:])], n)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 1, bits: bool = False) -> DataFrame:
    """Write the token ids of all documents in ascending doc_id order; returns the table of files."""
    tokenizer = tokenizer or tokenizer_path()

    def task(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name = f"{path}/part-{part:06d}.qmt"
        store, place = _open(name)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        encoder, table = Encoder.at(tokenizer), []
        with store.open_output_stream(f"{place}.{attempt}.tmp", compression=None) as out:
            writer = PlaneWriter(out, bits)
            for batch in batches:
                for run in slices(batch):
                    ids, off = encoder.encode(run.column("text"))
                    size = np.diff(off)
                    if end_id is not None:
                        ids = np.insert(ids, off[1:], np.uint32(end_id))
                        size = size + 1
                    doc = run.column("doc_id")
                    table.append(np.stack([doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64), size], axis=1))
                    writer.add(ids)
            rows = np.concatenate(table) if table else np.zeros((0, 3), np.int64)
            writer.close(rows)
        if len(rows):
            store.move(f"{place}.{attempt}.tmp", place)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "n_docs": [len(rows)], "n_tokens": [writer.n_ids]})
        else:
            store.delete_file(f"{place}.{attempt}.tmp")

    order = [F.col("doc_id"), F.xxhash64("text"), F.octet_length("text")]  # rows of one id are dealt too
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.mapInArrow(task, FILE_SCHEMA), "token-files")


def read(files: DataFrame) -> DataFrame:
    """A row per document of the files: its id, the ids before it, its number of ids and their crc32."""
    n = files.count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))  # a row per file

    def task(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, place = _open(path)
                with store.open_input_file(place) as file:
                    reader = PlaneReader(file)
                    docs = reader.docs()
                    ends = np.cumsum(docs[:, 2])
                    crc, k, at = np.zeros(len(docs), np.int64), 0, 0
                    for ids in reader.blocks():
                        raw, lo = ids.tobytes(), at
                        at += len(ids)
                        while k < len(docs):
                            to = min(int(ends[k]), at)
                            crc[k] = zlib.crc32(raw[4 * (lo - (at - len(ids))) : 4 * (to - (at - len(ids)))], int(crc[k]))
                            lo = to
                            if ends[k] > at:
                                break
                            k += 1
                    ids = pa.array(docs[:, 0], mask=docs[:, 1].astype(bool))
                    out = pa.RecordBatch.from_arrays([ids, pa.array(base + ends - docs[:, 2]), pa.array(docs[:, 2]), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    for m in range(0, len(docs), 50_000):
                        yield out.slice(m, 50_000)

    return placed.select("part", "path", "base").repartitionByRange(max(1, n), "part").mapInArrow(task, DOC_SCHEMA)


def write_and_read(docs: DataFrame, **how) -> DataFrame:
    return read(write(docs, scratch(docs.sparkSession, "tokens"), **how))
