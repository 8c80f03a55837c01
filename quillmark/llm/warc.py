"""WARC archives through a chunked record table.

A payload is cut into rows (record, chunk number, at most CHUNK bytes) before it is shuffled, so that no step beside the scan
allocates a whole record. Writing streams a task's rows, in order, into gzip members of one file, a member per record after a
`warcinfo`; the digest is carried from chunk to chunk. Reading inflates a file piece by piece and gives chunk rows again, each
with the digest so far; a file that ends within a record, or holds fewer records than were written, is refused.

A record's block is an HTTP response: a status line and headers, then the payload. A record of a payload of at least `least`
bytes that a record of a smaller id also has is a `revisit`: its block has the HTTP headers alone, it names the record it refers to
and that payload's digest and length. A file is written under an attempt's own name and then moved, so a repeated task leaves
one whole file.

Defined results: a null payload is empty; a null url writes no WARC-Target-URI; rows that share a page_id have a record each;
a row with a null page_id has one too, and revisits the least page_id of its payload if there is any; of rows that share page_id
and payload none revisits the other; an empty table makes no records. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch

CHUNK = 1 << 20
LEAST = 100
CHUNKS = "part int, record int, page_id long, record_type string, refers_to long, chunk int, last boolean, size long, digest string, payload_bytes long, payload binary"
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(pages: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """A row per chunk: page_id, url, n_bytes, sha256, refers_to, _row (tells records of a scan apart), chunk, piece. A revisit has one, empty."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("sha256", F.sha2("payload", 256))
    # Copies are found on narrow rows; chunks are dealt once.
    narrow = rows.where(F.col("n_bytes") >= least).select("page_id", "sha256")
    first = narrow.groupBy("sha256").agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1 and first is not null").drop("_n")
    first = materialize(first, "warc-copies")  # so that a join may split the rows of one payload
    again = narrow.where("page_id is not null").join(first, "sha256").where("first < page_id").distinct()
    again = again.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("sha256", "first"))).alias("_again"))
    n = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk)).cast("int")
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    # Chunk numbers first, then each chunk by itself out of the payload.
    cut = rows.select("page_id", "url", "n_bytes", "sha256", "_row", "payload", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    cut = cut.select("page_id", "url", "n_bytes", "sha256", "_row", "chunk", F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("piece"))
    named = cut.where("page_id is not null").join(again, "page_id", "left").withColumn("refers_to", F.try_element_at("_again", F.col("sha256"))).drop("_again")
    # Rows without an id all have the null key: they are dealt by payload, whose rows the join may split.
    nameless = cut.where("page_id is null").join(first, "sha256", "left").withColumnRenamed("first", "refers_to")
    both = named.unionByName(nameless)
    revisit = F.col("refers_to").isNotNull()
    return both.where(~revisit | (F.col("chunk") == 0)).withColumn("piece", F.when(revisit, F.lit(b"")).otherwise(F.col("piece")))


def _urn(page: int | None, digest: str, tail: str) -> str:
    return f"<urn:page:{'none' if page is None else page}:{digest}:{tail}>"


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def _head(kind: str, urn: str, date: str, length: int, more: list[str]) -> bytes:
    return ("\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn}", f"WARC-Date: {date}", *more, f"Content-Length: {length}"]) + "\r\n\r\n").encode()


def _record(page: int | None, url: str | None, n: int, digest: str, refers: int | None, tail: str, date: str) -> bytes:
    """The headers and the HTTP part of a record; its payload follows unless it is a revisit."""
    more = ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n}"]
    if url is not None:
        more.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers is not None:
        more += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers, digest, '0')}"]
    http = _http(n)
    return _head("response" if refers is None else "revisit", _urn(page, digest, tail), date, len(http) + (n if refers is None else 0), more) + http


def write(pages: DataFrame, path: str, least: int = LEAST, chunk: int = CHUNK, date: str = DATE) -> DataFrame:
    """Write the archives; returns the table of files."""
    # A record's chunks come from one scanned row and go to one key, so they stay together however joins are split.
    rows = chunked(pages, least, chunk).sortWithinPartitions("page_id", "sha256", "_row", "chunk")

    def task(batches):
        from pyarrow import fs

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name = f"{path}/part-{part:06d}.warc.gz"
        store, place = fs.FileSystem.from_uri(name)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        n, seen, copy = 0, None, 0
        with store.open_output_stream(f"{place}.{attempt}.tmp", compression=None) as out:

            def member(*pieces: bytes) -> None:
                gz = zlib.compressobj(3, zlib.DEFLATED, 31)
                out.write(b"".join(gz.compress(p) for p in pieces) + gz.flush())

            info = b"software: quillmark\r\nformat: WARC File Format 1.1\r\n"
            member(_head("warcinfo", f"<urn:file:{part}>", date, len(info), ["Content-Type: application/warc-fields"]), info, b"\r\n\r\n")
            gz = left = digest = None
            for batch in batches:
                cols = {c: batch.column(c) for c in batch.schema.names}
                for i in range(batch.num_rows):
                    at = {c: v[i].as_py() for c, v in cols.items() if c != "piece"}
                    if at["chunk"] == 0:
                        if left:
                            raise ValueError("a record's chunks are not together")
                        same = (at["page_id"], at["sha256"])
                        copy = copy + 1 if same == seen else 0
                        gz, n, digest, seen = zlib.compressobj(3, zlib.DEFLATED, 31), n + 1, hashlib.sha256(), same
                        left = 0 if at["refers_to"] is not None else at["n_bytes"]
                        # The first record of a page and payload has the name that revisits give; any other one is named by its place.
                        tail = "0" if copy == 0 and at["page_id"] is not None else f"{part}-{n}"
                        out.write(gz.compress(_record(at["page_id"], at["url"], at["n_bytes"], at["sha256"], at["refers_to"], tail, date)))
                    piece = cols["piece"][i].as_buffer()
                    out.write(gz.compress(piece))
                    digest.update(piece)
                    left -= len(piece)
                    if left == 0:
                        if at["refers_to"] is None and digest.hexdigest() != at["sha256"]:
                            raise ValueError(f"chunks of page {at['page_id']} don't make its payload")
                        out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        if n:
            store.move(f"{place}.{attempt}.tmp", place)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "n_records": [n]})
        else:
            store.delete_file(f"{place}.{attempt}.tmp")

    return materialize(rows.mapInArrow(task, "part int, path string, n_records long"), "warc-files")


def _members(file, size: int = 1 << 18):
    """Pieces of the inflated records of a file as (piece, record ends)."""
    gz, raw, begun = zlib.decompressobj(31), b"", False
    while True:
        raw = raw or file.read(size)
        if not raw:
            if begun:
                raise ValueError("the file ends within a record")
            return
        begun = True
        piece = gz.decompress(raw, CHUNK)
        raw = gz.unconsumed_tail
        if gz.eof:
            raw, gz, begun = gz.unused_data, zlib.decompressobj(31), False
            yield piece, True
        else:
            yield piece, False


def records(file, chunk: int = CHUNK):
    """Chunk rows of a WARC file: headers, chunk number, whether it is the last, its bytes, digest so far. Chunks are of the payload, without HTTP headers."""
    held, head, http, left, k, digest = bytearray(), None, False, 0, 0, None
    for piece, ends in _members(file):
        held += piece
        if head is None and (cut := held.find(b"\r\n\r\n")) >= 0:
            lines = held[:cut].decode().split("\r\n")
            head = dict(x.split(": ", 1) for x in lines[1:])
            del held[: cut + 4]
            left, k, digest = int(head["Content-Length"]), 0, hashlib.sha256()
            http = head.get("Content-Type", "").startswith("application/http")
        if head is not None and http and (cut := held.find(b"\r\n\r\n")) >= 0:
            del held[: cut + 4]
            left, http = left - cut - 4, False
        if ends and (head is None or http or left < 0):
            raise ValueError("a record ends within its headers")
        if head is None or http:
            continue
        while left >= chunk and len(held) >= chunk or ends:
            n = min(chunk, left, len(held))
            data = bytes(held[:n])
            del held[:n]
            left -= n
            digest.update(data)
            yield head, k, left == 0, data, digest.hexdigest()
            k += 1
            if left == 0:
                break
            if ends and not held:
                raise ValueError("a record ends early")
        if ends:
            if held not in (b"\r\n\r\n", b""):
                raise ValueError("a record is longer than its Content-Length")
            held, head = bytearray(), None


def read(files: DataFrame, with_payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives; `digest` is that of the payload up to the chunk's end. (part, record) tells records apart."""
    n = files.count()

    def page_of(urn: str) -> int | None:
        page = urn.strip("<>").split(":")[2]
        return None if page == "none" else int(page)

    def task(batches):
        from pyarrow import fs

        for batch in batches:
            for part, path, told in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "n_records"))):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as file:
                    rows, held, record = [], 0, -1
                    for head, k, last, data, digest in records(file, chunk):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        record += k == 0
                        refers = page_of(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
                        revisit = head["WARC-Type"] == "revisit"
                        whole, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                        if last and not revisit and digest != whole:
                            raise ValueError(f"{path}: the payload of {head['WARC-Record-ID']} is not the one written")
                        rows.append((part, record, page_of(head["WARC-Record-ID"]), head["WARC-Type"], refers, k, last, len(data), whole if revisit else digest, size if revisit else None, data if with_payload else None))
                        held += len(data) * with_payload + 200
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if record + 1 != told:
                        raise ValueError(f"{path} holds {record + 1} records of {told}")
                    if rows:
                        yield _batch(rows)

    return files.select("part", "path", "n_records").repartitionByRange(max(1, n), "part").mapInArrow(task, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)


def digests(chunks: DataFrame) -> DataFrame:
    """One row per record of the chunk table. A record's chunks lie in one partition, so only sums are shuffled."""
    return chunks.groupBy("part", "record").agg(
        F.max("page_id").alias("page_id"),
        F.max(F.coalesce("payload_bytes", F.lit(0))).alias("_told"),
        F.sum("size").alias("_read"),
        F.max_by("digest", "chunk").alias("payload_digest"),
        F.max("record_type").alias("record_type"),
        F.max("refers_to").alias("refers_to"),
    ).select("page_id", F.greatest("_told", "_read").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def write_and_read(pages: DataFrame) -> DataFrame:
    return digests(read(write(pages, scratch(pages.sparkSession, "warc")), with_payload=False))
