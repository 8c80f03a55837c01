"""Growing JSON-line files as a stream, by byte offsets.

Spark's file stream takes a file once; transcripts grow. This Python data source's offset is a map of path to byte: a batch
reads from there to the last newline, a file that shrank starts anew, and a partial last line waits. New readers start at
the files' ends unless `backfill` is set. Spark's checkpoint keeps the offsets.

Batch and stream read the same way: what is to be read of a file is cut into ranges of `split` bytes, a task each, and a range has the
lines that start in it. A task reads blocks, cuts them at newlines as a whole and hands Arrow batches on; it holds a block and, of a
longer line, that line. Folders are paths or URIs of any file system that Arrow knows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as afs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, path string, off long, line string"
_ARROW = pa.schema([("source", pa.string()), ("path", pa.string()), ("off", pa.int64()), ("line", pa.string())])
#: Bytes of a file that one task reads, and that it reads at a time.
SPLIT, BLOCK = 64 << 20, 4 << 20
_BLANK = " \t\n\r\x0b\x0c"


class Range(InputPartition):
    """The lines of a file that start in [start, end); whole: the range begins with a line."""

    def __init__(self, path: str, start: int, end: int, whole: bool = True):
        self.path, self.start, self.end, self.whole = path, start, end, whole


@lru_cache(64)
def _system(prefix: str) -> afs.FileSystem:
    return afs.FileSystem.from_uri(prefix or "/")[0]


def _placed(path: str) -> tuple[afs.FileSystem, str, str]:
    """The file system of a path or URI, the path there, and what stands before it in the URI."""
    if "://" not in path:
        return _system(""), os.path.abspath(path), ""
    system, inner = afs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def _files(folder: str) -> dict[str, int]:
    """Every *.jsonl file below a folder, and its size."""
    system, inner, prefix = _placed(folder)
    found = system.get_file_info(afs.FileSelector(inner, allow_not_found=True, recursive=True))
    return {prefix + x.path: x.size for x in sorted(found, key=lambda x: x.path) if x.type == afs.FileType.File and x.path.endswith(".jsonl")}


def _end(path: str, start: int) -> int:
    """The byte after the last newline at or after start."""
    system, inner, _ = _placed(path)
    with system.open_input_file(inner) as f:
        size = f.size()
        start = start if start <= size else 0
        at = size
        while at > start:
            lo = max(start, at - (1 << 16))
            cut = f.read_at(at - lo, lo).rfind(b"\n")
            if cut >= 0:
                return lo + cut + 1
            at = lo
    return start


def ranges(path: str, start: int, end: int, split: int) -> list[InputPartition]:
    return [Range(path, lo, min(lo + split, end), lo == start) for lo in range(start, end, split)]


def _batches(whole: bytes, at: int, part: Range, source: str) -> Iterator[pa.RecordBatch]:
    """The lines of some bytes that begin with a line, at byte `at` of the file."""
    starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(whole, np.uint8) == 10) + 1])
    starts = starts[:-1] if starts[-1] == len(whole) else starts
    starts = starts[: np.searchsorted(starts + at, part.end)]
    ends = np.append(starts[1:], whole.find(b"\n", int(starts[-1])) + 1 or len(whole)) if len(starts) else starts
    if not len(starts):
        return
    cut = np.append(starts, ends[-1]).astype("<i8")
    raw = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cut), pa.py_buffer(whole)])
    try:
        whole.decode()
        texts = raw.view(pa.large_string())
    except UnicodeDecodeError:  # no byte of another character is a newline's, so lines are replaced as by themselves
        texts = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())
    texts = pc.ascii_rtrim(texts, "\n").cast(pa.string())
    some = pc.greater(pc.binary_length(pc.ascii_trim(texts, _BLANK)), 0)
    texts, off = texts.filter(some), pa.array(starts + at).filter(some)
    if len(texts):
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(source), len(texts)), pa.repeat(pa.scalar(part.path), len(texts)), off, texts], schema=_ARROW)


def lines(part: Range, source: str, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The lines of a range with the byte each starts at; blank ones go, and what is no UTF-8 is replaced."""
    system, inner, _ = _placed(part.path)
    with system.open_input_file(inner) as f:
        at, held = (part.start, b"") if part.whole else (part.start - 1, b"")
        skip = not part.whole  # the rest of a line that starts in the range before
        size = f.size()
        while at < part.end or held:
            to = at + len(held)
            read = f.read_at(min(block, size - to), to) if to < size else b""
            held += read
            cut = held.rfind(b"\n") + 1 if read else len(held)
            if not cut:
                continue  # a line longer than what is held
            whole, rest = held[:cut], held[cut:]
            if skip:
                first = whole.find(b"\n") + 1 or len(whole)
                whole, at, skip = whole[first:], at + first, False
            if whole:
                yield from _batches(whole, at, part, source)
            at, held = at + len(whole), rest
            if not read or at >= part.end:
                return


class LineReader(DataSourceReader):
    """All whole lines of the files as a batch."""

    def __init__(self, options: dict):
        self.folder, self.source, self.split = options["path"], options.get("source", ""), int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        return [r for p in _files(self.folder) for r in ranges(p, 0, _end(p, 0), self.split)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        return lines(part, self.source)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.source, self.split = options["path"], options.get("source", ""), int(options.get("split", SPLIT))
        self.backfill = options.get("backfill", "false").lower() == "true"
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {p: 0 if self.backfill else _end(p, 0) for p in _files(self.folder)}

    def latestOffset(self) -> dict:
        out = dict(self.last)
        for p, size in _files(self.folder).items():
            if size == out.get(p):
                continue  # read to its end, and no more there
            try:
                out[p] = _end(p, out.get(p, 0))
            except OSError:
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = dict(end)
        out = []
        for p, to in end.items():
            at = start.get(p, 0)
            at = at if at <= to else 0  # the file was replaced by a shorter one
            out += ranges(p, at, to, self.split)
        return out

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        return lines(part, self.source)

    def commit(self, end: dict) -> None:
        self.last = dict(end)


class TranscriptTail(DataSource):
    """spark.readStream.format("transcript_tail").option("source", ..).option("backfill", "true").load(folder), or spark.read for a batch."""

    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)
