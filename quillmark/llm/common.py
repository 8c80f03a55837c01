"""What the corpus operators share: tables, the shared folder, sizes, and numpy kernels over Arrow text columns."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one kernel call works on at a time; bounds the memory of a Python worker.
SLICE_BYTES = 8 << 20
#: Text behind one fragment of a packed shuffle, so that a fragment fits a Python worker.
FRAGMENT_BYTES = 32 << 20

U64 = np.uint64
K1, K2, K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session names none (local runs)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/quillmark/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder; it survives the loss of any executor."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of `materialize` that nothing reads any more: all that came of them is written itself."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(df._scratch)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def spared(names: list[str], own: tuple[str, ...]) -> list[str]:
    """Names without those that an operator's result has itself: its columns replace them. Spark tells names without case."""
    mine = {x.lower() for x in own}
    return [c for c in names if c.lower() not in mine]


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.select(F.sum(F.octet_length(column)).alias("b")).first().b or 0


def fragments(n_bytes: int, spark: SparkSession, each: int = FRAGMENT_BYTES) -> int:
    """Fragments of a packed shuffle: in proportion to the text, and enough for all cores."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-n_bytes // each))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * K2
    h = (h ^ (h >> U64(27))) * K3
    return h ^ (h >> U64(31))


def scaled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes to 0..n-1, in the order of the hashes."""
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


# -- kernels ---------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes of words that end at ASCII white space.
NOT_SPACE = ~_SPACE
#: Bytes of lower-cased words of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.array([c >= 128 or chr(c).isdigit() or 97 <= c <= 122 for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def flat(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null reads as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    return (LOWER[raw] if lower else raw), off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows of about limit bytes of text; a longer row stands alone, and its kernels take memory in
    proportion to that one text (some 100 bytes for each of its bytes)."""
    size = np.array(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    if not len(size):
        return
    end = np.cumsum(size)
    at = 0
    while at < len(size):
        base = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a text column: start, end (bytes), and off: the first word of each row, n+1 of them."""

    def __init__(self, column: pa.Array, keep: np.ndarray = NOT_SPACE, lower: bool = True):
        self.raw, rows = flat(column, lower)
        inside = keep[self.raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = rows[1:] > rows[:-1]
        heads, tails = rows[:-1][full], rows[1:][full] - 1
        first[heads] = inside[heads]
        last[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, rows)

    def array(self) -> pa.Array:
        """The words as strings."""
        size = self.end - self.start
        cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        text = self.raw[ragged(self.start, size)]
        return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(text.tobytes())])

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(self.raw) + 1,), "<u8", padded, strides=(1,))
        size = self.end - self.start
        h = size.astype(U64) * K1
        h = (h ^ (lanes[self.start] & _MASK[np.minimum(size, 8)])) * K2
        h ^= h >> U64(32)
        at = np.flatnonzero(size > 8)
        k = 8
        while len(at):
            g = (h[at] ^ (lanes[self.start[at] + k] & _MASK[np.minimum(size[at] - k, 8)])) * K3
            h[at] = g ^ (g >> U64(29))
            k += 8
            at = at[size[at] > k]
        return mix(h)

    def grams(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of one row at each start, and which starts have k words in their row."""
        n = max(0, len(h) - k + 1)
        ends = np.repeat(self.off[1:], np.diff(self.off))[:n]
        fits = np.arange(n) + k <= ends
        if k <= 8:
            g = np.zeros(n, U64)
            for i in range(k):
                g = g * K1 + h[i : i + n]
        else:
            with np.errstate(over="ignore"):
                power = np.cumprod(np.full(len(h) + 1, K1))
                back = np.cumprod(np.full(n, U64(pow(int(K1), -1, 1 << 64))))
                total = np.concatenate([np.zeros(1, U64), np.cumsum(h * power[:-1])])
                g = (total[k:] - total[: n]) * back
        return mix(g ^ U64(k)), fits


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start..start+count-1 of each pair, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)


def blob(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The arrays of a binary column, one after the other."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)
