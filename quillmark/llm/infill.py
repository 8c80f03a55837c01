"""Fill-in-the-middle transformation by succinct rank and select.

The places where tokens (`[A-Za-z]+|[^A-Za-z]`, over code points) begin are a packed bitvector over a text's bytes, with the counts of
ones before every block of 512 bits as a directory. The total count gives n; select on two ranks gives the byte cuts of prefix,
middle and suffix; a second such vector over code points turns byte cuts into characters by rank. A bit depends on its byte and the
one before alone, so vectors of long texts are built chunk by chunk, at an eighth of the text's bytes. All rows of a run of text lie
in one vector, so both operations work on many rows at once.

The kernel is an Arrow UDF that returns five integers; hashes, forms and the outputs (slices of bytes) are made by Spark's own functions,
and so is `restored`, which rebuilds the text from output and form.

Defined results: null text is empty; an empty text has n = 0 and is plain, and so is a text that holds one of the marks; a null doc_id
is hashed as no digits; rows that repeat give equal rows; very long texts are cut whole, by the same law; an empty table gives no
rows. The new columns begin with an underscore and replace columns of these names; all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import flat, spared

MARKS = ("<P>", "<S>", "<M>")
#: Bits of a block of the directory, and bytes of text whose bits are made at a time.
BLOCK, CHUNK = 512, 1 << 20
NEW = ("_n", "_form", "_prefix_chars", "_middle_chars", "_output")

_LETTER = np.array([chr(c).isalpha() if c < 128 else False for c in range(256)])
_HEAD = np.array([c & 0xC0 != 0x80 for c in range(256)])  # bytes that begin a code point


class Bits:
    """A packed bitvector with rank and select."""

    def __init__(self, n: int, chunks: Iterator[np.ndarray]):
        """chunks: the n bits as booleans, cut at multiples of eight."""
        packed = np.zeros(-(-(n + 1) // BLOCK) * (BLOCK // 8), np.uint8)
        at = 0
        for bits in chunks:
            part = np.packbits(bits, bitorder="little")
            packed[at : at + len(part)] = part
            at += len(part)
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, word = at // BLOCK, at // 64
        total = self.before[block]
        first = block * (BLOCK // 64)
        for k in range(BLOCK // 64 - 1):
            total = total + np.where(first + k < word, np.bitwise_count(self.words[first + k]), 0)
        below = (np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1)
        return total + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that has k ones before it."""
        block = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[block]
        word = block * (BLOCK // 64)
        for _ in range(BLOCK // 64 - 1):
            n = np.bitwise_count(self.words[word]).astype(np.int64)
            on = left >= n
            left, word = np.where(on, left - n, left), word + on
        place = np.zeros(len(k), np.int64)
        held = self.words[word]
        for width in (32, 16, 8, 4, 2, 1):  # halves of a word, by their counts
            low = held & np.uint64((1 << width) - 1)
            n = np.bitwise_count(low).astype(np.int64)
            on = left >= n
            left = np.where(on, left - n, left)
            place += np.where(on, width, 0)
            held = np.where(on, held >> np.uint64(width), low)
        return word * 64 + place


def _starts(raw: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Whether a token begins at each byte: at code points, but for letters after a letter of the same row."""
    for lo in range(0, len(raw), CHUNK):
        part = raw[lo : lo + CHUNK]
        letter = _LETTER[part]
        after = np.empty(len(part), bool)
        after[0] = lo > 0 and _LETTER[raw[lo - 1]]
        after[1:] = letter[:-1]
        new = rows[np.searchsorted(rows, lo) : np.searchsorted(rows, lo + len(part))] - lo
        after[new] = False
        yield _HEAD[part] & ~(letter & after)


def _points(raw: np.ndarray) -> Iterator[np.ndarray]:
    return (_HEAD[raw[lo : lo + CHUNK]] for lo in range(0, len(raw), CHUNK))


def cuts(texts: pa.Array, one: np.ndarray, two: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: n tokens, the bytes of prefix and middle, and their code points; the cuts lie after the smaller and the larger of
    one % (n + 1) and two % (n + 1) tokens."""
    raw, rows = flat(texts)
    tokens = Bits(len(raw), _starts(raw, rows[:-1]))
    at = tokens.rank(rows)
    n = np.diff(at)
    a, b = one % (n + 1), two % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)

    def place(k: np.ndarray) -> np.ndarray:
        """The byte where the k-th token of each row begins, or the row's end."""
        out = rows[1:].copy()
        some = np.flatnonzero(k < n)
        out[some] = tokens.select(at[:-1][some] + k[some])
        return out

    first, second = place(low), place(high)
    points = Bits(len(raw), _points(raw))
    zero, p, q = points.rank(rows[:-1]), points.rank(first), points.rank(second)
    return {"n": n, "prefix_bytes": first - rows[:-1], "middle_bytes": second - first, "prefix_chars": p - zero, "middle_chars": q - p}


_CUTS = StructType([StructField(c, LongType()) for c in ("n", "prefix_bytes", "middle_bytes", "prefix_chars", "middle_chars")])


@F.arrow_udf(_CUTS)
def _cut(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, one, two in parts:
        got = cuts(texts, one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False))
        yield pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in got.values()], list(got))


def _marks(marks: tuple[str, str, str]) -> None:
    if len(set(marks)) < 3 or any(not m or m[0] in m[1:] or (m[0] in o[1:]) for m in marks for o in marks):
        raise ValueError("marks must differ, and the first character of each may stand nowhere else in them: the text could not be restored")


def transformed(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs with _n, _form (plain, psm or spm), _prefix_chars, _middle_chars (null if plain) and _output.

    Cuts and form follow the first four groups of eight hexadecimal digits of the sha256 of `seed:doc_id`; of a hundred texts plain stay
    as they are, and of the rest spm of a hundred have the suffix first.
    """
    _marks(marks)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(*spared(docs.columns, (*NEW, "__h", "__text", "__cut")), key.alias("__h"), F.coalesce("text", F.lit("")).alias("__text"))
    h = [F.conv(F.substring("__h", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("__text", F.lit(m))
    form = F.when((F.col("__text") == "") | marked | (h[2] % 100 >= 100 - plain), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumn("__cut", _cut("__text", h[0], h[1])).withColumn("_form", form)
    raw, a, b = F.col("__text").cast("binary"), F.col("__cut.prefix_bytes").cast("int"), F.col("__cut.middle_bytes").cast("int")
    prefix, middle, suffix = F.substr(raw, F.lit(1), a), F.substr(raw, a + 1, b), F.substr(raw, a + b + 1)
    p, s, m = (F.lit(x).cast("binary") for x in marks)
    psm, spm_ = F.concat(p, prefix, s, suffix, m, middle), F.concat(s, suffix, p, prefix, m, middle)
    output = F.when(F.col("_form") == "plain", F.col("__text")).when(F.col("_form") == "psm", psm.cast("string")).otherwise(spm_.cast("string"))
    cut = F.col("_form") != "plain"
    return rows.select(
        *spared(docs.columns, NEW), F.col("__cut.n").alias("_n"), "_form", F.when(cut, F.col("__cut.prefix_chars")).alias("_prefix_chars"),
        F.when(cut, F.col("__cut.middle_chars")).alias("_middle_chars"), output.alias("_output"),
    )


def restored(output: str = "_output", form: str = "_form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text behind an output. A mark never begins within a part of a text without marks, so the first one found is the one set."""
    _marks(marks)
    out, p, s, m = F.col(output), *marks

    def between(x: Column, mark: str) -> tuple[Column, Column]:
        """x before and after the first mark, by bytes."""
        raw, head = x.cast("binary"), F.substring_index(x, mark, 1)
        n = F.octet_length(head)
        return head, F.substr(raw, n + 1 + len(mark.encode())).cast("string")

    def rebuilt(first: str, second: str) -> tuple[Column, Column, Column]:
        one, rest = between(F.substr(out.cast("binary"), F.lit(1 + len(first.encode()))).cast("string"), second)
        return one, *between(rest, m)

    prefix, suffix, middle = rebuilt(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = rebuilt(s, p)
    spm = F.concat(prefix, middle, suffix)
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)
