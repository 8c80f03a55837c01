"""Token ids of texts by a public tokenizer of the `tokenizers` library, a batch at a time.

A text's ids are those of its white-space-separated chunks one after the other: the tokenizer drops white space and
never joins across it. Where the tokenizer also cuts between letters and marks, chunks of plain letters and marks are cut
there too. The distinct units of a batch are encoded once, and each worker keeps a bounded table of the units it has
seen, by 128 bits of hash. `tests/llm` hold the ids against the library's own on whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import K1, NOT_SPACE, U64, Words, mix, ragged

TOKENIZER = "word_bpe_49k.json"
#: Units that a worker remembers before it starts afresh: bounds memory, never results.
REMEMBERED = 1_500_000

_LETTER, _MARK, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, np.int8)
_KIND[~NOT_SPACE] = 0
_KIND[[*range(97, 123), *range(65, 91), 0xC3]] = _LETTER
_KIND[[ord(c) for c in ".,!?;:*$%&#"]] = _MARK


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Units(Words):
    """White-space-separated chunks; those of plain letters and marks are cut between the two."""

    def __init__(self, column: pa.Array, lower: bool, cut: bool):
        super().__init__(column, NOT_SPACE, lower)
        if not cut or not len(self.start):
            return
        kind = _KIND[self.raw]
        after = np.flatnonzero(self.raw[:-1] == 0xC3) + 1  # Latin letters of two bytes
        kind[after] = np.where((self.raw[after] == 0x97) | (self.raw[after] == 0xB7), _OTHER, _LETTER)
        bad = np.concatenate([[0], np.cumsum(kind == _OTHER)])
        turn = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] != 0) & (kind[:-1] != 0)) + 1
        chunk = np.searchsorted(self.start, turn, "right") - 1
        turn = turn[(bad[self.end[chunk]] == bad[self.start[chunk]]) & (turn < self.end[chunk]) & (turn > self.start[chunk])]
        rows = np.concatenate([[0], self.end])[self.off]  # the end of the last chunk before each row
        self.start, self.end = np.sort(np.concatenate([self.start, turn])), np.sort(np.concatenate([self.end, turn]))
        self.off = np.searchsorted(self.end, rows, "right")
        self.off[0] = 0


class Encoder:
    _of: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        byte = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: byte.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)}
        self._forget()
        one = self._ids
        self.cuts = one("ab,.Cd") == one("ab") + one(",.") + one("cd") and all(one(w) == self._word(w) for w in ("ab", "café", "übung", "straße"))

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _forget(self) -> None:
        self.runs: list[tuple[np.ndarray, ...]] = []  # sorted keys, checks, first and number of ids
        self.pool: list[np.ndarray] = []
        self.pooled = 0

    def _ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.lower().translate(self.letters))]

    def _plain(self, unit: str) -> bool:
        return all(c.isascii() and c.isalpha() or ord(c) in self.letters for c in unit)

    def _new(self, units: list[str]) -> list[list[int]]:
        if not self.cuts:
            return [self._ids(u) for u in units]
        return [self._word(u) if u.isascii() and u.isalpha() or self._plain(u) else self._ids(u) for u in units]

    def _known(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        todo = np.arange(len(keys))
        for run, check, start, n in self.runs:
            at = np.minimum(np.searchsorted(run, keys[todo]), len(run) - 1)
            hit = (run[at] == keys[todo]) & (check[at] == checks[todo])
            first[todo[hit]], size[todo[hit]] = start[at[hit]], n[at[hit]]
            todo = todo[~hit]
        return first, size

    def _learn(self, keys: np.ndarray, checks: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        first = self.pooled + np.cumsum(size) - size
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        self.pool.append(flat)
        self.pooled += len(flat)
        order = np.argsort(keys)
        self.runs.append((keys[order], checks[order], first[order], size[order]))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) >= len(self.runs[-2][0]):
            both = [np.concatenate(x) for x in zip(self.runs.pop(), self.runs.pop())]
            order = np.argsort(both[0])
            self.runs.append(tuple(x[order] for x in both))
        return first, size

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and n+1 offsets; null reads as empty."""
        column = column.fill_null("").cast(pa.large_string())
        special = pc.any(pc.match_substring(column, "<|")).as_py()  # they are matched before lower-casing
        units = Units(column, lower=not special, cut=self.cuts)
        if sum(len(r[0]) for r in self.runs) > REMEMBERED:
            self._forget()
        h = units.hashes()
        coded = pa.array(h).dictionary_encode()
        codes, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False)
        where = np.zeros(len(keys), np.int64)
        where[codes] = np.arange(len(codes))
        lo, hi = units.start[where], units.end[where]
        # The second hash: bytes summed with other factors by their place.
        at = ragged(lo, hi - lo)
        value = mix(units.raw[at].astype(U64) * K1 + (at - np.repeat(lo, hi - lo)).astype(U64))
        checks = np.add.reduceat(value, np.cumsum(hi - lo) - (hi - lo)) if len(lo) else np.zeros(0, U64)
        first, size = self._known(keys, checks)
        new = np.flatnonzero(first < 0)
        if len(new):
            text = units.raw.tobytes()
            got = self._new([text[a:b].decode() for a, b in zip(lo[new].tolist(), hi[new].tolist())])
            first[new], size[new] = self._learn(keys[new], checks[new], got)
        if len(self.pool) > 1:
            self.pool = [np.concatenate(self.pool)]
        counts = size[codes] if len(codes) else np.zeros(0, np.int64)
        ids = self.pool[0][ragged(first[codes], counts)] if len(codes) else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], np.cumsum(counts)])[units.off]
