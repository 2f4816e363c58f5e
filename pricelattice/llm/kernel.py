"""Vectorised byte kernels that the Arrow-based operators share.

A batch of texts is one uint8 array with document bounds; words are spans of it. Work goes in slices of at most SLICE bytes (one
document may be longer), so memory does not depend on batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
#: Space and \\x09-\\x0D separate words.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A second table, drawn apart from the first: bytes that meet under one do not for that meet under the other.
_OTHER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_pow = np.ones(1, np.uint64)
NO_DOCS = np.zeros(0, np.int64)


def powers(n: int) -> np.ndarray:
    """_BASE ** 0 .. n - 1 modulo 2 ** 64, kept between calls."""
    global _pow
    if len(_pow) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        p = np.full(size, _BASE, np.uint64)
        p[0] = 1
        _pow = np.cumprod(p, dtype=np.uint64)
    return _pow[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F) + np.uint64(0x2545F4914F6CDD1D))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data, off


def slices(off: np.ndarray, limit: int = SLICE):
    """Row ranges of at most `limit` bytes each, or of one row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


class Spans:
    """Words of some documents: start, end (in `data`), and `doc` (n + 1 word offsets by document)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, blank: np.ndarray = BLANK):
        self.data = data
        word = ~blank[data]
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        before = np.empty(len(data), bool)
        before[:1], before[1:] = False, word[:-1]
        self.start = np.flatnonzero(word & (~before | first[:-1]))
        after = np.empty(len(data), bool)
        after[-1:], after[:-1] = False, word[1:]
        self.end = np.flatnonzero(word & (~after | first[1:])) + 1
        self.doc = np.searchsorted(self.start, bounds)
        self.word = word

    def __len__(self) -> int:
        return len(self.start)

    def of(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(len(self.doc) - 1), np.diff(self.doc))

    def hashes(self, seed: int = 0, other: bool = False) -> np.ndarray:
        """64-bit hash of each word's bytes; `other` gives a second one, independent of the first."""
        if not len(self):
            return np.zeros(0, np.uint64)
        return hash_spans(self.data, self.start, self.end, self.word, seed, other)

    def bytes(self, i: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[i].tolist(), self.end[i].tolist(), strict=True)]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, inside: np.ndarray | None, seed: int = 0, other: bool = False) -> np.ndarray:
    """Hash of spans in rising order that do not overlap; bytes outside `inside` count for nothing."""
    n = len(data)
    at = np.arange(n, dtype=np.int64)
    at[start[0] :] -= np.repeat(start, np.diff(np.append(start, n)))
    v = (_OTHER if other else _BYTE)[data]
    v *= powers(int(at.max()) + 1)[at]
    if inside is not None:
        v *= inside
    h = np.add.reduceat(v, start)
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(seed))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, index of an occurrence of each, class of each item)."""
    order = np.argsort(h)
    g = h[order]
    new = np.empty(len(g), bool)
    new[:1], new[1:] = True, g[1:] != g[:-1]
    cls = np.empty(len(g), np.int64)
    cls[order] = np.cumsum(new) - 1
    return g[new], order[new], cls


class SpanCache:
    """Values by 64-bit span hash, in sorted arrays; over `most` entries only those of the slice at hand stay."""

    def __init__(self, most: int):
        self.most, self.keys, self.values = most, np.zeros(0, np.uint64), np.zeros(0, object)

    def resolve(self, keys: np.ndarray, make) -> np.ndarray:
        """Values of sorted distinct keys; make(indices of unknown keys) gives a list of their values."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty(len(keys), object)
        out[hit] = self.values[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            out[new] = fresh = _objects(make(new))
            if len(self.keys) + len(new) > self.most:
                self.keys, self.values = keys, out
            else:
                put = np.searchsorted(self.keys, keys[new])
                self.keys, self.values = np.insert(self.keys, put, keys[new]), np.insert(self.values, put, fresh)
        return out


def _objects(items: list) -> np.ndarray:
    out = np.empty(len(items), object)
    out[:] = items
    return out
