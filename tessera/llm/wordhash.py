"""Vectorised hashing of words and n-grams of many texts at once (NumPy).

Words are hashed from their bytes without algebraic structure: runs of up to 32 bytes in 8-byte chunks, each followed
by a full mixing round, longer ones by XXH3. Words of at most 8 bytes can only collide across lengths.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S32 = np.uint64(33), np.uint64(32)
_ODD, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Keeps the first k bytes of a little-endian chunk.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
SHORT = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x = x * _M2
    x ^= x >> _S33
    return x


def _chunks(data: np.ndarray) -> np.ndarray:
    """The 8-byte little-endian number that starts at each byte (zeros follow the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes data[start:end]."""
    size = end - start
    out = mix(size.astype(np.uint64) * _LENGTH)
    chunks = _chunks(data)
    rows = np.flatnonzero(size <= SHORT)
    for at in range(0, SHORT, 8):
        rows = rows[size[rows] > at]
        if not len(rows):
            break
        part = chunks[start[rows] + at] & _KEEP[np.minimum(size[rows] - at, 8)]
        out[rows] = mix((out[rows] ^ part) * _ODD)
    for k in np.flatnonzero(size > SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
    return out


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether each run has the same bytes as the run that `other` names for it."""
    size = end - start
    if (size != size[other]).any():
        return False
    chunks = _chunks(data)
    rows = np.flatnonzero(size <= SHORT)
    for at in range(0, SHORT, 8):
        rows = rows[size[rows] > at]
        if not len(rows):
            break
        differ = (chunks[start[rows] + at] ^ chunks[start[other[rows]] + at]) & _KEEP[np.minimum(size[rows] - at, 8)]
        if differ.any():
            return False
    cut = lambda k: data[start[k] : end[k]].tobytes()
    return all(k == o or cut(k) == cut(o) for k, o in ((k, other[k]) for k in np.flatnonzero(size > SHORT).tolist()))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(_SPACE[data].view(np.int8), prepend=1))
    return edge[::2], edge[1::2]


class Words:
    """Words (runs of bytes other than ASCII white space) of a list of UTF-8 texts.

    hash: 64-bit hash of each word; doc: index of its text; start, end: byte places in `data`;
    spans: finds other parts than words, none across a line break; first: place in hash where each text's words begin (len(texts) + 1 entries).
    """

    def __init__(self, texts: list[bytes], spans: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None):
        blob = b"\n".join(texts) + b"\n"
        self.data = data = np.frombuffer(blob, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.start, self.end = (spans or _words)(data)
        self.hash = span_hash(data, self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.first[-1] = len(self.start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each kind and each word's kind; equal hashes are checked byte for byte."""
        _, first, place = np.unique(self.hash, return_index=True, return_inverse=True)
        if same_spans(self.data, self.start, self.end, first[place]):
            return first, place
        seen: dict[bytes, int] = {}
        place = np.fromiter((seen.setdefault(self.bytes_of(k), len(seen)) for k in range(len(self.hash))), np.int64, len(self.hash))
        return np.unique(place, return_index=True)[1], place


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every n-word window; windows don't cross texts."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(m, np.uint64)
    for k in range(n):
        value = (value ^ words.hash[k : k + m]) * _ODD
        value ^= value >> _S32
    inside = words.doc[:m] == words.doc[n - 1 :]
    return mix(value)[inside], words.doc[:m][inside]


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, sorted by text then hash: (hash, text index, first place per text).

    A text with fewer than n words (but some) has its whole sequence as the one shingle.
    """
    value, doc = grams(words, n)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([_whole(words.hash[words.first[d] : words.first[d + 1]]) for d in short], np.uint64)
        value, doc = np.concatenate([value, extra]), np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, doc = value[new], doc[new]
    return value, doc, np.searchsorted(doc, np.arange(len(counts) + 1))


def _whole(hashes: np.ndarray) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(hashes.astype("<u8").tobytes(), seed=len(hashes)))
