"""Vectorised word splitting and hashing over the raw UTF-8 buffer of an Arrow column.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, the same as the regular expression
``[^\\x20\\x09-\\x0D]+``.  Names are 64-bit; they are mixed, so any bits of them may be used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


def salts(n: int, seed: int) -> np.ndarray:
    """n odd multipliers, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


@dataclass
class Words:
    """Words of a batch of texts: byte ranges in ``buf``; text i has words ``first[i]:first[i+1]``."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def raw(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = (texts if texts.null_count == 0 else texts.fill_null("")).cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


#: For split(): words are runs of letters and digits; only ASCII is looked at, all else counts as letters.
ALNUM = np.ones(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def split(texts: pa.Array | pa.ChunkedArray, lower: bool = False, blank: np.ndarray = _BLANK) -> Words:
    buf, off = raw(texts)
    if lower:
        buf = _LOWER[buf]
    solid = np.empty(len(buf) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(blank[buf], out=solid[1:-1])
    # a text may begin right after another one's last word
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    joint = np.unique(edge[solid[edge] & solid[edge + 1]])
    start = np.flatnonzero(solid[1:] & ~solid[:-1])
    end = np.flatnonzero(solid[:-1] & ~solid[1:])
    if len(joint):
        start = np.sort(np.concatenate([start, joint]))
        end = np.sort(np.concatenate([end, joint]))
    return Words(buf, start, end, np.searchsorted(start, off), off)


def hash_words(w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    padded = np.zeros(len(w.buf) + 8, np.uint8)
    padded[: len(w.buf)] = w.buf
    lanes = np.ndarray((len(w.buf) + 1,), "<u8", buffer=padded, strides=(1,))
    size = w.end - w.start
    with np.errstate(over="ignore"):
        h = mix(size.astype(U) + U(0x5851F42D4C957F2D + seed))
        at, todo = 0, np.arange(len(size))
        while len(todo):
            left = size[todo] - at
            lane = lanes[w.start[todo] + at]
            short = left < 8
            lane[short] &= (U(1) << (left[short].astype(U) * U(8))) - U(1)
            h[todo] = mix((h[todo] ^ lane) * U(0x9E3779B97F4A7C15) + U(1))
            at += 8
            todo = todo[left > 8]
    return h


def grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each k consecutive entries (len(h) - k + 1 of them, across texts as well)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for c, j in zip(salts(k, seed), range(k), strict=True):
            out += h[j : j + n] * c
        return mix(out)


def inside(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which of the total - k + 1 windows of k words lie in one text."""
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    for j in range(1, k):  # a window that begins j words before a text's first word crosses into it
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``most`` bytes of text each, at least one row."""
    for b in batches:
        col = b.column(b.schema.get_field_index(column))
        if not len(col):
            continue
        _, off = raw(col)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def signed(h: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(h.view(np.int64))
