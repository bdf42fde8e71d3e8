"""Code words and bytes of quantization codes.

Code word lengths come from a histogram, which is small; the codes themselves are packed stretch by stretch in tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = 1 << 16
LANES, LONGEST = 64, 56  # codes decoded at a time, bits of a code word


def huffman_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Length of each symbol's code word; of equal weights the smaller symbols are joined first."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    heap = [(n, s, (s,)) for s, n in counts.items()]
    heapq.heapify(heap)
    length = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        (n, a, x), (m, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*x, *y):
            length[s] += 1
        heapq.heappush(heap, (n + m, min(a, b), x + y))
    return length


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, lengths, code words) in the order of canonical words: by length, then symbol."""
    order = sorted(lengths.items(), key=lambda x: (x[1], x[0]))
    symbols, size = (np.array([x[k] for x in order], np.int64) for k in (0, 1))
    if len(size) and size[-1] > LONGEST:
        raise ValueError(f"a code word of {size[-1]} bits is longer than {LONGEST}")
    words, word, last = np.zeros(len(size), np.uint64), 0, 0
    for k, n in enumerate(size.tolist()):
        word <<= n - last
        words[k] = word
        word, last = word + 1, n
    return symbols, size, words


def codebook(lengths: dict[int, int]) -> dict[int, str]:
    """Canonical code words as text."""
    return {s: format(w, f"0{n}b") for s, n, w in zip(*(x.tolist() for x in canonical(lengths)), strict=True)}


def table_bytes(lengths: dict[int, int]) -> bytes:
    """A code's lengths as bytes: the number of symbols, the symbols by canonical order, their lengths; zstd compressed."""
    symbols, size, _ = canonical(lengths)
    return zstandard.compress(np.array([len(symbols)], "<i8").tobytes() + symbols.astype("<i8").tobytes() + size.astype(np.uint8).tobytes())


def table_from(content: bytes) -> dict[int, int]:
    raw = zstandard.decompress(content)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    return dict(zip(np.frombuffer(raw[8 : 8 + 8 * n], "<i8").tolist(), np.frombuffer(raw[8 + 8 * n :], np.uint8).tolist(), strict=True))


def lanes(n: int) -> int:
    """Into how many consecutive parts n codes are cut, which are decoded at the same time."""
    return int(min(LANES, max(1, n // 64)))


def encoded(codes: np.ndarray, book: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[int, bytes]:
    """(bits, bytes): where each lane ends, in bits, and the code words one after the other; all of it zstd compressed."""
    symbols, size, words = book
    order = np.argsort(symbols)
    at = order[np.searchsorted(symbols[order], codes)]
    length = size[at]
    end = np.cumsum(length)
    place = np.arange(end[-1] if len(end) else 0) - np.repeat(end - length, length)
    bits = (np.repeat(words[at], length) >> (np.repeat(length, length) - 1 - place).astype(np.uint64)) & np.uint64(1)
    k = lanes(len(codes))
    edges = np.append(0, end)[np.arange(1, k + 1) * len(codes) // k]
    return int(end[-1]) if len(end) else 0, zstandard.compress(edges.astype("<u4").tobytes() + np.packbits(bits.astype(np.uint8)).tobytes())


def decoded(content: bytes, n: int, book: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The n codes that encoded() wrote, a code of each lane at a time."""
    symbols, size, words = book
    raw, k, top = zstandard.decompress(content), lanes(n), np.uint64(64)
    edges = np.frombuffer(raw[: 4 * k], "<u4").astype(np.int64)
    stream = np.frombuffer(raw[4 * k :] + bytes(16), np.uint8)
    at, first = np.append(0, edges[:-1]), np.arange(k + 1) * n // k
    # of each length its first word, moved to the left edge: the length of a word is that of the last first word that is not larger
    kinds, begin = np.unique(size, return_index=True)
    least = words[begin] << (top - kinds.astype(np.uint64))
    out = np.empty(n, np.int64)
    shifts = np.arange(56, -8, -8).astype(np.uint64)
    for t in range(int(np.diff(first).max()) if n else 0):
        live = np.flatnonzero(first[:-1] + t < first[1:])
        here = at[live]
        window = (stream[(here >> 3)[:, None] + np.arange(8)].astype(np.uint64) << shifts).sum(1, dtype=np.uint64) << (here & 7).astype(np.uint64)
        kind = np.searchsorted(least, window, "right") - 1
        place = begin[kind] + ((window >> (top - kinds[kind].astype(np.uint64))) - words[begin[kind]]).astype(np.int64)
        out[first[live] + t] = symbols[place]
        at[live] += kinds[kind]
    if not np.array_equal(at, edges):
        raise ValueError("lanes don't end where they should")
    return out


def histogram_of(codes: DataFrame, code: str = "code", most: int = SYMBOLS) -> dict[int, int]:
    """The histogram on the driver; more than ``most`` different codes raise an error, as no codebook of that size is sent to tasks."""
    rows = codes.groupBy(code).agg(F.count("*").alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} different codes: widen the bound or escape the outer ones")
    return {r[0]: r[1] for r in rows}


def huffman_packed(codes: DataFrame, stretch: int = 1 << 18, code: str = "code") -> tuple[DataFrame, dict[int, int]]:
    """((part, n, bits, content), code word lengths): codes(i, code) by stretches of consecutive i, Huffman coded and then zstd compressed."""
    lengths = huffman_lengths(histogram_of(codes, code))
    book = canonical(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encoded(np.asarray(x, np.int64), book) for x in b.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("n"), pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.binary())], ["part", "n", "bits", "content"])

    grouped = codes.groupBy(F.expr(f"i div {stretch}").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", code))), lambda s: s[code]).alias("codes"))
    return grouped.withColumn("n", F.size("codes").cast("long")).mapInArrow(run, "part long, n long, bits long, content binary"), lengths


def huffman_unpacked(packed: DataFrame, lengths: dict[int, int], stretch: int = 1 << 18) -> DataFrame:
    """(i, code) of huffman_packed(), for codes that fill their stretches."""
    book = canonical(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, n, content in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + part * stretch), pa.array(decoded(content, n, book))], ["i", "code"])

    return packed.mapInArrow(run, "i long, code long")


def bit_width(df: DataFrame, code: str = "code") -> DataFrame:
    """One row: bits that the largest of the non-negative codes needs; 0 for none."""
    return df.agg(F.coalesce(F.max(F.when(F.col(code) > 0, F.length(F.bin(code)))), F.lit(0)).alias("bits"))


def bits_packed(codes: DataFrame, width: int, stretch: int = 1 << 18, code: str = "code") -> DataFrame:
    """(part, n, content): codes(i, code) of 0 to 2 ** width - 1 by stretches of consecutive i, ``width`` bits each, highest first; a larger one raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = []
            for x in b.column("codes"):
                x = x.values.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(x) and (x.min() < 0 or x.max() >> width):
                    raise ValueError(f"a code outside 0 to {(1 << width) - 1}")
                content.append(np.packbits((x[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("n"), pa.array(content, pa.binary())], ["part", "n", "content"])

    grouped = codes.groupBy(F.expr(f"i div {stretch}").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", code))), lambda s: s[code]).alias("codes"))
    return grouped.withColumn("n", F.size("codes").cast("long")).mapInArrow(run, "part long, n long, content binary")


def bits_unpacked(rows: DataFrame, width: int, stretch: int = 1 << 18) -> DataFrame:
    """(i, code) of bits_packed(), for codes that fill their stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, n, content in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), b.column("content").to_pylist(), strict=True):
                bits = np.unpackbits(np.frombuffer(content, np.uint8), count=n * width).reshape(n, width).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + part * stretch), pa.array(bits @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64)))], ["i", "code"])

    return rows.mapInArrow(run, "i long, code long")


def truncated(df: DataFrame, keep: int, x: str = "x") -> DataFrame:
    """y: the value with only the ``keep`` (1 to 4) most significant bytes of its 32-bit form."""
    mask = np.uint32(0xFFFFFFFF << 8 * (4 - keep) & 0xFFFFFFFF)

    @F.pandas_udf("double")
    def cut(v):
        import pandas as pd

        return pd.Series((v.to_numpy(np.float32).view(np.uint32) & mask).view(np.float32).astype(float), v.index)

    return df.withColumn("y", cut(F.col(x)))


def smaller(a: DataFrame, b: DataFrame, size: str = "bytes") -> DataFrame:
    """Of two one-row candidates (codec, bytes) the smaller, the first of equal ones by name."""
    return a.unionByName(b).agg(F.min(F.struct(size, "codec")).alias("m")).select("m.codec", f"m.{size}")
