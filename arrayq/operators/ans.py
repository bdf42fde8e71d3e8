"""Entropy coder with fractions of a bit for each symbol (range variant of asymmetric numeral systems).

As with the Huffman coder, shares come from the histogram and stretches of codes are coded by themselves in tasks.  Within a
stretch ``LANES`` coders take turns, so that numpy does one step for all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entropy import histogram_of

U = np.uint64
SCALE_BITS, LANES = 16, 64
SCALE, WORD, FLOOR = 1 << SCALE_BITS, U(16), U(1 << 32)  # a coder's state stays in [2 ** 32, 2 ** 48)


def shares(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols ascending, whole-numbered shares of at least 1 that sum to SCALE) of at most SCALE symbols."""
    symbols = np.array(sorted(counts), np.int64)
    if len(symbols) > SCALE:
        raise ValueError(f"{len(symbols)} symbols are more than {SCALE}")
    n = np.array([counts[s] for s in symbols.tolist()], float)
    f = np.maximum(1, np.floor(n / n.sum() * SCALE)).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    order = np.argsort(-f, kind="stable")
    if len(f) and f.sum() < SCALE:
        f[order[0]] += SCALE - f.sum()
    for k in order:  # too much was given to rare symbols: the frequent ones give it back
        over = f.sum() - SCALE
        if over <= 0:
            break
        f[k] -= min(over, max(0, f[k] - max(1, f[k] // 2)))
    while f.sum() > SCALE:
        f[np.argmax(f)] -= 1
    return symbols, f


def encoded(place: np.ndarray, f: np.ndarray) -> bytes:
    """Bytes of a stretch, given each code's place among the symbols."""
    f, start = f.astype(U), (np.cumsum(f) - f).astype(U)
    x, chunks = np.full(LANES, FLOOR, U), []
    for at in range((len(place) - 1) // LANES * LANES, -1, -LANES):
        s = place[at : at + LANES]
        y, w = x[: len(s)], f[s]
        out = y >= (w << U(32))
        chunks.append((y[out] & U(0xFFFF)).astype("<u2"))
        y = np.where(out, y >> WORD, y)
        x[: len(s)] = ((y // w) << U(SCALE_BITS)) + y % w + start[s]
    return x.astype("<u8").tobytes() + b"".join(c.tobytes() for c in reversed(chunks))


def decoded(content: bytes, n: int, f: np.ndarray) -> np.ndarray:
    """The n places that encoded() wrote."""
    start, slot = (np.cumsum(f) - f).astype(U), np.repeat(np.arange(len(f)), f)
    f = f.astype(U)
    x, words, at = np.frombuffer(content[: 8 * LANES], "<u8").astype(U), np.frombuffer(content[8 * LANES :], "<u2").astype(U), 0
    out = np.empty(n, np.int64)
    for k in range(0, n, LANES):
        y = x[: min(LANES, n - k)]
        low = y & U(SCALE - 1)
        s = slot[low.astype(np.int64)]
        y = f[s] * (y >> U(SCALE_BITS)) + low - start[s]
        refill = np.flatnonzero(y < FLOOR)
        y[refill] = (y[refill] << WORD) | words[at : at + len(refill)]
        at += len(refill)
        out[k : k + len(s)], x[: len(s)] = s, y
    return out


def packed(codes: DataFrame, stretch: int = 1 << 18, code: str = "code") -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """((part, n, content), (symbols, shares)): codes(i, code) by stretches of consecutive i.  No rows give no rows; codes are not null."""
    symbols, f = model = shares(histogram_of(codes, code))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = [encoded(np.searchsorted(symbols, np.asarray(x, np.int64)), f) for x in b.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("n"), pa.array(content, pa.binary())], ["part", "n", "content"])

    grouped = codes.groupBy(F.expr(f"i div {stretch}").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", code))), lambda s: s[code]).alias("codes"))
    return grouped.withColumn("n", F.size("codes").cast("long")).mapInArrow(run, "part long, n long, content binary"), model


def unpacked(rows: DataFrame, model: tuple[np.ndarray, np.ndarray], stretch: int = 1 << 18) -> DataFrame:
    """(i, code) of packed(), for codes that fill their stretches."""
    symbols, f = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, n, content in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + part * stretch), pa.array(symbols[decoded(content, n, f)])], ["i", "code"])

    return rows.mapInArrow(run, "i long, code long")
