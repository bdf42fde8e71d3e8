"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Tokens are lower-cased runs of letters and digits.  Every run of ``tile`` tokens that a document shares
with a test item is a seed; Spark joins the seeds of both tables, and pairs of a document and an item are made only for seeds
that a document which holds enough of the item can't do without (the rarest).  Seeds on one diagonal make up maximal matches.  The longest match is marked
first, what later ones overlap with is cut off them, and matches shorter than ``tile`` are dropped, until none is
left.  As tiles may lie anywhere, reordered passages count in full.  A pair is reported where the
tiles cover at least ``coverage`` of the item's tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import saved, without

TILE, COVERAGE, SIEVE = 5, 0.5, 23


def tiles(i: np.ndarray, j: np.ndarray, n: int, tile: int) -> int:
    """Item tokens covered by greedy tiling, given the seeds' places in the item (of n tokens) and in the document."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.append(True, (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1))
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(i))) + tile - 1
    heap = [(-s, a, b) for s, a, b in zip(size.tolist(), i[at].tolist(), j[at].tolist(), strict=True)]
    heapify(heap)
    base = int(j.min())
    mine, theirs = np.zeros(n, bool), np.zeros(int(j.max()) - base + tile, bool)
    while heap:
        s, a, b = heappop(heap)
        s = -s
        taken = mine[a : a + s] | theirs[b - base : b - base + s]
        if not taken.any():
            mine[a : a + s] = theirs[b - base : b - base + s] = True
            continue
        edge = np.diff(np.concatenate([[1], taken.view(np.int8), [1]]))
        for x, y in zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist(), strict=True):
            if y - x >= tile:
                heappush(heap, (x - y, a + x, b + x))
    return int(mine.sum())


def _seeds(b: pa.RecordBatch, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of ``tile`` tokens in a batch's texts: row in the batch, hash, place in the text; and the rows' numbers of tokens."""
    w = W.split(b.column("text"), True, W.ALNUM)
    at = np.flatnonzero(W.inside(w.first, tile, len(w)))
    of = w.text_of[at] if len(at) else at
    return of, W.grams(W.hash_words(w), tile, 41)[at], at - w.first[of], w.counts


def item_seeds(benchmark: DataFrame, tile: int) -> DataFrame:
    """(item, item_id, tokens, seed, at): the seeds of each item, a row of benchmark(item_id, text, ...); item tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "text"):
            of, seed, at, n = _seeds(b, tile)
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays([b.column("item").take(rows), b.column("item_id").take(rows), pa.array(n[of], pa.int64()), W.signed(seed), pa.array(at, pa.int64())], ["item", "item_id", "tokens", "seed", "at"])

    rows = benchmark.where("item_id is not null and text is not null").select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item long, item_id long, tokens long, seed long, at long")


def doc_seeds(docs: DataFrame, items: DataFrame, tile: int) -> DataFrame:
    """(row, doc_id, seed, at): the seeds of each row of docs(doc_id, text, ...) that may be one of items(seed, ...).

    The sieve has 2 ** SIEVE places, however large the benchmark is; what it lets through by chance meets nothing in the join.
    """
    slots = items.select(F.shiftrightunsigned("seed", 64 - SIEVE).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()  # at most 2 ** SIEVE
    sieve = np.zeros(1 << SIEVE, bool)
    sieve[slots] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(sieve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.unpackbits(sent.value).view(bool)
        for b in W.pieces(batches, "text"):
            of, seed, at, _ = _seeds(b, tile)
            ok = np.flatnonzero(sieve[(seed >> W.U(64 - SIEVE)).astype(np.int64)])
            rows = pa.array(of[ok])
            yield pa.RecordBatch.from_arrays([b.column("row").take(rows), b.column("doc_id").take(rows), W.signed(seed[ok]), pa.array(at[ok], pa.int64())], ["row", "doc_id", "seed", "at"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, seed long, at long")


def rare_seeds(items: DataFrame, hits: DataFrame, tile: int, coverage: float) -> DataFrame:
    """(item, seed): seeds of each item of which every row that covers enough of it has one.

    k tiles that cover at least c tokens hold at least max(k, c - (tile - 1) * k) of the item's seeds, so at least ceil(c / tile)
    for any k, and a row must have one of the others but these, whatever their order.  The rarest are taken, so that phrases which
    many rows and items have make no pairs.
    """
    c = F.ceil(F.lit(coverage) * F.col("tokens"))
    least = F.greatest(F.lit(1), F.ceil(c / tile))
    n = hits.groupBy("seed").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("n", F.lit(0)), "seed", "at"))
    return items.join(n, "seed", "left").select("item", "seed", "tokens", place.alias("place")).where(F.col("place") <= F.col("tokens") - tile + 1 - least + 1).select("item", "seed").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered) for each row of docs(doc_id, text, ...) and of benchmark(item_id, text, ...) that overlap enough.

    Items of fewer than ``tile`` tokens, null texts and null item_ids match nothing; a null doc_id is
    reported like any other; repeated rows of either table are reported once each.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, n = b.column("pairs"), b.column("item_tokens").to_numpy()
            off, flat = pairs.offsets.to_numpy(), pairs.values
            i, j = (flat.field(k).to_numpy() for k in (0, 1))
            covered = np.array([tiles(i[s:e], j[s:e], int(x), tile) for s, e, x in zip(off[:-1].tolist(), off[1:].tolist(), n.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("item_id"), b.column("item_tokens"), pa.array(covered)], ["doc_id", "item_id", "item_tokens", "covered"])

    items = saved(item_seeds(benchmark, tile))
    hits = doc_seeds(docs, items, tile)
    hits = saved(hits.join(items.select("seed").distinct(), "seed", "left_semi"))
    near = hits.select("row", "seed").distinct().join(rare_seeds(items, hits, tile, coverage), "seed").select("row", "item").distinct()
    both = near.join(items.withColumnRenamed("at", "i"), "item").join(hits.withColumnRenamed("at", "j"), ["row", "seed"])
    # as many rows as the item's seeds occur in the row
    pairs = both.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.first("tokens").alias("item_tokens"), F.collect_list(F.struct("i", "j")).alias("pairs"))
    found = pairs.select("doc_id", "item_id", "item_tokens", "pairs").mapInArrow(run, "doc_id long, item_id long, item_tokens long, covered long")
    return found.where(F.col("covered") >= F.lit(coverage) * F.col("item_tokens"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """docs without the documents that hold ``coverage`` of a test item; all columns, null doc_ids stay.

    All rows of a doc_id go if one of them holds an item.  Null and empty texts stay, an empty benchmark removes nothing.
    """
    bad = contaminated(docs, benchmark, tile, coverage).select("doc_id").distinct()
    return without(docs, bad, "doc_id")
