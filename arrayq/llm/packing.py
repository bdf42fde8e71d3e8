"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Only the last, shorter part of a document has to find a place, so every document is one item of 1 to
``capacity`` tokens, beside its full pieces, which fill sequences of their own.  Items and the gaps of open sequences
are rows of one table.  Each round is a few Spark jobs over it:

* Items for which no gap is large enough open sequences: they are range-sorted by size, and by their ranks as many as fit into one share a
  sequence.  As many sequences are opened as the tokens that are left need at least.
* Else items and gaps are range-sorted together, largest first.  In this order an item takes the latest gap that is still free: its
  successor, the smallest one that holds it, conflicts being resolved by rank.  That is the matching of brackets, which needs no loop:
  the running sum of gaps less items says at which depth a row lies, and at one depth an item follows its gap at once.  The sum is taken
  in each range and the ranges' totals are added.  Gaps that hold the largest item several times are offered in slots of that size.

Then gaps are updated, and what found none goes into the next round.  Each round takes items over half the size of its largest one (all,
once none is over an eighth of ``capacity``), so that small ones stay for the gaps that are left at the end.  How many rounds there are depends on the sizes, not on the number of rows;
each ends with a table in the shared folder.  The driver gets a histogram of at most 2 * ``capacity`` sizes a round, for
the round's limits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import drop, saved

CAPACITY = 1024
RANGE = 1 << 18  # rows of a sorted range


def encoder(name: str = "byte_bpe_50k"):
    """text -> ids of a public byte-level BPE, equal to tokenizers' encode(text, add_special_tokens=False) with the json file of that name."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    special = {"<|endoftext|>": len(ranks)}
    t = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: t.encode(text, allowed_special=set(special), disallowed_special=())


def tokenized(docs: DataFrame, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): the pieces of each document; a shorter one comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in W.pieces(batches, "text"):
            out = []
            for row, doc, text in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end], "<u4")
                head = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(head, len(ids) + 1, capacity)]
                out += [(row, doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def ordered(rows: DataFrame, weight: Column, n: int, *key: Column) -> DataFrame:
    """rows, range-sorted by key (a row's place must be unique), with ``running``, the sum of weight up to and with a row.

    No task sorts more than a range of some RANGE rows, whatever is frequent, as long as key tells rows apart.
    """
    names = [f"k{i}" for i in range(len(key))]
    out = rows.select("*", weight.cast("long").alias("weight"), *(k.alias(c) for c, k in zip(names, key, strict=True)))
    local = F.sum("weight").over(Window.partitionBy("part").orderBy(*names))
    if n <= RANGE:  # one range
        return out.coalesce(1).withColumn("part", F.lit(0)).withColumn("running", local).drop("weight", "part")
    out = saved(out.repartitionByRange(-(-n // RANGE), *names).withColumn("part", F.spark_partition_id()))
    # as many rows as there are ranges
    before = out.groupBy("part").agg(F.sum("weight").alias("total")).select("part", F.expr("sum(total) over (order by part) - total").alias("before"))
    return out.withColumn("local", local).join(F.broadcast(before), "part").withColumn("running", F.col("local") + F.col("before")).drop("weight", "part", "local", "before")


def opened(items: DataFrame, n: int, sizes: dict[int, int], most: int, first: int, capacity: int) -> tuple[DataFrame, int]:
    """items(id, size) with the new sequence and the offset in it of those that open one, and how many are opened.

    sizes: how many items there are of each; ``capacity`` // size of one size share a sequence, the largest sizes come first and
    at most ``most`` sequences are opened.
    """
    classes, at, used = [], 0, 0  # (items a sequence, first rank, items that open, first sequence)
    for k in sorted({capacity // s for s in sizes}):
        have = sum(c for s, c in sizes.items() if capacity // s == k)
        take = min(have, max(0, most - used) * k)
        classes.append((k, at, take, first + used))
        at, used = at + have, used + -(-take // k)
    table = items.sparkSession.createDataFrame(classes, "share long, begin long, take long, base long")
    ranked = ordered(items, F.lit(1), n, -F.col("size"), F.col("id"))
    place = F.col("running") - 1 - F.col("begin")
    ranked = ranked.withColumn("share", F.floor(F.lit(capacity) / F.col("size"))).join(F.broadcast(table), "share")
    ranked = ranked.select("id", "size", "running", F.when(place < F.col("take"), F.col("base") + F.floor(place / F.col("share"))).alias("sequence"))
    # at most ``capacity`` items a sequence; those without one are kept apart by their ids
    within = Window.partitionBy("sequence", F.when(F.col("sequence").isNull(), F.col("id"))).orderBy("running")
    return saved(ranked.select("id", "size", "sequence", (F.sum("size").over(within) - F.col("size")).alias("offset"))), used


def matched(items: DataFrame, gaps: DataFrame, n: int, top: int, capacity: int) -> DataFrame:
    """items(id, size) with the sequence and the offset in it of those that find a place in gaps(id, size); no item is larger than top."""
    slots = F.greatest(F.lit(1), F.floor(F.col("size") / top))
    offer = gaps.select("id", F.col("size").alias("gap"), F.posexplode(F.array_repeat(F.lit(0), slots.cast("int"))).alias("slot", "zero"), slots.alias("slots"))
    offer = offer.select(F.lit(0).alias("kind"), "id", "slot", F.when(F.col("slot") + 1 < F.col("slots"), F.lit(top)).otherwise(F.col("gap") - F.col("slot") * top).alias("size"), "gap")
    both = offer.unionByName(items.select(F.lit(1).alias("kind"), "id", F.lit(0).alias("slot"), "size", F.lit(0).alias("gap")))
    swept = ordered(both, F.lit(1) - 2 * F.col("kind"), n, -F.col("size"), F.col("kind"), F.col("id"), F.col("slot"))
    # the depth of a gap is that behind it, of an item that before it; at each depth gaps and items take turns
    at = Window.partitionBy("depth").orderBy("k0", "k1", "k2", "k3")
    swept = swept.withColumn("depth", F.col("running") + F.col("kind")).withColumn("taken", F.lag(F.struct("kind", "id", "slot", "gap")).over(at)).where("kind = 1")
    found = swept.select("id", "size", F.when(F.col("taken.kind") == 0, F.col("taken")).alias("taken"))
    # a sequence takes at most ``capacity`` items; those without one are kept apart by their ids
    within = Window.partitionBy("taken.id", F.when(F.col("taken").isNull(), F.col("id"))).orderBy("taken.slot")
    return saved(found.select("id", "size", F.col("taken.id").alias("sequence"), (F.lit(capacity) - F.col("taken.gap") + F.sum("size").over(within) - F.col("size")).alias("offset")))


def placed(items: DataFrame, capacity: int) -> DataFrame:
    """(id, sequence, offset) of every one of items(id, size); sequences are numbered from 0."""
    # kind 1: an item that waits; kind 0: a gap, its id is that of the sequence
    state, done, first = items.select(F.lit(1).alias("kind"), "id", F.col("size").cast("long").alias("size")), [], 0
    while True:
        counts = state.groupBy("kind", "size").agg(F.count("*").alias("n")).collect()  # at most 2 * capacity rows
        have, free = ({r["size"]: r["n"] for r in counts if r["kind"] == k} for k in (1, 0))
        if not have:
            break
        top, largest, total = max(have), max(free, default=0), lambda c: sum(s * n for s, n in c.items())
        low = top // 2 if top > capacity // 8 else 0
        low = low if top <= largest else max(largest, low)
        take = {s: n for s, n in have.items() if s > low}
        now = state.where((F.col("kind") == 1) & (F.col("size") > low)).select("id", "size")
        if top > largest:
            # no gap is of use to what is larger than all: these open as many as are needed at least, and so does the total
            most = max(-(-(total(have) - total(free)) // capacity), -(-total({s: n for s, n in have.items() if s > largest}) // capacity), sum(n for s, n in have.items() if s > max(largest, capacity // 2)))
            found, used = opened(now, sum(take.values()), take, most, first, capacity)
            gaps = found.where("sequence is not null").groupBy(F.col("sequence").alias("id")).agg((F.lit(capacity) - F.sum("size")).alias("size"))
            stay, first = state.where((F.col("kind") == 0) | (F.col("size") <= low)), first + used
        else:
            n = sum(take.values()) + sum(c * max(1, s // top) for s, c in free.items() if s > low)
            open_ = state.where((F.col("kind") == 0) & (F.col("size") > low)).select("id", "size")
            found = matched(now, open_, n, top, capacity)
            filled = found.where("sequence is not null").select(F.col("sequence").alias("id"), (-F.col("size")).alias("size"))
            gaps = open_.unionByName(filled).groupBy("id").agg(F.sum("size").alias("size"))
            stay = state.where(F.col("size") <= low)
        done.append(found.where("sequence is not null").select("id", "sequence", "offset"))
        after = stay.unionByName(found.where("sequence is null").select(F.lit(1).alias("kind"), "id", "size")).unionByName(gaps.select(F.lit(0).alias("kind"), "id", "size"))
        last, state = state, saved(after.where((F.col("kind") == 1) | (F.col("size") >= min(have))))
        if len(done) > 1:
            drop(last)
    return reduce(DataFrame.unionByName, done) if done else items.select("id", F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("long").alias("offset")).limit(0)


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k", end: int = 2) -> DataFrame:
    """Every row of docs(doc_id, text, ...) as its pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its text's ids (null text: empty) and then ``end``.  One longer than ``capacity`` is cut into pieces of that
    length, a shorter one first.  Pieces share sequences of at most ``capacity`` tokens without gaps.
    Repeated rows and null doc_ids are documents of their own.  No rows give no rows.
    """
    pieces = saved(tokenized(docs, tokenizer, end, capacity))
    places = placed(pieces.where(F.col("piece") == 0).select(F.col("row").alias("id"), F.col("length").alias("size")), capacity)
    out = pieces.withColumn("place", F.monotonically_increasing_id()).join(places.withColumnRenamed("id", "row"), "row")
    # a full piece behind the first has a sequence of its own, numbered below zero by its place in the table
    first = F.col("piece") == 0
    own = -1 - F.col("place")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.when(first, F.col("sequence")).otherwise(own).alias("sequence_id"), F.when(first, F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"))
