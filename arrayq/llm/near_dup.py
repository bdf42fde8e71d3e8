"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is ``chunks * width`` min-hash symbols of 16 bits.  Two signatures with at most
``limit`` differing symbols have, by the pigeonhole principle, a chunk with at most limit // chunks of
them; every choice of that many symbols of a chunk is left out in turn, and the rest is a key, so such
a pair always shares a key.  With the defaults (70 symbols, 27 may differ, 14 chunks, one error each) a
pair at Jaccard similarity 0.8 differs in 14 +- 3.3 symbols; one in some 10,000 such borderline pairs
lies beyond the limit, and far fewer above 0.8.  What shares a key is compared on signatures, and what
is near enough is confirmed on the whole shingle sets.

Equal sets collapse into one representative before all that.  Links are confirmed in rounds, which join large groups of
near copies with few pairs: first each document with the smallest one of all its keys; then, for each number in
``nearest``, with so many of its nearest ones by signature that are not yet in its component.  Last comes every pair of near
signatures under one key whose ends are still apart, each pair under the first key that it
shares.  Beside its signature a document carries, for ``PARITIES`` parts of the hash space, whether it has an odd number of
shingles there: where two documents differ in this, at least one shingle is in one set only, which bounds their
similarity from above, so that pairs just below the threshold need no look at the texts.  A key held by more than ``block`` documents is compared in blocks, by
different tasks, the documents of its smallest component only with the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .graph import components
from .store import drop, saved

CHUNKS, WIDTH, LIMIT, BLOCK, NEAREST = 14, 5, 27, 1024, (1, 3)
PARITIES = 2048


def shingle_sets(texts: pa.Array, k: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each text, one text after the other, and where each begins."""
    w = W.split(texts, lower)
    h, counts = W.hash_words(w), w.counts
    g, ok = W.grams(h, k, 11), W.inside(w.first, k, len(w))
    owner = w.text_of
    small = np.flatnonzero((counts > 0) & (counts < k))
    with np.errstate(over="ignore"):
        whole = np.array([W.mix(np.bitwise_xor.accumulate(W.mix(h[w.first[i] : w.first[i + 1]] * W.salts(k, 5)[: counts[i]] + W.U(counts[i]))))[-1] for i in small], W.U)
    g, owner = np.concatenate([g[ok], whole]), np.concatenate([owner[: len(ok)][ok], small])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(len(counts) + 1))


def signatures(g: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) min-hash symbols of 16 bits; zero for an empty set."""
    out = np.zeros((len(first) - 1, n), np.uint16)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        at = first[full]
        with np.errstate(over="ignore"):
            for j, (a, b) in enumerate(zip(W.salts(n, 101), W.salts(n, 202), strict=True)):
                out[full, j] = W.mix(np.minimum.reduceat((g ^ b) * a, at)) >> W.U(48)
    return out


def keys(sig: np.ndarray, chunks: int, width: int, errors: int) -> np.ndarray:
    """(texts, keys): for each chunk, each choice of symbols that may differ, a hash of the others; the key's place is in its lowest bits."""
    left = list(combinations(range(width), width - errors))
    cols, place = [], W.U(places(chunks, width, errors) - 1)
    with np.errstate(over="ignore"):
        for c in range(chunks):
            part = sig[:, c * width : (c + 1) * width].astype(W.U)
            for i, keep in enumerate(left):
                h = np.full(len(sig), W.mix(np.array([c * len(left) + i + 1], W.U))[0], W.U)
                for j in keep:
                    h = W.mix((h ^ part[:, j]) * W.U(0x9E3779B97F4A7C15) + W.U(1))
                cols.append((h & ~place) | W.U(c * len(left) + i))
    return np.stack(cols, 1) if cols else np.zeros((0, 0), W.U)


def places(chunks: int, width: int, errors: int) -> int:
    """How many values the lowest bits of a key take."""
    return 1 << (chunks * comb(width, errors) - 1).bit_length()


def first_shared(sig: np.ndarray, p: np.ndarray, q: np.ndarray, place: int, width: int, errors: int) -> np.ndarray:
    """Which pairs of rows p and q share no key of a lower place."""
    ok, at = np.ones(len(p), bool), 0
    for c in range(place // comb(width, errors) + 1):
        part = sig[p, c * width : (c + 1) * width] != sig[q, c * width : (c + 1) * width]
        for keep in combinations(range(width), width - errors):
            if at < place:
                ok &= part[:, list(keep)].any(1)
            at += 1
    return ok


def parities(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, PARITIES / 8) bytes: for each part of the hash space whether the set has an odd number of shingles in it."""
    n = len(first) - 1
    at = np.repeat(np.arange(n), np.diff(first)) * PARITIES + (g >> W.U(20)).astype(np.int64) % PARITIES
    return np.packbits((np.bincount(at, minlength=n * PARITIES) & 1).astype(bool).reshape(n, PARITIES), 1)


def possible(parity_a: np.ndarray, parity_b: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may reach the similarity, given the sum of their sizes: no link is ever lost."""
    apart = np.bitwise_count(parity_a ^ parity_b).sum(1, dtype=np.int64)
    return 100 * (both - apart) >= percent * (both + apart)


def matrix(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and parities of a column of bytes."""
    raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), 2 * n + PARITIES // 8)
    return np.ascontiguousarray(raw[:, : 2 * n]).view(np.uint16), raw[:, 2 * n :]


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, lower: bool = True, chunks: int = CHUNKS, width: int = WIDTH, limit: int = LIMIT, block: int = BLOCK, nearest: tuple[int, ...] = NEAREST) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text, ...).

    Documents are linked where 100 * |A & B| >= percent * |A | B| for their sets of distinct ``shingle``-word
    runs (fewer words: the whole sequence as one).  component_id is the smallest doc_id reachable; kept
    is doc_id = component_id.  Null or empty text: no shingles, its own component.  A null doc_id has a
    null component and is kept.  Rows that repeat a doc_id are taken as copies of one document; if their texts differ,
    links are confirmed on the smallest of them.  Extra columns are not read.
    """
    n, errors = chunks * width, limit // chunks
    many = places(chunks, width, errors)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "text"):
            g, first = shingle_sets(b.column("text"), shingle, lower)
            size, full = np.diff(first), np.flatnonzero(np.diff(first) > 0)
            fps = [np.zeros(len(b), np.int64) for _ in range(2)]
            if len(full):
                fps[0][full] = np.add.reduceat(W.mix(g), first[full]).view(np.int64)
                fps[1][full] = np.bitwise_xor.reduceat(W.mix(g ^ W.U(0x5DEECE66D)), first[full]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), *map(pa.array, fps), pa.array([x.tobytes() + y.tobytes() for x, y in zip(signatures(g, first, n), parities(g, first), strict=True)], pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "sig"])

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                k = keys(matrix(b.column("sig"), n)[0], chunks, width, errors)
                yield pa.RecordBatch.from_arrays([W.signed(k.reshape(-1)), pa.array(np.repeat(b.column("doc_id").to_numpy(zero_copy_only=False), k.shape[1]))], ["key", "doc_id"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, u), (y, v) = matrix(b.column("sig_a"), n), matrix(b.column("sig_b"), n)
            ok = ((x != y).sum(1) <= limit) & possible(u, v, b.column("n_a").to_numpy() + b.column("n_b").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 200):
                b = whole.slice(at, 200)
                (ga, fa), (gb, fb) = (shingle_sets(b.column(c), shingle, lower) for c in ("text_a", "text_b"))
                common = np.array([len(np.intersect1d(ga[fa[i] : fa[i + 1]], gb[fb[i] : fb[i + 1]], True)) for i in range(len(b))], np.int64)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(100 * common >= percent * (np.diff(fa) + np.diff(fb) - common)))

    def cross(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
        """Near signatures of different components under one key, for each document the ``most`` nearest or all; rows come sorted by key, block pair and size."""
        held: list[pa.RecordBatch] = []

        def pairs(t: pa.Table, place: int) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            sig, parity = matrix(t.column("sig").combine_chunks(), n)
            doc, comp, size, side, same = (t.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles", "mine", "alone"))
            step = max(1, 4_000_000 // (n * max(1, len(doc))))
            for i in range(0, len(doc), step):
                # sizes ascend: only those up to 100/percent times as large can be linked
                to = int(np.searchsorted(size, size[min(i + step, len(doc)) - 1] * 100 // percent, "right"))
                x, y = slice(i, i + step), slice(i, to)
                d = (sig[x, None, :] != sig[None, y, :]).sum(2, dtype=np.uint16)
                far = (comp[x, None] != comp[None, y]) & (same[x, None] | (side[x, None] != side[None, y]))
                good = (d <= limit) & far & (size[None, y] * percent <= 100 * size[x, None])
                p, q = np.nonzero(good)
                for at in range(0, len(p), 1 << 16):
                    u, v = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
                    good[u, v] = possible(parity[u + i], parity[v + i], size[u + i] + size[v + i], percent)
                if most is not None and most < d.shape[1]:
                    d[~good] = n + 1
                    q = np.argpartition(d, most - 1, 1)[:, :most]
                    p = np.repeat(np.arange(len(d)), most)
                    q = q.reshape(-1)
                    ok = good[p, q]
                    p, q = p[ok], q[ok]
                else:
                    p, q = np.nonzero(good)
                apart, p, q = d[p, q], p + i, q + i
                if most is None:
                    new = first_shared(sig, p, q, place, width, errors)
                    apart, p, q = apart[new], p[new], q[new]
                yield pa.RecordBatch.from_arrays([pa.array(doc[p]), pa.array(np.minimum(doc[p], doc[q])), pa.array(np.maximum(doc[p], doc[q])), pa.array(apart.astype(np.int32))], ["of", "a", "b", "d"])

        last = None
        for b in batches:
            if not len(b):
                continue
            key, part = b.column("key").to_numpy(), b.column("part").to_numpy()
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1), len(b)]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if held and (key[s], part[s]) != last:
                    yield from pairs(pa.Table.from_batches(held), int(last[0]) & (many - 1))
                    held = []
                held.append(b.slice(s, e - s))
                last = (key[s], part[s])
        if held:
            yield from pairs(pa.Table.from_batches(held), int(last[0]) & (many - 1))

    signs = saved(docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, f1 long, f2 long, sig binary"))
    classes = saved(signs.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "f1", "f2").agg(F.min(F.struct("doc_id", "sig")).alias("r")).select("n_shingles", "f1", "f2", "r.*"))
    shared = saved(
        classes.select("doc_id", "sig").mapInArrow(key_rows, "key long, doc_id long")
        .select("key", "doc_id", F.expr("min(doc_id) over (partition by key)").alias("low"), F.expr("count(*) over (partition by key)").alias("n")).where("n > 1")
    )
    sigs = classes.select("doc_id", "sig", "n_shingles")
    wanted = shared.select("doc_id").distinct()
    texts = saved(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        return saved(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long"))

    of = lambda c: sigs.select(F.col("doc_id").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    edges = lambda comps: comps.select(F.col("node").alias("a"), F.col("component").alias("b"))

    def candidates(comps: DataFrame, most: int | None = None) -> DataFrame:
        """(a, b): near signatures under one key and in different components."""
        left = shared.select("key", "doc_id").join(comps.withColumnsRenamed({"node": "doc_id"}), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        left = left.select("*", F.expr("min(component) over (partition by key)").alias("low"), F.expr("max(component) over (partition by key)").alias("high")).where("low < high")
        # the smallest component, mostly by far the largest, has no pair inside: its blocks meet those of the others only
        low = F.col("component") == F.col("low")
        of_key = Window.partitionBy("key")
        two = F.min(F.when(~low, F.col("component"))).over(of_key) < F.col("high")  # the others have pairs among themselves
        left = left.select("key", "doc_id", "component", low.alias("in_low"), two.alias("two"), F.count(F.when(low, 1)).over(of_key).alias("n_low"), F.count(F.when(~low, 1)).over(of_key).alias("n"))
        lows, others = F.ceil(F.col("n_low") / block), F.ceil(F.col("n") / block)
        left = left.select("key", "doc_id", "component", "in_low", "two", lows.alias("lows"), others.alias("others"), F.pmod(F.xxhash64("doc_id"), F.when(F.col("in_low"), lows).otherwise(others)).alias("of"))
        to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        place = lambda part, mine, alone: F.struct(part.cast("long").alias("part"), mine.cast("long").alias("mine"), alone.alias("alone"))
        with_others = F.transform(to("others"), lambda j: place(1 + 2 * (F.col("of") * F.col("others") + j), F.lit(0), F.lit(False)))
        with_lows = F.transform(to("lows"), lambda i: place(1 + 2 * (i * F.col("others") + F.col("of")), F.lit(1), F.lit(False)))
        among = F.transform(to("others"), lambda j: place(2 * (F.least("of", j) * F.col("others") + F.greatest("of", j)), F.col("of"), F.col("of") == j))
        left = left.select("key", "doc_id", "component", F.explode(F.when(F.col("in_low"), with_others).when(F.col("two"), F.concat(with_lows, among)).otherwise(with_lows)).alias("p")).select("key", "doc_id", "component", "p.*")
        found = left.join(sigs, "doc_id").repartition("key", "part").sortWithinPartitions("key", "part", "n_shingles").mapInArrow(partial(cross, most=most), "of long, a long, b long, d int")
        if most is None:
            return found.select("a", "b").distinct()
        # a document has at most ``most`` for each of its keys
        best = found.groupBy("of").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "a", "b"))), 1, most).alias("p"))
        return best.select(F.explode("p").alias("p")).select("p.a", "p.b").distinct()

    stars = shared.where("doc_id > low").groupBy(F.col("doc_id").alias("b")).agg(F.min("low").alias("a"))
    stars = stars.join(of("a"), "a").join(of("b"), "b").where(f"least(n_a, n_b) * 100 >= greatest(n_a, n_b) * {percent}").select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(near, "a long, b long")
    comps = components(confirmed(stars))
    for most in (*nearest, None):
        comps = components(confirmed(candidates(comps, most)).unionByName(edges(comps)))
    for t in (shared, texts):  # what follows reads neither
        drop(t)
    comps = comps.withColumnsRenamed({"node": "doc_id"})
    of_class = classes.join(comps, "doc_id", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "doc_id").alias("c"))
    out = signs.select("doc_id", "n_shingles", "f1", "f2").join(of_class, ["n_shingles", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
