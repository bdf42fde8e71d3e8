"""Substring dedup by recompression.

Each round names, everywhere alike, the maximal runs of one symbol and then the pairs whose left symbol
falls into the left half of the alphabet and right one into the right half.  A name is a hash of what it
stands for, so no round has to exchange a dictionary.  For each symbol the stretch of words that its
making depended on is carried along; a repeat that covers this stretch holds the same symbol wherever it
occurs.  Each window of ``window`` words chooses one such symbol as its anchor (longer ones first, then
the largest name), so equal windows choose equal anchors.

Spark groups the runs of consecutive windows with one anchor by anchor; of the documents of a batch that have the same run only the
smallest one is sent there, so that a passage which very many documents have sends a row for each megabyte of text.  A run whose words were already
seen in a smaller document is resolved at once: this settles the inside of long repeats.  Runs that share
an anchor, but not all words, are their edges or chance; only their windows are compared one by one, by
80 bits of hash.  Anchors of a single document, most of them, go no further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import drop, saved, unused

WINDOW, ROUNDS = 13, 4


def _with_next(low, high, of_low, of_high, joins, far):
    """Stretches widened by the next symbol's; beyond any window if there is none in the text."""
    lo, hi = np.append(of_low[1:], of_low[-1:]), np.append(of_high[1:], of_high[-1:])
    return np.where(joins[1:], np.minimum(low, lo), low), np.where(joins[1:], np.maximum(high, hi), high + far)


def _with_previous(low, high, of_low, of_high, joins, far):
    lo, hi = np.append(of_low[:1], of_low[:-1]), np.append(of_high[:1], of_high[:-1])
    return np.where(joins[:-1], np.minimum(low, lo), low - far), np.where(joins[:-1], np.maximum(high, hi), high)


def _rounds(h: np.ndarray, first: np.ndarray, window: int, rounds: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Symbols after each round as (name, words, low, high): [low, high) is what the symbol depends on."""
    n = len(h)
    name, size = h.copy(), np.ones(n, np.int64)
    low, high = np.arange(n), np.arange(n) + 1
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    far = window + 1
    with np.errstate(over="ignore"):
        for r in range(rounds):
            if not len(name):
                return
            # runs
            same = np.zeros(len(name), bool)
            same[1:] = (name[1:] == name[:-1]) & (text[1:] == text[:-1])
            at = np.flatnonzero(~same)
            end = np.append(at[1:], len(name))
            length = end - at
            run = length > 1
            made = np.where(run, W.mix(name[at] * W.U(0xD1342543DE82EF95) + length.astype(W.U) + W.U(r)), name[at])
            text = text[at]
            joins = np.zeros(len(at) + 1, bool)  # joins[i]: i-1 and i lie in one text
            joins[1:-1] = text[1:] == text[:-1]
            lo, hi, total = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.add.reduceat(size, at)
            # that a run ends where it does depends on the symbols next to it, not on all of the runs that these may belong to
            lo, hi = _with_previous(lo, hi, low[end - 1], high[end - 1], joins, far)
            low, high = _with_next(lo, hi, low[at], high[at], joins, far)
            name, size = made, total
            # pairs
            left = (W.mix(name + W.U(0xA24BAED4963EE407 * (r + 1) & 0xFFFFFFFFFFFFFFFF)) & W.U(1)).astype(bool)
            pair = np.zeros(len(name), bool)
            pair[:-1] = left[:-1] & ~left[1:] & joins[1:-1]
            gone = np.append(False, pair[:-1])
            nxt = np.append(np.arange(1, len(name)), len(name) - 1)
            made = np.where(pair, W.mix((name ^ W.mix(name[nxt] + W.U(0x632BE59BD9B4E019))) * W.U(0x9E3779B97F4A7C15) + W.U(r + 1)), name)
            # a pair depends on its two; a symbol of the left half on its right neighbour, and the other way round
            to_next, to_previous = _with_next(low, high, low, high, joins, far), _with_previous(low, high, low, high, joins, far)
            lo, hi = (np.where(pair | left, x, y) for x, y in zip(to_next, to_previous, strict=True))
            total = size + np.where(pair, size[nxt], 0)
            stay = ~gone
            name, size, low, high, text = made[stay], total[stay], lo[stay], hi[stay], text[stay]
            yield name, size, low, high


def anchors(h: np.ndarray, first: np.ndarray, window: int, rounds: int) -> np.ndarray:
    """The anchor of each window that begins at a word, 0 where a window has none."""
    n = len(h)
    best = np.zeros(n, W.U)
    for name, size, low, high in _rounds(h, first, window, rounds):
        fits = (high - low <= window) & (size > 1)
        name, size, low, high = name[fits], size[fits], low[fits], high[fits]
        rank = (np.minimum(size, 3).astype(W.U) << W.U(60)) | (name >> W.U(4))  # those of three words or more first
        room = window - (high - low)
        for j in range(window - 1):
            ok = (room >= j) & (low >= j)
            np.maximum.at(best, low[ok] - j, rank[ok])
    if len(best) >= window:
        ok = W.inside(first, window, n)
        best[: len(ok)][~ok] = 0
        best[len(ok) :] = 0
    else:
        best[:] = 0
    return best


def runs(w: W.Words, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows with one anchor: (anchor, name, begin, end, text, windows' hashes).

    The name stands for all words of the run's windows.  A window without a usable symbol is its own anchor.
    """
    h = W.hash_words(w)
    hashes = W.grams(h, window, 31)
    at = np.flatnonzero(W.inside(w.first, window, len(h)))
    a, owner = anchors(h, w.first, window, rounds)[at], w.text_of[at]
    with np.errstate(over="ignore"):
        a = np.where(a == 0, W.mix(hashes[at] + W.U(5)), a)
        begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]))) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(at)))
        total = np.add.reduceat(hashes[at], begin) if len(at) else np.zeros(0, W.U)
        begin, owner, a = at[begin], owner[begin], a[begin]
        name = W.mix(total + W.mix(hashes[begin] ^ W.mix(hashes[begin + size - 1] + size.astype(W.U))))
    return a, name, begin, begin + size, owner, h


def removed_windows(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_hash, begins): for docs(doc_id, text, ...) the word positions where windows to remove begin.

    A window of ``window`` consecutive words goes if its words also begin in a document of smaller doc_id.
    Only rows that lose something are returned; text_hash is xxhash64(text).  Null or empty text and texts shorter
    than the window lose nothing, nor do rows with a null doc_id, which also count for no other row.  Rows
    that repeat a doc_id count as one document and are judged each by itself.
    """

    def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "text"):
            a, name, _, _, owner, _ = runs(W.split(b.column("text")), window, rounds)
            doc = b.column("doc_id").to_numpy()[owner]
            order = np.lexsort((doc, name))
            a, name, doc = a[order], name[order], doc[order]
            first = np.append(True, name[1:] != name[:-1])[: len(name)]
            new = np.flatnonzero(first | np.append(True, doc[1:] != doc[:-1])[: len(name)])
            # a run that a smaller document of this batch has is settled here, and goes where its name is not awaited
            gone = ~first[new]
            # by document again, so that the column of ids compresses in the shuffle
            order = np.lexsort((name[new], doc[new]))
            new, gone = new[order], gone[order]
            a, name, doc = a[new], name[new], doc[new]
            with np.errstate(over="ignore"):
                # the lowest bit of an anchor says so, as a column of its own would cost a word a row
                a = np.where(gone, W.mix(a ^ W.mix(doc.view(W.U) + W.U(9))) | W.U(1), a & ~W.U(1))
            yield pa.RecordBatch.from_arrays([W.signed(a), W.signed(name), pa.array(doc)], ["anchor", "name", "doc_id"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Begins of the windows of resolved runs, hashes of the windows of open ones."""
        for b in W.pieces(batches, "text"):
            w = W.split(b.column("text"))
            _, name, begin, end, owner, h = runs(w, window, rounds)
            salt = W.mix(np.arange(len(b)).astype(W.U) + W.U(77))  # a run of one text differs from the same one of another
            size, docs_of, places = end - begin, b.column("doc_id").to_numpy(), []
            for c in ("gone", "open"):
                lists = b.column(c)
                known = lists.flatten().to_numpy(zero_copy_only=False).view(W.U) ^ np.repeat(salt, lists.value_lengths().to_numpy(zero_copy_only=False))
                hit = np.flatnonzero(np.isin(name ^ salt[owner], known))
                places.append(np.repeat(begin[hit], size[hit]) + np.arange(size[hit].sum()) - np.repeat(np.cumsum(size[hit]) - size[hit], size[hit]))
            gone, at = places
            k1, k2 = W.grams(h, window, 31)[at], W.grams(h, window, 37)[at] >> W.U(48)
            # what a smaller document of this batch has needs no comparison elsewhere, so common windows leave few rows
            of = w.text_of
            doc = docs_of[of[at]]
            order = np.lexsort((doc, k2, k1))
            new = np.flatnonzero(np.append(True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1]))[: len(at)])
            low = np.empty(len(at), np.int64)
            low[order] = np.repeat(doc[order][new], np.diff(np.append(new, len(at))))
            later = doc > low
            gone, at, k1, k2 = np.sort(np.concatenate([gone, at[later]])), at[~later], k1[~later], k2[~later]
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(of[x], np.arange(len(b) + 1)).astype(np.int32)), y) for x, y in ((gone, pa.array((gone - w.first[of[gone]]).astype(np.int32))), (at, pa.array((at - w.first[of[at]]).astype(np.int32))), (at, W.signed(k1)), (at, pa.array(k2.astype(np.int32))))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *lists], ["doc_id", "text_hash", "gone", "at", "k1", "k2"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    named = rows.select("doc_id", "text").mapInArrow(run_rows, "anchor long, name long, doc_id long")
    whole = "over (partition by anchor order by name rows between unbounded preceding and unbounded following)"
    same = "min(doc_id) over (partition by anchor, name)"
    named = named.select("doc_id", "name", F.expr(f"min(doc_id) {whole} < max(doc_id) {whole}").alias("more"), F.expr(f"min(name) {whole} < max(name) {whole}").alias("mixed"), F.expr(f"anchor & 1 = 1 or {same} < doc_id").alias("gone"))
    flags = saved(named.where("gone or more and mixed").select("doc_id", "name", "gone"))
    of_doc = flags.groupBy("doc_id").agg(F.collect_list(F.when(F.col("gone"), F.col("name"))).alias("gone"), F.collect_list(F.when(~F.col("gone"), F.col("name"))).alias("open"))
    found = saved(rows.join(of_doc, "doc_id").select("doc_id", "text", "text_hash", "gone", "open").mapInArrow(resolve, "doc_id long, text_hash long, gone array<int>, at array<int>, k1 array<bigint>, k2 array<int>"))
    drop(flags)
    seen = found.where("size(at) > 0").select("doc_id", "text_hash", F.explode(F.arrays_zip("k1", "k2", "at")).alias("w")).select("doc_id", "text_hash", "w.*")
    later = seen.select("doc_id", "text_hash", "at", F.expr("min(doc_id) over (partition by k1, k2)").alias("low")).where("low < doc_id")
    later = later.groupBy("doc_id", "text_hash").agg(F.collect_list("at").alias("begins"))
    both = found.where("size(gone) > 0").select("doc_id", "text_hash", F.col("gone").alias("begins")).unionByName(later)
    return both.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("begins"))).alias("begins"))


def removed_words(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Every row of docs(doc_id, text, ...) as (doc_id, text, begins), begins from removed_windows(), empty where nothing goes."""
    gone = removed_windows(docs, window, rounds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "text", F.coalesce("begins", F.array().cast("array<int>")).alias("begins"))


def _kept(texts: pa.Array, begins: pa.Array, window: int) -> tuple[W.Words, np.ndarray]:
    w = W.split(texts)
    change = np.zeros(len(w) + window + 1, np.int64)
    at = begins.flatten().to_numpy(zero_copy_only=False) + np.repeat(w.first[:-1], begins.value_lengths().to_numpy(zero_copy_only=False))
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return w, np.cumsum(change)[: len(w)] <= 0


def digest(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of removed_words(); null texts have no words, no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "text"):
            w, keep = _kept(b.column("text"), b.column("begins"), window)
            raw, sums, gone = w.buf.tobytes(), [], []
            for s, e in zip(w.first[:-1], w.first[1:], strict=True):
                k = keep[s:e]
                gone.append(int(e - s - k.sum()))
                kept = b" ".join(x for x, y in zip(raw[w.start[s] : w.end[e - 1]].split(), k.tolist(), strict=True) if y) if e > s else b""
                sums.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """docs with the words that removed_words() names cut out of text; other columns, and texts that lose nothing, stay as they are.

    A cut text has its kept words joined by one space, and n_chars, if there is such a column, its new length.
    doc_id should be unique.  A row with a null doc_id stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "text"):
            w, keep = _kept(b.column("text"), b.column("begins"), window)
            raw, out = w.buf.tobytes(), []
            for i, (s, e) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                k = keep[s:e]
                out.append(b.column("text")[i].as_py() if k.all() else b" ".join(x for x, y in zip(raw[w.start[s] : w.end[e - 1]].split(), k.tolist(), strict=True) if y).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(out, pa.string())], ["cut_id", "cut_hash", "cut_text"])

    gone = removed_windows(docs, window, rounds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    cut = rows.join(gone, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "begins")
    cut = cut.mapInArrow(run, "cut_id long, cut_hash long, cut_text string").dropDuplicates(["cut_id", "cut_hash"])
    names = [unused(docs, c) for c in cut.columns]
    id_, hash_, text = map(F.col, names)
    both = docs.join(cut.toDF(*names), (F.col("doc_id") == id_) & (F.xxhash64("text") == hash_), "left")
    cols = {"text": F.when(id_.isNotNull(), text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(id_.isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return both.select(*(cols.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
