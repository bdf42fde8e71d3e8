"""Hidden Markov language model.

States emit word classes and a class emits its words: P(word | state) = P(class | state) * P(word | class).
The ``own`` most frequent words are classes by themselves, the others share ``suffixes`` classes by their
last three bytes, so that the trained tables have a fixed size; P(word | class) comes from exact counts of all
training words, add-one smoothed with one place for unseen words, and is as large as the corpus' vocabulary.
Baum-Welch runs over all training texts: each task sums its expected counts, Spark adds
them up by class, the driver normalises at most own + suffixes rows.  Within a task long texts are worked through in stretches of ``stretch`` tokens
at once; each takes ``burn`` tokens of its text on both sides along, whose own counts are not added, as a chain forgets its past quickly.  The likelihood of a text is the
scaled forward recursion over the whole of it.

A word's count reaches the texts in two ways: words with at least N / ``head`` of the N tokens, of which
there can be no more than ``head``, are sent to all tasks; the rarer ones are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import saved

STATES, ITERATIONS, OWN, SUFFIXES, HEAD, STRETCH, BURN, TOLERANCE = 8, 3, 8191, 8192, 1 << 21, 512, 16, 1e-3
END = W.U(0x8F14E45FCEEA167A)  # stands for the end of a text


def tokens(texts: pa.Array, suffixes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and ends, their suffix classes (-1: end), where each text begins."""
    w = W.split(texts, True)
    n = len(w.first) - 1
    tail = W.Words(w.buf, np.maximum(w.start, w.end - 3), w.end, w.first, w.offsets)
    first = w.first + np.arange(n + 1)
    at = np.arange(len(w)) + w.text_of
    h, c = np.full(first[-1], END, W.U), np.full(first[-1], -1, np.int32)
    h[at], c[at] = W.hash_words(w), (W.hash_words(tail, 3) % W.U(suffixes)).astype(np.int32)
    return h, c, first


def word_counts(docs: DataFrame, suffixes: int = SUFFIXES) -> DataFrame:
    """(word, suffix, n) over docs(text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "text"):
            h, c, _ = tokens(b.column("text"), suffixes)
            v, at, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([W.signed(v), pa.array(c[at]), pa.array(n)], ["word", "suffix", "n"])

    return docs.select("text").mapInArrow(run, "word long, suffix int, n long").groupBy("word", "suffix").agg(F.sum("n").alias("n"))


class Lexicon:
    """The head words, sorted, with count and class; what is not among them has its suffix' class."""

    def __init__(self, words: np.ndarray, n: np.ndarray, own: int, suffixes: int):
        top = np.lexsort((words, -n, words != END))[:own]  # the end always is a class of its own
        cls = np.full(len(words), -1, np.int32)
        cls[top] = suffixes + np.arange(len(top), dtype=np.int32)
        order = np.argsort(words, kind="stable")
        self.words, self.n, self.own = words[order], n[order], cls[order]
        self.classes = suffixes + len(top)
        self.sieve = np.zeros(1 << 24, bool)
        self.sieve[(self.words >> W.U(40)).astype(np.int64)] = True

    def look(self, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count or -1 if not in the head)"""
        n = np.full(len(h), -1, np.int64)
        cls = np.where(c < 0, 0, c)
        at = np.flatnonzero(self.sieve[(h >> W.U(40)).astype(np.int64)])
        if len(at):
            x = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
            ok = self.words[x] == h[at]
            at, x = at[ok], x[ok]
            n[at] = self.n[x]
            cls[at] = np.where(self.own[x] >= 0, self.own[x], cls[at])
        return cls, n


def stretches(first: np.ndarray, stretch: int, burn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, given by where each begins, in stretches: (token of each place, where each stretch begins, what counts, which begin a text).

    A stretch has up to ``burn`` tokens of its text before and behind it, which don't count: they make up for the cut.
    """
    cut = np.concatenate([np.arange(s, e, stretch) for s, e in zip(first[:-1], first[1:], strict=True)] or [np.zeros(0, np.int64)])
    text = np.searchsorted(first, cut, "right") - 1
    begin, end = first[text], first[text + 1]
    low, high = np.maximum(begin, cut - burn), np.minimum(end, cut + stretch + burn)
    starts = np.concatenate([[0], np.cumsum(high - low)])
    at = np.arange(starts[-1]) + np.repeat(low - starts[:-1], high - low)
    counts = (at >= np.repeat(cut, high - low)) & (at < np.repeat(cut + stretch, high - low))
    return at, starts, counts, cut == begin


def expected(cls: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, counts: np.ndarray | None = None, heads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (starts, moves, emissions by class) and log likelihood over sequences of classes; emit is (classes, states).

    counts: tokens that count, each with the move to it; heads: sequences that begin a text.
    """
    counts = np.ones(len(cls), bool) if counts is None else counts
    heads = np.ones(len(first) - 1, bool) if heads is None else heads
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size, heads = first[:-1][order], size[order], heads[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    states = len(start)
    gamma = np.zeros((len(cls), states), np.float32)
    alphas, seen, scale = [], [], []
    a, likelihood = None, 0.0
    for t in range(longest):
        m = active[t]
        o = emit[cls[begin[:m] + t]]
        a = np.where(heads[:m, None], start, np.float32(1 / states)) * o if t == 0 else (a[:m] @ move) * o
        s = a.sum(1, keepdims=True)
        a = a / s
        likelihood += float(np.log(s[counts[begin[:m] + t]]).sum(dtype=float))
        alphas.append(a)
        seen.append(o)
        scale.append(s)
    moves, b = np.zeros((states, states)), None
    for t in range(longest - 1, -1, -1):
        m = active[t]
        after = np.ones((m, states), np.float32)
        if t + 1 < longest:
            k = active[t + 1]
            x = seen[t + 1] * b / scale[t + 1]
            moves += alphas[t][:k].T @ (x * counts[begin[:k] + t + 1, None])
            after[:k] = x @ move.T
        b = after
        gamma[begin[:m] + t] = alphas[t] * b
    starts = gamma[begin[heads]].sum(0) if len(begin) else np.zeros(states)
    cls, gamma = cls[counts], gamma[counts]
    return starts, moves * move, np.stack([np.bincount(cls, gamma[:, k], len(emit)) for k in range(states)], 1), likelihood


def forward(cls: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    out, a = np.zeros(len(size)), None
    for t in range(longest):
        m = active[t]
        a = (start if t == 0 else a[:m] @ move) * emit[cls[begin[:m] + t]]
        s = a.sum(1)
        out[:m] += np.log10(s)
        a /= s[:, None]
    back = np.zeros(len(size))
    back[order] = out
    return back


def trained(train: DataFrame, lex: Broadcast, prior: np.ndarray, states: int, iterations: int, suffixes: int, stretch: int, burn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Tables of starts, moves and emissions by Baum-Welch over train(text, ...), and the log likelihood before each iteration.

    lex: the broadcast Lexicon; prior: shares of the classes.  Ends after ``iterations`` or when one gained less than TOLERANCE of the likelihood.
    """
    rng = np.random.default_rng(20)
    classes = len(prior)
    emit = prior[:, None] * np.exp(0.5 * rng.standard_normal((classes, states)))
    emit, start, move = emit / emit.sum(0), np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    cols, history = [f"s{k}" for k in range(states)], []
    for _ in range(iterations):
        tables = train.sparkSession.sparkContext.broadcast([x.astype(np.float32) for x in (start, move, emit)])

        def run(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            total = None
            for b in W.pieces(batches, "text"):
                h, c, first = tokens(b.column("text"), suffixes)
                at, starts, counts, heads = stretches(first, stretch, burn)
                got = expected(lex.value.look(h, c)[0][at], starts, *tables.value, counts, heads)
                total = got if total is None else [x + y for x, y in zip(total, got, strict=True)]
            if total is not None:
                rows = np.vstack([*total[:3], np.full((1, states), total[3] / states)])
                keep = np.flatnonzero(rows.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(keep), *(pa.array(rows[keep, k].astype(float)) for k in range(states))], ["row", *cols])

        sums = train.select("text").mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in cols)).groupBy("row").agg(*(F.sum(c).alias(c) for c in cols)).toArrow()
        full = np.zeros((2 + states + classes, states))
        full[sums["row"].to_numpy()] = np.stack([sums[c].to_numpy() for c in cols], 1)
        start = (full[0] + 0.1) / (full[0] + 0.1).sum()
        move = full[1 : 1 + states] + 0.1
        move /= move.sum(1, keepdims=True)
        emit = full[1 + states : -1] + 10 * prior[:, None]
        emit /= emit.sum(0)
        tables.unpersist()
        history.append(float(full[-1].sum()))
        if len(history) > 1 and history[-1] - history[-2] < TOLERANCE * abs(history[-1]):
            break
    return start, move, emit, history


def scored(docs: DataFrame, train: DataFrame, states: int = STATES, iterations: int = ITERATIONS, own: int = OWN, suffixes: int = SUFFIXES, head: int = HEAD, stretch: int = STRETCH, burn: int = BURN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, held_out, text, ...).

    train(text, ...): what the model learns from.  Null texts are empty, an empty text has one token, its
    end.  Without training rows every word is unknown and the score is that of the untrained tables.  Repeated rows are scored alike; nothing else is read.
    """
    spark = docs.sparkSession
    counts = saved(word_counts(train, suffixes))
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where((F.col("n") * head >= n_all) | (F.col("word") == int(END.view(np.int64)))).select("word", "n").toArrow()  # at most ``head`` + 1 rows
    lex = Lexicon(top["word"].to_numpy().view(W.U), top["n"].to_numpy(), own, suffixes)
    mine = np.sort(lex.words[lex.own >= 0]).view(np.int64).tolist()
    own_words = spark.createDataFrame([(x,) for x in mine], "word long")  # at most ``own`` rows
    mass, kinds = np.zeros(lex.classes), np.zeros(lex.classes)
    for suffix, n, v in counts.join(F.broadcast(own_words), "word", "left_anti").where("suffix >= 0").groupBy("suffix").agg(F.sum("n"), F.count("*")).collect():
        mass[suffix], kinds[suffix] = n, v
    mass[lex.own[lex.own >= 0]] = lex.n[lex.own >= 0]
    shared_lex = spark.sparkContext.broadcast(lex)
    start, move, emit, _ = trained(train, shared_lex, (mass + 0.5) / (mass + 0.5).sum(), states, iterations, suffixes, stretch, burn)
    final = spark.sparkContext.broadcast((start, move, emit, np.log10(mass + kinds + 1)))

    def run_final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, (start, move, emit, room) = shared_lex.value, final.value
        for b in W.pieces(batches, "text", 2 << 20):
            h, c, first = tokens(b.column("text"), suffixes)
            cls, n = lex.look(h, c)
            owner = np.repeat(np.arange(len(b)), np.diff(first))
            sums = lambda x: np.bincount(owner, x, len(b))
            inside = (cls < suffixes) & (c >= 0)  # words that share their class
            logs = np.log10(np.maximum(n, 0) + 1.0)
            score = forward(cls, first, start, move, emit) + sums(np.where(inside, logs - room[cls], 0.0))
            rare = np.flatnonzero(n < 0)
            order = rare[np.lexsort((h[rare], owner[rare]))]
            new = np.append(True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1]))[: len(order)]
            at = np.flatnonzero(new)
            many = np.diff(np.append(at, len(order)))
            off = pa.array(np.searchsorted(owner[order[at]], np.arange(len(b) + 1)).astype(np.int32))
            words, times = pa.ListArray.from_arrays(off, W.signed(h[order[at]])), pa.ListArray.from_arrays(off, pa.array(many.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("held_out"), pa.array(np.diff(first)), pa.array(sums((n > 0).astype(float)).astype(np.int64)), pa.array(sums(logs)), pa.array(score), words, times], ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "words", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    half = saved(rows.mapInArrow(run_final, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, words array<bigint>, times array<int>"))
    rare = half.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("k"))
    rare = rare.join(counts.where((F.col("n") * head < n_all) & (F.col("word") != int(END.view(np.int64)))).select("word", "n"), "word").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum(F.col("k").cast("long")).alias("k"))
    more = F.coalesce("more", F.lit(0.0))
    unit = float(np.log10(n_all + v_all + 1))
    return half.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * unit).alias("base_score"), (F.col("score") + more).alias("score"),
    )
