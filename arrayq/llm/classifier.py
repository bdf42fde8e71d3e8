"""Co-training quality classifier: a text view and a metadata view teach each other.

Two properties are learned alike, low quality and toxicity, each by two logistic models.  The text view has the words of a text and
counts of its characters and repetitions; the metadata view has what is known without reading it: source, language, stated size and the
layout in lines.  Both are fitted to labelled documents.  Then, in each round, Spark scores every document that is not labelled by
both; what a view is surest of, by quantiles of all scores, is labelled for the other one, which goes on learning from
its labels and these: Spark sums the gradient over all of them for each step, the driver adds that of the labelled ones.  A held-out
part of the labels calibrates both views and weighs their calibrated scores (Platt scaling and stacking).  Last, all
documents are scored; one is accepted if both probabilities are below ``reject``.

Fitting takes at most ``labelled`` labelled documents, those with the smallest hashes of their ids, and their ``vocabulary`` most telling words for
each property; only these documents' features come to the driver, all others count where they lie.  Features are made once and
kept in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as X
from . import words as W
from .store import saved, without

LABELLED, VOCABULARY, ROUNDS, STEPS, REJECT = 8000, 300, 3, 5, 0.5
SLOTS = 64  # one-hot places for each of source and language, by hash
CONTENT, LAYOUT = 10, 5  # how many numbers _content() and _layout() take from a text
SURE, PSEUDO, BINS, REACH = 2.0, 0.3, 4096, 32.0  # least score of a pseudo-label, its weight; bins of scores and where they end
FEATURES = "doc_id long, low int, toxic int, known boolean, hold boolean, dense binary, words binary"


def _slots(col: pa.Array) -> np.ndarray:
    w = W.Words(*(lambda b, o: (b, o[:-1], o[1:], np.arange(len(o)), o))(*W.raw(col)))
    return (W.hash_words(w) >> W.U(58)).astype(np.uint8)


def _content(w: W.Words, h: np.ndarray) -> np.ndarray:
    """(texts, CONTENT): character kinds, word lengths, repetitions."""
    n, size = np.maximum(w.counts, 1), np.maximum(np.diff(w.offsets), 1)
    key = np.lexsort((h, w.text_of))
    again = (h[key][1:] == h[key][:-1]) & (w.text_of[key][1:] == w.text_of[key][:-1]) if len(h) else np.zeros(0, bool)
    repeated = np.bincount(w.text_of[key][1:][again], minlength=len(n)) if len(h) else np.zeros(len(n))
    frac = lambda t: X.per_text(w, np.flatnonzero(t[w.buf])) / size
    chars = X.word_chars(w) / n
    cols = [chars, chars**2, *(np.sqrt(frac(t)) for t in (X.SYMBOLS, X.UPPER, X.DIGIT, X.MARKS)), repeated / n, (repeated / n) ** 2, X.repeat_words(w, h) / n, np.log1p(w.counts)]
    return np.stack(cols, 1).astype(np.float32)


def _layout(b: pa.RecordBatch, w: W.Words) -> np.ndarray:
    """(texts, LAYOUT): stated size, lines."""
    stated = np.maximum(b.column("n_chars").cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False), 0)
    size, breaks = np.maximum(np.diff(w.offsets), 1), X.per_text(w, np.flatnonzero(w.buf == 10))
    dup, n_lines = X.duplicate_lines(w)
    cols = [np.log1p(stated), np.log1p(stated) ** 2 / 10, np.log1p(n_lines), np.log1p(size / (breaks + 1)), dup / np.maximum(n_lines, 1)]
    return np.stack(cols, 1).astype(np.float32)


def _distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
    return h[new], owner[new]


def _rows(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    text = lambda c: (F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c)
    size = (F.col("n_chars") if "n_chars" in have else F.length("text")).cast("double").alias("n_chars")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text("text"), text("source"), text("lang"), size)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """The values of each of n rows as bytes; owners ascend."""
    off = np.searchsorted(owner, np.arange(n + 1)) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]], off - off[0]


class Batch:
    """Features of some documents: dense numbers, slots of source and language, places of their words in the vocabulary."""

    def __init__(self, dense: pa.Array, words: pa.Array):
        raw, _ = _bytes(dense)
        raw = raw.reshape(len(dense), 4 * (CONTENT + LAYOUT) + 2)
        self.dense = np.ascontiguousarray(raw[:, :-2]).view(np.float32)
        self.slots = raw[:, -2:].astype(np.int64)
        raw, off = _bytes(words)
        self.ids = raw.view(np.uint16).astype(np.int64)
        self.owner = np.repeat(np.arange(len(dense)), np.diff(off) // 2)

    def __len__(self) -> int:
        return len(self.dense)

    def only(self, rows: np.ndarray) -> Batch:
        """Those rows, a mask."""
        out, keep, number = Batch.__new__(Batch), rows[self.owner], np.cumsum(rows) - 1
        out.dense, out.slots, out.ids, out.owner = self.dense[rows], self.slots[rows], self.ids[keep], number[self.owner[keep]]
        return out


@dataclass
class View:
    """One view's columns of a Batch; coefficients are one for each column and, last, the intercept."""

    kind: str
    words: int
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, b: Batch) -> np.ndarray:
        x = b.dense[:, :CONTENT] if self.kind == "text" else b.dense[:, CONTENT:]
        return (x - self.mean) / self.scale

    @property
    def width(self) -> int:
        return len(self.mean) + (self.words if self.kind == "text" else 2 * SLOTS) + 1

    def score(self, b: Batch, c: np.ndarray) -> np.ndarray:
        k = len(self.mean)
        z = self.dense(b) @ c[:k] + c[-1]
        if self.kind == "text":
            return z + np.bincount(b.owner, c[k:-1][b.ids], len(b))
        return z + c[k + b.slots[:, 0]] + c[k + SLOTS + b.slots[:, 1]]

    def sums(self, b: Batch, r: np.ndarray) -> np.ndarray:
        """The columns' sums, each row times r."""
        if self.kind == "text":
            hot = np.bincount(b.ids, r[b.owner], self.words)
        else:
            hot = np.concatenate([np.bincount(b.slots[:, k], r, SLOTS) for k in (0, 1)])
        return np.concatenate([r @ self.dense(b), hot, [r.sum()]])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(c: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], weight: float, curve: float, steps: int, penalty: float = 1.0) -> np.ndarray:
    """Nesterov's method on a logistic loss; curve: the largest curvature of the loss for each unit of weight."""
    rate, last = 1 / (curve + penalty / weight), c
    for t in range(steps):
        p = c + (t / (t + 3)) * (c - last)
        g = gradient(p) / weight
        g[:-1] += penalty / weight * p[:-1]
        last, c = c, p - rate * g
    return c


def curvature(view: View, b: Batch) -> float:
    """A quarter of the largest eigenvalue of the columns' mean square, by powers."""
    v = np.full(view.width, view.width**-0.5)
    for _ in range(15):
        v = view.sums(b, view.score(b, v))
        v /= np.linalg.norm(v) + 1e-12
    return 0.25 * 1.05 * float(v @ view.sums(b, view.score(b, v))) / max(1, len(b))


def platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of y on the columns of z."""
    x = np.column_stack([z, np.ones(len(z))])
    curve = 0.25 * 1.05 * float(np.linalg.eigvalsh(x.T @ x)[-1]) / len(x)
    return descend(np.zeros(x.shape[1]), lambda c: (sigmoid(x @ c) - y) @ x, len(x), curve, 300, 0.1)


@dataclass
class Property:
    """Coefficients of a property's views, of their calibration and of the weighing."""

    coef: list[np.ndarray]
    calibration: list[np.ndarray]
    stack: np.ndarray

    def probability(self, z: list[np.ndarray]) -> np.ndarray:
        both = [a * x + b for x, (a, b) in zip(z, self.calibration, strict=True)]
        return sigmoid(both[0] * self.stack[0] + both[1] * self.stack[1] + self.stack[2])


def sample(labels: DataFrame, labelled: int) -> DataFrame:
    """(doc_id, low, toxic, hold): at most ``labelled`` documents; a quarter is held out for calibration."""
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).cast("int").alias("low"), F.max("toxic").cast("int").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(labelled)
    return saved(chosen.withColumn("hold", F.pmod(F.xxhash64("doc_id", F.lit(19)), F.lit(4)) == 0))


def telling_words(docs: DataFrame, chosen: DataFrame, most: int) -> np.ndarray:
    """Sorted hashes of the words that tell a property best in the sample, by squared standardised difference of document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "text"):
            w = W.split(b.column("text"), True, W.ALNUM)
            h, owner = _distinct(W.hash_words(w), w.text_of)
            yield pa.RecordBatch.from_arrays([W.signed(h), *(b.column(c).take(pa.array(owner)) for c in ("low", "toxic"))], ["word", "low", "toxic"])

    train = chosen.where("not hold")
    n, low, toxic = train.agg(F.count("*"), F.coalesce(F.sum("low"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    words = _rows(docs).join(F.broadcast(train), "doc_id").select("text", "low", "toxic").mapInArrow(run, "word long, low int, toxic int")  # train has at most ``labelled`` rows
    words = saved(words.groupBy("word").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).where("n > 2"))
    out: set[int] = set()
    for c, positive in (("low", low), ("toxic", toxic)):
        p = max(positive / max(1, n), 1e-6)
        z = (F.col(c) - F.col("n") * p) ** 2 / (F.col("n") * p * max(1 - p, 1e-6))
        out.update(r[0] for r in words.orderBy(z.desc(), "word").limit(most).select("word").collect())
    return np.sort(np.array(sorted(out), np.int64).view(W.U))


def featured(docs: DataFrame, chosen: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """FEATURES of every row of docs; known: it belongs to the sample."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        sieve = np.zeros(1 << 16, bool)
        sieve[(vocabulary >> W.U(48)).astype(np.int64)] = True
        for b in W.pieces(batches, "text"):
            w = W.split(b.column("text"))
            dense = np.hstack([_content(w, W.hash_words(w)), _layout(b, w)]).astype(np.float32)
            slots = np.stack([_slots(b.column(c)) for c in ("source", "lang")], 1)
            w = W.split(b.column("text"), True, W.ALNUM)
            h, owner = W.hash_words(w), w.text_of
            some = sieve[(h >> W.U(48)).astype(np.int64)]
            h, owner = h[some], owner[some]
            at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
            ok = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
            ids, owner = _distinct(at[ok], owner[ok])
            cells = np.hstack([dense.view(np.uint8).reshape(len(b), -1), slots])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "low", "toxic", "known", "hold")), _lists(cells.reshape(-1), np.repeat(np.arange(len(b)), cells.shape[1]), len(b)), _lists(ids.astype(np.uint16), owner, len(b))], FEATURES.replace(",", "").split()[::2])

    marked = _rows(docs).join(F.broadcast(chosen), "doc_id", "left")  # at most ``labelled`` rows
    return saved(marked.withColumn("known", F.col("hold").isNotNull()).mapInArrow(run, FEATURES))


def _thresholds(bins: np.ndarray, share: float, prior: float) -> tuple[float, float, int]:
    """Scores from which on, and up to which, documents are pseudo-labelled, in the classes' proportions; how many these are."""
    edges, total = np.linspace(-REACH, REACH, len(bins) + 1), bins.sum()
    above, below = np.append(np.cumsum(bins[::-1])[::-1], 0), np.append(0, np.cumsum(bins))
    up = max(SURE, float(edges[np.argmax(above <= total * share * prior)]))
    down = min(-SURE, float(edges[len(bins) - np.argmax(below[::-1] <= total * share * (1 - prior))]))
    return up, down, int(above[np.searchsorted(edges, up)] + below[np.searchsorted(edges, down)])


def cotrained(table: DataFrame, words: int, rounds: int, steps: int) -> tuple[list[View], list[Property | float]]:
    """The views and the model of each property, from featured().  With one class only, its share is the constant probability."""
    spark = table.sparkSession
    got = table.where("known").select("doc_id", "low", "toxic", "hold", "dense", "words").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()  # the sample
    known, hold = Batch(got["dense"], got["words"]), got["hold"].to_numpy().astype(bool)
    ys = [got[c].to_numpy().astype(float) for c in ("low", "toxic")]
    train = ~hold
    if any(min(len(np.unique(y[train])), len(np.unique(y[hold]))) < len(np.unique(y)) for y in ys):
        train = hold = np.ones(len(known), bool)
    mine = known.only(train)
    stat = lambda f, cut: f(mine.dense[:, cut], 0) if len(mine) else np.zeros(mine.dense[:, cut].shape[1])
    views = [View(kind, words, stat(np.mean, cut), stat(np.std, cut) + 1e-3) for kind, cut in (("text", slice(0, CONTENT)), ("metadata", slice(CONTENT, None)))]
    learned = [p for p, y in enumerate(ys) if len(y) >= 20 and 0 < y.mean() < 1]
    if not learned:
        return views, [float(y.mean()) if len(y) else 0.0 for y in ys]
    curves, held = [curvature(v, mine) for v in views], known.only(hold)
    of_labels = lambda p, k: lambda c: views[k].sums(mine, sigmoid(views[k].score(mine, c)) - ys[p][train])
    pairs = [(p, k) for p in learned for k in (0, 1)]
    coef = {(p, k): descend(np.zeros(views[k].width), of_labels(p, k), len(mine), curves[k], 150) for p, k in pairs}

    def over(work: Callable[[Batch], np.ndarray]) -> np.ndarray:
        """The sum of work() over all documents outside the sample."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if len(b):
                    got = work(Batch(b.column("dense"), b.column("words")))
                    total = got if total is None else total + got
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "v"])

        sums = table.where("not known").select("dense", "words").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(int(sums["at"].to_numpy().max()) + 1 if len(sums) else 0)
        out[sums["at"].to_numpy()] = sums["v"].to_numpy()
        return out

    def padded(x: np.ndarray, n: int) -> np.ndarray:
        return np.pad(x, (0, n - len(x)))

    for r in range(1, rounds):
        now = dict(coef)
        bins = padded(over(lambda b, now=now: np.concatenate([np.bincount(np.clip((views[k].score(b, now[p, k]) + REACH) * (BINS / 2 / REACH), 0, BINS - 1).astype(np.int64), minlength=BINS) for p, k in pairs]).astype(float)), BINS * len(pairs)).reshape(len(pairs), BINS)
        if not bins.any():
            break
        limits = {(p, k): _thresholds(x, r / rounds / 2, float(ys[p][train].mean())) for (p, k), x in zip(pairs, bins, strict=True)}
        # all pseudo-labels of a view weigh at most PSEUDO times as much as the labels
        weight = {(p, k): PSEUDO * min(1.0, len(mine) / max(1, limits[p, 1 - k][2])) for p, k in pairs}
        at = np.concatenate([[0], np.cumsum([views[k].width for _, k in pairs])])

        def gradients(points: dict, now=now, limits=limits, weight=weight, at=at) -> dict:
            def work(b: Batch) -> np.ndarray:
                out = []
                for p, k in pairs:
                    teacher, (up, down, _) = views[1 - k].score(b, now[p, 1 - k]), limits[p, 1 - k]
                    yes = teacher >= up
                    some = yes | (teacher <= down)
                    part = b.only(some)
                    out.append(weight[p, k] * views[k].sums(part, sigmoid(views[k].score(part, points[p, k])) - yes[some]))
                return np.concatenate(out)

            sums = padded(over(work), at[-1])
            return {key: sums[at[i] : at[i + 1]] for i, key in enumerate(pairs)}

        last, mass = dict(coef), {(p, k): len(mine) + weight[p, k] * limits[p, 1 - k][2] for p, k in pairs}
        for t in range(steps):
            point = {key: coef[key] + (t / (t + 3)) * (coef[key] - last[key]) for key in pairs}
            theirs = gradients(point)
            for p, k in pairs:
                # pseudo-labelled documents may differ from the labelled ones, whose curvature is known
                one = lambda c, p=p, k=k: of_labels(p, k)(c) + theirs[p, k]
                last[p, k], coef[p, k] = coef[p, k], descend(point[p, k], one, mass[p, k], 1.5 * curves[k], 1)

    out: list[Property | float] = [float(y.mean()) for y in ys]
    for p in learned:
        y, z = ys[p][hold], [v.score(held, coef[p, k]) for k, v in enumerate(views)]
        calibration = [platt(x[:, None], y) for x in z]
        out[p] = Property([coef[p, 0], coef[p, 1]], calibration, platt(np.stack([a * x + b for x, (a, b) in zip(z, calibration, strict=True)], 1), y))
    return views, out


def scored(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, vocabulary: int = VOCABULARY, rounds: int = ROUNDS, steps: int = STEPS, reject: float = REJECT) -> DataFrame:
    """(doc_id, low_quality, toxic, accepted) for every row of docs(doc_id, text, [source, lang, n_chars], ...).

    labels(doc_id, quality, toxic): rows with nulls are left out, contradicting rows count as the worse, those of documents that docs doesn't
    have count for nothing. Null texts count as empty, null metadata as a value of its own.  Without labels of both classes a property has a
    constant probability.  Repeated rows are scored alike.  No rows give no rows.
    """
    chosen = sample(labels, labelled)
    words = telling_words(docs, chosen, vocabulary)
    table = featured(docs, chosen, words)
    sent = docs.sparkSession.sparkContext.broadcast(cotrained(table, len(words), rounds, steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, models = sent.value
        for b in batches:
            x = Batch(b.column("dense"), b.column("words"))
            p = [np.full(len(b), m) if isinstance(m, float) else m.probability([v.score(x, c) for v, c in zip(views, m.coef, strict=True)]) for m in models]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(q.astype(float)) for q in p), pa.array((p[0] < reject) & (p[1] < reject))], ["doc_id", "low_quality", "toxic", "accepted"])

    return table.select("doc_id", "dense", "words").mapInArrow(run, "doc_id long, low_quality double, toxic double, accepted boolean")


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rejected ones; all columns.  doc_id should be unique: all rows of one go if one of them is rejected; null doc_ids stay."""
    return without(docs, scored(docs, labels, **options).where("not accepted and doc_id is not null").select("doc_id").distinct(), "doc_id")
