"""Quality rules with risk-controlled thresholds.

Each rule compares one measure of a text with a cutoff.  Cutoffs are learned for each stratum (language)
on labelled good documents, of which all rules together shall reject fewer than ``risk``; documents that fail
the base rule are decided already and don't count.  The rules are tightened one grid value at a time along a
path from "reject nothing" on.  At every step an exact binomial test of the good documents rejected by any rule
so far must show a rate below ``risk`` at level ``delta`` / strata; the first step that fails ends the path
(fixed sequence, so the level is not divided by its steps).  The path must not depend on the good documents:
it comes from the documents labelled otherwise and the unlabelled ones, and takes next the cutoffs that reject the
most bad documents for each unlabelled one.  Where the first step fails, nothing is rejected in that
stratum: it takes ``least_labels`` good documents to show anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features as X
from . import words as W
from .store import saved

RISK, DELTA = 0.01, 0.05
#: Rule: SQL expression of what grows with badness, grid of cutoffs.  A text is rejected above the cutoff.
RULES = {
    "symbols": ("n_symbols / n_words", tuple(i / 100 for i in range(2, 102, 2))),
    "repeats": ("n_repeat_words / n_words", tuple(i / 100 for i in range(2, 102, 2))),
    "lines": ("n_dup_lines / n_lines", tuple(i / 100 for i in range(2, 102, 2))),
    "long_words": ("word_chars / n_words", tuple(i / 2 for i in range(8, 60))),
    "short_words": ("-word_chars / n_words", tuple(-i / 4 for i in range(4, 20))),
}


def measured(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *extra, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) of every row of docs(doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "text"):
            w = W.split(b.column("text"))
            dup, n_lines = X.duplicate_lines(w)
            cols = [w.counts, X.word_chars(w), X.per_text(w, np.flatnonzero(X.SYMBOLS[w.buf])), dup, n_lines, X.repeat_words(w, W.hash_words(w))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in extra), *(pa.array(c.astype(np.int64)) for c in cols)], names)

    names = ["doc_id", *extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    kinds = ["doc_id long", *(f"{c} string" for c in extra), *(f"{c} long" for c in names[1 + len(extra) :])]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in extra), "text").mapInArrow(run, ", ".join(kinds))


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p): the exact sum over the tail that k lies in, outwards until terms no longer count."""
    if k >= n:
        return 1.0
    low = k < n * p
    first = k if low else k + 1
    term = exp(lgamma(n + 1) - lgamma(first + 1) - lgamma(n - first + 1) + first * log(p) + (n - first) * log(1 - p))
    total, i = term, first
    while term > total * 1e-18 and (i > 0 if low else i < n):
        term *= i * (1 - p) / ((n - i + 1) * p) if low else (n - i) * p / ((i + 1) * (1 - p))
        i += -1 if low else 1
        total += term
    return min(1.0, total) if low else max(0.0, 1 - total)


def rule_values() -> list:
    guard = {"n_lines": "greatest(n_lines, 1)", "n_words": "greatest(n_words, 1)"}
    return [F.expr(e.replace("/ n_words", f"/ {guard['n_words']}").replace("/ n_lines", f"/ {guard['n_lines']}")).alias(k) for k, (e, _) in RULES.items()]


def least_labels(strata: int, risk: float = RISK, delta: float = DELTA) -> int:
    """The good documents of a stratum from which on a step that rejects none of them passes."""
    return ceil(log(delta / max(1, strata)) / log(1 - risk))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def path(bad: list[np.ndarray], free: list[np.ndarray], risk: float = RISK) -> list[tuple[int, int]]:
    """The order (rule, place of the cutoff in its grid) in which rules are tightened.

    bad, free: for each rule, the bad and unlabelled documents in each cell.  Next comes the rule with the stretch of
    cutoffs that adds most bad documents for each unlabelled one, and of equal ones fewest unlabelled; the mildest first.
    A share risk of the unlabelled ones is added to each stretch, so that a few chance documents don't put it first.
    """
    tails = [[np.append(np.cumsum(x[::-1])[::-1], 0)[1:] for x in both] for both in zip(bad, free, strict=True)]
    at, out, chance = [len(b) - 1 for b in bad], [], max(1.0, risk * float(free[0].sum()))
    while any(at):
        gains = [((b[i] - b[at[k]]) / (f[i] - f[at[k]] + chance), -(f[i] - f[at[k]]), i, -k) for k, (b, f) in enumerate(tails) for i in range(at[k])]
        _, _, i, k = max(gains)
        out += [(-k, j) for j in range(at[-k] - 1, i - 1, -1)]
        at[-k] = i
    return out


def cutoffs(rows: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, tested, rejected): the certified cutoffs; tested and rejected (by all rules) are those of the stratum.

    rows: measured(); labels(doc_id, good): each document once.  Counts go by stratum, rule and grid cell, then
    by stratum and place on the path, so what is gathered grows with the strata only.
    """
    names, grids = list(RULES), [np.sort(g) for _, g in RULES.values()]
    grid = F.array(*(F.array(*map(F.lit, map(float, g))) for g in grids))
    values = F.array(*(F.col(k).cast("double") for k in RULES))
    strata = rows.select(F.coalesce(F.col(stratum), F.lit("")).alias("stratum")).agg(F.countDistinct("stratum")).first()[0]
    level = delta / max(1, strata)
    # cell of a value: how many grid values it exceeds
    cells = rows.where(~base_failed()).select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), *rule_values())
    cells = cells.select("doc_id", "stratum", F.zip_with(values, grid, lambda v, g: F.size(F.filter(g, lambda x: x < v))).alias("cells"))
    cells = saved(cells.join(labels, "doc_id", "left"))
    others = cells.where("good is null or not good").select("stratum", F.col("good").isNotNull().alias("bad"), F.posexplode("cells").alias("rule", "cell"))
    others = others.groupBy("stratum", "bad", "rule", "cell").agg(F.count("*").alias("n"))
    others = cells.select("stratum").distinct().join(others, "stratum", "left")

    def ordered(key, cell: pd.DataFrame) -> pd.DataFrame:
        at = [np.zeros((2, len(g) + 1), dtype=np.int64) for g in grids]
        for r in cell.dropna().itertuples():
            at[int(r.rule)][int(r.bad), int(r.cell)] = r.n
        steps = path([x[1] for x in at], [x[0] for x in at], risk)
        # a document of cell c is rejected from the step of cutoff c - 1 on, of cell 0 never
        places = [[len(steps)] * (len(g) + 1) for g in grids]
        for place, (k, i) in enumerate(steps):
            places[k][i + 1] = place
        return pd.DataFrame([(key[0], places)], columns=["stratum", "places"])

    paths = saved(others.groupBy("stratum").applyInPandas(ordered, "stratum string, places array<array<int>>"))
    first = F.array_min(F.zip_with("cells", "places", lambda c, p: F.get(p, c)))
    tested = cells.where("good").join(paths, "stratum").groupBy("stratum", first.alias("place")).agg(F.count("*").alias("n"))

    def choose(key, found: pd.DataFrame) -> pd.DataFrame:
        places = [list(p) for p in found["places"].iloc[0]]
        at = {int(p): (k, c - 1) for k, rule in enumerate(places) for c, p in enumerate(rule) if c}
        at_place = dict(zip(found["place"], found["n"], strict=True))
        n, rejected, best, last = int(found["n"].sum()), 0, {}, None
        for place in range(len(at)):
            k = rejected + int(at_place.get(place, 0))
            if k != last and at_most(k, n, risk) > level:
                break
            rejected = last = k
            best[at[place][0]] = float(grids[at[place][0]][at[place][1]])
        return pd.DataFrame([(key[0], names[k], c, n, rejected) for k, c in sorted(best.items())], columns=["stratum", "rule", "cutoff", "tested", "rejected"])

    return tested.join(paths, "stratum").groupBy("stratum").applyInPandas(choose, "stratum string, rule string, cutoff double, tested long, rejected long")


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row of docs(doc_id, text, stratum, ...).

    labels(doc_id, quality, ...): documents with quality 1 (in all of their rows) are the good ones; nulls don't count, and
    unlabelled documents only order the cutoffs.  A null stratum counts with the empty one.  Null or empty texts have no words, so they fail the
    base rule.  Repeated rows are judged alike.  base_failed: fewer than 20 words or over 30 % repeated words.
    """
    rows = saved(measured(docs, (stratum,)))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    table = cutoffs(rows, known, stratum, risk, delta).groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == k, F.col("cutoff"))).alias(f"__{k}") for k in RULES)).withColumnRenamed("stratum", "__stratum")
    both = rows.select("*", *(v.alias(f"__v_{k}") for k, v in zip(RULES, rule_values(), strict=True))).join(saved(table), F.coalesce(F.col(stratum), F.lit("")) == F.col("__stratum"), "left")
    bad = [F.coalesce(F.col(f"__v_{k}") > F.col(f"__{k}"), F.lit(False)) for k in RULES]
    failed = base_failed()
    rejected = bad[0]
    for x in bad[1:]:
        rejected = rejected | x
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
