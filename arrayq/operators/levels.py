"""Levels that the values of an array gather around, as an arithmetic progression.

The values are summed by cells of a grid over their range, whose number does not grow with the data.  On these sums
the best division into k intervals is found exactly for k = 1, 2, .. by dynamic programming.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS, MOST, JUMP = 1024, 150, 1.5


def cells(df: DataFrame, x: str = "x", grid: int = CELLS) -> DataFrame:
    """(cell, n, s, q): count, sum and sum of squares of the values in each used cell of the grid; at most grid + 1 rows."""
    v = F.col(x).cast("double")
    r = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("r")).scalar()
    cell = F.when(r["hi"] > r["lo"], F.floor((v - r["lo"]) / (r["hi"] - r["lo"]) * grid)).otherwise(F.lit(0)).cast("int")
    return df.where(v.isNotNull()).select(cell.alias("cell"), v.alias("v")).groupBy("cell").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))


def divisions(n: np.ndarray, s: np.ndarray, q: np.ndarray, most: int):
    """For k = 1, 2, .. the least sum of squared distances to the means of k intervals, and these means."""
    m = len(n)
    cn, cs, cq = (np.concatenate([[0.0], np.cumsum(v)]) for v in (n, s, q))
    i, j = np.arange(m)[:, None], np.arange(1, m + 1)[None, :]
    cost = np.where(j > i, np.maximum(0.0, cq[j] - cq[i] - (cs[j] - cs[i]) ** 2 / np.maximum(cn[j] - cn[i], 1.0)), np.inf)
    best, came = cost[0], []
    for k in range(1, min(most, m) + 1):
        ends = [m]
        for back in reversed(came):
            ends.append(int(back[ends[-1] - 1]))
        cut = np.array([0, *reversed(ends)])
        yield float(best[-1]), np.diff(cs[cut]) / np.diff(cn[cut])
        total = np.concatenate([[np.inf], best[:-1]])[:, None] + cost  # the last interval begins at cell i
        back = total.argmin(0)
        best = total[back, np.arange(m)]
        came.append(back)


def fitted(df: DataFrame, x: str = "x", grid: int = CELLS, most: int = MOST, jump: float = JUMP) -> DataFrame:
    """One row (start, step, levels) of the progression start + step * k, for 0 <= k < levels.

    Where the cost falls from k - 1 to k intervals by more than ``jump`` times the mean of the falls so far, k is a candidate;
    of the first candidates that follow each other, at most ``most``, the last is taken, and the progression drawn from its means.  Without
    candidates there are 0 levels and nulls.  Nulls in x are left out.
    """
    rows = cells(df, x, grid).orderBy("cell").toArrow()  # at most grid + 1 rows
    n, s, q = (rows[c].to_numpy().astype(float) for c in ("n", "s", "q"))
    out, schema = (None, None, 0), "start double, step double, levels int"
    if len(n) > 1:
        middle = s.sum() / n.sum()  # sums about the mean lose no digits to a large offset
        q, s = q - 2 * middle * s + middle**2 * n, s - middle * n
        found = list(divisions(n, s, q, most))
        cost = np.array([c for c, _ in found]) + 1e-9 * max(found[0][0], 1e-300)
        fall = cost[:-1] / cost[1:]
        steep = fall > jump * np.cumsum(fall) / np.arange(1, len(fall) + 1)
        if steep.any():
            first = int(steep.argmax())
            k = first + int(np.append(steep[first:], False).argmin()) + 1
            c = found[k - 1][1] + middle
            step = float(c[-1] - c[0]) / (k - 1)
            start = float(np.mean(c - step * np.arange(k)))
            top = df.agg(F.max(x)).first()[0]
            out = (start, step, int(round((top - start) / step)) + 1)
    return df.sparkSession.createDataFrame([out], schema)


def level_of(x: Column, start: float, step: float) -> Column:
    """Number of the nearest level."""
    return F.round((x - start) / step).cast("long")


def predicted(df: DataFrame, start: float, step: float, x: str = "x") -> DataFrame:
    """df with level and pred, the value of the nearest level."""
    k = level_of(F.col(x), start, step)
    return df.withColumn("level", k).withColumn("pred", F.col("level") * step + start)
