"""Stencils and level plans by lattice arithmetic.

The parities of a cell's coordinates, one bit an axis, are a vector over two elements.  A stencil keeps the cells of a
linear subspace K of these vectors and predicts those of a coset K + v from them.  A plan is a chain of
such halvings: when K has no odd element on an axis, that axis' stride doubles.  So the step at which a cell is
predicted follows from its coordinates alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of the cells above which the coarsest ones are stored as they are.
PIVOT_RATIO = 1 << 17


@dataclass(frozen=True)
class Stencil:
    """known: parity vectors (as integers, axis 0 lowest) that stay; targets: the coset that is predicted."""

    ndim: int
    known: tuple[int, ...]
    targets: tuple[int, ...]

    def offsets(self, least: int = 1) -> list[tuple[int, ...]]:
        """Neighbours of a target among the known cells one step away: those over the fewest axes that make ``least``."""
        near = [o for o in product((-1, 0, 1), repeat=self.ndim) if sum((abs(x) & 1) << k for k, x in enumerate(o)) in self.targets]
        for radius in range(1, self.ndim + 1):
            some = [o for o in near if sum(map(abs, o)) <= radius]
            if len(some) >= least:
                return some
        return near


@cache
def subspaces(ndim: int) -> tuple[tuple[int, ...], ...]:
    """All linear subspaces, each as its sorted vectors."""
    found, todo = {(0,)}, [(0,)]
    while todo:
        s = todo.pop()
        for v in range(1 << ndim):
            if v not in s and (t := tuple(sorted({*s, *(x ^ v for x in s)}))) not in found:
                found.add(t)
                todo.append(t)
    return tuple(sorted(found, key=lambda s: (-len(s), s)))


@cache
def catalog(ndim: int) -> tuple[Stencil, ...]:
    """Every coset of every proper subspace: 1, 6, 35 and 240 stencils in one to four dimensions; those with most targets first."""
    out = []
    for k in subspaces(ndim):
        if len(k) < 1 << ndim:
            cosets = {tuple(sorted(x ^ v for x in k)) for v in range(1 << ndim) if v not in k}
            out += [Stencil(ndim, k, c) for c in sorted(cosets)]
    return tuple(out)


def catalog_table(spark: SparkSession, ndims: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """(ndim, id, n_targets, known, targets, n_neighbours): the catalogue, 282 rows for up to four dimensions."""
    rows = [(n, i, len(s.targets), list(s.known), list(s.targets), len(s.offsets())) for n in ndims for i, s in enumerate(catalog(n))]
    return spark.createDataFrame(rows, "ndim int, id int, n_targets int, known array<int>, targets array<int>, n_neighbours int")


@dataclass(frozen=True)
class Step:
    """One halving: a stencil at a stride for each axis."""

    stride: tuple[int, ...]
    stencil: Stencil

    def parity(self) -> Column:
        p = F.lit(0)
        for k, s in enumerate(self.stride):
            p = p + F.expr(f"cast((i{k} div {s}) % 2 as int) * {1 << k}")
        return p

    def on_grid(self) -> Column:
        ok = F.lit(True)
        for k, s in enumerate(self.stride):
            ok = ok & (F.col(f"i{k}") % s == 0)
        return ok

    def is_target(self) -> Column:
        return self.on_grid() & self.parity().isin(list(self.stencil.targets))

    def is_known(self) -> Column:
        return self.on_grid() & self.parity().isin(list(self.stencil.known))

    def shape(self, whole: Sequence[int]) -> list[int]:
        return [-(-d // s) for d, s in zip(whole, self.stride, strict=True)]


@dataclass(frozen=True)
class State:
    """What is known: the stride of each axis and the subspace of parities at that stride."""

    stride: tuple[int, ...]
    space: tuple[int, ...]

    def after(self, s: Stencil) -> State:
        stride, space = list(self.stride), s.known
        for k in range(len(stride)):
            if not any(v >> k & 1 for v in space):
                stride[k] *= 2
                space = tuple(sorted({*space, *(v ^ (1 << k) for v in space)}))
        return State(tuple(stride), space)


def start(ndim: int) -> State:
    return State((1,) * ndim, tuple(range(1 << ndim)))


def eligible(state: State, shape: Sequence[int]) -> list[int]:
    """Catalogue places of the stencils that halve what is known and have a target inside the array."""
    ndim, out = len(shape), []
    for i, s in enumerate(catalog(ndim)):
        whole = tuple(sorted((*s.known, *s.targets)))
        inside = any(all(not (t >> k & 1) or state.stride[k] < shape[k] for k in range(ndim)) for t in s.targets)
        if whole == state.space and inside:
            out.append(i)
    return out


def halvings(shape: Sequence[int]) -> int:
    return sum((d - 1).bit_length() for d in shape)


def axis_plan(shape: Sequence[int], steps: int | None = None) -> list[Step]:
    """The plan that halves the axes in turn, the last first."""
    ndim, state, out = len(shape), start(len(shape)), []
    full = tuple(range(1 << ndim))
    for _ in range(halvings(shape) if steps is None else min(steps, halvings(shape))):
        k = min((k for k in range(ndim) if state.stride[k] < shape[k]), key=lambda k: (state.stride[k], -k))
        known = tuple(v for v in full if not v >> k & 1)
        s = next(s for s in catalog(ndim) if s.known == known)
        out.append(Step(state.stride, s))
        state = state.after(s)
    return out


def plan_table(spark: SparkSession, plan: Sequence[Step], shape: Sequence[int]) -> DataFrame:
    """(step, shape, stencil), finest first."""
    ids = {s: i for i, s in enumerate(catalog(len(shape)))}
    return spark.createDataFrame([(k, p.shape(shape), ids[p.stencil]) for k, p in enumerate(plan)], "step int, shape array<int>, stencil int")


def level(plan: Sequence[Step]) -> Column:
    """The step, from 0, at which a cell is predicted; the number of steps for those that are stored."""
    out = F.lit(len(plan))
    for k in range(len(plan) - 1, -1, -1):
        out = F.when(plan[k].is_target(), F.lit(k)).otherwise(out)
    return out


def pivot_level(plan: Sequence[Step], shape: Sequence[int], ratio: int = PIVOT_RATIO) -> int:
    """The first step that isn't predicted: from it on fewer than cells / ratio are left, which are stored."""
    total = 1
    for d in shape:
        total *= d
    left, k = total, 0
    while k < len(plan) and left * ratio >= total:
        left, k = (left + 1) // 2, k + 1
    return k
