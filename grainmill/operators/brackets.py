"""Weighted quantiles of many columns at once, by bisection over the rows as they are: no row is multiplied, sorted across tasks or shuffled.

A target is a rank in the running weight of a column, over all rows or those of one group. Each pass reads the rows once and counts the weight
in ``BINS`` parts of every target's interval of values; the part that holds the rank becomes the interval, shrunk to the values seen in it. When all
intervals are single values, one more pass takes the rows beside them, which the interpolation needs. The driver holds a few numbers per target.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 128
MAX_PASSES = 100


@dataclass
class Target:
    """The rank ``p`` in a column's running weight; of one group, where every row weighs 1, or of all rows (group -1) by their weights."""

    group: int
    column: int
    p: float
    low: float = 0.0
    high: float = 0.0
    below: float = 0.0  # weight of the values below ``low``
    total: float = 0.0

    @property
    def rank(self) -> float:
        return self.p * self.total


@dataclass
class Found:
    """The value at a target's rank, its neighbours, and the mid-point positions of the rows at their borders."""

    before: tuple[float, float] | None  # position and value of the last row below the value
    first: tuple[float, float]
    last: tuple[float, float]
    after: tuple[float, float] | None
    rank: float

    def value(self, transform=lambda x: x) -> float:
        """Interpolated between the two rows around the rank, after ``transform`` (monotone); the end rows' values beyond them."""
        points = [(p, transform(x)) for p, x in filter(None, (self.before, self.first, self.last, self.after))]
        return float(np.interp(self.rank, *zip(*points)))


def _columns(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Groups, keys, weights and values of one batch, ordered by group."""
    g = b.column(0).to_numpy(zero_copy_only=False)
    order = np.argsort(g, kind="stable")
    return g[order], b.column(1).to_numpy(zero_copy_only=False)[order], b.column(2).to_numpy(zero_copy_only=False)[order], [b.column(3 + i).to_numpy(zero_copy_only=False)[order] for i in range(k)]


def _cells(targets: list[Target]) -> dict[tuple[int, int], list[int]]:
    out: dict[tuple[int, int], list[int]] = {}
    for i, t in enumerate(targets):
        out.setdefault((t.group, t.column), []).append(i)
    return out


def _rows_of(g: np.ndarray, x: list[np.ndarray], w: np.ndarray, cell: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, weights and positions of a cell's rows in a batch, without NULLs."""
    group, column = cell
    at = slice(0, len(g)) if group < 0 else slice(*np.searchsorted(g, [group, group + 1]))
    v = x[column][at]
    ok = np.flatnonzero(~np.isnan(v))
    return v[ok], w[at][ok] if group < 0 else np.ones(len(ok)), ok + at.start


def search(rows: DataFrame, columns: list[str], wanted: list[tuple[int, int, float]]) -> dict[tuple[int, int, float], Found]:
    """Found targets by (group, column, p); those without any row are missing.

    ``rows``: g int, k bigint (unique; ties of equal values are ordered by it), w double (positive), and ``columns``, doubles without NaN.
    """
    k = len(columns)
    narrow = rows.select(F.col("g").cast("int"), F.col("k").cast("bigint"), F.col("w").cast("double"), *[F.col(c).cast("double") for c in columns])
    ends: dict[tuple[int, int], list] = {}
    sides = [F.struct(F.min(c).alias("a"), F.max(c).alias("b"), F.sum(F.when(F.col(c).isNotNull(), F.col("w"))).alias("w"), F.count(c).alias("n")).alias(f"s{i}") for i, c in enumerate(columns)]
    for r in narrow.groupBy("g").agg(*sides).collect():  # a row per group
        for i in range(k):
            s = r[f"s{i}"]
            if s.n:
                ends[r.g, i] = [s.a, s.b, float(s.n)]
                e = ends.setdefault((-1, i), [s.a, s.b, 0.0])
                ends[-1, i] = [min(e[0], s.a), max(e[1], s.b), e[2] + s.w]
    targets = [Target(g, c, p, ends[g, c][0], ends[g, c][1], 0.0, ends[g, c][2]) for g, c, p in wanted if (g, c) in ends]
    for _ in range(MAX_PASSES):
        open_ = [t for t in targets if t.low < t.high]
        if not open_:
            break
        _narrow(narrow, k, open_)
    else:
        raise RuntimeError("quantiles did not converge")
    return _neighbours(narrow, k, targets)


def _narrow(rows: DataFrame, k: int, targets: list[Target]) -> None:
    """One pass: every target's interval becomes the part that holds its rank. Targets that share an interval share its counts."""
    spans = sorted({(t.group, t.column, t.low, t.high) for t in targets})
    edges = [np.linspace(lo, hi, BINS + 1) for _, _, lo, hi in spans]
    cells: dict[tuple[int, int], list[int]] = {}
    for i, (g, c, _, _) in enumerate(spans):
        cells.setdefault((g, c), []).append(i)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros((len(spans), BINS))
        least, most = np.full((len(spans), BINS), np.inf), np.full((len(spans), BINS), -np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            g, _, w, x = _columns(b, k)
            for cell, members in cells.items():
                v, u, _ = _rows_of(g, x, w, cell)
                order = np.argsort(v)
                v, running = v[order], np.r_[0.0, np.cumsum(u[order])]
                for i in members if len(v) else ():
                    at = np.searchsorted(v, edges[i], "left")
                    at[-1] = np.searchsorted(v, edges[i][-1], "right")  # the last part holds the upper end
                    weight[i] += np.diff(running[at])
                    full = np.flatnonzero(np.diff(at))
                    least[i, full] = np.minimum(least[i, full], v[at[full]])
                    most[i, full] = np.maximum(most[i, full], v[at[full + 1] - 1])
        i, j = np.nonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, j, weight[i, j], least[i, j], most[i, j])], ["i", "j", "w", "a", "b"])

    got = rows.mapInArrow(count, "i bigint, j bigint, w double, a double, b double").groupBy("i", "j").agg(F.sum("w").alias("w"), F.min("a").alias("a"), F.max("b").alias("b"))
    parts: dict[int, list] = {}
    for r in sorted(got.collect()):
        parts.setdefault(r.i, []).append(r)
    number = {s: i for i, s in enumerate(spans)}
    for t in targets:
        mine = parts[number[t.group, t.column, t.low, t.high]]
        for r in mine:
            if t.below + r.w >= t.rank or r is mine[-1]:
                t.low, t.high = r.a, r.b
                break
            t.below += r.w


_SIDES = ("before", "first", "last", "after")


def _neighbours(rows: DataFrame, k: int, targets: list[Target]) -> dict[tuple[int, int, float], Found]:
    cells = _cells(targets)
    values = [t.low for t in targets]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, str], tuple[float, int, float]] = {}
        same = np.zeros(len(values))

        def take(i: int, side: str, v: np.ndarray, key: np.ndarray, u: np.ndarray, biggest: bool) -> None:
            at = np.lexsort((key, v))[-1 if biggest else 0]
            row, old = (float(v[at]), int(key[at]), float(u[at])), seen.get((i, side))
            if old is None or (row[:2] > old[:2]) == biggest:
                seen[i, side] = row

        for b in batches:
            if not b.num_rows:
                continue
            g, key, w, x = _columns(b, k)
            for cell, members in cells.items():
                v, u, at = _rows_of(g, x, w, cell)
                for i in members:
                    for side, mask, biggest in (("before", v < values[i], True), ("first", v == values[i], False), ("last", v == values[i], True), ("after", v > values[i], False)):
                        if mask.any():
                            if side in ("before", "after"):  # only the nearest value's rows
                                near = v[mask].max() if biggest else v[mask].min()
                                mask = v == near
                            take(i, side, v[mask], key[at[mask]], u[mask], biggest)
                    same[i] += u[v == values[i]].sum()
        out = [(i, s, *row) for (i, s), row in seen.items()] + [(i, "same", 0.0, 0, float(x)) for i, x in enumerate(same) if x]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.float64()))], ["i", "side", "x", "k", "w"])

    every = rows.mapInArrow(look, "i bigint, side string, x double, k bigint, w double")
    row = F.struct("x", "k", "w")
    got: dict[tuple[int, str], tuple[float, float]] = {}
    for r in every.groupBy("i", "side").agg(F.max(row).alias("most"), F.min(row).alias("least"), F.sum("w").alias("w")).collect():
        one = r.most if r.side in ("before", "last") else r.least
        got[r.i, r.side] = (r.w, 0.0) if r.side == "same" else (one.x, one.w)
    out = {}
    for i, t in enumerate(targets):
        side = {s: got.get((i, s)) for s in _SIDES}
        through = t.below + got[i, "same"][0]
        at = {"before": t.below - (side["before"] or (0, 0))[1] / 2, "first": t.below + side["first"][1] / 2, "last": through - side["last"][1] / 2, "after": through + (side["after"] or (0, 0))[1] / 2}
        out[t.group, t.column, t.p] = Found(*[(at[s], side[s][0]) if side[s] else None for s in _SIDES], t.rank)
    return out
