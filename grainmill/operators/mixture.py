"""Mixtures and losses: features, ridge and kernel models, grouped cross-validation, effects and ranking measures.

Kernel models solve the dense system of up to ``MAX_RECIPES`` recipes, and beyond that the one of the kernel's expansion in some of them; feature sums (Gram matrices), predictions and all that
compares recipes in pairs run on the executors for any number of recipes, the pairs in squares of two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.sources.shared import cut

MAX_RECIPES = 4096
BLOCK = 1024  #: recipes of a block, about
BINS = 4096  #: intervals that a quantile's bracket is cut into in one pass
SCALE = BINS * (1 - 1e-12)  #: so that the greatest value falls into the last interval
CELLS = 1 << 22  #: numbers of a matrix that are held at once
FIRST = 2048  #: recipes among which a kernel's centres are first looked for: so many from the edge, and from all over
TINY_SHARE = 1e-7  #: of the penalty, up to which the expansion of a kernel may differ
STRIP = 32  #: rows of a square of blocks that are handled at once


def validated_pairs(recipes: DataFrame, losses: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """(index, p, y) of the recipes (index, p array) and losses (index, y array): indexes unique on either side and the same on both, shares finite, not negative and
    summing to 1 within the tolerance, losses finite and positive, arrays of one length. Errors name up to ten bad indexes. Shares come out summing to 1."""
    ok_sum = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    broken = lambda a, low: F.coalesce(F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | low(x)), F.lit(True))
    left = recipes.groupBy("index").agg(F.count("*").alias("_n"), F.first("p").alias("p"))
    right = losses.groupBy("index").agg(F.count("*").alias("_m"), F.first("y").alias("y"))
    j = cut(left.join(right, "index", "full").withColumn("_s", ok_sum("p")))
    sizes = j.agg(F.max(F.size("p")).alias("p"), F.max(F.size("y")).alias("y")).first()
    tests = {
        "NULL index": F.col("index").isNull(), "repeated index": (F.col("_n") > 1) | (F.col("_m") > 1), "index of one side only": F.col("_n").isNull() | F.col("_m").isNull(),
        "invalid shares": broken("p", lambda x: x < 0) | (F.size("p") != sizes.p), "sums of shares": ~F.coalesce(F.abs(F.col("_s") - 1) <= tolerance, F.lit(False)), "invalid losses": broken("y", lambda x: x <= 0) | (F.size("y") != sizes.y),
    }
    for what, bad in tests.items():
        if found := j.where(bad).orderBy("index").limit(10).collect():
            raise ValueError(f"{what}: {[r['index'] for r in found]}")
    return j.select("index", F.transform("p", lambda x: x / F.col("_s")).alias("p"), "y")


def validate_pair(p: np.ndarray, y: np.ndarray, tolerance: float = 0.005) -> None:
    """Shares finite, non-negative and summing to 1 within the tolerance; losses finite and positive. Errors name the first bad rows."""
    bad = {"shares": ~np.isfinite(p).all(1) | (p < 0).any(1), "losses": ~np.isfinite(y).all(1) | (y <= 0).any(1), "sums": np.abs(p.sum(1) - 1) > tolerance}
    for what, rows in bad.items():
        if rows.any():
            raise ValueError(f"invalid {what} in rows {np.flatnonzero(rows)[:10].tolist()}")


def collect(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Array columns of a recipe table as matrices: the driver holds a recipe's numbers, eight bytes each."""
    got = df.select(*columns).toArrow()
    if not got.num_rows:
        return [np.zeros(0) for _ in columns]
    return [np.asarray(got[c].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(got.num_rows, -1) for c in columns]


def features(p: Column, d: int) -> Column:
    """The d shares and their d (d - 1) / 2 products."""
    return F.array(*[F.get(p, F.lit(i)) for i in range(d)], *[F.get(p, F.lit(i)) * F.get(p, F.lit(j)) for i in range(d) for j in range(i + 1, d)])


def expand(p: np.ndarray, quadratic: bool) -> np.ndarray:
    i, j = np.triu_indices(p.shape[1], 1)
    return np.hstack([p, p[:, i] * p[:, j]]) if quadratic else p


def gram(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """i, j, s: sums of x_i * x_j (and of x_i * y_j at j counted from -1 down), partial sums per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                a = np.array(b.column(0).to_pylist(), float)
                c = np.hstack([a, np.array(b.column(1).to_pylist(), float)]) if y else a
                total = a.T @ c + (0 if total is None else total)
        if total is not None:
            i, j = np.indices(total.shape)
            j = np.where(j < total.shape[0], j, total.shape[0] - 1 - j)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "s"])

    return df.select(x, *([y] if y else [])).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a) @ b


class Ridge:
    """Ridge without intercept on root-mean-square scaled features; products are penalised ``ratio`` times as much."""

    def __init__(self, p: np.ndarray, y: np.ndarray, lam: float, ratio: float = 1.0, quadratic: bool = False, extra: np.ndarray | None = None):
        x = expand(p, quadratic)
        self.quadratic = quadratic
        self.scale = np.sqrt((x * x).mean(0))
        self.scale[self.scale < 1e-12] = 1
        xs = x / self.scale
        pen = np.where(np.arange(x.shape[1]) < p.shape[1], 1.0, ratio)
        lhs = xs.T @ xs + lam * len(x) * np.diag(pen)
        if extra is not None:  # a prior on the linear block, given in unscaled coefficients
            d, s = p.shape[1], 1 / self.scale[: p.shape[1]]
            lhs[:d, :d] += len(x) * extra * np.outer(s, s)
        self.beta = solve(lhs, xs.T @ y)

    def predict(self, p: np.ndarray) -> np.ndarray:
        return expand(p, self.quadratic) / self.scale @ self.beta


def ridge_from_sums(gram_: np.ndarray, cross: np.ndarray, n: float, d: int, lam: float, ratio: float = 1.0, quadratic: bool = False) -> Ridge:
    """The ridge of ``Ridge`` from sums of feature products and of features with outputs alone, so for any number of recipes."""
    out = Ridge.__new__(Ridge)
    out.quadratic = quadratic
    out.scale = np.sqrt(np.diag(gram_) / max(n, 1))
    out.scale[out.scale < 1e-12] = 1
    pen = np.where(np.arange(len(gram_)) < d, 1.0, ratio)
    out.beta = solve(gram_ / np.outer(out.scale, out.scale) + lam * n * np.diag(pen), cross / out.scale[:, None])
    return out


def fit_distributed(df: DataFrame, d: int, lam: float, ratio: float, quadratic: bool) -> Ridge:
    """Ridge on recipes (p array, y array) of any number: one pass of partial sums."""
    x = features(F.col("p"), d) if quadratic else F.col("p")
    rows = gram(df.select(x.alias("x"), "y"), "x", "y").collect()  # features^2 numbers
    k = max((r.i for r in rows), default=-1) + 1
    g, c = np.zeros((k, k)), np.zeros((k, max((-r.j for r in rows), default=0)))
    for r in rows:
        if r.j >= 0:
            g[r.i, r.j] = r.s
        else:
            c[r.i, -1 - r.j] = r.s
    return ridge_from_sums(g, c, df.count(), d, lam, ratio, quadratic)


def anchor_prior(q: np.ndarray, known: np.ndarray, strength: float) -> np.ndarray:
    """Penalty on what linear coefficients of known domains have beyond a line in quality; needs three differing anchors."""
    if known.sum() < 3 or np.std(q[known]) < 1e-12:
        raise ValueError("a quality prior needs at least three differing anchors")
    b = np.column_stack([np.ones(known.sum()), q[known]])
    out = np.zeros((len(q), len(q)))
    out[np.ix_(known, known)] = strength * (np.eye(known.sum()) - b @ np.linalg.pinv(b))
    return out


class Kernel:
    """Kernel ridge around the mean with exp(-gamma * squared distance / median squared distance).

    Beyond ``MAX_RECIPES`` recipes the kernel is expanded in those at ``centres`` of them, to TINY_SHARE of the penalty for every recipe, and the ridge is solved in the
    expansion's terms: sums over all recipes, no matrix of all pairs.
    """

    def __init__(self, p: np.ndarray, y: np.ndarray, gamma: float, lam: float):
        self._set(*kernel_parts(p, y, gamma, [lam])[0])

    def _set(self, p: np.ndarray, gamma: float, width: float, mean: np.ndarray, alpha: np.ndarray) -> Kernel:
        self.p, self.gamma, self.width, self.mean, self.alpha = p, gamma, width, mean, alpha
        return self

    def predict(self, p: np.ndarray) -> np.ndarray:
        step = max(1, CELLS // max(1, len(self.p)))
        parts = [np.exp(-self.gamma * squared(p[i : i + step], self.p) / self.width) @ self.alpha for i in range(0, len(p), step)]
        return self.mean + (np.concatenate(parts) if parts else np.zeros((0, len(self.mean))))


def kernels(p: np.ndarray, y: np.ndarray, gamma: float, lams: list[float]) -> list[Kernel]:
    """The kernel ridge of each penalty; what doesn't depend on the penalty is done once."""
    return [Kernel.__new__(Kernel)._set(*x) for x in kernel_parts(p, y, gamma, lams)]


def kernel_parts(p: np.ndarray, y: np.ndarray, gamma: float, lams: list[float]) -> list[tuple]:
    """What a ``Kernel`` predicts from, for each penalty."""
    n, mean = len(p), y.mean(0)
    if n <= MAX_RECIPES:
        d = squared(p, p)
        off = d[np.triu_indices(n, 1)]
        width = max(float(np.median(off)) if len(off) else 1.0, 1e-12)
        k = np.exp(-gamma * d / width)
        return [(p, gamma, width, mean, solve(k + lam * n * np.eye(n), y - mean)) for lam in lams]
    width = max(median_squared(p), 1e-12)
    x, at, times = np.unique(p, axis=0, return_inverse=True, return_counts=True)  # equal recipes count once, with their number and the sum of their outputs
    sums = np.stack([np.bincount(at.ravel(), c) for c in (y - mean).T], 1)
    eps = max(TINY_SHARE * min(lams), 1e-13)
    seen, rest = np.argsort(-((x - x.mean(0)) ** 2).sum(1), kind="stable"), np.zeros(0, int)
    seen = np.unique(np.concatenate([seen[:FIRST], seen[:: max(1, len(x) // FIRST)]]))
    while True:
        seen = np.concatenate([seen, rest])
        z = x[seen[centres(x[seen], gamma / width, eps)]]
        low = np.linalg.inv(np.linalg.cholesky(np.exp(-gamma / width * squared(z, z)) + 1e-15 * len(z) * np.eye(len(z))))
        g, c, left = np.zeros((len(z), len(z))), np.zeros((len(z), y.shape[1])), np.zeros(len(x))
        step = max(64, CELLS // len(z))
        for i in range(0, len(x), step):
            terms = np.exp(-gamma / width * squared(x[i : i + step], z)) @ low.T
            left[i : i + step] = 1 - (terms * terms).sum(1)
            c += terms.T @ sums[i : i + step]
            terms *= np.sqrt(times[i : i + step])[:, None]
            g += terms.T @ terms
        rest = np.setdiff1d(np.flatnonzero(left > 10 * eps + 1e-12), seen)
        if not len(rest):
            return [(z, gamma, width, mean, low.T @ solve(g + lam * n * np.eye(len(z)), c)) for lam in lams]
        rest = rest[np.argsort(-left[rest], kind="stable")][:FIRST]


def centres(x: np.ndarray, rate: float, eps: float) -> np.ndarray:
    """Rows of ``x`` in whose kernels exp(-rate * squared distance) those of all rows are expanded with a remainder of at most ``eps``: a pivoted Cholesky factor, made in blocks."""
    left, rows, chosen = np.ones(len(x)), np.zeros((0, len(x))), []
    size = 0
    while True:
        order = np.argsort(-left, kind="stable")[:64]
        order = order[left[order] > eps]
        if not len(order):
            return np.array(chosen, int)
        s = np.exp(-rate * squared(x[order], x[order])) - rows[:size, order].T @ rows[:size, order]
        picked, factor, rest, floor = [], np.zeros((len(order), len(order))), np.diag(s).copy(), max(eps, 0.1 * left[order[0]])
        while (k := int(rest.argmax())) not in picked and (not picked or rest[k] > floor):  # the most distinct of the block
            m = len(picked)
            factor[m] = (s[k] - factor[:m, k] @ factor[:m]) / np.sqrt(max(rest[k], 1e-300))
            rest -= factor[m] ** 2
            rest[k] = 0
            picked.append(k)
        new = order[picked]
        inner = np.tril(factor[: len(picked), picked].T)
        if size + len(new) > len(rows):
            rows = np.concatenate([rows, np.zeros((max(256, len(rows)), len(x)))])
        add = np.linalg.solve(inner, np.exp(-rate * squared(x[new], x)) - rows[:size, new].T @ rows[:size])
        rows[size : size + len(new)] = add
        size += len(new)
        left -= (add * add).sum(0)
        chosen += new.tolist()
        left[chosen] = 0


def median_squared(p: np.ndarray) -> float:
    """The median squared distance of all pairs of recipes, counted in finer and finer intervals: no list of all pairs."""
    n, own = len(p), (p * p).sum(1)
    left, right = np.column_stack([-2 * p, own, np.ones(len(p))]), np.ascontiguousarray(np.column_stack([p, np.ones(len(p)), own]).T)

    def strips():
        for i in range(0, n - 1, STRIP):
            for j in range(i, n, BLOCK):
                v = np.maximum(left[i : i + STRIP] @ right[:, j : j + BLOCK], 0)
                yield v[np.arange(j, j + v.shape[1]) > np.arange(i, i + len(v))[:, None]] if j < i + STRIP else v.ravel()

    high = float(4 * ((p - p.mean(0)) ** 2).sum(1).max()) * (1 + 1e-9)  # no two are further apart
    if high <= 0:
        return 0.0
    total = n * (n - 1) // 2

    def inside(path: list) -> Iterator[np.ndarray]:
        for v in strips():
            for low, scale, part in path:
                v = v[_bin(v, low, scale, False) == part]
            if len(v):
                yield v

    def ranked(rank: int) -> list[float]:
        """The values of this rank and the next, as far as they are in one interval."""
        path, low, up = [], 0.0, high
        while up - low > 1e-14 * high:
            scale, counts = SCALE / (up - low), np.zeros(BINS, np.int64)
            for v in inside(path):
                counts += np.bincount(_bin(v, low, scale, False), minlength=BINS)
            upto = np.cumsum(counts)
            part = int(np.searchsorted(upto, rank, "right"))
            rank -= int(upto[part - 1]) if part else 0
            path, low, up = [*path, (low, scale, part)], low + part / scale, low + (part + 1) / scale
            if counts[part] <= CELLS:
                return [float(v) for v in np.sort(np.concatenate(list(inside(path))))[rank : rank + 2]]
        return [low]

    got = ranked((total - 1) // 2)
    return float(got[0] if total % 2 else (got[0] + (got[1] if len(got) > 1 else ranked(total // 2)[0])) / 2)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def fit(family: str, p: np.ndarray, y: np.ndarray, params: dict):
    if family == "linear_ridge":
        return Ridge(p, y, params["lam"])
    if family == "quadratic_ridge":
        return Ridge(p, y, params["lam"], params["ratio"], True)
    if family == "rbf_kernel_ridge":
        return Kernel(p, y, params["gamma"], params["lam"])
    raise ValueError(f"unknown family {family}")


def components(p: np.ndarray, threshold: float) -> np.ndarray:
    """Smallest member of each recipe's group of recipes within an L1 distance of ``threshold``, transitively. Recipes are compared with those near in the first share."""
    x, first, at = np.unique(p, axis=0, return_index=True, return_inverse=True)  # in order of the first share
    ends, sets = np.searchsorted(x[:, 0], x[:, 0] + threshold + 1e-9, "right"), Sets()
    low = first.copy()
    for i, end in enumerate(ends):
        for j in i + 1 + np.flatnonzero(np.abs(x[i + 1 : end] - x[i]).sum(1) <= threshold):
            sets.join(i, int(j))
    root = np.array([sets.find(i) for i in range(len(x))], int)
    np.minimum.at(low, root, first)
    return low[root][at.ravel()]


def folds(groups: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Groups dealt in a seeded order; near-duplicates stay together."""
    unique = np.unique(groups)
    np.random.default_rng(seed).shuffle(unique)
    place = {int(g): i % count for i, g in enumerate(unique)}
    return np.array([place[int(g)] for g in groups])


# The grids of the three families.
LAMBDAS, RATIOS, GAMMAS = (1e-8, 1e-6, 1e-4, 1e-2, 1e-1, 1.0), (1.0, 10.0, 100.0), (0.25, 1.0, 4.0)
GRID = [("linear_ridge", {"lam": lam}) for lam in LAMBDAS] + [("quadratic_ridge", {"lam": lam, "ratio": r}) for r in RATIOS for lam in LAMBDAS] + [("rbf_kernel_ridge", {"gamma": g, "lam": lam}) for g in GAMMAS for lam in LAMBDAS]


def fold_errors(spark, value, p: np.ndarray, y: np.ndarray, fold: np.ndarray, shapes: list[list[int]], fitted: Callable) -> np.ndarray:
    """Mean squared error over the folds of each point of a grid. ``shapes``: points that are fitted together, by ``fitted(value, points, p, y)``; a task has one of them and one fold."""
    names = np.unique(fold)
    tasks = [(s, f) for s in sorted(shapes, key=len, reverse=True) for f in names]

    width = max(map(len, shapes))

    def work(shared, i: int) -> list[float]:
        value, p, y, fold = shared
        s, f = tasks[i]
        inside = fold == f
        errors = [float(np.mean((m.predict(p[inside]) - y[inside]) ** 2)) for m in fitted(value, s, p[~inside], y[~inside])]
        return errors + [np.nan] * (width - len(errors))

    got = in_parallel(spark, (value, p, y, fold), len(tasks), work, width)
    out = np.full((sum(map(len, shapes)), len(names)), np.nan)
    for (s, f), errors in zip(tasks, got):
        out[s, np.flatnonzero(names == f)[0]] = errors[: len(s)]
    return np.array([float(np.mean(x)) for x in out])


def together(keys: list) -> list[list[int]]:
    """Numbers of the equal keys; None is equal to no other."""
    out: dict = {}
    for i, k in enumerate(keys):
        out.setdefault((i,) if k is None else k, []).append(i)
    return list(out.values())


def _grid_models(_, points: list[int], p: np.ndarray, y: np.ndarray) -> list:
    if GRID[points[0]][0] != "rbf_kernel_ridge":
        return [fit(GRID[k][0], p, y, GRID[k][1]) for k in points]
    return kernels(p, y, GRID[points[0]][1]["gamma"], [GRID[k][1]["lam"] for k in points])


def cross_validate(spark, p: np.ndarray, y: np.ndarray, threshold: float = 0.01, count: int = 5, seed: int = 20260924) -> DataFrame:
    """family, params, cv_mse, best: the grid's points are fitted in parallel on the executors, which get the recipes by broadcast."""
    from pyspark.sql import Window

    fold = folds(components(p, threshold), count, seed)
    mse = fold_errors(spark, None, p, y, fold, together([x.get("gamma") for _, x in GRID]), _grid_models)
    scored = spark.createDataFrame([(k, f, str(sorted(x.items())), float(mse[k])) for k, (f, x) in enumerate(GRID)], "k int, family string, params string, cv_mse double")
    return scored.withColumn("best", F.row_number().over(Window.partitionBy("family").orderBy("cv_mse", "k")) == 1).drop("k")


# Models whose geometry or prior takes the domains' quality. The grid of their parameters.
VARIANT_GRID = {"gamma": (0.25, 1.0), "lam": (1e-4, 1e-2), "alpha": (0.0, 0.5, 1.5), "ridge_lam": (1e-4, 1e-2), "ratio": (10.0, 100.0), "prior": (0.0, 1e-6, 1e-4, 1e-2)}
VARIANTS = ("M1-RBF", "M2-RBF", "M3-RBF", "M123-RBF", "M1-Scheffe", "M3prior-Scheffe")


def geometry(variant: str, p: np.ndarray, q: np.ndarray, alpha: float) -> np.ndarray:
    """What the kernel compares: the shares alone (M1), with their mean quality (M2), with quality by domain (M3), or with both (M123)."""
    extra = {"M1": [], "M2": [(p @ q)[:, None]], "M3": [p * q], "M123": [p * q, (p @ q)[:, None]]}
    kind = variant.split("-")[0]
    if kind not in extra or q.shape != (p.shape[1],):
        raise ValueError(f"no geometry {variant} with {q.shape} qualities")
    return np.hstack([p, *(alpha * x for x in extra[kind])])


def parameters(variant: str, grid: dict = VARIANT_GRID) -> list[dict]:
    if variant.endswith("Scheffe"):
        return [{"lam": a, "ratio": r, "prior": s} for a in grid["ridge_lam"] for r in grid["ratio"] for s in (grid["prior"] if "prior" in variant else (0.0,))]
    return [{"alpha": a, "gamma": g, "lam": x} for a in ((0.0,) if variant.startswith("M1-") else grid["alpha"]) for g in grid["gamma"] for x in grid["lam"]]


class Variant:
    """One of VARIANTS, fitted; ``known``: the domains whose quality the prior may use."""

    def __init__(self, variant: str, p: np.ndarray, y: np.ndarray, q: np.ndarray, known: np.ndarray, params: dict):
        self.variant, self.q, self.params = variant, q, params
        if variant.endswith("Scheffe"):
            extra = anchor_prior(q, known, params["prior"]) if params["prior"] else None
            self.model = Ridge(p, y, params["lam"], params["ratio"], True, extra)
        else:
            self.model = Kernel(geometry(variant, p, q, params["alpha"]), y, params["gamma"], params["lam"])

    def predict(self, p: np.ndarray) -> np.ndarray:
        return self.model.predict(p if self.variant.endswith("Scheffe") else geometry(self.variant, p, self.q, self.params["alpha"]))


def shape(variant: str, params: dict) -> tuple | None:
    """Equal where kernel variants differ in their penalty alone; without quality all of them compare the shares alone."""
    if variant.endswith("Scheffe"):
        return None
    return (variant if params["alpha"] else "M1-RBF", params["alpha"], params["gamma"])


def variants(grid: list[tuple[str, dict]], points: list[int], p: np.ndarray, y: np.ndarray, q: np.ndarray, known: np.ndarray) -> list[Variant]:
    """The variants of these points of the grid, whose shape is equal."""
    variant, params = grid[points[0]]
    if variant.endswith("Scheffe"):
        return [Variant(*grid[k][:1], p, y, q, known, grid[k][1]) for k in points]
    out = []
    for k, m in zip(points, kernels(geometry(variant, p, q, params["alpha"]), y, params["gamma"], [grid[k][1]["lam"] for k in points])):
        v = Variant.__new__(Variant)
        v.variant, v.q, v.params, v.model = variant, q, params, m
        out.append(v)
    return out


def centred_ridge(p: np.ndarray, y: np.ndarray, lam: float, ratio: float = 1.0, quadratic: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge around the outputs' means, products penalised through their scale: (scale, coefficients, means)."""
    x = expand(p, quadratic)
    scale = np.sqrt((x * x).mean(0))
    scale[scale < 1e-12] = 1
    scale[p.shape[1] :] *= np.sqrt(ratio)
    xs, mean = x / scale, y.mean(0)
    return scale, solve(xs.T @ xs + lam * len(x) * np.eye(x.shape[1]), xs.T @ (y - mean)), mean


def in_parallel(spark, shared_value, count: int, work: Callable[[object, int], list[float]], width: int) -> np.ndarray:
    """Rows ``work(value, i)`` for i below ``count``, computed on the executors, which get the value by broadcast. For bounded numeric tasks."""
    shared = spark.sparkContext.broadcast(shared_value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([list(map(float, work(shared.value, i))) for i in ids], pa.list_(pa.float64()))], ["i", "v"])

    got = spark.range(0, count, 1, count).mapInArrow(run, "i bigint, v array<double>").collect()
    out = np.full((count, width), np.nan)
    for r in got:
        out[r.i] = r.v
    return out


def rank_correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    """Spearman with mean ranks for ties; None where one is constant."""
    def rank(v):
        order = np.argsort(v, kind="stable")
        _, first, inverse, n = np.unique(v[order], return_index=True, return_inverse=True, return_counts=True)
        out = np.empty(len(v))
        out[order] = (first + (n - 1) / 2)[inverse]
        return out

    x, y = rank(np.asarray(a, float)), rank(np.asarray(b, float))
    return float(np.corrcoef(x, y)[0, 1]) if x.std() > 1e-12 and y.std() > 1e-12 else None


def measures(actual: np.ndarray, predicted: np.ndarray) -> dict:
    """Errors over all outputs and of the mean loss, rank correlations, overlaps of the best k and the regret of picking them."""
    error, ma, mp = actual - predicted, actual.mean(1), predicted.mean(1)
    spread, macro_spread = ((actual - actual.mean(0)) ** 2).sum(), ((ma - ma.mean()) ** 2).sum()
    rhos = [r for j in range(actual.shape[1]) if (r := rank_correlation(actual[:, j], predicted[:, j])) is not None]
    out = {"n": len(ma), "rmse": np.sqrt((error**2).mean()), "mae": np.abs(error).mean(), "r2": 1 - (error**2).sum() / spread if spread else None, "macro_rmse": np.sqrt(((ma - mp) ** 2).mean())}
    out |= {"macro_mae": np.abs(ma - mp).mean(), "macro_r2": 1 - ((ma - mp) ** 2).sum() / macro_spread if macro_spread else None, "macro_spearman": rank_correlation(ma, mp), "mean_output_spearman": np.mean(rhos) if rhos else None}
    best, picked = np.argsort(ma, kind="stable"), np.argsort(mp, kind="stable")
    for k in (1, 5, 10):
        m = min(k, len(ma))
        out |= {f"top{k}_overlap": len(set(picked[:m]) & set(best[:m])) / m, f"regret_at_{k}": ma[picked[:m]].min() - ma.min()}
    out |= {"oracle_rank": int(np.flatnonzero(picked == best[0])[0]) + 1, "best_rank_of_ten": int(min(np.flatnonzero(np.isin(best, picked[:10])))) + 1}
    return {k: v if v is None or isinstance(v, int) else float(v) for k, v in out.items()}


def paired_interval(base: np.ndarray, other: np.ndarray, rng: np.random.Generator, repeats: int) -> tuple[float, float, float]:
    """Gain in root mean squared error of ``other`` over ``base``, both errors of the same recipes, and its interval over resampled recipes."""
    at = (rng.integers(0, len(base), len(base)) for _ in range(repeats))
    low, high = np.quantile([np.sqrt(base[i].mean()) - np.sqrt(other[i].mean()) for i in at], [0.025, 0.975])
    return float(np.sqrt(base.mean()) - np.sqrt(other.mean())), float(low), float(high)


def linear_prediction(x: Column, beta: list[float]) -> Column:
    """Dot product of an array column with literal coefficients."""
    return sum((F.get(x, F.lit(i)) * float(b) for i, b in enumerate(beta)), F.lit(0.0))


def blocks(df: DataFrame) -> DataFrame:
    """block, keys, flat: recipes (index, p array) packed into rows of about BLOCK recipes, in order of the index."""
    count = max(1, -(-df.count() // BLOCK))
    packed = df.groupBy(F.pmod(F.xxhash64("index"), F.lit(count)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("index", "p"))).alias("r"))
    return cut(packed.select("block", F.transform("r", lambda x: x["index"]).alias("keys"), F.flatten(F.transform("r", lambda x: x["p"])).alias("flat")))


def squares(a: DataFrame, b: DataFrame, upper: bool = False) -> DataFrame:
    """Every block of ``a`` with every one of ``b``; ``upper``: each unordered pair of blocks of one table once."""
    left = a.toDF("block_a", "keys_a", "flat_a").repartition(a.sparkSession.sparkContext.defaultParallelism, "block_a")
    j = left.crossJoin(b.toDF("block_b", "keys_b", "flat_b"))
    return j.where("block_a <= block_b") if upper else j


def _square(b: pa.RecordBatch, i: int) -> tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether both blocks are the same, and keys and shares of both."""
    ka, fa, kb, fb = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("keys_a", "flat_a", "keys_b", "flat_b"))
    return b.column("block_a")[i].as_py() == b.column("block_b")[i].as_py(), ka, fa.reshape(len(ka), -1), kb, fb.reshape(len(kb), -1)


def nearest(queries: DataFrame, train: DataFrame, other: bool = False) -> DataFrame:
    """index, nearest, l1, exact for recipes (index, p array): each square of blocks gives its least distances, of which the least counts.

    ``other``: a recipe isn't compared with the one of its own index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                _, ka, at, kb, m = _square(b, i)
                d = np.round(np.array([np.abs(m - x).sum(1) for x in at]), 12)  # equal distances tie towards the least index
                if other:
                    d[ka[:, None] == kb[None, :]] = np.inf
                k = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(ka), pa.array(kb[k]), pa.array(d[np.arange(len(at)), k])], ["index", "nearest", "l1"])

    found = squares(blocks(queries.select("index", "p")), blocks(train.select("index", "p"))).mapInArrow(run, "index bigint, nearest bigint, l1 double")
    best = found.where("l1 < double('infinity')").groupBy("index").agg(F.min(F.struct("l1", "nearest")).alias("r"))
    return best.select("index", "r.nearest", "r.l1", (F.col("r.l1") < 1e-12).alias("exact"))


class Sets:
    """Disjoint sets, each known by its least member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (u := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(u, u)
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def groups(df: DataFrame, threshold: float) -> DataFrame:
    """index, group_index: the least index that steps of at most ``threshold`` in L1 lead to. The driver holds one number per recipe.

    Each task joins the recipes of its squares and gives (member, least member) alone, so no list of all near pairs is made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for b in batches:
            for i in range(b.num_rows):
                same, ka, p, kb, q = _square(b, i)
                for k, x in enumerate(p):
                    first = k + 1 if same else 0
                    for j in kb[first:][np.abs(q[first:] - x).sum(1) <= threshold]:
                        sets.join(int(ka[k]), int(j))
        low = [(x, sets.find(x)) for x in list(sets.up)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in low], pa.int64()), pa.array([y for _, y in low], pa.int64())], ["a", "b"])

    table = blocks(df)
    sets = Sets()
    for r in squares(table, table, True).mapInArrow(run, "a bigint, b bigint").toLocalIterator():
        sets.join(r.a, r.b)
    linked = df.sparkSession.createDataFrame([(x, sets.find(x)) for x in list(sets.up)], "index long, group_index long")
    return df.select("index").join(linked, "index", "left").select("index", F.coalesce("group_index", "index").alias("group_index"))


def squared_pairs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances summed column by column, the same in every pass."""
    return sum(((p[:, k, None] - q[None, :, k]) ** 2 for k in range(p.shape[1])), np.zeros((len(p), len(q))))


def pair_summary(table: DataFrame, value, probs: list[float]) -> dict | None:
    """``pair_summaries`` of one value."""
    got = pair_summaries(table, lambda p, q: [lambda rows: value(p[rows], q)], probs)
    return got[0] if got else None


def _bin(v: np.ndarray, low: float, scale: float, whole: bool) -> np.ndarray:
    """The interval of each value, the same in every pass and never less for a greater value. ``whole``: the interval is the values' range, so none lies outside."""
    i = ((v - low) * scale).astype(np.int32)
    return i if whole else np.clip(i, 0, BINS - 1)


def pair_summaries(table: DataFrame, values, probs: list[float]) -> list[dict]:
    """pairs, mean, min, max and interpolated quantiles of each value over all unordered pairs of recipes in ``table`` (blocks).

    ``values(p, q)`` gives a function per value, from a slice of the recipes ``p`` to the matrix of their values with all of ``q``. A pass counts the pairs of the intervals that hold the wanted ranks in BINS parts of each, until a part is less than 1e-13 of the values' range. All values
    share the passes; nothing is sorted. Empty without a pair.
    """
    pairs = squares(table, table, True)

    def strips(batches):
        """(number of the value, values) of some rows of a square at a time, which stay in the processor's cache."""
        for b in batches:
            for i in range(b.num_rows):
                same, _, p, _, q = _square(b, i)
                of_rows = values(p, q)
                for at in range(0, len(p), STRIP):
                    keep = np.arange(len(q)) > np.arange(at, min(at + STRIP, len(p)))[:, None] if same else None
                    for k, f in enumerate(of_rows):
                        v = f(slice(at, at + STRIP))
                        yield k, v[keep] if same else v.ravel()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for k, v in strips(batches):
            if len(v):
                n, s, low, high = got.get(k, (0, 0.0, np.inf, -np.inf))
                got[k] = (n + len(v), s + float(v.sum()), min(low, float(v.min())), max(high, float(v.max())))
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), *[pa.array([g[k] for g in got.values()], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.float64()))]], ["k", "n", "s", "low", "high"])

    rows = pairs.mapInArrow(first, "k bigint, n bigint, s double, low double, high double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("k").collect()  # a row per value
    if not rows:
        return []
    at = [(rows[0].n - 1) * p for p in probs]
    ranks = sorted({r for x in at for r in (int(np.floor(x)), int(np.ceil(x)))})
    found: dict[tuple[int, int], float] = {}
    todo = {}  # (value, rank) -> the rank inside of the interval, and the intervals that led there as (low, scale, number)
    for one in rows:
        for r in ranks:
            if one.high > one.low:
                todo[one.k, r] = (r, (), one.low, one.high)
            else:
                found[one.k, r] = one.low
    fine = {one.k: max(1e-13 * (one.high - one.low), 1e-15 * max(abs(one.low), abs(one.high))) for one in rows}
    tops = {one.k: (one.low, SCALE / (one.high - one.low)) for one in rows if one.high > one.low}
    while todo:
        spans = sorted({(k, path, low, SCALE / (high - low)) for (k, _), (_, path, low, high) in todo.items()})
        of: dict[int, list[int]] = {}
        for i, span in enumerate(spans):
            of.setdefault(span[0], []).append(i)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(spans), BINS), np.int64)  # noqa: B023
            for k, v in strips(batches):
                top = _bin(v, *tops[k], True) if k in of else None  # noqa: B023
                for i in of.get(k, ()):  # noqa: B023
                    _, path, low, scale = spans[i]  # noqa: B023
                    if not path:
                        total[i] += np.bincount(top, minlength=BINS)
                        continue
                    x = v[np.flatnonzero(top == path[0][2])]
                    for a, c, part in path[1:]:
                        x = x[_bin(x, a, c, False) == part]
                    if len(x):
                        total[i] += np.bincount(_bin(x, low, scale, False), minlength=BINS)
            k, i = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, i, total[k, i])], ["k", "i", "n"])

        inside = np.zeros((len(spans), BINS), np.int64)
        for r in pairs.mapInArrow(count, "k bigint, i bigint, n bigint").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():  # at most BINS rows a span
            inside[r.k, r.i] = r.n
        number, left = {span[:2]: i for i, span in enumerate(spans)}, {}
        for (k, rank), (r, path, low, high) in todo.items():
            upto = np.cumsum(inside[number[k, path]])
            part, scale = int(np.searchsorted(upto, r, "right")), SCALE / (high - low)
            a, b = low + part / scale, low + (part + 1) / scale
            if b - a <= fine[k] or not a < b:
                found[k, rank] = a
            else:
                left[k, rank] = (r - int(upto[part - 1] if part else 0), (*path, (low, scale, part)), a, b)
        todo = left
    out = []
    for one in rows:
        low, high = ([found[one.k, int(f(x))] for x in at] for f in (np.floor, np.ceil))
        out.append({"pairs": one.n, "mean": one.s / one.n, "low": one.low, "high": one.high, "q": [float(a + (b - a) * (x - np.floor(x))) for a, b, x in zip(low, high, at)]})
    return out


def pair_extremes(table: DataFrame, value, count: int) -> DataFrame:
    """end, index_a < index_b, value: the ``count`` lowest and the ``count`` highest of all unordered pairs, ties by the indices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                same, ka, p, kb, q = _square(b, i)
                u, v = np.triu_indices(len(p), 1) if same else (x.ravel() for x in np.indices((len(p), len(q))))
                x = np.round(value(p, q)[u, v], 12) + 0.0
                one, two = np.minimum(ka[u], kb[v]), np.maximum(ka[u], kb[v])
                for end, sign in (("lowest", 1), ("highest", -1)):
                    k = np.lexsort((two, one, sign * x))[:count]
                    yield pa.RecordBatch.from_arrays([pa.array([end] * len(k), pa.string()), pa.array(one[k]), pa.array(two[k]), pa.array(x[k])], ["end", "index_a", "index_b", "value"])

    found = cut(squares(table, table, True).mapInArrow(run, "end string, index_a bigint, index_b bigint, value double"))
    low, high = (found.where(F.col("end") == e).orderBy(o, "index_a", "index_b").limit(count) for e, o in (("lowest", F.col("value").asc()), ("highest", F.col("value").desc())))
    return low.unionByName(high)
