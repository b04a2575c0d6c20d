"""Regressors under grouped folds. Rows are read twice whatever the number of folds, penalties and targets: for moments by
fold, and for products of features, scaled as each held-out fold's training rows ask for. Products are dealt in tiles, added
up by tile and solved where they lie, one held-out fold a task; the driver gets moments and weights, never the products."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areasignal.functions.geo import hashed_unit
from areasignal.operators import kernel
from areasignal.session import written

# Penalties tried for ridge and for its stacked form, shares of the first norm, bound of scaled values; parts
# that the training rows are split into to choose among penalties, penalties of a path, the least of it against the first.
RIDGE = np.logspace(-2, 6, 25)
STACKED = np.logspace(-2, 4, 13)
L1_SHARES = (0.1, 0.3, 0.5, 0.7, 0.9)
CLIP = 30.0
INNER, PATH, LEAST = 5, 100, 1e-3
#: Rows whose products one task adds up, features of a tile, steps of a descent at most.
PART, TILE, STEPS = 8192, 512, 20_000

Features = Sequence[str] | str


@dataclass
class Fold:
    """A model that hasn't seen one fold: scaling, weights ([bias, w] by target), and the penalty chosen for each target."""

    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    alpha: np.ndarray
    share: np.ndarray
    clip: float | None

    def scaled(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.sd
        return np.clip(z, -self.clip, self.clip) if self.clip else z

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + self.scaled(x) @ self.weights[1:]


def _rows(df: DataFrame, unit: str, fold: str, features: Features, targets: Sequence[str]) -> DataFrame:
    """unit, fold, inner (a fifth by a hash of the unit), x and y: arrays of doubles. features: columns, or one array column."""
    x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(c).cast("double") for c in features))
    inner = F.floor(hashed_unit(F.lit("inner"), F.col(unit)) * INNER).cast("int")
    return df.select(F.col(unit).alias("unit"), F.col(fold).cast("int").alias("fold"), inner.alias("inner"), x.alias("x"), F.array(*(F.col(c).cast("double") for c in targets)).cast("array<double>").alias("y"))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Number of rows, means and sums of squares about them of x, by fold."""

    def merged(parts: list[tuple]) -> tuple:
        n = sum(p[0] for p in parts)
        mean = sum(p[0] * p[1] for p in parts) / n
        return n, mean, sum(p[2] + p[0] * (p[1] - mean) ** 2 for p in parts)

    def table(found: dict[int, tuple]) -> pa.RecordBatch:
        keys = list(found)
        arrays = [pa.array([found[k][j].tolist() for k in keys], pa.list_(pa.float64())) for j in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([found[k][0] for k in keys], pa.int64()), *arrays], ["fold", "n", "mean", "squares"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            x, f = _matrix(batch.column(1), batch.num_rows), batch.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(f).tolist():
                part = x[f == k]
                mean = part.mean(axis=0)
                now = (len(part), mean, ((part - mean) ** 2).sum(axis=0))
                found[k] = merged([found[k], now]) if k in found else now
        yield table(found)

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        found = merged([(n, np.array(m), np.array(s)) for n, m, s in zip(*(parts[c].to_pylist() for c in ("n", "mean", "squares")))])
        return pa.Table.from_batches([table({key[0].as_py(): found})])

    schema = "fold int, n long, mean array<double>, squares array<double>"
    merged_rows = rows.select("fold", "x").mapInArrow(run, schema).groupBy("fold").applyInArrow(merge, schema)
    return {r.fold: (r.n, np.array(r.mean), np.array(r.squares)) for r in merged_rows.collect()}


def _scaling(stats: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation (where it is 0, 1) of the rows outside each fold; of the only fold, its own."""
    out = {}
    for k in stats:
        rest = [stats[j] for j in stats if j != k] or [stats[k]]
        n = sum(s[0] for s in rest)
        mean = sum(s[0] * s[1] for s in rest) / n
        var = sum(s[2] + s[0] * (s[1] - mean) ** 2 for s in rest) / n
        out[k] = mean, np.where(var > 1e-24, np.sqrt(np.maximum(var, 0)), 1.0)
    return out


def _solved(rows: DataFrame, scaling: dict, clip: float | None, solve: Callable[[list[np.ndarray]], tuple], schema: str) -> list:
    """What solve makes of the products of [1, z, y] of each held-out fold's training rows, one matrix for each inner part."""
    n = rows.count()
    parts = max(1, -(-n // (PART * INNER * len(scaling))))
    only = len(scaling) == 1
    dealt = rows.withColumn("part", F.floor(hashed_unit(F.lit("part"), F.col("unit")) * parts).cast("int")).select("fold", "inner", "part", "x", "y")
    dealt = dealt.repartition("fold", "inner", "part").sortWithinPartitions("fold", "inner", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, {}

        def tiles() -> Iterator[pa.RecordBatch]:
            for k, p in sums.items():
                for i, j in product(range(0, len(p), TILE), repeat=2):
                    if i <= j:
                        at = [pa.array([v], pa.int32()) for v in (k, key[1], i, j)]
                        yield pa.RecordBatch.from_arrays([*at, pa.array([np.ascontiguousarray(p[i : i + TILE, j : j + TILE]).tobytes()], pa.binary())], ["held", "inner", "i", "j", "v"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
            bounds = [0, *(np.flatnonzero(np.diff(keys, axis=0).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if (now := tuple(keys[a].tolist())) != key:
                    yield from tiles()
                    key, sums = now, {}
                x, y = (_matrix(batch.column(c)[a:b], b - a) for c in (3, 4))
                for k, (mean, sd) in scaling.items():
                    if k != key[0] or only:
                        z = (x - mean) / sd
                        z = np.column_stack([np.ones(b - a), np.clip(z, -clip, clip) if clip else z, y])
                        sums[k] = sums[k] + z.T @ z if k in sums else z.T @ z
        yield from tiles()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in table["v"].to_pylist())
        return table.slice(0, 1).set_column(4, "v", pa.array([total.tobytes()], pa.binary()))

    def end(key: tuple, table: pa.Table) -> pa.Table:
        rows_of = table.to_pylist()
        last = max(r["i"] for r in rows_of)
        w = last + int(round((len(next(r["v"] for r in rows_of if r["i"] == r["j"] == last)) / 8) ** 0.5))
        found = {m: np.zeros((w, w)) for m in sorted({r["inner"] for r in rows_of})}
        for r in rows_of:
            p, h = found[r["inner"]], min(TILE, w - r["i"])
            tile = np.frombuffer(r["v"], np.float64).reshape(h, -1)
            p[r["i"] : r["i"] + h, r["j"] : r["j"] + tile.shape[1]] = tile
            p[r["j"] : r["j"] + tile.shape[1], r["i"] : r["i"] + h] = tile.T
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in solve(list(found.values())))], names=["held", *(f.split()[0] for f in schema.split(", "))])

    tile = "held int, inner int, i int, j int, v binary"
    summed = dealt.mapInArrow(run, tile).groupBy("held", "inner", "i", "j").applyInArrow(add, tile)
    return summed.groupBy("held").applyInArrow(end, f"held int, {schema}").collect()


def _centred(p: np.ndarray, d: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means of z and y, products of z with z and with y about the means."""
    n = p[0, 0]
    mx, my = p[0, 1 : 1 + d] / n, p[0, 1 + d :] / n
    return n, mx, my, p[1 : 1 + d, 1 : 1 + d] - n * np.outer(mx, mx), p[1 : 1 + d, 1 + d :] - n * np.outer(mx, my)


def _misses(p: np.ndarray, d: int, bias: np.ndarray, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sums of squared errors over a part's rows of models (columns of w), each for its target t."""
    full = np.vstack([bias, w])
    return np.diag(p)[1 + d :][t] - 2 * (full * p[: 1 + d, 1 + d :][:, t]).sum(axis=0) + (full * (p[: 1 + d, : 1 + d] @ full)).sum(axis=0)


def ridge_path(a: np.ndarray, b: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Weights of least squares with alpha times the square of w, for all alphas of each target in turn (columns)."""
    values, vectors = np.linalg.eigh(a)
    turned = vectors.T @ b
    return np.concatenate([vectors @ (turned[:, t, None] / (np.maximum(values, 0)[:, None] + alphas)) for t in range(b.shape[1])], axis=1)


def elastic_path(a: np.ndarray, b: np.ndarray, alphas: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Columns of weights of half the mean squared error with alpha * (share * |w| + (1 - share) / 2 * w^2); a and b are mean
    products about the means. One column for each of b, alphas and shares, whose alphas fall along the columns of a path.

    Accelerated descent over the features that some column may use: those whose slope is over the column's bound, until
    none is found outside. Columns that have come to rest take part no more.
    """
    out = np.zeros((len(a), b.shape[1]))
    l1, l2 = alphas * shares, alphas * (1 - shares)
    use = (np.abs(b) > l1).any(axis=1)
    while True:
        at = np.flatnonzero(use)
        sub = a[np.ix_(at, at)]
        top = float(np.linalg.eigvalsh(sub)[-1]) if len(at) else 0.0
        w = v = out[at]
        open_, t = np.arange(b.shape[1]), 1.0
        for _ in range(STEPS if len(at) else 0):
            rate = 1 / (top + l2[open_] + 1e-12)
            new = v - rate * (sub @ v - b[np.ix_(at, open_)] + l2[open_] * v)
            new = np.sign(new) * np.maximum(np.abs(new) - rate * l1[open_], 0)
            moved = np.abs(new - w)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            back = ((v - new) * (new - w)).sum(axis=0) > 0  # going the wrong way: begin anew from here
            v = np.where(back, new, new + (t - 1) / t2 * (new - w))
            w, t = new, t2
            rest = moved.max(axis=0) <= 1e-9 * np.maximum(1e-3, np.abs(new).max(axis=0))
            if rest.any():
                out[np.ix_(at, open_[rest])] = w[:, rest]
                open_, w, v = open_[~rest], w[:, ~rest], v[:, ~rest]
                if not len(open_):
                    break
        if len(open_) and len(at):
            out[np.ix_(at, open_)] = w
        over = (np.abs(b - a @ out) > l1 * (1 + 1e-6) + 1e-9).any(axis=1) & ~use
        if not over.any():
            return out
        use |= over


def _chosen(parts: list[np.ndarray], d: int, kind: str, alphas: np.ndarray | None, shares: Sequence[float]) -> tuple[np.ndarray, ...]:
    """Weights, and the alpha and share of each target, of the best mean over the parts, each left out in turn: of the share
    of variance explained for ridge, of the mean squared error for lasso and elastic net. The first of equals wins."""
    whole = sum(parts)
    t = whole.shape[0] - 1 - d
    n, mx, my, a, b = _centred(whole, d)
    if kind == "ridge":
        grid = np.tile(RIDGE if alphas is None else np.asarray(alphas, float), t)
        share, of = np.full(len(grid), np.nan), np.repeat(np.arange(t), len(grid) // t)
        path = lambda n, a, b: ridge_path(a, b, grid[: len(grid) // t])
    else:
        first = np.abs(b).max(axis=0, initial=0.0) / n
        lists = [[(x, s) for s in shares for x in (first[k] / s * np.logspace(0, np.log10(LEAST), PATH) if alphas is None else alphas)] for k in range(t)]
        grid, share = (np.array([p[i] for of_k in lists for p in of_k]) for i in (0, 1))
        of = np.repeat(np.arange(t), len(grid) // t)
        path = lambda n, a, b: elastic_path(a / n, b[:, of] / n, grid, share)
    size = len(grid) // t
    if len(parts) > 1 and size > 1:
        marks = np.zeros(len(grid))
        for p in parts:
            m, cx, cy, ca, cb = _centred(whole - p, d)
            w = path(m, ca, cb)
            miss = _misses(p, d, cy[of] - cx @ w, w, of)
            if kind == "ridge":
                about = (np.diag(p)[1 + d :] - p[0, 1 + d :] ** 2 / p[0, 0])[of]
                marks -= np.where(about > 1e-12, 1 - miss / np.where(about > 1e-12, about, 1), 0) / len(parts)
            else:
                marks += miss / p[0, 0] / len(parts)
        best = marks.reshape(t, size).argmin(axis=1) + np.arange(t) * size
    else:
        best = np.arange(t) * size
    w = path(n, a, b)[:, best]
    return np.vstack([my - mx @ w, w]).ravel(), grid[best], share[best]


def fitted(df: DataFrame, unit: str, fold: str, features: Features, targets: Sequence[str], kind: str = "ridge", clip: float | None = CLIP, alphas: Sequence[float] | None = None, scale: bool = True) -> dict[int, Fold]:
    """A model for each held-out fold. kind: ridge, lasso or elastic (which scale and don't clip).

    The training rows of a fold are scaled by their own moments (deviation 0: 1), unless scale is off. Each target has a penalty of its own, chosen
    over INNER parts of the training rows: of RIDGE, or of a path of PATH from the least that leaves no weight down to LEAST
    of it, for each of L1_SHARES. Ridge of fewer rows than features goes by the rows' kernel (`kernel`). Rows with nulls must have been imputed or dropped. Fold numbers are small integers. Without
    rows there are no models.
    """
    if kind not in ("ridge", "lasso", "elastic"):
        raise ValueError(f"unknown regressor {kind!r}")
    bound = clip if kind == "ridge" else None
    rows = written(_rows(df, unit, fold, features, targets))
    scaling = _scaling(_moments(rows))
    if not scaling:
        return {}
    d = len(next(iter(scaling.values()))[0])
    if not scale:
        scaling = {k: (np.zeros(d), np.ones(d)) for k in scaling}
    grid, shares = None if alphas is None else np.asarray(alphas, float), (1.0,) if kind == "lasso" else L1_SHARES
    if kind == "ridge" and kernel.use(rows.count(), d):
        made = kernel.dual_ridge(rows, scaling, bound, RIDGE if grid is None else grid)
        return {k: Fold(*scaling[k], w, alpha, np.full(len(targets), np.nan), bound) for k, (w, alpha) in made.items()}
    found = _solved(rows, scaling, bound, lambda parts: _chosen(parts, d, kind, grid, shares), "weights array<double>, alpha array<double>, share array<double>")
    return {r.held: Fold(*scaling[r.held], np.array(r.weights).reshape(1 + d, len(targets)), np.array(r.alpha), np.array(r.share), bound) for r in found}


def linear_oof(df: DataFrame, unit: str, fold: str, features: Features, targets: Sequence[str], kind: str = "ridge", clip: float | None = CLIP, alphas: Sequence[float] | None = None, scale: bool = True) -> DataFrame:
    """unit, fold and pred_<target>: each row predicted by the model that didn't see its fold. kind: ridge, lasso, elastic."""
    return apply_linear(df, unit, fold, features, targets, fitted(df, unit, fold, features, targets, kind, clip, alphas, scale))


def _mapped(df: DataFrame, unit: str, fold: str, features: Features, names: Sequence[str], fn: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """unit, fold and columns of doubles: what fn makes of a fold's rows."""
    kind, rows = df.schema[unit].dataType.simpleString(), _rows(df, unit, fold, features, ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, f = _matrix(batch.column(2), batch.num_rows), batch.column(1).to_numpy(zero_copy_only=False)
            out = np.full((len(x), len(names)), np.nan)
            for k in np.unique(f).tolist():
                out[f == k] = fn(k, x[f == k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(out[:, t]) for t in range(len(names)))], [unit, fold, *names])

    return rows.select("unit", "fold", "x").mapInArrow(run, ", ".join([f"`{unit}` {kind}, `{fold}` int", *(f"`{c}` double" for c in names)]))


def apply_linear(df: DataFrame, unit: str, fold: str, features: Features, targets: Sequence[str], models: dict[int, Fold]) -> DataFrame:
    """pred_<target> of each row by its fold's model; NaN where a fold has none."""
    return _mapped(df, unit, fold, features, [f"pred_{t}" for t in targets], lambda k, x: models[k].predict(x) if k in models else np.nan)


def save(models: dict[int, Fold], spark: SparkSession, path: str) -> None:
    """Models as a table: a row for each fold, in the folder, which is replaced."""
    rows = [(k, m.mean.tolist(), m.sd.tolist(), m.weights.ravel().tolist(), m.alpha.tolist(), m.share.tolist(), m.clip) for k, m in models.items()]
    schema = "fold int, mean array<double>, sd array<double>, weights array<double>, alpha array<double>, share array<double>, clip double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict[int, Fold]:
    """What `save` wrote."""
    of = {r.fold: r for r in spark.read.parquet(path).collect()}
    return {k: Fold(np.array(r.mean), np.array(r.sd), np.array(r.weights).reshape(1 + len(r.mean), -1), np.array(r.alpha), np.array(r.share), r.clip) for k, r in of.items()}


def _axes(parts: list[np.ndarray], d: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n axes of the largest variance (rows, sign by their largest entry) and the variances."""
    whole = sum(parts)
    rows = max(1.0, whole[0, 0])
    values, vectors = np.linalg.eigh(whole[1 : 1 + d, 1 : 1 + d] / rows)
    order = np.argsort(-values, kind="stable")[: min(n, d, int(rows))]
    axes = vectors[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return axes.ravel(), values[order]


def axes_by_fold(df: DataFrame, unit: str, fold: str, features: Features, n: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each held-out fold the mean, the axes (rows) and the variances of the other folds' centred features."""
    rows = written(_rows(df, unit, fold, features, ()))
    scaling = {k: (mean, np.ones_like(mean)) for k, (mean, _) in _scaling(_moments(rows)).items()}
    d = len(next(iter(scaling.values()))[0]) if scaling else 0
    found = _solved(rows, scaling, None, lambda parts: _axes(parts, d, n), "axes array<double>, variances array<double>") if scaling else []
    return {r.held: (scaling[r.held][0], np.array(r.axes).reshape(-1, d), np.array(r.variances)) for r in found}


def pca(df: DataFrame, unit: str, features: Features, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, axes (rows) and variances of all rows' centred features."""
    return axes_by_fold(df.withColumn("_one", F.lit(0)), unit, "_one", features, n)[0]


def pca_oof(df: DataFrame, unit: str, fold: str, features: Features, n: int, prefix: str = "pc") -> DataFrame:
    """unit, fold and the components of each row by the axes of the other folds."""
    axes = axes_by_fold(df, unit, fold, features, n)
    width = min((len(a) for _, a, _ in axes.values()), default=n)
    return _mapped(df, unit, fold, features, [f"{prefix}{i}" for i in range(width)], lambda k, x: (x - axes[k][0]) @ axes[k][1][:width].T)


def reduced(df: DataFrame, unit: str, fold: str, blocks: dict[str, Features], n: int) -> DataFrame:
    """df with the components of each block of features (<block>_pc0 ...) in place of the block, by the axes of the other
    folds; all other columns stay as they are."""
    out = df
    for name, features in blocks.items():
        made = pca_oof(df, unit, fold, features, n, f"{name}_pc")
        out = out.drop(*([features] if isinstance(features, str) else features)).join(made.drop(fold), unit)
    return out


def residual_oof(df: DataFrame, unit: str, fold: str, first: Features, second: Features, targets: Sequence[str]) -> DataFrame:
    """Two stages: ridge on the first features, ridge of what it leaves on the second, summed: pred_<target>."""
    a = written(linear_oof(df, unit, fold, first, targets))
    left = df.join(a.drop(fold), unit).withColumns({f"_r_{t}": F.col(t) - F.col(f"pred_{t}") for t in targets})
    b = linear_oof(left, unit, fold, second, [f"_r_{t}" for t in targets])
    return a.join(b.drop(fold), unit).select(unit, fold, *((F.col(f"pred_{t}") + F.col(f"pred__r_{t}")).alias(f"pred_{t}") for t in targets))


def stacked_oof(df: DataFrame, unit: str, fold: str, oofs: Sequence[DataFrame], targets: Sequence[str], default: float = 0.0) -> DataFrame:
    """Ridge of targets in log odds of scores 1 to 10 over the unscaled predictions of several models; of a unit that a model
    doesn't predict, that model's prediction is the default."""
    from areasignal.functions.vectors import from_logit, to_logit

    joined = df.select(unit, fold, *(to_logit(F.col(t)).alias(t) for t in targets))
    names = []
    for i, oof in enumerate(oofs):
        cols = [f"p{i}_{t}" for t in targets]
        joined = joined.join(oof.select(unit, *(F.col(f"pred_{t}").alias(c) for t, c in zip(targets, cols))), unit, "left").fillna(default, cols)
        names += cols
    out = linear_oof(written(joined), unit, fold, names, targets, clip=None, alphas=STACKED, scale=False)
    return out.select(unit, fold, *(from_logit(F.col(f"pred_{t}")).alias(f"pred_{t}") for t in targets))
