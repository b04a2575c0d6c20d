"""Boosted trees on binned features: gradient histograms of all folds and targets are added up together, trees grow leaf by leaf.

A model is one held-out fold and one target. Gradients are whole numbers of a common small unit, so sums are exact in any
order: the same trees come of many tasks as of one, however rows are dealt.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areasignal.functions.geo import hashed_unit
from areasignal.session import ship, written


@dataclass(frozen=True)
class Settings:
    """Rounds at most, step, leaves of a tree, rows of a leaf, L2, bins of a feature, shares of features of a tree and of rows of
    `every` rounds, rounds without gain before it stops, and the share of training rows that decide on that."""

    rounds: int = 2000
    rate: float = 0.03
    leaves: int = 31
    least: int = 20
    l2: float = 1.0
    bins: int = 255
    features: float = 0.8
    rows: float = 0.8
    every: int = 5
    patience: int = 100
    early: float = 0.15
    seed: int = 42


#: Bytes of binned features up to which each model is fitted by one task; beyond, every pass over rows is a job. Histograms that one
#: job adds up at once; rounds whose trees are added to the rows' scores when they are written anew.
LOCAL_BYTES, HISTOGRAM_BYTES, KEEP_ROUNDS = 1 << 26, 1 << 27, 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of whole numbers spread evenly (the finisher of splitmix64)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chosen_features(s: Settings, tree: int, d: int) -> np.ndarray:
    """The features that a tree may split on: a share of them by hash, at least one."""
    order = np.argsort(_mixed(np.arange(d, dtype=np.uint64) + np.uint64((s.seed * 1_000_003 + tree) * 1_048_583)), kind="stable")
    return np.sort(order[: max(1, round(s.features * d))])


def in_bag(s: Settings, tree: int, hashes: np.ndarray) -> np.ndarray:
    """Whether a row counts for a tree: a share of rows by hash, dealt anew every few rounds."""
    if s.rows >= 1:
        return np.ones(len(hashes), bool)
    with np.errstate(over="ignore"):
        mixed = _mixed(hashes.astype(np.uint64) + np.uint64(tree // s.every + 1) * np.uint64(0x9E3779B97F4A7C15))
    return (mixed >> np.uint64(11)).astype(float) / 2.0**53 < s.rows


@dataclass
class Node:
    """Sum of gradients (whole), rows, the best split known (gain, feature, bin, sum and rows to the left; None: there is none), and,
    once split, children."""

    g: int
    n: int
    best: tuple | None = None
    known: bool = False
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    """Splits by node: feature (-1: a leaf), bin (up to it goes left), children, value of leaves."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            split = self.feature[at] >= 0
            if not split.any():
                return at
            left = bins[rows, np.maximum(self.feature[at], 0)] <= self.bin[at]
            at = np.where(split, np.where(left, self.left[at], self.right[at]), at)


@dataclass
class Model:
    """One fold's and target's trees so far; after fitting those of the best round alone."""

    fold: int
    target: int
    base: float = 0.0
    unit: float = 1.0
    trees: list[Tree] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)
    errors: list[int] = field(default_factory=list)
    done: bool = False

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += t.value[t.leaf(bins)]
        return out


def _shape(nodes: Sequence[Node], value: Callable[[Node], float]) -> Tree:
    split = [x.left >= 0 for x in nodes]
    return Tree(*(np.array(c) for c in ([x.best[1] if s else -1 for x, s in zip(nodes, split)], [x.best[2] if s else 0 for x, s in zip(nodes, split)], [x.left for x in nodes], [x.right for x in nodes], [0.0 if s else value(x) for x, s in zip(nodes, split)])))


def best_split(g: np.ndarray, n: np.ndarray, features: np.ndarray, s: Settings, unit: float) -> tuple | None:
    """(gain, feature, bin, g and n to the left) of the largest gain, of equal ones the lowest feature and bin; g and n by
    feature and bin."""
    gl, nl = np.cumsum(g, 1)[:, :-1], np.cumsum(n, 1)[:, :-1]
    total, rows = int(g[0].sum()), int(n[0].sum())
    gr, nr = total - gl, rows - nl
    fits = (nl >= s.least) & (nr >= s.least)
    if not fits.any():
        return None
    of = lambda a, b: (a * unit) ** 2 / (b + s.l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, of(gl, nl) + of(gr, nr) - of(total, rows), -np.inf)
    at = int(gain.argmax())
    i, b = divmod(at, gain.shape[1])
    return (float(gain[i, b]), int(features[i]), int(b), int(gl[i, b]), int(nl[i, b])) if gain[i, b] > 1e-10 else None


def _taken(m: Model, s: Settings) -> tuple[list[int], list[int]]:
    """Nodes that are split if the largest gain known is taken first, until the tree has its leaves; and those that stay leaves."""
    split, leaves = [], {0}
    heap = [(-m.nodes[0].best[0], 0)] if m.nodes[0].best else []
    while heap and len(split) + 1 < s.leaves:
        _, i = heapq.heappop(heap)
        split.append(i)
        if m.nodes[i].left >= 0:
            leaves = leaves - {i} | {m.nodes[i].left, m.nodes[i].right}
            for c in (m.nodes[i].left, m.nodes[i].right):
                if m.nodes[c].best:
                    heapq.heappush(heap, (-m.nodes[c].best[0], c))
    return split, sorted(leaves)


def _wanted(m: Model, s: Settings) -> list[int]:
    """Nodes whose best split must be known before the tree is done: children of all that would be split by the gains known so far.
    Some are split ahead of their turn, perhaps in vain, so a tree takes about as many passes as it has levels."""
    while True:
        new = []
        for i in _taken(m, s)[0]:
            x = m.nodes[i]
            if x.left < 0:
                _, _, _, gl, nl = x.best
                x.left, x.right = len(m.nodes), len(m.nodes) + 1
                for g, n in ((gl, nl), (x.g - gl, x.n - nl)):
                    m.nodes.append(Node(g, n, None, n < 2 * s.least))
                    new.append(len(m.nodes) - 1)
        if not new or (unknown := [i for i in new if not m.nodes[i].known]):
            return unknown if new else []


def _grown(m: Model, s: Settings) -> Tree:
    """The finished tree, without the nodes that were split ahead of their turn in vain."""
    split, leaves = _taken(m, s)
    order = sorted(split + leaves)
    new = {i: k for k, i in enumerate(order)}
    taken = set(split)
    nodes = [Node(m.nodes[i].g, m.nodes[i].n, m.nodes[i].best, True, new[m.nodes[i].left] if i in taken else -1, new[m.nodes[i].right] if i in taken else -1) for i in order]
    return _shape(nodes, lambda x: -x.g * m.unit / (x.n + s.l2) * s.rate)


#: evaluate(wanted, first): wanted are (model's index, nodes); gives by (model's index, node) its best split, and, if first, by
#: model's index (gradients' sum, rows, squared errors of the rows set aside, their number), from the state before the tree.
Evaluate = Callable[[list[tuple[int, list[int]]], bool], tuple[dict, dict]]


def fit(models: list[Model], s: Settings, evaluate: Evaluate, finished: Callable[[int], None]) -> None:
    """Grows trees of all models side by side until each has all rounds, or none of its last `patience` rounds was better on the
    rows set aside; then each keeps the trees of its best round. finished(round) is told when a round's trees are there."""
    for round_ in range(s.rounds + 1):
        open_ = [k for k, m in enumerate(models) if not m.done]
        if not open_:
            break
        for k in open_:
            models[k].nodes = [Node(0, 0)]
        splits, totals = evaluate([(k, [0]) for k in open_], True)
        for k in open_:
            m = models[k]
            g, n, error, early = totals.get(k, (0, 0, 0, 0))
            m.errors.append(error if early else -len(m.trees))
            best = int(np.argmin(m.errors))
            if len(m.errors) - 1 - best >= s.patience or round_ == s.rounds or not n:
                m.trees, m.done, m.nodes = m.trees[:best], True, []
                continue
            m.nodes = [Node(g, n, splits.get((k, 0)), True)]
        open_ = [k for k in open_ if not models[k].done]
        while wanted := [(k, w) for k in open_ if (w := _wanted(models[k], s))]:
            splits, _ = evaluate(wanted, False)
            for k, nodes in wanted:
                for i in nodes:
                    models[k].nodes[i].best, models[k].nodes[i].known = splits.get((k, i)), True
        for k in open_:
            models[k].trees.append(_grown(models[k], s))
            models[k].nodes = []
        if open_:
            finished(round_)


def _histograms(bins: np.ndarray, hashes: np.ndarray, aside: np.ndarray, folds: np.ndarray, y: np.ndarray, scores: Callable[[int], np.ndarray], models: list[Model], wanted: list[tuple[int, list[int]]], s: Settings, tree: int, clip: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple]]:
    """(model's index, node, gradients and rows by feature and bin, totals) of one part of the rows."""
    d = bins.shape[1]
    use = chosen_features(s, tree, d)
    bag, width = in_bag(s, tree, hashes), s.bins + 2
    for k, nodes in wanted:
        m = models[k]
        mine = (folds != m.fold) & ~np.isnan(y[:, m.target])
        score = scores(k)
        error = score - y[:, m.target]
        early = mine & aside
        late = np.flatnonzero(mine & ~aside & bag)
        part, own = bins[late], error[late]
        g = np.rint(np.clip(own, -clip, clip) / m.unit)
        at = _shape(m.nodes, lambda x: 0.0).leaf(part) if len(m.nodes) > 1 else np.zeros(len(late), np.int64)
        squared = np.rint(np.clip(error[early], -clip, clip) ** 2 / m.unit)
        totals = (int(g.sum()), len(late), int(squared.sum()), int(early.sum()))
        for i in nodes:
            here = at == i
            b = part[here][:, use].astype(np.int64) + np.arange(len(use)) * width
            size = len(use) * width
            yield k, i, np.rint(np.bincount(b.ravel(), np.repeat(g[here], len(use)), size)).astype(np.int64).reshape(-1, width), np.bincount(b.ravel(), None, size).astype(np.int64).reshape(-1, width), totals


@dataclass
class Binned:
    """Rows as parts of them hold them: row's id, fold, hash, whether it is set aside, bins and targets."""

    rows: DataFrame
    cuts: list[np.ndarray]
    n: int
    folds: list[int]
    span: float
    means: dict[tuple[int, int], float]

    @property
    def d(self) -> int:
        return len(self.cuts)


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin 0 for what is missing, then those up to each cut, then what is above all."""
    out = np.zeros(x.shape, np.int16)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(c, x[:, j], "left"))
    return out


def _array(column: pa.Array, n: int, kind=float) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1)


def binned(df: DataFrame, unit: str, fold: str, features: Sequence[str] | str, targets: Sequence[str], s: Settings) -> Binned:
    """Cuts are places of each feature's values, of all rows and whatever their labels, by Spark's approximate percentiles; at most
    `bins` of them. Null features are their own bin; a row counts for the targets that it has."""
    x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(c).cast("double") for c in features)).cast("array<double>")
    plain = written(df.select(F.col(unit).alias("unit"), F.col(fold).cast("int").alias("fold"), F.xxhash64(F.lit(s.seed), F.col(unit).cast("string")).alias("hash"), (hashed_unit(F.lit("early"), F.col(unit)) < s.early).alias("aside"), x.alias("x"), F.array(*(F.col(c).cast("double") for c in targets)).cast("array<double>").alias("y")))
    shares = [i / s.bins for i in range(1, s.bins)]
    found = plain.select(F.posexplode("x").alias("j", "v")).where("v IS NOT NULL AND NOT isnan(v)").groupBy("j").agg(F.percentile_approx("v", F.array(*map(F.lit, shares)), 20 * s.bins).alias("c")).collect()
    width = plain.agg(F.max(F.size("x"))).first()[0] or 0
    by = {r.j: np.unique(r.c) for r in found}
    cuts = [by.get(j, np.zeros(0)) for j in range(width)]
    ship(df.sparkSession)
    kind = plain.schema["unit"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            made = _bins(_array(batch.column(4), n), cuts) if n else np.zeros((0, width), np.int16)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([r.tobytes() for r in made], pa.binary()), batch.column(5)], ["unit", "fold", "hash", "aside", "bins", "y"])

    rows = written(plain.mapInArrow(run, f"unit {kind}, fold int, hash bigint, aside boolean, bins binary, y array<double>"))
    long = plain.select("fold", F.posexplode("y").alias("t", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    stats = long.groupBy("fold", "t").agg(F.sum(F.col("v").cast("decimal(38,12)")).cast("double").alias("s"), F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    folds = sorted(r[0] for r in plain.select("fold").distinct().collect() if r[0] is not None)
    means = {}
    for k in folds:
        for t in range(len(targets)):
            rest = sorted((r.fold, r.s, r.n) for r in stats if r.t == t and r.fold != k and r.fold is not None)
            means[k, t] = sum(r[1] for r in rest) / n if (n := sum(r[2] for r in rest)) else math.nan
    span = max((max(abs(r.low), abs(r.high)) for r in stats), default=1.0) or 1.0
    return Binned(rows, cuts, plain.count(), folds, span, means)


def _parts(batch: pa.RecordBatch, d: int) -> tuple:
    """Folds (-1 for none), hashes, aside, bins, y of a batch of Binned.rows (columns in that order from the second)."""
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int16).reshape(n, d)
    return batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False), bins, _array(batch.column(5), n)


def _models(data: Binned, targets: int, s: Settings) -> list[Model]:
    """A model for each fold and target. The unit of gradients is a power of two so small that sums over all rows fit 62 bits, and
    those of a batch the whole numbers of doubles."""
    bits = min(30, 60 - math.ceil(math.log2(max(2, data.n))) - math.ceil(math.log2(16 * max(data.span, 1e-300) ** 2 + 1)))
    return [Model(k, t, data.means[k, t] if not math.isnan(data.means[k, t]) else 0.0, 2.0**-bits) for k in data.folds for t in range(targets)]


class _Growing:
    """A model's training rows in one task. A tree's rows are parted node by node: histograms of the lesser child come of its rows,
    those of the other are its parent's less them."""

    def __init__(self, m: Model, s: Settings, clip: float, folds: np.ndarray, hashes: np.ndarray, aside: np.ndarray, bins: np.ndarray, y: np.ndarray):
        mine = (folds != m.fold) & ~np.isnan(y[:, m.target])
        self.m, self.s, self.clip, self.bins, self.y = m, s, clip, np.ascontiguousarray(bins[mine].T), y[mine, m.target]
        self.aside, self.late = np.flatnonzero(aside[mine]), np.flatnonzero(~aside[mine])
        self.hashes, self.score = hashes[mine][self.late], np.full(len(self.y), m.base)
        self.bag, self.dealt = self.late, -1
        # rows whose gradients add up to whole numbers of doubles, however large each is
        self.exact = max(1, int(2.0**53 * m.unit / clip))

    def evaluate(self, wanted: list[tuple[int, list[int]]], first: bool) -> tuple[dict, dict]:
        m, splits, totals = self.m, {}, {}
        if first:
            totals[0] = self._begin()
        nodes = wanted[0][1]
        if 0 not in nodes:
            asked = set(nodes)
            for i, x in enumerate(m.nodes):
                if x.left >= 0 and i in self.parts and asked & {x.left, x.right}:
                    self._part(i, x)
        for i in nodes:
            splits[0, i] = best_split(*self.sums[i], self.use, self.s, m.unit)
        return splits, totals

    def _begin(self) -> tuple[int, int, int, int]:
        m, s, tree = self.m, self.s, len(self.m.trees)
        error = np.clip(self.score - self.y, -self.clip, self.clip)
        if tree // s.every != self.dealt:
            self.bag, self.dealt = self.late[in_bag(s, tree, self.hashes)], tree // s.every
        self.use = chosen_features(s, tree, len(self.bins))
        g, squared = np.rint(error[self.bag] / m.unit), np.rint(error[self.aside] ** 2 / m.unit)
        self.parts = {0: (g, self.bins[self.use][:, self.bag])}
        self.sums = {0: self._sums(*self.parts[0])}
        return int(g.astype(np.int64).sum()), len(g), int(squared.astype(np.int64).sum()), len(squared)

    def _sums(self, g: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and rows by feature and bin."""
        width = self.s.bins + 2
        total, rows = np.zeros((len(bins), width), np.int64), np.zeros((len(bins), width), np.int64)
        for at in range(0, len(g), self.exact):
            part = slice(at, at + self.exact)
            for j, b in enumerate(bins):
                total[j] += np.bincount(b[part], g[part], width).astype(np.int64)
                rows[j] += np.bincount(b[part], None, width)
        return total, rows

    def _part(self, i: int, x: Node) -> None:
        (g, bins), whole = self.parts.pop(i), self.sums.pop(i)
        left = bins[np.searchsorted(self.use, x.best[1])] <= x.best[2]
        for c, here in ((x.left, left), (x.right, ~left)):
            self.parts[c] = g.compress(here), bins.compress(here, 1)
        less, other = sorted((x.left, x.right), key=lambda c: len(self.parts[c][0]))
        self.sums[less] = self._sums(*self.parts[less])
        self.sums[other] = tuple(a - b for a, b in zip(whole, self.sums[less]))

    def finished(self, _: int) -> None:
        """Adds the last tree to the scores of all rows."""
        t, open_ = self.m.trees[-1], [(0, np.arange(len(self.y), dtype=np.int32))]
        while open_:
            i, rows = open_.pop()
            if t.feature[i] < 0:
                self.score[rows] += t.value[i]
                continue
            left = self.bins[t.feature[i]][rows] <= t.bin[i]
            open_ += [(t.left[i], rows.compress(left)), (t.right[i], rows.compress(~left))]


def _fitted_in_tasks(data: Binned, models: list[Model], s: Settings) -> list[Model]:
    """Each model in a task of its own, over all rows: only for tables of a checked size."""
    d, clip = data.d, 4 * data.span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k = [], None
        for batch in batches:
            if batch.num_rows:
                k = batch.column(6)[0].as_py()
                parts.append(_parts(batch, d))
        if parts:
            growing = _Growing(models[k], s, clip, *(np.concatenate(c) for c in zip(*parts)))
            del parts
            fit([models[k]], s, growing.evaluate, growing.finished)
            yield pa.RecordBatch.from_pylist([_packed(k, models[k])], _MODEL)

    one_row = data.rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1))))
    found = one_row.repartitionById(len(models), F.col("model")).mapInArrow(run, _MODEL_DDL).collect()
    return _unpacked(found)


def _fitted_by_jobs(data: Binned, models: list[Model], s: Settings) -> list[Model]:
    """Every pass over the rows is a job: histograms of the nodes of all models are added up by model, node and feature in tasks,
    best splits found where they lie; the driver sees splits. Rows carry each model's score, written anew every few rounds."""
    spark, d, clip, width = data.rows.sparkSession, data.d, 4 * data.span, s.bins + 2
    state, since = data.rows.withColumn("scores", F.lit(None).cast("binary")), 0

    def scores_of(batch: pa.RecordBatch, bins: np.ndarray, start: int):
        held = batch.column(6).to_pylist()
        stored = None if not held or held[0] is None else np.frombuffer(b"".join(held)).reshape(len(bins), -1)

        def of(k: int) -> np.ndarray:
            out = np.full(len(bins), models[k].base) if stored is None else stored[:, k].copy()
            for t in models[k].trees[start:]:
                out += t.value[t.leaf(bins)]
            return out

        return of

    def evaluate(wanted, first):
        splits, totals = {}, {}
        each = max(1, HISTOGRAM_BYTES // (16 * width * max(1, d)))
        queue = [(k, i) for k, nodes in wanted for i in nodes]
        for at in range(0, len(queue), each):
            some: dict[int, list[int]] = {}
            for k, i in queue[at : at + each]:
                some.setdefault(k, []).append(i)
            for r in _one_pass(list(some.items())):
                if r.g is not None:
                    splits[r.k, r.i] = (r.gain, r.feature, r.bin, r.g, r.n)
                totals[r.k] = (r.tg, r.tn, r.error, r.early)
        return splits, totals

    def _one_pass(some):
        start = since
        tree = max(len(models[k].trees) for k, _ in some)

        def add(batches):
            sums: dict = {}
            for batch in batches:
                folds, hashes, aside, bins, y = _parts(batch, d)
                if not len(bins):
                    continue
                for k, i, g, n, t in _histograms(bins, hashes, aside, folds, y, scores_of(batch, bins, start), models, some, s, tree, clip):
                    old = sums.get((k, i))
                    sums[k, i] = (g, n, t) if old is None else (old[0] + g, old[1] + n, tuple(a + b for a, b in zip(old[2], t)))
            for (k, i), (g, n, t) in sums.items():
                yield pa.RecordBatch.from_pylist([{"k": k, "i": i, "g": g.tobytes(), "n": n.tobytes(), "t": list(t)}], pa.schema([("k", pa.int32()), ("i", pa.int32()), ("g", pa.binary()), ("n", pa.binary()), ("t", pa.list_(pa.int64()))]))

        shape = [("k", pa.int32()), ("i", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()), ("bin", pa.int32()), ("g", pa.int64()), ("n", pa.int64()), ("tg", pa.int64()), ("tn", pa.int64()), ("error", pa.int64()), ("early", pa.int64())]

        def total(key, table):
            g = n = 0
            t = [0] * 4
            for r in table.to_pylist():
                g, n = g + np.frombuffer(r["g"], np.int64), n + np.frombuffer(r["n"], np.int64)
                t = [a + b for a, b in zip(t, r["t"])]
            k, i = (x.as_py() for x in key)
            best = best_split(g.reshape(-1, width), n.reshape(-1, width), chosen_features(s, tree, d), s, models[k].unit) or (None,) * 5
            return pa.Table.from_pylist([dict(zip((c for c, _ in shape), (k, i, *best, *t)))], pa.schema(shape))

        by_task = state.mapInArrow(add, "k int, i int, g binary, n binary, t array<bigint>")
        return by_task.groupBy("k", "i").applyInArrow(total, "k int, i int, gain double, feature int, bin int, g bigint, n bigint, tg bigint, tn bigint, error bigint, early bigint").collect()

    def finished(round_):
        nonlocal state, since
        if (round_ + 1) % KEEP_ROUNDS:
            return
        start, columns = since, state.columns

        def moved(batches):
            for batch in batches:
                bins = _parts(batch, d)[3]
                of = scores_of(batch, bins, start)
                scores = np.stack([of(k) for k in range(len(models))], 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([r.tobytes() for r in scores], pa.binary())], columns)

        state, since = written(state.mapInArrow(moved, state.schema.simpleString()[7:-1].replace(":", " "))), round_ + 1

    fit(models, s, evaluate, finished)
    return models


_TREE = pa.struct([("feature", pa.list_(pa.int32())), ("bin", pa.list_(pa.int32())), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])
_MODEL = pa.schema([("model", pa.int32()), ("fold", pa.int32()), ("target", pa.int32()), ("base", pa.float64()), ("unit", pa.float64()), ("rounds", pa.int32()), ("trees", pa.list_(_TREE))])
_MODEL_DDL = "model int, fold int, target int, base double, unit double, rounds int, trees array<struct<feature:array<int>,bin:array<int>,left:array<int>,right:array<int>,value:array<double>>>"


def _packed(at: int, m: Model) -> dict:
    return {"model": at, "fold": m.fold, "target": m.target, "base": m.base, "unit": m.unit, "rounds": len(m.trees), "trees": [{k: v.tolist() for k, v in asdict(t).items()} for t in m.trees]}


def _unpacked(rows) -> list[Model]:
    return [Model(r["fold"], r["target"], r["base"], r["unit"], [Tree(*(np.array(t[c]) for c in ("feature", "bin", "left", "right", "value"))) for t in r["trees"]], done=True) for r in sorted(rows, key=lambda r: r["model"])]


@dataclass
class Boosted:
    """Fitted models and the cuts of their features."""

    models: list[Model]
    cuts: list[np.ndarray]
    targets: list[str]

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables in the folder, which are replaced: models, a row for each fold and target, and cuts by feature."""
        spark.createDataFrame([_packed(i, m) for i, m in enumerate(self.models)], _MODEL_DDL).withColumn("name", F.get(F.array(*map(F.lit, self.targets)), F.col("target"))).coalesce(1).write.mode("overwrite").parquet(f"{path}/models")
        spark.createDataFrame([(j, c.tolist()) for j, c in enumerate(self.cuts)], "j int, cuts array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cuts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        """What `save` wrote."""
        rows = [r.asDict(True) for r in spark.read.parquet(f"{path}/models").collect()]
        cuts = sorted((r.j, np.array(r.cuts)) for r in spark.read.parquet(f"{path}/cuts").collect())
        names = {r["target"]: r["name"] for r in rows}
        return cls(_unpacked(rows), [c for _, c in cuts], [names[t] for t in sorted(names)])

    def predict(self, df: DataFrame, unit: str, fold: str, features: Sequence[str] | str) -> DataFrame:
        """unit, fold and pred_<target> of each row by its fold's models; NaN where a fold has none."""
        x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(c).cast("double") for c in features)).cast("array<double>")
        rows = df.select(F.col(unit).alias("unit"), F.col(fold).cast("int").alias("fold"), x.alias("x"))
        by, cuts, targets = {(m.fold, m.target): m for m in self.models}, self.cuts, self.targets
        ship(df.sparkSession)

        def run(batches):
            for batch in batches:
                n = batch.num_rows
                folds = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
                bins = _bins(_array(batch.column(2), n), cuts) if n else np.zeros((0, len(cuts)), np.int16)
                out = np.full((n, len(targets)), np.nan)
                for k in np.unique(folds).tolist():
                    here = folds == k
                    for t in range(len(targets)):
                        if (k, t) in by:
                            out[here, t] = by[k, t].predict(bins[here])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(out[:, t]) for t in range(len(targets)))], [unit, fold, *(f"pred_{t}" for t in targets)])

        kind = rows.schema["unit"].dataType.simpleString()
        return rows.mapInArrow(run, ", ".join([f"`{unit}` {kind}, `{fold}` int", *(f"`pred_{t}` double" for t in targets)]))


def fitted(df: DataFrame, unit: str, fold: str, features: Sequence[str] | str, targets: Sequence[str], settings: Settings = Settings(), local_bytes: int = LOCAL_BYTES) -> Boosted:
    """Models of each fold's held-out rows and each target. Tables of up to local_bytes of binned features give each model a task;
    larger ones are passed over by jobs, with the same trees."""
    data = binned(df, unit, fold, features, targets, settings)
    models = _models(data, len(targets), settings)
    small = data.n * max(1, data.d) * 2 <= local_bytes
    done = (_fitted_in_tasks if small else _fitted_by_jobs)(data, models, settings) if models and data.d else models
    return Boosted(done, data.cuts, list(targets))


def boosted_oof(df: DataFrame, unit: str, fold: str, features: Sequence[str] | str, targets: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """unit, fold and pred_<target>: each row predicted by the models that didn't see its fold, of which a share of rows set aside
    by hash chose the number of rounds (all rounds are kept if there are none of them)."""
    return fitted(df, unit, fold, features, targets, settings).predict(df, unit, fold, features)
