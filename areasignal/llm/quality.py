"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areasignal.llm.common import arrow_map, in_fold, kind_of

#: The statistics of a text, in the order of `statistics`.
STATS = (
    "n_chars", "n_words", "n_lines", "word_length", "letters", "upper", "digits", "spaces", "symbols", "points", "pipes", "shouts", "marked_words", "repeated_lines", "repeated_words", "top_line", "line_length", "line_spread", "closed_lines", "short_words",
)
_BYTES = np.arange(256)
_UPPER, _DIGIT = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 48) & (_BYTES <= 57)
_LETTER = _UPPER | (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128)
_SPACE = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
_SYMBOL = np.isin(_BYTES, list(rb"#$%&*+<=>@\^_`{|}~"))
_POINT = np.isin(_BYTES, list(rb".,;:?!"))


def statistics(text: str | None) -> tuple[float, ...]:
    """Counts and shares of a whole text; of an empty one all are 0."""
    raw = (text or "").encode()
    if not raw:
        return (0.0,) * len(STATS)
    n, words = len(raw), raw.split()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()] or [b""]
    letters, n_words, n_lines = int(hist[_LETTER].sum()), max(1, len(words)), len(lines)
    kinds: dict[bytes, int] = {}
    for x in lines:
        kinds[x] = kinds.get(x, 0) + 1
    lengths = np.fromiter(map(len, lines), np.int64, n_lines)
    marked = sum(x[-1] < 128 and bool(_SYMBOL[x[-1]] or x[-1] == 33) for x in words)
    return (
        float(len(text)), float(len(words)), float(n_lines), (n - int(hist[_SPACE].sum())) / n_words, letters / n, int(hist[_UPPER].sum()) / max(1, letters), int(hist[_DIGIT].sum()) / n, int(hist[_SPACE].sum()) / n, int(hist[_SYMBOL].sum()) / n, int(hist[_POINT].sum()) / n,
        int(hist[124]) / n_words, int(hist[33]) / n_words, marked / n_words, 1 - len(kinds) / n_lines, 1 - len(set(words)) / n_words, max(kinds.values()) / n_lines if n_lines > 1 else 0.0, float(lengths.mean()), float(lengths.std() / max(1.0, lengths.mean())), sum(x.rstrip()[-1:] in (b".", b"?", b"!", b":") for x in lines) / n_lines, sum(len(x) < 3 for x in words) / n_words,
    )


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in keep and a column for each statistic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(x.as_py()) for x in batch.column(0)], np.float64).reshape(batch.num_rows, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(values[:, j]) for j in range(len(STATS)))], [id_col, *keep, *STATS])

    kinds = ", ".join([*(f"`{c}` {kind_of(df, c)}" for c in (id_col, *keep)), *(f"{s} double" for s in STATS)])
    return arrow_map(df.select(text_col, id_col, *keep), run, kinds)


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests (index of a statistic, whether it is above, threshold), and its weight."""

    tests: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def fires(self, x: np.ndarray) -> np.ndarray:
        return reduce(and_, ((x[:, j] > t) == above for j, above, t in self.tests))

    def column(self) -> Column:
        test = reduce(and_, (F.col(STATS[j]) > F.lit(t) if above else F.col(STATS[j]) <= F.lit(t) for j, above, t in self.tests))
        return F.when(test, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules and a bias; `score` is the column of the probability of label 1 over columns named as STATS."""

    rules: tuple[Rule, ...]
    bias: float

    def score(self) -> Column:
        return 1 / (1 + F.exp(-reduce(add, (r.column() for r in self.rules), F.lit(self.bias))))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r in self.rules:
            z += r.weight * r.fires(x)
        return 1 / (1 + np.exp(-z))


def _tree(bins: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, features: np.ndarray, depth: int, least: int) -> list[tuple[tuple[int, bool, float], ...]]:
    """The paths to all nodes of a regression tree with least squares, and its fit by way of `target`, which it reduces."""
    paths, todo = [], [((), np.arange(len(target)))]
    k = max(len(c) for c in cuts) + 1
    cell = bins[:, features] + np.arange(len(features)) * k  # all features' bins side by side
    while todo:
        path, rows = todo.pop()
        y, best = target[rows], None
        if len(path) < depth and len(rows) >= 2 * least:
            at = cell[rows].ravel()
            n = np.cumsum(np.bincount(at, minlength=len(features) * k).reshape(-1, k), axis=1)[:, :-1]
            s = np.cumsum(np.bincount(at, np.repeat(y, len(features)), minlength=len(features) * k).reshape(-1, k), axis=1)[:, :-1]
            ok = (n >= least) & (len(rows) - n >= least)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (y.sum() - s) ** 2 / np.maximum(len(rows) - n, 1) - y.sum() ** 2 / len(rows), 0)
            if gain.max(initial=0.0) > 1e-9:
                best = np.unravel_index(int(gain.argmax()), gain.shape)
        if best is None:
            target[rows] -= 0.3 * y.mean()
            continue
        j, c = features[best[0]], best[1]
        low = bins[rows, j] <= c
        for above, part in ((False, rows[low]), (True, rows[~low])):
            paths.append((*path, (int(j), above, float(cuts[j][c]))))
            todo.append((paths[-1], part))
    return paths


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, most: int = 64, penalty: float = 1e-3, seed: int = 7) -> RuleEnsemble:
    """Boosted trees give the rules, a lasso logistic regression their weights; at most `most` rules stay.

    With no rows, or rows of one class, the ensemble has no rules and scores the smoothed share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return RuleEnsemble((), bias)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 49))) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(cuts[j], x[:, j]) for j in range(x.shape[1])], axis=1)
    target, paths = y - y.mean(), {}
    for _ in range(trees):
        features = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False))
        paths |= dict.fromkeys(_tree(bins, cuts, target, features, depth, max(1, len(y) // 500)))
    rules, seen = [], set()
    for path in paths:
        fires = Rule(path).fires(x)
        if 0 < fires.sum() < len(y) and (key := np.packbits(fires).tobytes()) not in seen:
            seen.add(key)
            rules.append((Rule(path), fires))
    if not rules:
        return RuleEnsemble((), bias)

    def lasso(chosen: list, weight: float, steps: int = 400) -> tuple[np.ndarray, float]:
        """FISTA; the bias has no penalty."""
        a = np.stack([f for _, f in chosen], axis=1).astype(np.float32)
        mean = a.mean(axis=0, dtype=np.float64)
        a -= mean.astype(np.float32)
        rate = 4 * len(y) / (float(np.linalg.eigvalsh((a.T @ a).astype(np.float64))[-1]) + 1e-9)
        w = v = np.zeros(a.shape[1])
        b, t = bias, 1.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a @ v.astype(np.float32) + b)))
            b -= 2.0 * float((p - y).mean())
            new = v - rate * (a.T @ (p - y).astype(np.float32)) / len(y)
            new = np.sign(new) * np.maximum(np.abs(new) - rate * weight, 0)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            moved = float(np.abs(new - w).max())
            w, v, t = new, new + (t - 1) / t2 * (new - w), t2
            if moved < 1e-5:
                break
        return w, b - float(mean @ w)

    w, _ = lasso(rules, penalty)
    order = [i for i in np.argsort(-np.abs(w), kind="stable")[:most] if w[i]]
    if not order:
        return RuleEnsemble((), bias)
    kept = [rules[i] for i in order]
    w, b = lasso(kept, penalty / 10)
    return RuleEnsemble(tuple(Rule(r.tests, float(x)) for (r, _), x in zip(kept, w) if x), b)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> RuleEnsemble:
    """Fits on the labelled rows that aren't held out (`in_fold`), at most max_rows of them: those least by a hash of the id.

    That bound keeps what is broadcast and collected (20 numbers a row) at a few MB. Null labels and ids are left
    out; an id with several labels or texts counts once, with the least.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~in_fold(F.col(id_col)))
    rows = rows.groupBy(F.col(id_col).alias("_key")).agg(F.min(F.col(label_col).cast("double")).alias("_label"))
    chosen = rows.orderBy(F.xxhash64("_key"), "_key").limit(max_rows)
    part = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_key")
    found = with_statistics(part, "_key", "_text", ("_label",)).groupBy("_key").agg(F.min(F.struct(*STATS)).alias("s"), F.min("_label").alias("y"))
    found = sorted(found.select("_key", "s", "y").collect())
    return fit_rules(np.array([tuple(r.s) for r in found], np.float64).reshape(-1, len(STATS)), np.array([r.y for r in found], np.float64))


def score_quality(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id_col, held_out, score (0 to 1, of the text alone) and predicted (1 if score >= threshold).

    Null and empty texts have statistics of 0 and are scored by them. Repeated rows give repeated results; other columns
    don't matter.
    """
    rows = with_statistics(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__id", "__text")
    scored = rows.select(F.col("__id").alias(id_col), in_fold(F.col("__id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least the threshold."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    rows = with_statistics(plain, names[0], names[docs.columns.index(text_col)], tuple(names[1:]))
    return rows.where(model.score() >= threshold).select(*names).toDF(*docs.columns)
