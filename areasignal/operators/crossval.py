"""Runs of cross-validation by their settings: features put together without leaks, fits, predictions out of fold, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areasignal.config import RunConfig, feature_blocks
from areasignal.functions.vectors import from_logit, masked, to_logit
from areasignal.operators import boosting, learn, metrics, spatial, tables
from areasignal.operators.encode import widened
from areasignal.session import written


def assembled(config: RunConfig, units: DataFrame, unit: str, targets: Sequence[str], edges: DataFrame, blocks: dict[str, list[str]], embedding: tuple[str, int] | None = None) -> tuple[DataFrame, list[str], list[tuple[str, int, int]]]:
    """The rows of a run with all its features, their columns in order, and where each block starts and ends among them.

    units has a row for each unit with fold, targets, the columns of the blocks (poi, coordinates, indicators, ratios) and an
    embedding (column and width of a modality). Lags of features read all units, lags of targets only other folds, means for
    nulls only other folds.
    """
    folds = list(range(config.folds))
    rows, blocks = written(units), dict(blocks)
    if embedding and config.use_embedding:
        column, width = embedding
        rows = rows.withColumn(column, masked(F.col(column), width, config.ablate, config.keep))
        rows, blocks["embedding"] = widened(rows, column, 4 * width)
        if config.pca_components:
            parts = learn.pca_oof(rows, unit, "fold", blocks["embedding"], config.pca_components)
            names = [c for c in parts.columns if c not in (unit, "fold")]
            rows, blocks["embedding"] = rows.drop(*blocks["embedding"]).join(parts.drop("fold"), unit), names
    base = blocks.get("embedding") or blocks.get("poi") or []
    if config.use_ego_gap and base:
        gap = spatial.ego_gap(rows, unit, base, edges)
        rows, blocks["ego_gap"] = rows.join(gap, unit), [f"{c}_gap" for c in base]
    if config.use_neighbour_mean and base:
        lag = spatial.neighbour_means(rows, unit, base, edges)
        rows, blocks["neighbour_mean"] = rows.join(lag, unit), [f"{c}_lag" for c in base]
    if config.use_target_lag:
        lag = spatial.target_lag(rows, unit, "fold", list(targets), edges, folds).where("held_out = fold").drop("held_out", "fold")
        rows, blocks["target_lag"] = rows.join(lag, unit), [f"{t}_lag" for t in targets]
    if config.ratio_columns:
        names = tables.select_columns(rows.columns, config.ratio_columns)
        full = tables.impute_by_fold(rows.select(unit, "fold", *names), "fold", names, folds).where("held_out = fold").drop("held_out", "fold")
        rows, blocks["ratios"] = rows.drop(*names).join(full, unit), names
    return rows, *feature_blocks(config, blocks)


def run(config: RunConfig, units: DataFrame, unit: str, targets: Sequence[str], edges: DataFrame, blocks: dict[str, list[str]], embedding: tuple[str, int] | None = None) -> DataFrame:
    """unit, fold and pred_<target> of one run (`assembled` says what it reads); each model is fitted without the fold it predicts."""
    rows, features, _ = assembled(config, units, unit, targets, edges, blocks, embedding)
    rows = written(rows)  # fits read them several times
    if config.logit_target:
        rows = rows.withColumns({t: to_logit(F.col(t)) for t in targets})
    if config.regressor == "boosted":
        out = boosting.boosted_oof(rows, unit, "fold", features, targets, boosting.Settings(**dict(config.boosting)))
    elif config.regressor in ("ridge", "lasso", "elastic"):
        out = learn.linear_oof(rows, unit, "fold", features, targets, config.regressor)
    else:
        raise ValueError(f"unknown regressor {config.regressor!r}")
    return out.select(unit, "fold", *(from_logit(F.col(f"pred_{t}")).alias(f"pred_{t}") for t in targets)) if config.logit_target else out


def summary(oof: DataFrame, units: DataFrame, unit: str, targets: Sequence[str]) -> DataFrame:
    """domain (each target, pooled and macro), n, rho and r2 of predictions against the units' targets."""
    wide = oof.join(units.select(unit, *(F.col(t).alias(f"target_{t}") for t in targets)), unit)
    long = metrics.also_pooled(metrics.unpivoted(wide, [unit], targets))
    one = written(metrics.scores(long, "y", "p", ["domain"]).select("domain", "n", "rho", "r2"))
    return one.union(one.where("domain <> 'pooled'").agg(F.lit("macro"), F.sum("n"), F.avg("rho"), F.avg("r2")))


def compared(runs: dict[str, DataFrame], units: DataFrame, unit: str, targets: Sequence[str]) -> DataFrame:
    """run, pooled_rho and pooled_r2 of several runs, and their differences from the first."""
    out = None
    for i, (name, oof) in enumerate(runs.items()):
        wide = oof.join(units.select(unit, *(F.col(t).alias(f"target_{t}") for t in targets)), unit)
        row = metrics.pooled(metrics.unpivoted(wide, [unit], targets)).select(F.lit(i).alias("run_ord"), F.lit(name).alias("run"), "n", "pooled_rho", "pooled_r2")
        out = row if out is None else out.union(row)
    return metrics.deltas(out, "run", "run_ord", ["pooled_rho", "pooled_r2"])
