"""Settings of a run: what feature blocks it uses, how it is fitted and cut into folds."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class RunConfig:
    """One run of cross-validation. Blocks are joined in the order of `feature_blocks`."""

    name: str = "baseline"
    caption_mode: str = "modality"
    regressor: str = "ridge"
    folds: int = 5
    seed: int = 42
    ablate: tuple[str, ...] = ()
    keep: tuple[str, ...] | None = None
    use_embedding: bool = True
    use_poi: bool = True
    use_ego_gap: bool = True
    use_neighbour_mean: bool = False
    use_target_lag: bool = True
    use_coordinates: bool = False
    use_indicators: bool = False
    ratio_columns: tuple[str, ...] = ()
    pca_components: int = 0
    logit_target: bool = False
    #: Settings of boosted trees that differ from the defaults, as pairs of name and value; a mapping in files.
    boosting: tuple[tuple[str, float], ...] = ()

    @classmethod
    def of(cls, *layers: dict) -> RunConfig:
        """Defaults, then each layer in turn (a file's, the command line's); unknown names are an error."""
        names = {f.name for f in fields(cls)}
        out = cls()
        for layer in layers:
            if unknown := set(layer) - names:
                raise ValueError(f"unknown settings {sorted(unknown)}")
            out = replace(out, **{k: tuple(v) if isinstance(v, list) else tuple(v.items()) if isinstance(v, dict) else v for k, v in layer.items() if v is not None})
        return out


#: What runs that look at residuals start from: most blocks are on.
DIAGNOSTICS = {"name": "diagnostics", "use_coordinates": True, "use_indicators": True, "use_neighbour_mean": False}


def manifest(path: str, base_dir: str | None = None) -> tuple[list[RunConfig], dict[str, str]]:
    """The runs of a file of JSON or YAML, {"defaults": {...}, "runs": [{...}, ...], "paths": {...}}, and its paths, which lie
    under the base folder (the file's own if none is given) unless they are absolute."""
    from areasignal import settings_files

    found = settings_files.read(path)
    base = base_dir or os.path.dirname(os.path.abspath(path))
    runs = [RunConfig.of(found.get("defaults") or {}, layer) for layer in found["runs"]]
    if len({r.name for r in runs}) < len(runs):
        raise ValueError("runs of one name")
    return runs, {k: p if os.path.isabs(p) or "://" in p else os.path.join(base, p) for k, p in (found.get("paths") or {}).items()}


def even(size: int) -> int:
    """A size that must be even and above 0."""
    if size <= 0 or size % 2:
        raise ValueError(f"{size} isn't even and above 0")
    return size


def chosen(runs: list[RunConfig], only: list[str] | None) -> list[RunConfig]:
    """The runs named, in the manifest's order."""
    if only and (missing := set(only) - {r.name for r in runs}):
        raise ValueError(f"no runs {sorted(missing)}")
    return [r for r in runs if not only or r.name in only]


def feature_blocks(config: RunConfig, blocks: dict[str, list[str]]) -> tuple[list[str], list[tuple[str, int, int]]]:
    """The columns that a run uses, and where each block starts and ends among them."""
    use = {"embedding": config.use_embedding, "poi": config.use_poi, "ego_gap": config.use_ego_gap, "neighbour_mean": config.use_neighbour_mean, "target_lag": config.use_target_lag, "coordinates": config.use_coordinates, "indicators": config.use_indicators, "ratios": bool(config.ratio_columns)}
    columns: list[str] = []
    slices = []
    for name, used in use.items():
        if used and blocks.get(name):
            slices.append((name, len(columns), len(columns) + len(blocks[name])))
            columns += blocks[name]
    return columns, slices
