"""Arrays as vectors, and transforms of targets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modalities in the order of their blocks in a vector.
MODALITIES = ("sat", "ntl", "sv", "poi")
#: How near a share may come to 0 and 1.
EPS = 1e-3


def masked(vector: Column, width: int, ablate: Iterable[str] = (), keep: Iterable[str] | None = None) -> Column:
    """The vector with zeros in the blocks to ablate, or in all but those to keep (which wins)."""
    off = set(MODALITIES) - set(keep) if keep is not None else set(ablate)
    if unknown := off - set(MODALITIES) | (set(keep or ()) - set(MODALITIES)):
        raise ValueError(f"unknown modalities {sorted(unknown)}")
    blocks = [i for i, m in enumerate(MODALITIES) if m in off]
    if not blocks:
        return vector
    return F.transform(vector, lambda x, i: F.when(F.floor(i / width).isin(blocks), F.lit(0.0)).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(vector: Column) -> Column:
    """The vector over its length; of length 0 as it is."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def to_logit(score: Column, low: float = 1.0, high: float = 10.0) -> Column:
    """A score's share of the range, kept off its ends, in log odds."""
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), (score.cast("double") - low) / (high - low)))
    return F.ln(p / (1 - p))


def from_logit(y: Column, low: float = 1.0, high: float = 10.0) -> Column:
    return low + (high - low) / (1 + F.exp(-y))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ordinal(x: Column, low: int = 1, high: int = 10) -> Column:
    """Rounded half to even and clipped."""
    return clipped(F.bround(x), low, high).cast("int")


def finite(*columns: Column) -> Column:
    """Whether all are numbers."""
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf"))
    return out


def not_nan(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)
