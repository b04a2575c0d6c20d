"""Texts as vectors: an interface for encoders, a hashed stand-in without weights, and pooling by modality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areasignal.functions.geo import named
from areasignal.functions.text import NO_EVIDENCE, split_segment
from areasignal.functions.vectors import MODALITIES
from areasignal.session import written

#: An encoder takes a column of texts and gives a column of vectors of one width.
Encoder = Callable[[Column], Column]


def hashed(width: int = 64, seed: int = 42) -> Encoder:
    """Words and pairs of words counted with a sign at places by MD5, scaled to length 1; zeros of a null text or one
    without words. Built-ins alone: it stands where a language model would."""

    def slot(gram: Column) -> Column:
        """Twice the gram's place, and one more if its sign is plus."""
        return (F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(str(seed)), gram)), 1, 8), 16, 10).cast("long") % (2 * width)).cast("int")

    def counted(grams: Column) -> Column:
        without = lambda slots, i: F.size(F.array_remove(slots, i))
        return named(F.transform(grams, slot), lambda s: F.array(*((without(s, 2 * i) - without(s, 2 * i + 1)).cast("double") for i in range(width))))

    def scaled(sums: Column) -> Column:
        length = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x * x))
        return named(length, lambda n: F.transform(sums, lambda x: F.when(n > 0, x / n).otherwise(x)))

    def encode(text: Column) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
        pairs = lambda w: F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())
        return named(named(words, lambda w: counted(F.concat(w, pairs(w)))), scaled)

    return encode


ENCODERS: dict[str, Callable[..., Encoder]] = {"hashed": hashed}


def encoder(name: str, **settings) -> Encoder:
    """An encoder by name; others can be put into ENCODERS."""
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name!r}")
    return ENCODERS[name](**settings)


def masked_mean(states: Column, mask: Column) -> Column:
    """The mean of token vectors (an array of arrays) where the mask is 1; zeros without any."""
    width = F.size(F.get(states, F.lit(0)))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1.0))
    add = lambda a, x: F.zip_with(a, x, lambda p, q: p + q)
    weighted = F.zip_with(states, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(weighted, F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0)), add)
    return F.transform(total, lambda x: x / n)


def by_modality(df: DataFrame, unit: str, encode: Encoder, width: int) -> DataFrame:
    """unit and a vector of four blocks (sat, ntl, sv, poi): three texts as they are, street phrases encoded one by one and
    averaged; without phrases the marker is encoded. Each distinct phrase is encoded once, however many units have it."""
    df = written(df.select(unit, "sat", "ntl", "poi_text", "sv"))
    one = df.select(unit, *(encode(F.coalesce(F.col(c), F.lit(NO_EVIDENCE[m]))).alias(f"_{m}") for m, c in (("sat", "sat"), ("ntl", "ntl"), ("poi", "poi_text"))))
    phrases = split_segment(F.col("sv"))
    long = df.select(unit, F.explode(F.when(F.size(phrases) > 0, phrases).otherwise(F.array(F.lit(NO_EVIDENCE["sv"])))).alias("_p"))
    codes = written(long.select("_p").distinct().select("_p", encode(F.col("_p")).alias("_v")))
    means = long.join(codes, "_p").groupBy(unit).agg(*(F.avg(F.get("_v", F.lit(i))).alias(f"_{i}") for i in range(width)))
    pooled = means.select(unit, F.array(*(f"_{i}" for i in range(width))).alias("_sv"))
    return one.join(pooled, unit).select(unit, F.concat(*(F.col(f"_{m}") for m in MODALITIES)).alias("embedding"))


def widened(df: DataFrame, vector: str, width: int, prefix: str = "e") -> tuple[DataFrame, list[str]]:
    """df with a column for each component."""
    names = [f"{prefix}{i}" for i in range(width)]
    return df.withColumns({n: F.get(vector, F.lit(i)) for i, n in enumerate(names)}), names
