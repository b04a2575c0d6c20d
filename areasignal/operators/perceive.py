"""Interfaces for what needs images, networks or weights; stand-ins that need none, so that all else can run and be tested."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areasignal.functions.geo import hashed_unit
from areasignal.operators.tables import PIXEL_CLASSES


class Perceiver(Protocol):
    """Turns an image's path into an array of phrases."""

    def __call__(self, path: Column) -> Column: ...


class Segmenter(Protocol):
    """Turns an image's path into an array of pixel classes (channel numbers)."""

    def __call__(self, path: Column) -> Column: ...


def stand_in_phrases(words: Sequence[str], most: int = 5) -> Perceiver:
    """Phrases of a list by hashes of the path."""
    pool = F.array(*map(F.lit, words))
    return lambda path: F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.get(pool, F.floor(hashed_unit(path, i) * len(words)).cast("int"))))


def stand_in_classes(pixels: int = 64) -> Segmenter:
    """Pixel classes by hashes of the path, most of them kept ones."""
    pool = F.array(*map(F.lit, [*PIXEL_CLASSES, 149]))
    return lambda path: F.transform(F.sequence(F.lit(1), F.lit(pixels)), lambda i: F.get(pool, F.floor(hashed_unit(path, i) * (len(PIXEL_CLASSES) + 1)).cast("int")))


def perceived(images: DataFrame, unit: str, path: str, perceive: Perceiver, retry: Perceiver | None = None) -> DataFrame:
    """unit, path and phrases of each image; images without any are asked once more by `retry`."""
    first = perceive(F.col(path))
    phrases = F.when(F.size(first) > 0, first).otherwise(retry(F.col(path))) if retry else first
    return images.select(unit, path, phrases.alias("phrases"))


def backfilled(records: DataFrame, key: str, made: DataFrame, column: str) -> DataFrame:
    """records with a missing or empty column taken from another table, all else as it was."""
    other = made.select(key, F.col(column).alias("_new"))
    empty = F.col(column).isNull() | (F.size(column) == 0)
    return records.join(other, key, "left").withColumn(column, F.when(empty, F.coalesce("_new", column)).otherwise(F.col(column))).select(*records.columns)
