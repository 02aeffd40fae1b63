"""Fixed-length sequences, model windows and votes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeloom.functions.scalars import argmax


def padded(df: DataFrame, keys: list[str], order: str, features: list[str], length: int, fill: float = -1.0) -> DataFrame:
    """One row per key: n_rows and sequence, the last `length` rows' features by order, filled up at the end.

    Only the rows that are kept are gathered: each partial result holds at most `length` of them.
    """
    value = F.struct((-F.col(order)).alias("o"), F.array(*[F.col(f).cast("double") for f in features]).alias("f"))
    ranked = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.max(order).alias("_last"))
    recent = _last_rows(df.select(*keys, order, *features), keys, order, length)
    rows = recent.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_rows")).join(ranked, keys)
    kept = F.reverse(F.transform("_rows", lambda r: r["f"]))
    blank = F.array_repeat(F.array(*[F.lit(fill) for _ in features]), length)
    return rows.select(*keys, "n_rows", F.slice(F.concat(kept, blank), 1, length).alias("sequence"))


def _last_rows(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def not_finite(sequence: Column) -> Column:
    """True if any number of an array of arrays is NaN or infinite."""
    return F.exists(sequence, lambda row: F.exists(row, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))


def model_windows(df: DataFrame, keys: list[str], at: str, inner: int, outer: int) -> DataFrame:
    """Each row in the model windows it is needed in: (df, window, place, inside).

    Windows of `outer` rows overlap by their margins of (outer - inner) // 2 rows on both sides;
    inside marks the `inner` rows whose prediction counts, so that they tile the key.
    """
    margin = (outer - inner) // 2
    low = F.floor((F.col(at) - (outer - margin - 1)) / inner)
    first = F.greatest(F.when(low * inner < F.col(at) - (outer - margin - 1), low + 1).otherwise(low), F.lit(0))
    windows = df.withColumn("window", F.explode(F.sequence(first, F.floor((F.col(at) + margin) / inner))))
    place = F.col(at) + margin - F.col("window") * inner
    return windows.withColumn("place", place).withColumn("inside", (place >= margin) & (place < margin + inner))


def majority(votes: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """The most frequent vote of each key, the smallest of equals; nulls don't vote. Counts are added up before they meet."""
    counts = votes.where(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by(vote, F.struct("_n", (-F.col(vote)).alias("_v"))).alias(vote))


def best_classes(scores: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the place of the largest score."""
    return scores.withColumn(out, argmax(F.col(column)))


def stitched(predictions: DataFrame, scores: str, out: str) -> DataFrame:
    """One row per row of the keys, from the predictions of model_windows: the class of the largest score where the row counts."""
    return best_classes(predictions.where("inside"), scores, out).drop("window", "place", "inside", scores)


def encoded(sequence: Column, width: int) -> Column:
    """A sequence of vectors of the given width plus their positions, as sines and cosines of falling frequency."""
    frequency = lambda j: F.exp((j - j % 2) * (-math.log(10_000.0) / width))
    wave = lambda i, j: F.when(j % 2 == 0, F.sin(i * frequency(j))).otherwise(F.cos(i * frequency(j)))
    return F.transform(sequence, lambda row, i: F.transform(row, lambda v, j: v + wave(i, j)))
