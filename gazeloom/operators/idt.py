"""Fixations by dispersion threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeloom.operators.islands import with_running_sums
from gazeloom.operators.ordered import in_blocks

SEGMENTS = 256
"""Segments that are dealt to a task together."""


def dispersion_fixations(df: DataFrame, keys: list[str], order: str, time: str, dispersion: float, duration: int) -> DataFrame:
    """Fixations: (keys, first_at, n, x, y, t), in rows counted from 0.

    A window of `duration` rows whose dispersion (range of x plus range of y) is within the limit
    grows while it stays so, but not to the key's last row; it gives its centroid and first time,
    and the search goes on after it. Otherwise the window moves on by a row.

    Where x and y step by more than the limit together, no window reaches across, and the search
    always stops at the row after the step. The segments between such steps are therefore
    independent: they are searched in parallel, whatever the key's length, in one pass over each
    task's sorted rows. A row with a missing coordinate is in no window.
    """
    if duration < 1:
        raise ValueError("duration must be at least 1")
    w = W.partitionBy(*keys, "_block").orderBy("_at")
    placed = in_blocks(df, keys, order, 1, 1)
    step = F.abs(F.col("x") - F.lag("x").over(w)) + F.abs(F.col("y") - F.lag("y").over(w))
    apart = ~F.coalesce(step <= dispersion, F.lit(False))
    rows = placed.withColumn("_cut", apart.cast("bigint")).withColumn("_last", F.lead("_at").over(w).isNull()).where("_core")
    rows = rows.select(*keys, F.col("_at").alias("at"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(time).cast("double").alias("t"), "_cut", "_last")
    segments = with_running_sums(rows, keys, "at", {"segment": F.col("_cut")})
    dealt = segments.withColumn("_hand", F.floor(F.col("segment") / SEGMENTS)).repartition(*keys, "_hand").sortWithinPartitions(*keys, "segment", "at")
    schema = T.StructType(
        [dealt.schema[k] for k in keys]
        + [T.StructField("first_at", T.LongType()), T.StructField("n", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("x", "y", "t")]
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            cut = _segment_starts(batch, keys)
            if len(cut):
                done, rest = batch.iloc[: cut[-1]], batch.iloc[cut[-1] :]
                yield _search(done, keys, dispersion, duration)[schema.names]
            else:
                rest = batch
        if rest is not None and len(rest):
            yield _search(rest, keys, dispersion, duration)[schema.names]

    return dealt.mapInPandas(search, schema)


def _segment_starts(batch: pd.DataFrame, keys: list[str]) -> np.ndarray:
    change = np.zeros(len(batch), bool)
    for column in (*keys, "segment"):
        values = batch[column].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def _search(rows: pd.DataFrame, keys: list[str], dispersion: float, duration: int) -> pd.DataFrame:
    starts = np.concatenate([[0], _segment_starts(rows, keys), [len(rows)]]).astype(int)
    x, y, last = rows["x"].to_numpy(), rows["y"].to_numpy(), rows["_last"].to_numpy()
    found = []
    for begin, end in zip(starts[:-1], starts[1:]):
        if end - begin >= duration:
            found += _windows(x, y, begin, end, end - 1 if last[end - 1] else end, dispersion, duration)
    first = np.array([f for f, _ in found], int)
    out = rows.iloc[first][[*keys, "at", "t"]].rename(columns={"at": "first_at"}).reset_index(drop=True)
    out["n"] = [n for _, n in found]
    out["x"] = [x[f : f + n].mean() for f, n in found]
    out["y"] = [y[f : f + n].mean() for f, n in found]
    return out


def _windows(x: np.ndarray, y: np.ndarray, begin: int, end: int, limit: int, dispersion: float, duration: int) -> list[tuple[int, int]]:
    """First row and length of each fixation in [begin, end); a window grows into rows before `limit` only."""
    found, i = [], begin
    while i + duration <= end:
        stop = i + duration
        low_x, high_x, low_y, high_y = x[i:stop].min(), x[i:stop].max(), y[i:stop].min(), y[i:stop].max()
        if not high_x - low_x + high_y - low_y <= dispersion:
            i += 1
            continue
        while stop < limit:
            a, b, c, d = min(low_x, x[stop]), max(high_x, x[stop]), min(low_y, y[stop]), max(high_y, y[stop])
            if not b - a + d - c <= dispersion:
                break
            low_x, high_x, low_y, high_y, stop = a, b, c, d, stop + 1
        found.append((i, stop - i))
        i = stop
    return found
