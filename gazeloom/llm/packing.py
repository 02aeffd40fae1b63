"""Filling containers of fixed capacity with items, best-two-fit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeloom.operators.ordered import with_position
from gazeloom.session import cut_lineage

CHUNKS = 1024
"""Parts into which the items of one size are cut to number them."""


@dataclass
class Plan:
    """For ranges of items of one size: key = size << 40 | rank of the range's first item."""

    key: np.ndarray
    first_container: np.ndarray
    per_container: np.ndarray
    containers: int


def pattern(counts: np.ndarray, capacity: int) -> list[int]:
    """The sizes that go into the next container, best-two-fit, out of counts[size] items of each.

    The largest item that fits goes in until none does. Then the smallest item but the first is
    replaced by two that together fill more of the room it leaves, if there are such.
    """
    left = counts.copy()
    sizes = np.flatnonzero(left)
    chosen: list[int] = []
    room = capacity
    while room > 0:
        at = np.searchsorted(sizes, room, side="right")
        while at and left[sizes[at - 1]] == 0:
            at -= 1
        if not at:
            break
        size = int(sizes[at - 1])
        chosen.append(size)
        left[size] -= 1
        room -= size
    if room > 0 and len(chosen) > 1:
        smallest = chosen[-1]
        gap = room + smallest
        a = sizes[(sizes < gap) & (left[sizes] > 0)]
        if len(a):
            partner = np.searchsorted(a, gap - a, side="right") - 1
            b = np.where(partner >= 0, a[partner], 0)
            alone = (b == a) & (left[a] < 2)
            lower = np.where(partner > 0, a[np.maximum(partner - 1, 0)], 0)
            b = np.where(alone, lower, b)
            filled = np.where(b > 0, a + b, 0)
            best = int(np.argmax(filled))
            if filled[best] > smallest:
                chosen[-1:] = [int(a[best]), int(b[best])]
    return chosen


def plan_containers(counts: np.ndarray, capacity: int) -> Plan:
    """Applies each pattern to as many containers as the counts allow.

    Every application uses up a size, so the plan's length follows from the capacity, not from the
    number of items.
    """
    left = counts.copy()
    used = np.zeros_like(left)
    rows, containers = [], 0
    while left.any():
        sizes, uses = np.unique(pattern(left, capacity), return_counts=True)
        times = int((left[sizes] // uses).min())
        for size, n in zip(sizes.tolist(), uses.tolist()):
            rows.append((size << 40 | int(used[size]), containers, n))
        left[sizes] -= uses * times
        used[sizes] += uses * times
        containers += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return Plan(table[:, 0], table[:, 1], table[:, 2], containers)


def parts(items: DataFrame, size: str, capacity: int) -> DataFrame:
    """Items with columns part and part_size: one row each, more for an item above the capacity."""
    full = F.floor(F.col(size) / capacity)
    n = F.greatest(F.ceil(F.col(size) / capacity), F.lit(1))
    divided = items.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return divided.withColumn("part_size", F.when(F.col("part") < full, F.lit(capacity)).otherwise(F.col(size) - full * capacity).cast("bigint"))


def pack(items: DataFrame, ident: str, size: Column, capacity: int) -> DataFrame:
    """Assigns every item to a container: (ident, part, part_size, container_id).

    Only an item larger than the capacity is divided, into parts of the capacity and one rest.
    Rows with a null ident or size are not items; repeated idents are one item each if their sizes
    agree (a larger size wins). Items of size 0 take no room and are spread over the containers; if
    there are only such, they share container 0. Negative sizes count as 0. No items, no rows.

    Which item of a size goes where is of no account, so the plan is made on the counts per size:
    at most `capacity` numbers reach the driver whatever the number of items, and each pattern of a
    container applies to as many containers as there are items for. Items learn their place from
    their number among those of their size, counted in CHUNKS parts so that no task holds a size as
    a whole. The sizes are written once, since measuring them may cost much.
    """
    measured = items.select(F.col(ident).alias("_id"), size.cast("bigint").alias("_size")).dropna().withColumn("_size", F.greatest("_size", F.lit(0)))
    measured = measured.groupBy("_id").agg(F.max("_size").alias("_size"))
    measured = cut_lineage(measured)
    rows = parts(measured, "_size", capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for size_, n in rows.where("part_size > 0").groupBy("part_size").count().collect():  # at most capacity rows
        counts[size_] = n
    plan = plan_containers(counts, capacity)
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("_id", "part"), F.lit(CHUNKS)))
    numbered = with_position(rows, ["part_size"], "_chunk", ["_id", "part"], "_rank")

    @F.pandas_udf("bigint")
    def container(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        sizes, ranks = sizes.to_numpy(np.int64), ranks.to_numpy(np.int64)
        if not plan.containers:
            return pd.Series(np.zeros(len(sizes), np.int64))
        key = sizes << 40 | ranks
        row = np.maximum(np.searchsorted(plan.key, key, side="right") - 1, 0)
        place = plan.first_container[row] + (key - plan.key[row]) // plan.per_container[row]
        return pd.Series(np.where(sizes > 0, place, ranks % plan.containers))

    return numbered.select(F.col("_id").alias(ident), "part", "part_size", container("part_size", "_rank").alias("container_id"))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items (parts), size, and the share of the containers' room in use."""
    sums = packed.agg(
        F.count_distinct("container_id").alias("n_containers"), F.count(F.lit(1)).alias("n_parts"), F.coalesce(F.sum("part_size"), F.lit(0)).alias("total_size")
    )
    return sums.withColumn("fill", F.try_divide(F.col("total_size").cast("double"), F.col("n_containers") * F.lit(capacity)))
