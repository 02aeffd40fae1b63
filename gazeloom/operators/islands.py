"""Numbering stretches of an ordered series, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazeloom.operators.ordered import prefix_sums


def with_running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], chunk_rows: int = 1 << 14) -> DataFrame:
    """Adds, for each name of sums, its total over the rows of the key up to and with each row.

    order is a number; a chunk is a stretch of chunk_rows of it. Sums run within chunks, on top of
    the totals of the chunks before.
    """
    rows = df.withColumn("_part", F.floor(F.col(order) / chunk_rows)).withColumns({f"_s{i}": c for i, c in enumerate(sums.values())})
    rows = rows.where(F.col("_part").isNotNull()).repartition(*keys, "_part")
    before = prefix_sums(rows, keys, "_part", {f"_b{i}": F.col(f"_s{i}") for i in range(len(sums))})
    inside = W.partitionBy(*keys, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({f"_r{i}": F.sum(f"_s{i}").over(inside) for i in range(len(sums))}).join(before, [*keys, "_part"])
    out = out.withColumns({n: F.col(f"_b{i}") + F.col(f"_r{i}") for i, n in enumerate(sums)})
    return out.drop("_part", *[f"{p}{i}" for p in ("_s", "_b", "_r") for i in range(len(sums))])
