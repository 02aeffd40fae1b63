"""Statistics of movement labels and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazeloom.operators.ordered import in_blocks


def label_percentages(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Per group and label: n and percent of all rows of the group; rows without a label count in the total only."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(1)))
    return counts.withColumn("percent", F.try_divide(F.col("n") * 100.0, total)).where(F.col(label).isNotNull())


def transitions(df: DataFrame, keys: list[str], order: str, time: str, label: str, pair: tuple[int, int]) -> DataFrame:
    """Rows that change between the two labels, either way: (keys, at, from_label, to_label, distance, gap)."""
    placed = in_blocks(df, keys, order, 1)
    w = W.partitionBy(*keys, "_block").orderBy("_at")
    dx, dy, dt = (F.col(c) - F.lag(c).over(w) for c in ("x", "y", time))
    rows = placed.select(
        *keys, F.col("_at").alias("at"), "_core", F.lag(label).over(w).alias("from_label"), F.col(label).alias("to_label"),
        F.sqrt(dx * dx + dy * dy).alias("distance"), F.abs(dt).alias("gap"),
    )
    a, b = pair
    change = ((F.col("from_label") == a) & (F.col("to_label") == b)) | ((F.col("from_label") == b) & (F.col("to_label") == a))
    return rows.where("_core").where(change).drop("_core")


def transition_summary(changes: DataFrame, by: list[str]) -> DataFrame:
    """n, mean and population standard deviation of distance, least and mean gap."""
    return changes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"), F.stddev_pop("distance").alias("std_distance"),
        F.min("gap").alias("least_gap"), F.avg("gap").alias("mean_gap"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def quality_counts(df: DataFrame, by: list[str], invalid: Column) -> DataFrame:
    """Per group: rows, invalid rows and their percentage."""
    n, bad = F.count(F.lit(1)), F.count_if(F.coalesce(invalid, F.lit(False)))
    return df.groupBy(*by).agg(n.alias("n"), bad.alias("n_invalid"), F.try_divide(bad * 100.0, n).alias("percent_invalid"))
