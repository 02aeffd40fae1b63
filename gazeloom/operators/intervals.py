"""Overlapping and gapped time intervals per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazeloom.operators.ordered import known, prefix_sums, with_next

CHUNK_S = 600
"""Seconds of an entity that one window holds."""


def covered_periods(df: DataFrame, keys: list[str], ident: str, start_us: str, end_us: str) -> DataFrame:
    """Continuous periods that intervals cover together, and the gaps between them.

    Result: kind ('period' or 'gap'), keys, start_us, end_us, n_intervals (0 for a gap). Intervals
    that overlap, nest or touch form one period; an interval without length is a point of it. Of
    rows with the same keys, ident, start and end one counts, as does each of several intervals
    with one ident. Rows with a null key or time, or with the end before the start, are no
    intervals. An empty table gives an empty result; other columns are ignored.

    Sweep line: a boundary adds one at a start and takes one at an end, starts before ends at the
    same time, and the prefix sum is the number of intervals then active. A period begins where it
    rises from 0 and ends where it falls back to 0. Boundaries with equal time are added up first,
    and the sums run per CHUNK_S seconds on top of a prefix of the chunks' totals, so no window
    holds an entity as a whole.
    """
    intervals = df.select(*keys, F.col(ident).alias("_id"), F.col(start_us).alias("_start"), F.col(end_us).alias("_end"))
    intervals = known(intervals, [*keys, "_start", "_end"]).where("_start <= _end").dropDuplicates()
    sides = F.array(F.struct(F.col("_start").alias("t"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("_end").alias("t"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    boundaries = intervals.select(*keys, F.inline(sides)).withColumn("_chunk", F.floor(F.col("t") / (CHUNK_S * 1_000_000)))
    boundaries = boundaries.groupBy(*keys, "_chunk", "t").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    boundaries = known(boundaries, ["_chunk"]).repartition(*keys, "_chunk")
    earlier = prefix_sums(boundaries, keys, "_chunk", {"_up": F.col("up"), "_down": F.col("down")})
    inside = W.partitionBy(*keys, "_chunk").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    counts = boundaries.join(earlier, [*keys, "_chunk"]).select(
        *keys, "_chunk", "t", "up",
        (F.col("_up") + F.sum("up").over(inside)).alias("starts"),
        (F.col("_down") + F.sum("down").over(inside)).alias("ends"),
        F.col("down"),
    )
    # a rise from 0 at t begins a period, a fall to 0 at t ends one; a lone point does both
    edges = counts.select(
        *keys, "_chunk", "t", "starts",
        ((F.col("starts") - F.col("up")) == (F.col("ends") - F.col("down"))).alias("begins"),
        (F.col("starts") == F.col("ends")).alias("closes"),
        (F.col("starts") - F.col("up")).alias("before"),
    ).where("begins or closes")
    edges = with_next(edges, keys, "_chunk", ["t"], ["t", "starts"], "_next")
    point = F.col("begins") & F.col("closes")
    period = F.when(
        F.col("begins"),
        F.struct(F.lit("period").alias("kind"), F.col("t").alias("start_us"), F.when(point, F.col("t")).otherwise(F.col("_next.t")).alias("end_us"),
                 (F.when(point, F.col("starts")).otherwise(F.col("_next.starts")) - F.col("before")).alias("n_intervals")),
    )
    gap = F.when(
        F.col("closes") & F.col("_next").isNotNull(),
        F.struct(F.lit("gap").alias("kind"), F.col("t").alias("start_us"), F.col("_next.t").alias("end_us"), F.lit(0).cast("bigint").alias("n_intervals")),
    )
    rows = edges.select(*keys, F.inline(F.filter(F.array(period, gap), lambda r: r.isNotNull())))
    return rows.select("kind", *keys, "start_us", "end_us", "n_intervals")


def fixation_intervals(fixations: DataFrame) -> DataFrame:
    """fixations with start_us and end_us in whole microseconds; end_us from elapsed_time where end_time is missing."""
    us = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    present = lambda c: F.when(~F.isnan(c), us(c))
    return fixations.withColumn("start_us", present("start_time")).withColumn(
        "end_us", F.coalesce(present("end_time"), F.col("start_us") + present("elapsed_time"))
    )
