"""Fixations by velocity threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazeloom.functions.scalars import angle_between
from gazeloom.operators.cleaning import keep_first
from gazeloom.operators.ordered import BEFORE, BLOCK, carried, known

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Thresholds:
    """Pixels per mm, degrees per second, the tracker's frequency, and the limits of merging and duration in seconds."""

    px_per_mm: float = 7.21
    fixation: float = 30.0
    saccade: float = 30.0
    frequency: float = 90.0
    merge_gap: float = 0.075
    merge_velocity: float = 0.5
    least_duration: float = 0.06


def classify(df: DataFrame, keys: list[str], time: str, order: str, z: str, limits: Thresholds = Thresholds()) -> DataFrame:
    """Samples with velocity (degrees per second, from the sample before) and point: 1 fixation, 0 saccade, -1 neither.

    Of samples with one time the first counts, so repeated rows count once; time runs from the key's
    first sample. The first two samples of a key are left out: the first has no velocity, and the
    second's isn't taken. A velocity that isn't known (a vector without length, a missing
    coordinate) is neither.
    """
    return _classified(df, keys, time, order, z, limits).drop("_chunk")


def _classified(df: DataFrame, keys: list[str], time: str, order: str, z: str, limits: Thresholds) -> DataFrame:
    """The same with _chunk, by which and the keys the rows are partitioned, so that later steps needn't shuffle them."""
    times = keep_first(df.withColumn("z", F.col(z)), [*keys, time], [order])
    rows = known(times.withColumn("_chunk", F.floor(F.col(order) / BLOCK)), [*keys, "_chunk"]).repartition(*keys, "_chunk")
    edges = carried(rows, keys, "_chunk", [order], {"_base": F.lit(1)}, last=list(AXES), first=[time])
    w = W.partitionBy(*keys, "_chunk").orderBy(order)
    placed = rows.withColumns({"_inside": F.row_number().over(w) - 1, "_lag": F.lag(F.struct(*AXES)).over(w)}).join(edges, [*keys, "_chunk"])
    scale = [limits.px_per_mm, limits.px_per_mm, 1.0]
    previous = F.coalesce("_lag", "_previous")
    velocity = angle_between([previous[a] / s for a, s in zip(AXES, scale)], [F.col(a) / s for a, s in zip(AXES, scale)]) * limits.frequency
    velocity = F.when(~F.isnan(velocity), velocity)
    at, since = F.col("_base") + F.col("_inside"), F.col(time) - F.col("_first")[time]
    points = placed.select(*keys, "_chunk", at.alias("at"), *AXES, since.alias("t"), velocity.alias("velocity")).where("at >= 2")
    return points.withColumn("point", F.when(F.col("velocity") < limits.fixation, 1).when(F.col("velocity") > limits.saccade, 0).otherwise(-1))


def fixations(points: DataFrame, keys: list[str]) -> DataFrame:
    """Fixations of classified samples: means, spread, times and ranks, not yet merged.

    The fixation samples up to each saccade since the one before are a fixation; samples that are
    neither don't end it; what follows the last saccade is left out. spread is the mean of both
    axes' sample standard deviations, null for one sample.
    """
    rows = known(points.withColumn("_chunk", F.floor(F.col("at") / BLOCK)), [*keys, "_chunk"])
    return _gathered(rows.repartition(*keys, "_chunk"), keys)


def velocity_fixations(df: DataFrame, keys: list[str], time: str, order: str, z: str, limits: Thresholds = Thresholds()) -> DataFrame:
    """The fixations of samples: classify and fixations in one partitioning."""
    return _gathered(_classified(df, keys, time, order, z, limits), keys)


def _gathered(points: DataFrame, keys: list[str]) -> DataFrame:
    saccade = (F.col("point") == 0).cast("bigint")
    edges = carried(points, keys, "_chunk", ["at"], {"_saccades": saccade})
    upto = W.partitionBy(*keys, "_chunk").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rows = points.withColumn("_upto", F.sum(saccade).over(upto)).join(edges, [*keys, "_chunk"])
    rows = rows.withColumn("island", F.col("_saccades") + F.col("_upto")).where("point = 1 and island < _saccades_all")
    by_time = lambda pick, c: pick(c, "at")
    groups = rows.groupBy(*keys, "island").agg(
        *[F.avg(a).alias(a) for a in AXES],
        ((F.stddev_samp("x") + F.stddev_samp("y")) / 2).alias("spread"),
        by_time(F.min_by, "t").alias("start_time"), by_time(F.max_by, "t").alias("end_time"), F.count(F.lit(1)).alias("n"),
    )
    return groups.withColumn("elapsed", F.col("end_time") - F.col("start_time"))


def _pair(islands: DataFrame, keys: list[str], limits: Thresholds) -> DataFrame:
    """Fixations in chunks (_chunk), with the next one (_next) and whether the two are close enough to merge (_close)."""
    fields = ["island", *AXES, "spread", "start_time", "end_time", "elapsed"]
    rows = known(islands.withColumn("_chunk", F.floor(F.col("island") / BLOCK)), [*keys, "_chunk"]).repartition(*keys, "_chunk")
    edges = carried(rows, keys, "_chunk", ["island"], first=fields).withColumnRenamed("_next", "_beyond")
    w = W.partitionBy(*keys, "_chunk").orderBy("island")
    rows = rows.withColumn("_lead", F.lead(F.struct(*fields)).over(w)).join(edges, [*keys, "_chunk"]).withColumn("_next", F.coalesce("_lead", "_beyond"))
    nxt = F.col("_next")
    middle = (nxt["start_time"] + nxt["end_time"]) / 2 - (F.col("start_time") + F.col("end_time")) / 2
    angle = angle_between([F.col(a) for a in AXES], [nxt[a] for a in AXES])
    near = (nxt["start_time"] - F.col("end_time") < limits.merge_gap) & (F.try_divide(angle, middle) <= limits.merge_velocity)
    # the first fixation is never merged with its successor
    return rows.withColumn("_close", F.coalesce(near & (F.col("island") > F.col("_first.island")), F.lit(False))).drop("_lead", "_beyond", "_first")


def merged_compat(islands: DataFrame, keys: list[str], limits: Thresholds = Thresholds()) -> DataFrame:
    """Merges close neighbours as the published method's program does.

    A fixation close to the next takes coordinates and spread weighted by each one's duration over
    the longer duration, which isn't a mean, and the sum of the durations; the next one stays.
    """
    rows = _pair(islands, keys, limits)
    longer = F.greatest("elapsed", "_next.elapsed")
    here, there = F.try_divide(F.col("elapsed"), longer), F.try_divide(F.col("_next.elapsed"), longer)
    close = F.col("_close")
    columns: dict[str, Column] = {c: F.when(close, here * F.col(c) + there * F.col(f"_next.{c}")).otherwise(F.col(c)) for c in (*AXES, "spread")}
    columns["elapsed"] = F.when(close, F.col("elapsed") + F.col("_next.elapsed")).otherwise(F.col("elapsed"))
    columns["end_time"] = F.when(close, F.col("_next.end_time")).otherwise(F.col("end_time"))
    return rows.withColumns(columns).where(F.col("elapsed") > limits.least_duration).select(*keys, *AXES, "spread", "elapsed", "start_time", "end_time")


def merged_weighted(islands: DataFrame, keys: list[str], limits: Thresholds = Thresholds()) -> DataFrame:
    """Merges every chain of close neighbours into one fixation with the means weighted by duration."""
    rows = _pair(islands, keys, limits).drop("_next")
    apart = (~F.col("_close")).cast("bigint")  # a chain is as many as there are fixations before it that aren't close to their next
    edges = carried(rows, keys, "_chunk", ["island"], {"_apart": apart})
    before = W.partitionBy(*keys, "_chunk").orderBy("island").rowsBetween(*BEFORE)
    chains = rows.withColumn("_inside", F.coalesce(F.sum(apart).over(before), F.lit(0))).join(edges, [*keys, "_chunk"]).withColumn("chain", F.col("_apart") + F.col("_inside"))
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("elapsed")), F.sum(F.when(F.col(c).isNotNull(), F.col("elapsed"))))
    out = chains.groupBy(*keys, "chain").agg(
        *[F.coalesce(weighted(c), F.avg(c)).alias(c) for c in (*AXES, "spread")],
        F.sum("elapsed").alias("elapsed"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
    )
    return out.where(F.col("elapsed") > limits.least_duration).drop("chain")
