"""Speed, direction, deviation, displacement and acceleration over several scales.

All functions expect rows in blocks (ordered.in_blocks) that reach REACH rows beyond their edges
or, for the fixed lags, as far as the longest of them; they keep the core rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazeloom.operators.ordered import in_blocks

LEAST_CONFIDENCE = 0.75
SCALES = (1, 2, 4, 8, 16)
REACH = max(SCALES) // 2 + 1
BLOCKED = ["_at", "_block", "_core"]


def _window(keys: list[str]):
    return W.partitionBy(*keys, "_block").orderBy("_at")


def _core(df: DataFrame) -> DataFrame:
    return df.where("_core").drop(*BLOCKED)


def speed_between(dx: Column, dy: Column, dt: Column) -> Column:
    """Distance over time, 0 where no time has passed, null where one isn't known."""
    return F.when(dt > 0, F.try_divide(F.sqrt(dx * dx + dy * dy), dt)).when(dt <= 0, 0.0)


def step_speed(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Adds speed from the row before: distance over time, 0 where no time has passed, null in a key's first row."""
    w = _window(keys)
    dx, dy, dt = (F.col(c) - F.lag(c).over(w) for c in ("x", "y", time))
    return _core(df.withColumn("speed", speed_between(dx, dy, dt)))


def _ends(step: int, scale: int, confident: Column, w) -> tuple[Column, Column]:
    """Offsets of the first and last row of the interval around a row: an end that is missing or not confident falls back to the row."""
    start = F.when(F.coalesce(F.lag("_sure", step).over(w), F.lit(False)), -step).otherwise(0)
    if step == scale:
        return start, F.lit(0)
    return start, F.when(F.coalesce(F.lead("_sure", step).over(w), F.lit(False)), step).otherwise(0)


def _at(column: str, offset: Column, step: int, w) -> Column:
    return F.when(offset < 0, F.lag(column, step).over(w)).when(offset > 0, F.lead(column, step).over(w)).otherwise(F.col(column))


def multiscale(df: DataFrame, keys: list[str], time: str, confidence: Column, scales: tuple[int, ...] = SCALES) -> DataFrame:
    """Adds speed_w, direction_w, standard_dev_w, displacement_w and acceleration_w for every scale w.

    A row's interval reaches ceil(w / 2) rows to both sides (for w = 1 only back), each end falling
    back to the row itself where it is missing or of too little confidence. Speed is displacement
    over the time between the ends, deviation the mean over both axes of the population standard
    deviation in the interval, acceleration the change of velocity since the row before over the
    time since then. All are 0 for a row of too little confidence, for an interval without extent,
    and where no time passes.
    """
    w = _window(keys)
    rows = df.withColumn("_sure", F.coalesce(confidence >= LEAST_CONFIDENCE, F.lit(False)))
    columns: dict[str, Column] = {}
    for scale in scales:
        step = math.ceil(scale / 2)
        start, end = _ends(step, scale, F.col("_sure"), w)
        extent = F.col("_sure") & (start != end)
        dx, dy, dt = (_at(c, end, step, w) - _at(c, start, step, w) for c in ("x", "y", time))
        length = F.sqrt(dx * dx + dy * dy)
        moved = extent & (dt != 0)
        columns[f"speed_{scale}"] = F.when(moved, F.try_divide(length, dt)).otherwise(0.0)
        columns[f"direction_{scale}"] = F.when(moved, F.atan2(dy, dx)).otherwise(0.0)
        columns[f"displacement_{scale}"] = F.when(extent, length).otherwise(0.0)
        spread = lambda a, b: (F.stddev_pop("x").over(w.rowsBetween(a, b)) + F.stddev_pop("y").over(w.rowsBetween(a, b))) / 2  # noqa: B023, E731
        deviation = F.when(~extent, 0.0)
        if step != scale:
            deviation = deviation.when((start < 0) & (end > 0), spread(-step, step)).when(end > 0, spread(0, step))
        columns[f"standard_dev_{scale}"] = deviation.otherwise(spread(-step, 0))
    rows = rows.withColumns(columns)
    before = F.coalesce(F.lag("_sure").over(w), F.lit(False))
    dt = F.col(time) - F.lag(time).over(w)
    changes: dict[str, Column] = {}
    for scale in scales:
        speed, direction = f"speed_{scale}", f"direction_{scale}"
        vx = F.col(speed) * F.cos(direction) - F.lag(F.col(speed) * F.cos(direction)).over(w)
        vy = F.col(speed) * F.sin(direction) - F.lag(F.col(speed) * F.sin(direction)).over(w)
        change = F.sqrt(F.pow(F.try_divide(vx, dt), F.lit(2.0)) + F.pow(F.try_divide(vy, dt), F.lit(2.0)))
        changes[f"acceleration_{scale}"] = F.when(F.col("_sure") & before & (dt != 0), change).otherwise(0.0)
    return _core(rows.withColumns(changes)).drop("_sure")


def lag_ladder(frequency: float, length: float, stride: int) -> list[int]:
    """Lags in rows, doubling up to frequency * length."""
    return [math.ceil(2**k * frequency * length / 2 ** (stride - 1)) for k in range(stride)]


def fixed_lag_features(df: DataFrame, keys: list[str], frequency: float, length: float, stride: int) -> DataFrame:
    """Adds speed and direction from `lag` rows before, for each step of the ladder: lag_speed_k, lag_direction_k.

    Time is counted in rows at the given frequency. Rows without ceil(frequency * length) rows
    before them are left out; repeated lags repeat their features.
    """
    w = _window(keys)
    columns: dict[str, Column] = {}
    for k, lag in enumerate(lag_ladder(frequency, length, stride)):
        dx, dy = (F.col(c) - F.lag(c, lag).over(w) for c in ("x", "y"))
        columns[f"lag_speed_{k}"] = F.sqrt(dx * dx + dy * dy) / (lag / frequency)
        columns[f"lag_direction_{k}"] = F.atan2(dy, dx)
    ready = df.withColumns(columns).where(F.col("_at") >= math.ceil(frequency * length))
    return _core(ready)


def shifted(df: DataFrame, keys: list[str], column: str, offset: int, out: str) -> DataFrame:
    """Adds the value of the column `offset` rows later, or earlier for a negative offset."""
    w = _window(keys)
    return _core(df.withColumn(out, F.lead(column, offset).over(w) if offset >= 0 else F.lag(column, -offset).over(w)))


def sliding_windows(df: DataFrame, keys: list[str], features: list[str], length: int) -> DataFrame:
    """Adds window: an array of the features of the row and the length - 1 rows before it; rows with fewer are left out."""
    w = _window(keys).rowsBetween(1 - length, 0)
    rows = df.withColumn("window", F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(w))
    return _core(rows.where(F.col("_at") >= length - 1))


def scaled(df: DataFrame, per_degree: Column, columns: list[str]) -> DataFrame:
    """The columns in degrees: divided by pixels per degree, null where that is 0."""
    return df.withColumns({c: F.try_divide(F.col(c), per_degree) for c in columns})


def online_features(
    df: DataFrame, keys: list[str], order: str, length: int, confidence: Column, latency_us: float, per_degree: Column, scales: tuple[int, ...] = SCALES
) -> DataFrame:
    """Adds window (a key's rows in stretches of `length`), speed_w and direction_w as an online classifier takes them.

    As in multiscale, but intervals end at the window's edges, time is counted in rows of latency_us
    microseconds, and speed is in degrees. order is as in in_blocks; rows aren't expected in blocks.
    """
    placed = in_blocks(df, keys, order, 0).where("_core").withColumn("window", F.floor(F.col("_at") / length))
    w = W.partitionBy(*keys, "window").orderBy("_at")
    rows = placed.withColumn("_sure", F.coalesce(confidence >= LEAST_CONFIDENCE, F.lit(False)))
    columns: dict[str, Column] = {}
    for scale in scales:
        step = math.ceil(scale / 2)
        start, end = _ends(step, scale, F.col("_sure"), w)
        extent = F.col("_sure") & (start != end)
        dx, dy = (_at(c, end, step, w) - _at(c, start, step, w) for c in ("x", "y"))
        seconds = (end - start) * latency_us / 1_000_000
        columns[f"speed_{scale}"] = F.when(extent, F.try_divide(F.try_divide(F.sqrt(dx * dx + dy * dy), seconds), per_degree)).otherwise(0.0)
        columns[f"direction_{scale}"] = F.when(extent, F.atan2(dy, dx)).otherwise(0.0)
    return rows.withColumns(columns).drop("_sure", *BLOCKED)


def training_windows(df: DataFrame, keys: list[str], features: list[str], label: str, length: int) -> DataFrame:
    """Adds window, an array of the features of the row and the length - 1 rows before it, for rows with a label.

    A window has the label of its last row; of length 1 it is the row itself. Rows come in blocks
    that reach length - 1 rows back.
    """
    return sliding_windows(df, keys, features, length).where(F.col(label).isNotNull())
