"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeloom.operators.ordered import clean_number, known, with_next

CHUNK = 4096
"""Cells of a source that one window holds; a task never holds more of a source than their readings."""
STEPS = 4096
"""Cells that one array holds while an interval is spread over the cells it overlaps."""


def regular_grid(
    df: DataFrame,
    keys: list[str],
    time: str,
    values: list[str],
    per_unit: int,
    usable: Column | None = None,
    counter: bool = False,
) -> DataFrame:
    """One row for every cell of 1/per_unit of time from a source's first to its last usable reading.

    Result: keys, slot (floor(time * per_unit)), the values, n_readings, status. status is
    'observed' for a cell that holds a usable reading, 'gap' for one that holds none; the values of
    a gap are filled in.

    Every interval between consecutive readings is spread over the cells it overlaps, in proportion
    to the overlap. counter=True: the values are cumulative counters; an interval's increment is
    the difference of its readings or, after a reset (the counter falls), the later reading, and a
    cell's value is the increment that falls into it. Otherwise the increment is that of the
    value's integral over time, which is a cumulative counter itself, on a straight line between
    the readings; a cell's value is its increment over the time covered, so the time-weighted mean.

    A reading is usable if `usable` holds (by default always) and time and all values are neither
    null nor NaN; infinite times are not usable. Of readings with the same key, time and values one
    counts; readings at one time with different values all count and follow in order of value.
    Null keys belong to no source. An empty table gives an empty grid; other columns are ignored.

    The work is split by CHUNK cells of a source. An interval's cells are made in arrays of at most
    STEPS, so a long gap costs only the rows it has.
    """
    names = [f"_v{i}" for i in range(len(values))]
    readings = df if usable is None else df.where(usable)
    readings = readings.select(
        *keys, F.col(time).cast("double").alias("_t"), *[clean_number(F.col(v).cast("double")).alias(n) for v, n in zip(values, names)]
    )
    readings = known(readings, [*keys, "_t", *names]).where(F.abs("_t") < float("inf"))
    readings = readings.withColumn("_slot", F.floor(F.col("_t") * per_unit)).withColumn("_chunk", F.floor(F.col("_slot") / CHUNK))
    readings = known(readings, ["_chunk"]).repartition(*keys, "_chunk").distinct()
    spans = with_next(readings, keys, "_chunk", ["_t", *names], ["_t", "_slot", *names], "_next")
    return _cells(spans, keys, values, names, per_unit, counter)


def _cells(spans: DataFrame, keys: list[str], values: list[str], names: list[str], per_unit: int, counter: bool) -> DataFrame:
    last = F.coalesce("_next._slot", "_slot")
    blocks = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_slot") / STEPS), F.floor(last / STEPS))))
    low = F.greatest("_slot", F.col("_block") * STEPS)
    high = F.least(last, F.col("_block") * STEPS + (STEPS - 1))
    cells = blocks.withColumn("slot", F.explode(F.sequence(low, high)))
    since = F.greatest("_t", F.col("slot") / per_unit)
    until = F.least("_next._t", (F.col("slot") + 1) / per_unit)
    length = F.col("_next._t") - F.col("_t")
    overlap = F.when(length > 0, F.greatest(until - since, F.lit(0.0))).otherwise(0.0)
    middle = F.when(length > 0, ((since + until) / 2 - F.col("_t")) / length)

    def increment(name: str) -> Column:
        here, there = F.col(name), F.col(f"_next.{name}")
        if counter:
            grown = F.when(there >= here, there - here).otherwise(there)
            share = F.when(length > 0, overlap / length).otherwise((F.col("slot") == last).cast("double"))
            return F.coalesce(grown * share, F.lit(0.0))
        return F.coalesce((here + (there - here) * middle) * overlap, F.lit(0.0))

    own = F.col("slot") == F.col("_slot")
    parts = cells.select(
        *keys, "slot", own.cast("int").alias("_own"), overlap.alias("_overlap"),
        *[increment(n).alias(f"_i{n}") for n in names], *[F.when(own, F.col(n)).alias(n) for n in names],
    )
    sums = parts.groupBy(*keys, "slot").agg(
        F.sum("_own").alias("n_readings"), F.sum("_overlap").alias("_overlap"),
        *[F.sum(f"_i{n}").alias(f"_i{n}") for n in names], *[F.avg(n).alias(n) for n in names],
    )

    def value(name: str) -> Column:
        return F.col(f"_i{name}") if counter else F.when(F.col("_overlap") > 0, F.col(f"_i{name}") / F.col("_overlap")).otherwise(F.col(name))

    return sums.select(
        *keys, "slot", *[value(n).alias(v) for v, n in zip(values, names)], "n_readings",
        F.when(F.col("n_readings") > 0, "observed").otherwise("gap").alias("status"),
    )
