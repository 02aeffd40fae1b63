"""Implausible readings: impossible values, stuck values and short spikes, per source and axis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeloom.operators.batches import begins, whole_groups
from gazeloom.operators.ordered import clean_number, known, prefix_sums
from gazeloom.session import cut_lineage

CHUNK = 1 << 14
"""Readings of a source that are judged at once."""
STUCK_RUN = 12
LONGEST_SPIKE = 3
FENCE = 10.0
"""A spike leaves its level by more than this many times the usual scatter."""
LEVEL = 6.0
"""Readings share a level if they differ by at most this many times the scatter. Two readings of a
held gaze differ by more in about one of 45,000 cases, as the scatter of their difference is 2 ** 0.5
times that of one; and it is well below FENCE."""
PRIOR = 500
"""Steps that a source's own scatter counts for against that of an hour."""
SKETCH_K = 400
"""Size parameter of the quantile sketches: a rank error of about 0.7 %."""
HALO = STUCK_RUN + LONGEST_SPIKE + 2
IQR_OF_DIFFERENCES = 1.349 * 2**0.5
"""Interquartile range of the difference of two normal readings, in units of their scatter."""


def spike_flags(
    df: DataFrame,
    keys: list[str],
    order: str,
    axes: list[str],
    valid: Column,
    limits: dict[str, tuple[Column, Column]] | None = None,
    hour: Column | None = None,
) -> DataFrame:
    """Flags readings that cannot be true: (keys, order, axis, impossible, stuck, spike), flagged rows only.

    df: one row per keys and order; of repeated rows one counts (rows of equal order that differ all
    count, in order of value). Only rows with valid count. order must be an integer that rises
    within a source. Each axis is judged on its own, over the readings where it is neither null nor
    NaN:

    - impossible: outside limits[axis] (low, high), columns of df; infinite values are outside.
      Without limits, or where they are null, nothing is impossible.
    - stuck: part of STUCK_RUN or more consecutive readings of the same value.
    - spike: one of at most LONGEST_SPIKE consecutive readings that leave, by more than FENCE times
      the scatter, a level which the readings before and after them share. The scatter is taken
      from the quartiles of the steps from reading to possible reading, in quantile sketches per
      source, axis and hour (the column hour, where given: a context of few values, such as the
      hour of the day). Sketches are merged across partitions. An hour's scatter is its own, drawn
      towards the source's by the weight of PRIOR steps, so an hour with few steps has the source's.
      It is a held gaze's noise as long as more than half of the steps are within a hold. A source
      without scatter (all values alike) has no spikes.

    Rows with a null key or order belong to no source and are not flagged; a null hour is one hour.
    An empty table gives an empty result; columns of df beyond those named are ignored.

    Sources of any length are cut twice: into chunks of CHUNK of order, which are counted and
    sketched, and, by the numbers of readings that gives, into blocks of CHUNK readings, each seeing
    HALO readings of its neighbours. So no task holds more of a source than that. All axes of a row
    travel together. The table is read and shuffled once; the distinct readings with their steps
    are written once, and counts, sketches and blocks are taken from there. Copies are dropped per
    batch before the shuffle, and sketches are merged before theirs.
    """
    limits = limits or {}
    nothing = F.lit(None).cast("double")
    n = len(axes)
    readings = df.where(valid).select(
        *keys,
        F.col(order).cast("bigint").alias("_o"),
        F.floor(F.col(order) / CHUNK).alias("_chunk"),
        F.coalesce(hour.cast("bigint"), F.lit(-1)).alias("_hour") if hour is not None else F.lit(0).cast("bigint").alias("_hour"),
        *[clean_number(F.col(a).cast("double")).alias(f"_v{i}") for i, a in enumerate(axes)],
        *[_outside(F.col(a), *limits.get(a, (nothing, nothing))).alias(f"_out{i}") for i, a in enumerate(axes)],
    )
    readings = _written(known(readings, [*keys, "_chunk"]), keys, n)
    blocks = _in_blocks(readings, _facts(readings, keys, n), keys, n)
    wanted = [*[readings.schema[k] for k in keys], T.StructField(order, T.LongType()), T.StructField("axis", T.IntegerType())]
    schema = T.StructType([*wanted, *[T.StructField(f, T.BooleanType()) for f in ("impossible", "stuck", "spike")]])
    chunk, names = CHUNK, F.array(*[F.lit(a) for a in axes])
    flagged = blocks.mapInArrow(lambda batches: _judged(batches, keys, n, chunk, schema.names), schema)
    return flagged.withColumn("axis", F.get(names, F.col("axis")))


def _outside(value: Column, low: Column, high: Column) -> Column:
    return F.coalesce((value < low) | (value > high), F.lit(False))


def _written(readings: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The distinct readings, with the number of each axis' readings before a row in its chunk (_c<i>) and its step (_step<i>), written."""
    group, rest = [*keys, "_chunk"], ["_o", *[f"_v{i}" for i in range(n)], "_hour", *[f"_out{i}" for i in range(n)]]
    fewer = readings.select(*group, *rest).mapInArrow(_distinct_in_batches, readings.select(*group, *rest).schema)
    ordered = fewer.repartition(*group).sortWithinPartitions(*group, *rest)
    added = [T.StructField(f"_c{i}", T.LongType()) for i in range(n)] + [T.StructField(f"_step{i}", T.DoubleType()) for i in range(n)]
    return cut_lineage(ordered.mapInArrow(lambda batches: _with_steps(batches, group, n), T.StructType([*fewer.schema.fields, *added])))


def _distinct_in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in _grouped(batch).columns], schema=batch.schema)


def _grouped(batch: pa.RecordBatch) -> pa.Table:
    return pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([])


def _new_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows without those equal to the one before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([last, batch] if last is not None else [batch])
        fresh = begins(table, table.schema.names)
        fresh[0] = last is None
        last = batch.slice(batch.num_rows - 1)
        kept = table.filter(pa.array(fresh)).combine_chunks().to_batches()
        yield from kept


def _with_steps(batches: Iterator[pa.RecordBatch], group: list[str], n: int) -> Iterator[pa.RecordBatch]:
    for table, fresh in whole_groups(_new_rows(batches), group, CHUNK):
        first = np.flatnonzero(fresh)
        of = np.cumsum(fresh) - 1
        counts, steps = [], []
        for i in range(n):
            column = table.column(f"_v{i}")
            there = column.is_valid().to_numpy()
            upto = np.cumsum(there)
            counts.append(pa.array(upto - there - (upto - there)[first][of]))
            v, rows = column.to_numpy(), np.flatnonzero(there)
            step = np.full(len(v), np.nan)
            with np.errstate(invalid="ignore"):
                step[rows[1:]] = np.where(of[rows[1:]] == of[rows[:-1]], np.diff(v[rows]), np.nan)
            step[table.column(f"_out{i}").to_numpy()] = np.nan
            steps.append(pa.array(step, mask=np.isnan(step)))
        out = table
        for i, c in enumerate(counts):
            out = out.append_column(f"_c{i}", c)
        for i, c in enumerate(steps):
            out = out.append_column(f"_step{i}", c)
        yield from out.combine_chunks().to_batches()


def _facts(readings: DataFrame, keys: list[str], n: int) -> DataFrame:
    """One row per chunk: by axis i the source's readings before the chunk (_b<i>), and scatter by hour (_s, a map to arrays)."""
    axes = range(n)
    before = prefix_sums(readings, keys, "_chunk", {f"_b{i}": F.when(F.col(f"_v{i}").isNotNull(), 1).otherwise(0) for i in axes})
    hourly = readings.groupBy(*keys, "_hour").agg(*[F.kll_sketch_agg_double(f"_step{i}", F.lit(SKETCH_K)).alias(f"_k{i}") for i in axes])
    whole = hourly.groupBy(*keys).agg(
        *[F.kll_merge_agg_double(f"_k{i}", F.lit(SKETCH_K)).alias(f"_k{i}") for i in axes], F.collect_list(F.struct("_hour", *[f"_k{i}" for i in axes])).alias("_h")
    )  # an hour's sketch each: hours are few

    def shrunk(hour: Column, i: int) -> Column:
        own, source = _scatter(hour[f"_k{i}"]), _scatter(F.col(f"_k{i}"))
        weight = F.kll_sketch_get_n_double(hour[f"_k{i}"]).cast("double")
        return F.coalesce((own * weight + source * PRIOR) / (weight + PRIOR), source)

    scatter = F.transform("_h", lambda h: F.struct(h["_hour"], F.array(*[shrunk(h, i) for i in axes])))
    return before.join(whole.select(*keys, F.map_from_entries(scatter).alias("_s")), keys)


def _scatter(sketch: Column) -> Column:
    """Scatter from a merged sketch of steps; null if there are no steps or all are 0."""

    def between(low: float, high: float) -> Column:
        q = F.kll_sketch_get_quantile_double(sketch, F.array(F.lit(low), F.lit(high)))
        return F.when(F.kll_sketch_get_n_double(sketch) > 0, q[1] - q[0])

    usual = between(0.25, 0.75) / IQR_OF_DIFFERENCES
    wide = between(0.1, 0.9) / (IQR_OF_DIFFERENCES * 1.9)
    return F.when(usual > 0, usual).when(wide > 0, wide)


def _in_blocks(readings: DataFrame, facts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Each row in the blocks that any of its axes needs it in, with the axes' numbers of readings (_at<i>) and scatters (_s<i>).

    An axis' reading belongs to the block of its number, and is seen by a neighbouring block within HALO of it.
    """
    there = lambda i: F.col(f"_v{i}").isNotNull()
    counted = readings.join(facts, [*keys, "_chunk"])
    at = {f"_at{i}": F.when(there(i), F.col(f"_b{i}") + F.col(f"_c{i}")) for i in range(n)}
    rows = counted.withColumns(at | {"_s": F.col("_s")[F.col("_hour")]})
    ends = [F.floor((F.col(f"_at{i}") + d) / CHUNK) for i in range(n) for d in (-HALO, HALO)]
    one = F.least(*ends) == F.greatest(*ends)  # nulls passed over; nearly all rows
    several = F.filter(F.array_distinct(F.array(*ends)), lambda b: b >= 0)
    block = F.explode(F.when(one, F.array(F.least(*ends))).otherwise(several)).alias("_block")
    numbers = [c for i in range(n) for c in (f"_v{i}", f"_out{i}", f"_at{i}")]
    copies = rows.select(*keys, "_o", *numbers, *[F.col("_s")[i].alias(f"_s{i}") for i in range(n)], block)
    return copies.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "_o", *[f"_v{i}" for i in range(n)])


def _judged(batches: Iterator[pa.RecordBatch], keys: list[str], n: int, chunk: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Flagged readings of sorted blocks, as many whole blocks at a time as have arrived."""
    for table, fresh in whole_groups(batches, [*keys, "_block"], CHUNK):
        group = np.cumsum(fresh)
        numbers = lambda c: table.column(c).to_numpy()  # noqa: B023, E731
        for i in range(n):
            at, block = numbers(f"_at{i}"), numbers("_block")
            with np.errstate(invalid="ignore"):
                rows = np.flatnonzero((np.floor((at - HALO) / chunk) <= block) & (block <= np.floor((at + HALO) / chunk)))
            if not len(rows):
                continue
            v, order = numbers(f"_v{i}")[rows], numbers("_o")[rows]
            if (tied := (order[1:] == order[:-1]) & (group[rows][1:] == group[rows][:-1])).any() and (v[1:] < v[:-1])[tied].any():
                rows = rows[np.lexsort((v, order, group[rows]))]
                v = numbers(f"_v{i}")[rows]
            stuck, spike = judge(v, group[rows], numbers(f"_s{i}")[rows].astype(float))
            impossible = numbers(f"_out{i}")[rows].astype(bool)
            chosen = np.flatnonzero((np.floor(at[rows] / chunk) == block[rows]) & (impossible | stuck | spike))
            if len(chosen):
                take = pa.array(rows[chosen])
                columns = [table.column(k).take(take).combine_chunks() for k in (*keys, "_o")]
                flags = [pa.array(np.full(len(chosen), i, np.int32)), *[pa.array(f[chosen]) for f in (impossible, stuck, spike)]]
                yield pa.RecordBatch.from_arrays([*columns, *flags], names=names)


def judge(v: np.ndarray, group: np.ndarray, scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuck and spike of each reading, of readings in order by group.

    An excursion of k readings is a spike if each leaves the level by more than FENCE times the
    scatter and the readings before and after it are apart by no more than LEVEL times it. A level
    is what more than one reading shares, so at least on one side the second reading must lie at it
    too, where there is one: both are away only where the gaze moves on and turns.
    """
    m = len(v)
    same = np.append(False, (v[1:] == v[:-1]) & (group[1:] == group[:-1]))
    run = np.cumsum(~same)
    stuck = (np.bincount(run, minlength=1) >= STUCK_RUN)[run]
    spike = np.zeros(m, bool)
    at = np.arange(m)

    def near(d: int) -> tuple[np.ndarray, np.ndarray]:
        """The value d readings away, and whether there is one in the group."""
        place = at + d
        inside = (place >= 0) & (place < m)
        place = np.clip(place, 0, m - 1)
        return v[place], inside & (group[place] == group)

    limit = np.where(np.isnan(scatter), -1.0, scatter)
    with np.errstate(invalid="ignore"):
        before, has_before = near(-1)
        further, has_further = near(-2)
        moving_before = np.where(has_further, np.abs(before - further), 0.0)
        for k in range(1, LONGEST_SPIKE + 1):
            after, has_after = near(k)
            beyond, has_beyond = near(k + 1)
            moving = np.minimum(moving_before, np.where(has_beyond, np.abs(beyond - after), 0.0))
            fits = has_before & has_after & (limit > 0) & (np.abs(before - after) <= LEVEL * limit) & (moving <= LEVEL * limit)
            level = (before + after) / 2
            for j in range(k):
                fits &= np.abs(near(j)[0] - level) > FENCE * limit
            for j in range(k):
                spike[np.flatnonzero(fits) + j] = True
    return stuck, spike
