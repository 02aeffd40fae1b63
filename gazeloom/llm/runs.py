"""Runs of equal consecutive events, found by a regular expression over symbol strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = re.compile(r"(.)\1*", re.DOTALL)
FIRST_CODE = 0x4E00
CODES = 10_000
"""Code points for events, from FIRST_CODE, and rows of a slice, which so has no more values. Each is used in two ranges, so that stretches which
must not run together, an entity's after another's or either side of a pause, alternate between
them."""


def event_runs(df: DataFrame, keys: list[str], time: str, order: str, event: Column, pause: float) -> DataFrame:
    """One row per run: (keys, event, first_order, last_order, n_events, start, end, duration).

    A run is a longest series of successive events of a key, by time and then order, of equal
    event, none more than pause after the one before. To collapse near-identical events, pass an
    expression that maps them to one. Events are whole numbers; rows with a null event, key, time
    or order are left out, as are NaN times. Rows with equal key, time and order are one event (the
    smallest counts). An empty table gives no runs; other columns are ignored.

    The rows are sorted into ranges of (keys, time, order), which split long keys evenly. A task
    reads its range in slices of at most CODES rows and writes a slice's events as one string of code
    points; a back-reference matches every run, and the match's span gives its events. A run that
    goes on in the next slice is carried there. Runs that touch a range's edge are joined with their
    neighbours afterwards, two a range.
    """
    events = df.select(*keys, F.col(time).cast("double").alias("_t"), F.col(order).cast("bigint").alias("_o"), event.cast("bigint").alias("_e"))
    events = events.dropna(subset=[*keys, "_t", "_o", "_e"]).where(~F.isnan("_t"))
    ranged = events.repartitionByRange(*keys, "_t", "_o").sortWithinPartitions(*keys, "_t", "_o", "_e")
    key_fields = [events.schema[k] for k in keys]
    schema = T.StructType(
        [*key_fields]
        + [T.StructField(n, T.LongType()) for n in ("event", "first_order", "last_order", "n_events")]
        + [T.StructField(n, T.DoubleType()) for n in ("start", "end")]
        + [T.StructField(n, T.BooleanType()) for n in ("opens", "closes")]
    )
    found = ranged.mapInArrow(lambda batches: _runs(batches, keys, pause), schema)
    whole = found.where("not opens and not closes").drop("opens", "closes")
    joined = _join_edges(found.where("opens or closes"), keys, pause)
    return whole.unionByName(joined).withColumn("duration", F.col("end") - F.col("start"))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], pause: float) -> Iterator[pa.RecordBatch]:
    last = waiting = None  # waiting: the last run so far, which may go on
    first = True
    for batch in (b.slice(i, CODES) for b in batches for i in range(0, b.num_rows, CODES)):
        t, o, e = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_t", "_o", "_e"))
        entity = np.zeros(len(t), bool)  # True where another entity begins
        columns = [batch.column(k) for k in keys]
        for c in columns:
            entity[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        again = np.zeros(len(t), bool)
        again[1:] = ~entity[1:] & (t[1:] == t[:-1]) & (o[1:] == o[:-1])
        again[0] = last is not None and last == (*[c[0].as_py() for c in columns], t[0], o[0])
        last = (*[c[-1].as_py() for c in columns], t[-1], o[-1])
        keep = np.flatnonzero(~again)
        if not len(keep):
            continue
        # an entity's first row is never a repeat, so dropping repeats loses no beginning
        t, o, e, entity = t[keep], o[keep], e[keep], entity[keep]
        broken = entity.copy()
        broken[1:] |= t[1:] - t[:-1] > pause
        side = np.cumsum(broken) % 2
        code = np.unique(e, return_inverse=True)[1]
        text = (FIRST_CODE + code + CODES * side).astype("<u4").tobytes().decode("utf-32-le")
        spans = np.array([m.span() for m in RUN.finditer(text)], np.int64)
        starts, ends = spans[:, 0], spans[:, 1] - 1
        values = [e[starts], o[starts], o[ends], ends - starts + 1, t[starts], t[ends], np.zeros(len(starts), bool), np.zeros(len(starts), bool)]
        rows = pa.array(keep[starts])
        found = pa.RecordBatch.from_arrays([*[c.take(rows) for c in columns], *map(pa.array, values)], names=[*keys, *FOUND])
        if waiting is not None:
            waiting, found = _carried(waiting, found, keys, pause)
            if waiting is not None:
                yield waiting
        elif first:
            found = _marked(found, 0, "opens")
        first = False
        if found.num_rows > 1:
            yield found.slice(0, found.num_rows - 1)
        waiting = found.slice(found.num_rows - 1)
    if waiting is not None:
        yield _marked(waiting, 0, "closes")


FOUND = ["event", "first_order", "last_order", "n_events", "start", "end", "opens", "closes"]


def _carried(waiting: pa.RecordBatch, found: pa.RecordBatch, keys: list[str], pause: float) -> tuple[pa.RecordBatch | None, pa.RecordBatch]:
    """The run that waits, if it is over, and the runs found, of which the first may continue it."""
    old, new = waiting.to_pylist()[0], found.slice(0, 1).to_pylist()[0]
    if any(old[k] != new[k] for k in (*keys, "event")) or new["start"] - old["end"] > pause:
        return waiting, found
    merged = new | {"first_order": old["first_order"], "start": old["start"], "opens": old["opens"], "n_events": old["n_events"] + new["n_events"]}
    first = pa.RecordBatch.from_pylist([merged], schema=found.schema)
    table = pa.Table.from_batches([first, found.slice(1)]).combine_chunks()
    return None, table.to_batches()[0]


def _marked(found: pa.RecordBatch, row: int, flag: str) -> pa.RecordBatch:
    mask = np.zeros(found.num_rows, bool)
    mask[row] = True
    return found.set_column(found.schema.get_field_index(flag), flag, pa.array(mask))


def _join_edges(edges: DataFrame, keys: list[str], pause: float) -> DataFrame:
    """Joins runs across the edges of ranges: one that closes its range and the next that opens one."""
    w = W.partitionBy(*keys).orderBy("start", "first_order")
    goes_on = F.lag("closes").over(w) & F.col("opens") & (F.lag("event").over(w) == F.col("event")) & (F.col("start") - F.lag("end").over(w) <= pause)
    numbered = edges.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    numbered = numbered.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    first, last = F.struct("start", "first_order"), F.struct("end", "last_order")
    return numbered.groupBy(*keys, "_run").agg(
        F.min("event").alias("event"), F.min_by("first_order", first).alias("first_order"), F.max_by("last_order", last).alias("last_order"),
        F.sum("n_events").alias("n_events"), F.min("start").alias("start"), F.max("end").alias("end"),
    ).drop("_run")
