import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from gazeloom.llm import runs

SCHEMA = "rec bigint, t double, ord bigint, kind int, event string, start string"


def found(spark, rows, pause=0.5):
    df = spark.createDataFrame([(*r, "clash", None) for r in rows], SCHEMA)
    got = runs.event_runs(df, ["rec"], "t", "ord", F.col("kind"), pause).collect()
    return sorted((r.rec, r.first_order, r.last_order, r.event, r.n_events, r.start, r.end) for r in got)


def brute(rows, pause=0.5):
    out = []
    clean = sorted({r for r in rows if None not in r and r[1] == r[1]}, key=lambda r: (r[0], r[1], r[2], r[3]))
    for rec, own in groupby(clean, key=lambda r: r[0]):
        last, seen = None, None
        for _, t, o, e in own:
            if (t, o) == seen:
                continue
            seen = (t, o)
            if last and last[-1][2] == e and t - last[-1][0] <= pause:
                last.append((t, o, e))
            else:
                last = [(t, o, e)]
                out.append((rec, last))
    return sorted((rec, r[0][1], r[-1][1], r[0][2], len(r), r[0][0], r[-1][0]) for rec, r in out)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_against_a_loop(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = random.Random(batch)
    rows = []
    for rec in (1, 2, 3, 4):
        t = 0.0
        for i in range({1: 600, 2: 60}.get(rec, 5)):
            t = round(t + rng.choice((0.0, 0.1, 0.1, 0.5, 0.6)), 3)
            rows.append((rec, t, i, rng.choice((0, 0, 0, 0, 1, 2, None))))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rng.shuffle(rows)
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark):
    nan = float("nan")
    assert found(spark, []) == [] and found(spark, [(None, 1.0, 1, 1), (1, None, 1, 1), (1, nan, 1, 1), (1, 1.0, None, 1), (1, 1.0, 1, None)]) == []
    assert found(spark, [(1, 1.0, 1, 5), (1, 1.0, 2, 5), (1, 1.0, 1, 5), (2, 1.0, 3, 5)]) == [(1, 1, 2, 5, 2, 1.0, 1.0), (2, 3, 3, 5, 1, 1.0, 1.0)]
    assert found(spark, [(1, float(i), i, 0) for i in range(3)], pause=1.0) == [(1, 0, 2, 0, 3, 0.0, 2.0)]


def test_one_long_run_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        assert found(spark, [(1, i / 100, i, -3) for i in range(2000)]) == [(1, 0, 1999, -3, 2000, 0.0, 19.99)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
