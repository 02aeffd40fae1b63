import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeloom.operators import grid

SCHEMA = "rec bigint, t double, x double, ok boolean, slot string, status string"


def cells(spark, rows, **kw):
    df = spark.createDataFrame([(*r, None, "clash") for r in rows], SCHEMA)
    got = grid.regular_grid(df, ["rec"], "t", ["x"], kw.pop("per", 10), F.col("ok"), **kw).collect()
    assert len({(r.rec, r.slot) for r in got}) == len(got)
    return {(r.rec, r.slot): (r.x, r.n_readings, r.status) for r in got}


@pytest.mark.parametrize("chunk", [3, 4096])
def test_gaps_and_values(spark, monkeypatch, chunk):
    monkeypatch.setattr(grid, "CHUNK", chunk)
    monkeypatch.setattr(grid, "STEPS", 2)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for rec in (1, 2):
        t = np.unique(np.round(np.cumsum(rng.exponential(0.15, 120)), 6))
        x = rng.normal(0, 50, len(t)).round(2)
        rows += [(rec, float(a), float(b), True) for a, b in zip(t, x)] + [(rec, float(t[0]) - 3, 1.0, False), (rec, float(t[-1]) + 3, None, True)]
        slots = np.floor(t * 10).astype(int)
        for s in range(slots[0], slots[-1] + 1):
            fine = np.clip(np.linspace(s / 10, (s + 1) / 10, 4001), t[0], t[-1])
            want[rec, s] = (float(np.interp(fine, t, x).mean()) if fine[0] < fine[-1] else None, int((slots == s).sum()))
    got = cells(spark, rows + rows[:9])
    assert got.keys() == want.keys()
    for k, (x, n, status) in got.items():
        assert n == want[k][1] and status == ("observed" if n else "gap")
        if n == 0:  # a whole cell inside an interval
            assert math.isclose(x, want[k][0], abs_tol=0.05)


def test_counter_keeps_the_total_over_resets(spark):
    rows = [(1, 0.0, 10.0, True), (1, 0.25, 20.0, True), (1, 1.05, 4.0, True), (1, 1.05, 6.0, True), (1, 1.1, 7.0, True)]
    got = cells(spark, rows, counter=True)
    assert sorted(s for _, s in got) == list(range(12))
    assert math.isclose(sum(v[0] for v in got.values()), 10 + 4 + 2 + 1) and math.isclose(got[1, 0][0], 4.0) and got[1, 5][2] == "gap"


def test_edges(spark):
    assert cells(spark, []) == {}
    nan = float("nan")
    assert cells(spark, [(None, 1.0, 1.0, True), (1, nan, 1.0, True), (1, None, 1.0, True), (1, 1.0, nan, True), (1, 1.0, None, True), (1, math.inf, 1.0, True), (1, 1.0, 1.0, None)]) == {}
    assert cells(spark, [(1, 1.0, 2.0, True)] * 2) == {(1, 10): (2.0, 1, "observed")}
    assert cells(spark, [(1, 1.0, 2.0, True), (1, 1.0, 4.0, True)])[1, 10] == (3.0, 2, "observed")
    far = cells(spark, [(1, -5.0, 0.0, True), (1, 1995.0, 2000.0, True)])
    assert len(far) == 20001 and sum(v[2] == "gap" for v in far.values()) == 19999
