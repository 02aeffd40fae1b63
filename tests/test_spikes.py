import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gazeloom.operators import spikes

SCHEMA = "rec bigint, ord bigint, x double, y double, ok boolean, w int, hour bigint, v string, impossible string"


def flags(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    limits = {a: (F.col("w") * -0.1, F.col("w") * 1.1) for a in ("x", "y")}
    got = spikes.spike_flags(df, ["rec"], "ord", ["x", "y"], F.col("ok"), limits, F.col("hour")).collect()
    return {(r.rec, r.ord, r.axis): (r.impossible, r.stuck, r.spike) for r in got}


def brute(rows):
    """One source's axis at a time, reading by reading."""
    out = {}
    d = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).drop_duplicates()
    d = d[d["ok"].eq(True) & d["rec"].notna() & d["ord"].notna()].sort_values(["rec", "ord"])
    for axis in ("x", "y"):
        for rec, g in d[d[axis].notna()].groupby("rec"):
            v, o, w = g[axis].to_numpy(), g["ord"].to_numpy(), g["w"].to_numpy()
            bad = (v < -0.1 * w) | (v > 1.1 * w)
            steps = np.diff(v)[~bad[1:]]
            whole = np.subtract(*np.percentile(steps, [75, 25])) / spikes.IQR_OF_DIFFERENCES if len(steps) else 0
            by_hour = {}
            for h in g["hour"].unique():
                own = np.diff(v)[(~bad[1:]) & (g["hour"].to_numpy()[1:] == h)]
                s_h = np.subtract(*np.percentile(own, [75, 25])) / spikes.IQR_OF_DIFFERENCES if len(own) else whole
                by_hour[h] = (s_h * len(own) + whole * spikes.PRIOR) / (len(own) + spikes.PRIOR)
            scatters = [by_hour[h] for h in g["hour"]]
            run = np.cumsum(np.append(True, v[1:] != v[:-1]))
            stuck = np.array([(run == r).sum() >= spikes.STUCK_RUN for r in run])
            spike = np.zeros(len(v), bool)
            for k in (1, 2, 3):
                for s in range(1, len(v) - k):
                    a, b = v[s - 1], v[s + k]
                    moving = min(abs(a - v[s - 2]) if s > 1 else 0, abs(v[s + k + 1] - b) if s + k + 1 < len(v) else 0)
                    scatter = scatters[s]
                    if scatter > 0 and abs(a - b) <= 6 * scatter and moving <= 6 * scatter and (abs(v[s : s + k] - (a + b) / 2) > 10 * scatter).all():
                        spike[s : s + k] = True
            for i in np.flatnonzero(bad | stuck | spike):
                out[rec, o[i], axis] = (bool(bad[i]), bool(stuck[i]), bool(spike[i]))
    return out


@pytest.mark.parametrize("chunk", [64, 1 << 14])
def test_against_readings_one_by_one(spark, monkeypatch, chunk):
    monkeypatch.setattr(spikes, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    rows = []
    for rec, n in ((1, 700), (2, 40), (3, 1), (4, 130)):
        x = np.repeat(rng.uniform(100, 900, n // 30 + 1), 30)[:n] + rng.normal(0, 3, n)
        y = np.repeat(rng.uniform(100, 900, n // 20 + 1), 20)[:n] + rng.normal(0, 2, n)
        for s in range(8, n - 5, 53):
            x[s : s + 1 + s % 4] += 80
        if n > 300:
            x[200:214], y[310:321], y[400] = 555.0, 7.0, 2000.0
        for i in range(n):
            value = None if i % 17 == 3 else float("nan") if i % 31 == 4 else round(float(x[i]), 2)
            rows.append((rec, i * 2, value, round(float(y[i]), 2), i % 23 != 5, 1000, i // 200, "clash", "clash"))
            if i % 41 == 0:
                rows.append(rows[-1])
    got, want = flags(spark, rows), brute(rows)
    assert got == want and {k for f in want.values() for k, on in zip("isp", f) if on} == set("isp")


def test_noise_by_hour(spark):
    """The same jump is a spike in a quiet hour and none in a noisy one."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(12_000):
        noise = 1.0 if i < 6000 else 20.0
        x = 500 + rng.normal(0, noise) + (40 if i in (3000, 9000) else 0)
        rows.append((1, i, float(x), None, True, 1000, i // 6000, None, None))
    got = flags(spark, rows)
    assert got.get((1, 3000, "x")) == (False, False, True) and (1, 9000, "x") not in got
    alike = flags(spark, [(*r[:6], 0, None, None) for r in rows])
    count = lambda f: sum(k[1] >= 6000 for k in f)
    assert count(alike) > 10 * max(count(got), 1)  # one fence for both hours is too narrow for the noisy one


def test_edges(spark):
    assert flags(spark, []) == {}
    row = lambda rec, i, x, **kw: (rec, i, x, kw.get("y"), kw.get("ok", True), kw.get("w"), None, None, None)
    rows = [row(1, i, 5.0) for i in range(12)] + [row(2, i, 5.0) for i in range(11)] + [row(None, 0, 9e9, w=10), row(3, None, 9e9, w=10), row(4, 0, None), row(5, 0, float("inf"), w=10), row(6, 0, 1e9)]
    rows += [row(7, i, 9e9, ok=None, w=10) for i in range(3)]
    got = flags(spark, rows)
    assert {k for k in got if k[0] == 1} == {(1, i, "x") for i in range(12)} and all(f == (False, True, False) for k, f in got.items() if k[0] == 1)
    assert got[5, 0, "x"] == (True, False, False) and {k[0] for k in got} == {1, 5}
