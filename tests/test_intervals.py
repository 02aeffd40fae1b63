import random

import pytest

from gazeloom.operators import intervals

SCHEMA = "id bigint, k string, s bigint, e bigint, kind string, t string"


def periods(spark, rows):
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in intervals.covered_periods(df, ["k"], "id", "s", "e").collect())


def brute(rows):
    out = []
    for k in {r[1] for r in rows if r[1] is not None}:
        own = sorted({(s, e, i) for i, q, s, e in rows if q == k and s is not None and e is not None and s <= e}, key=lambda r: (r[0], r[1]))
        found = []
        for s, e, _ in own:
            if found and s <= found[-1][1]:
                found[-1][1:] = [max(found[-1][1], e), found[-1][2] + 1]
            else:
                found.append([s, e, 1])
        out += [("period", k, s, e, n) for s, e, n in found] + [("gap", k, a[1], b[0], 0) for a, b in zip(found, found[1:])]
    return sorted(out)


@pytest.mark.parametrize("seconds", [1, 600])
def test_against_a_loop(spark, monkeypatch, seconds):
    monkeypatch.setattr(intervals, "CHUNK_S", seconds)
    rng = random.Random(4)
    rows = []
    for i in range(400):
        s = rng.randrange(0, 9_000_000, 50_000)
        rows.append((i, rng.choice("aab"), s, s + rng.choice((-50_000, 0, 0, 20_000, 50_000, 400_000))))
    rows += [(1000, "c", s, s + 10) for s in range(-3_000_000, 0, 1_000_000)] + [(1001, "d", -5, 9_000_000), (1001, "d", -5, 9_000_000), (1002, "d", -5, 9_000_000)]
    assert periods(spark, rows) == brute(rows)


def test_edges(spark):
    assert periods(spark, []) == []
    assert periods(spark, [(1, None, 0, 1), (1, "a", None, 1), (1, "a", 0, None), (1, "a", 2, 1)]) == []
    assert periods(spark, [(None, "a", 0, 0), (None, "a", 0, 0)]) == [("period", "a", 0, 0, 1)]


def test_fixation_times(spark):
    nan = float("nan")
    rows = [(1.5, 2.0, None), (1.5, None, 0.25), (1.5, nan, 0.25), (1.5, None, nan), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "start_time double, end_time double, elapsed_time double")
    got = [(r.start_us, r.end_us) for r in intervals.fixation_intervals(df).collect()]
    assert got == [(1_500_000, 2_000_000), (1_500_000, 1_750_000), (1_500_000, 1_750_000), (1_500_000, None), (None, 1_000_000)]
