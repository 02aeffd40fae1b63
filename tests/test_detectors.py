import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gazeloom.functions import scalars
from gazeloom.operators import idt, ihmm, imst, islands, ivt, kinematics, labels, ordered, sequence, stats

SCHEMA = "rec bigint, ord bigint, x double, y double, z double, t double"


def frame(spark, points, rec=1):
    return spark.createDataFrame([(rec, i, *map(float, p)) for i, p in enumerate(points)], SCHEMA)


def ivt_fixations(spark, points):
    rows = ivt.classify(frame(spark, points), ["rec"], "t", "ord", "z")
    return rows, ivt.fixations(rows, ["rec"])


def test_ivt_no_saccade_and_trailing(spark):
    still = [(100, 100, 650, i / 90) for i in range(6)]
    assert ivt_fixations(spark, still)[1].count() == 0
    jump = still + [(900, 900, 650, (6 + i) / 90) for i in range(5)]
    got = ivt_fixations(spark, jump)[1].collect()
    assert len(got) == 1 and got[0].n == 4 and math.isclose(got[0].elapsed, 3 / 90)


def test_ivt_zero_vector_is_neither(spark):
    rows, _ = ivt_fixations(spark, [(1, 1, 650, 0), (1, 1, 650, 1), (0, 0, 0, 2), (1, 1, 650, 3)])
    assert [r.point for r in rows.orderBy("at").collect()] == [-1, -1]


def islands_frame(spark, rows):
    data = [(1, i, x, 0.0, 650.0, 1.0, s, e, e - s, 2) for i, (x, s, e) in enumerate(rows)]
    return spark.createDataFrame(data, "rec bigint, island bigint, x double, y double, z double, spread double, start_time double, end_time double, elapsed double, n bigint")


def test_ivt_merging(spark):
    close = [(100.0, 0.0, 0.2), (100.0, 0.21, 0.41), (100.0, 0.42, 0.62), (900.0, 2.0, 2.2)]
    compat = ivt.merged_compat(islands_frame(spark, close), ["rec"]).orderBy("start_time").collect()
    assert [r.x for r in compat] == [100.0, 200.0, 100.0, 900.0]  # equal durations add up, the next stays, the first never merges
    weighted = ivt.merged_weighted(islands_frame(spark, close), ["rec"]).orderBy("start_time").collect()
    assert [(r.x, r.end_time) for r in weighted] == [(100.0, 0.2), (100.0, 0.62), (900.0, 2.2)]


def brute_idt(points, limit, duration):
    spread = lambda w: np.ptp(w[:, 0]) + np.ptp(w[:, 1])
    out, i, n = [], 0, len(points)
    while i <= n - duration:
        if not spread(points[i : i + duration]) <= limit:
            i += 1
            continue
        j = i + duration
        while j < n - 1 and spread(points[i : j + 1]) <= limit:
            j += 1
        out.append((i, j - i))
        i = j
    return out


@pytest.mark.parametrize("seed", range(3))
def test_idt_against_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    xy = np.cumsum(rng.normal(0, 4, (400, 2)) * rng.choice([1, 1, 1, 12], (400, 1)), 0)
    got = idt.dispersion_fixations(frame(spark, [(x, y, 0, i) for i, (x, y) in enumerate(xy)]), ["rec"], "ord", "t", 25.0, 4).collect()
    assert sorted((r.first_at, r.n) for r in got) == brute_idt(xy, 25.0, 4)
    with pytest.raises(ValueError):
        idt.dispersion_fixations(frame(spark, []), ["rec"], "ord", "t", 25.0, 0)


def test_idt_last_row_only_in_a_first_window(spark):
    found = lambda n: [(r.first_at, r.n) for r in idt.dispersion_fixations(frame(spark, [(1, 1, 0, i) for i in range(n)]), ["rec"], "ord", "t", 5.0, 3).collect()]
    assert found(3) == [(0, 3)] and found(6) == [(0, 5)] and found(2) == []


def test_hmm(spark):
    states = [0, 0, 1, 0, 0, None]
    df = spark.createDataFrame([(1, i, float(i), s) for i, s in enumerate(states)], "rec bigint, ord bigint, x double, s int")
    got = ihmm.decode_groups(df, ["rec"], "ord", F.col("s"), ["x"]).orderBy("first_order").collect()
    assert [(r.first_order, r.n, r.x) for r in got] == [(0, 2, 0.5), (3, 2, 3.5)]
    rng = np.random.default_rng(0)
    truth = np.repeat([0, 1, 0, 1, 0], 60)
    speeds = np.where(truth, rng.normal(300, 30, 300), rng.normal(20, 5, 300))
    assert (ihmm.two_states(speeds) == truth).mean() > 0.99 and not ihmm.two_states(np.ones(5)).any()


def test_spanning_tree_and_eccentricity():
    rng = np.random.default_rng(1)
    x, y = rng.random(60), rng.random(60)
    parents, children, weights = imst.spanning_tree(x, y)
    edges = sorted((math.hypot(x[i] - x[j], y[i] - y[j]), i, j) for i in range(60) for j in range(i))
    root = list(range(60))
    find = lambda v: v if root[v] == v else find(root[v])
    total = 0.0
    for w, i, j in edges:
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += w
    assert len(weights) == 59 and math.isclose(weights.sum(), total)
    hops = np.full((60, 60), 99)
    np.fill_diagonal(hops, 0)
    hops[parents, children] = hops[children, parents] = 1
    for k in range(60):
        hops = np.minimum(hops, hops[:, k, None] + hops[k])
    assert (imst.eccentricities(60, parents, children) == hops.max(1)).all()
    line = imst.spanning_tree(np.arange(4.0), np.zeros(4))
    assert imst.eccentricities(4, *line[:2]).tolist() == [3, 2, 2, 3]
    two = imst.communities([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (2, 3, 0.1), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0)])
    assert len({two[v] for v in (0, 1, 2)}) == len({two[v] for v in (3, 4, 5)}) == 1 and two[0] != two[5]


def test_hmm_of_a_long_recording_is_one_model(spark, monkeypatch):
    rng = np.random.default_rng(5)
    truth = np.repeat(rng.integers(0, 2, 30), rng.integers(5, 60, 30))
    truth[:250] = 0  # several pieces without a saccade
    speeds = np.abs(np.where(truth, rng.normal(120, 40, len(truth)), rng.normal(40, 20, len(truth)))).round(1)
    x = np.concatenate([[0], np.cumsum(speeds)])
    rows = [(1, i, float(v), 0.0, 0.0, float(i)) for i, v in enumerate(x)] + [(2, i, float(i % 3 == 0), 0.0, 0.0, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(ihmm, "PIECE", 64)
    got = ihmm.hmm_states(df, ["rec"], "ord", "t").where("state is not null").toPandas().sort_values(["rec", "at"])
    assert (got["state"][got["rec"] == 1] == ihmm.two_states(np.diff(x))).all()
    assert (got["state"][got["rec"] == 2] == ihmm.two_states(np.abs(np.diff([float(i % 3 == 0) for i in range(40)])))).all()


@pytest.mark.parametrize("leaf", (8, 128))
def test_spanning_tree_with_ties_is_that_of_all_edges(monkeypatch, leaf):
    monkeypatch.setattr(imst, "LEAF", leaf, raising=False)
    x, y = np.random.default_rng(leaf).integers(0, 15, (2, 300)).astype(float)
    root, want = list(range(300)), set()
    for _, i, j in sorted((float(np.hypot(x[i] - x[j], y[i] - y[j])), i, j) for j in range(300) for i in range(j)):
        if root[i] != root[j]:
            want.add((i, j))
            root = [root[i] if r == root[j] else r for r in root]
    low, high, _ = imst.spanning_tree(x, y)
    assert set(zip(low.tolist(), high.tolist())) == want


def test_a_long_recording_has_one_tree(spark):
    rng = np.random.default_rng(4)
    n = 5000  # more than a piece of 4096 points
    data = pd.DataFrame({"rec": 1, "ord": np.arange(n), "x": rng.random(n), "y": rng.random(n), "t": np.arange(n) / 90, "w": 1.0, "h": 2.0})
    df = spark.createDataFrame(data)
    rows = imst.mst_weight(df, ["rec"], "ord", "t", ("w", "h")).collect()
    want = imst.spanning_tree(data["x"].to_numpy(), data["y"].to_numpy() / 2)[2]
    assert len(want) == n - 1 and len(rows) == 1 and rows[0].n_points == n and math.isclose(rows[0].weight, want.sum())
    found = imst.mst_fixations(df, ["rec"], "ord", "t", ("w", "h")).orderBy("cluster").collect()
    assert [(r.x, r.y, r.n) for r in found] == imst.cluster_points(data["x"].to_numpy(), data["y"].to_numpy(), 1.0, 2.0)


def test_blocks_agree_with_whole_windows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(rec, int(o), float(x), float(y), 0.0, float(o)) for rec, n in ((1, 100), (2, 7)) for o, x, y in zip(np.sort(rng.choice(1000, n, False)), *rng.random((2, n)))]
    df = spark.createDataFrame(rows, SCHEMA)
    reach = kinematics.REACH
    sure = F.when(F.col("ord") % 5 == 0, 0.5).otherwise(1.0)
    small = kinematics.multiscale(ordered.in_blocks(df, ["rec"], "ord", reach, reach, size=16), ["rec"], "t", sure).toPandas()
    whole = kinematics.multiscale(ordered.in_blocks(df, ["rec"], "ord", reach, reach, size=4096), ["rec"], "t", sure).toPandas()
    key = ["rec", "ord"]
    pd.testing.assert_frame_equal(small.sort_values(key).reset_index(drop=True), whole.sort_values(key).reset_index(drop=True))
    sums = islands.with_running_sums(df, ["rec"], "ord", {"total": F.col("x")}, chunk_rows=50).toPandas().sort_values(key)
    assert np.allclose(sums["total"], sums.groupby("rec")["x"].cumsum())


def test_lag_ladder_and_columns(spark):
    assert kinematics.lag_ladder(100, 1, 10) == [1, 1, 1, 2, 4, 7, 13, 25, 50, 100]
    df = spark.createDataFrame([("True",), ("1",), ("1.0",), ("false",), (None,)], "v string")
    assert [r[0] for r in df.select(scalars.is_valid(F.col("v"))).collect()] == [True, True, True, False, False]
    assert spark.range(1).select(scalars.is_valid(F.lit(True))).first()[0]
    ppd = scalars.pixels_per_degree(*[F.lit(v) for v in (3840.0, 2160.0, 614.68, 363.22, 725.0)])
    mean, uneven = spark.range(1).select(*ppd).first()
    assert 70 < mean < 90 and not uneven
    codes = spark.createDataFrame([("F",), ("3",), ("Q",)], "p string").select(scalars.pattern_code(F.col("p")))
    assert [r[0] for r in codes.collect()] == [0, 3, None]


def test_votes_sequences_and_windows(spark):
    votes = spark.createDataFrame([(1, v) for v in (2, 2, 1, 1, 3)] + [(2, None), (2, 4)], "k int, v int")
    assert {r.k: r.v for r in sequence.majority(votes, ["k"], "v").collect()} == {1: 1, 2: 4}
    rows = spark.createDataFrame([(n, i, float(i)) for n in (2, 5, 8) for i in range(n)], "k int, o bigint, f double")
    got = {r.k: [v[0] for v in r.sequence] for r in sequence.padded(rows, ["k"], "o", ["f"], 5).collect()}
    assert got == {2: [0, 1, -1, -1, -1], 5: [0, 1, 2, 3, 4], 8: [3, 4, 5, 6, 7]}
    windows = sequence.model_windows(spark.createDataFrame([(1, i) for i in range(200)], "k int, at bigint"), ["k"], "at", 65, 129).toPandas()
    assert windows["inside"].sum() == 200 and windows["place"].between(0, 128).all()
    types = spark.createDataFrame([(1, 0), (1, 0), (1, None), (1, 2)], "k int, e int")
    assert {r.e: r.percent for r in stats.label_percentages(types, ["k"], "e").collect()} == {0: 50.0, 2: 25.0}


def test_label_states(spark):
    meta = spark.createDataFrame([(i, f"f{i}") for i in range(4)], "recording_id int, fname string")
    rows = spark.createDataFrame([("f0", 1), ("f0", 1), ("f1", 0), ("f1", 1), ("f2", None)], "fname string, y int")
    got = {r.recording_id: r.state for r in labels.label_states(meta, rows, "recording_id", ["fname"], "y").collect()}
    assert got == {0: "labelled", 1: "ambiguous", 2: "unlabelled", 3: "missing"}
    assert labels.labelled(meta, rows, "recording_id", ["fname"], "y").count() == 1
    with pytest.raises(Exception, match="more than one label"):
        labels.labelled(meta, rows, "recording_id", ["fname"], "y", strict=True).collect()
