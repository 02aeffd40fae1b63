import math
import random

import pytest
from pyspark.sql import functions as F

from gazeloom.llm import mixing

SCHEMA = "id bigint, source string, n bigint, n_uses string, _s string"


def setup(spark, rows, targets):
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return docs, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    return [(i * 10 + k, s, 1 + int(rng.expovariate(1 / 300))) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]


def test_shares_and_limits(spark):
    rows = rows_of({"a": 2000, "b": 700, "c": 150})
    targets = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 6)]
    docs, goals = setup(spark, rows + rows[:30] + [(7, None, 5), (8, "other", 5), (None, "a", 5), (19, "a", None), (29, "a", 0)], targets)
    got = mixing.mix(docs, "id", "source", F.col("n"), goals)
    report = {r.source: r for r in mixing.shares(got, "source", goals).collect()}
    assert all(abs(report[s].share - t) < 0.005 and report[s].most_uses <= m for s, t, m in targets)
    one = got.toPandas()
    size = {i: n for i, _, n in rows}
    assert one["id"].is_unique and all(size[i] == n for i, n in zip(one["id"], one["n_tokens"]))
    # the largest selection in which the shares hold: some source is used up
    supply = {s: sum(n for _, q, n in rows if q == s) for s, _, _ in targets}
    total = min(supply[s] * m / t for s, t, m in targets)
    assert abs((one["n_tokens"] * one["n_uses"]).sum() / total - 1) < 0.005


def test_total_beyond_the_limits_tilts_towards_the_natural_mix(spark):
    rows = rows_of({"a": 1000, "b": 100})
    docs, goals = setup(spark, rows, [("a", 0.5, 1), ("b", 0.5, 2)])
    supply = {s: sum(n for _, q, n in rows if q == s) for s in "ab"}
    total = float(sum(supply.values()))
    got = mixing.mix(docs, "id", "source", F.col("n"), goals, passes=1.0).toPandas()
    tokens = (got["n_tokens"] * got["n_uses"]).groupby(got["source"]).sum()
    assert abs(tokens["b"] / (2 * supply["b"]) - 1) < 0.05 and got.loc[got["source"] == "b", "n_uses"].max() == 2
    assert abs(tokens.sum() / total - 1) < 0.05


def test_even_mix_within_limits_and_target_entropy(spark):
    rows = rows_of({"a": 3000, "b": 900, "c": 60})
    targets = [("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.3, 4)]
    docs, goals = setup(spark, rows, targets)
    supply = {s: float(sum(n for _, q, n in rows if q == s)) for s in "abc"}
    total = sum(supply.values())
    got = mixing.mix(docs, "id", "source", F.col("n"), goals, passes=1.0, exponent=0.0)
    report = {r.source: r for r in mixing.shares(got, "source", goals).collect()}
    assert all(report[s].most_uses <= m for s, _, m in targets) and abs(report["a"].n_tokens / total - report["a"].share) < 0.01
    limits = {s: float(m) for s, _, m in targets}
    e = mixing.exponent_for_limits(supply, limits, total, wanted=0.0)
    assert 0 < e < 1 and all(abs(report[s].share - w) < 0.01 for s, w in mixing.temperature_weights(supply, e).items())
    got = mixing.mix(docs, "id", "source", F.col("n"), goals, entropy_goal=0.9)
    report = mixing.shares(got, "source", goals).collect()
    assert all(abs(r.entropy - 0.9) < 0.01 and r.most_uses <= r.max_repeats for r in report)
    # no mix allows three passes: the targets stay and the selection is the largest at these
    got = mixing.mix(docs, "id", "source", F.col("n"), goals, passes=3.0)
    assert all(abs(r.share - r.target_share) < 0.02 for r in mixing.shares(got, "source", goals).collect())


def test_temperature():
    supply = {"a": 900.0, "b": 90.0, "c": 10.0, "none": 0.0}
    natural, flat = mixing.temperature_weights(supply, 1.0), mixing.temperature_weights(supply, 0.0)
    assert math.isclose(natural["a"], 0.9) and math.isclose(flat["c"], 1 / 3) and "none" not in flat
    goal = 0.8
    assert math.isclose(mixing.entropy(mixing.temperature_weights(supply, mixing.exponent_for_entropy(supply, goal))), goal, abs_tol=1e-9)
    repeats = dict.fromkeys(supply, 4.0)
    e = mixing.exponent_for_limits(supply, repeats, 1000.0, wanted=0.0)
    assert math.isclose(mixing.repeats_needed(mixing.temperature_weights(supply, e), supply, repeats, 1000.0), 1.0, abs_tol=1e-6)


def test_edges(spark, monkeypatch):
    docs, goals = setup(spark, [], [("a", 1.0, 2)])
    assert mixing.mix(docs, "id", "source", F.col("n"), goals).count() == 0
    assert [(r.share, r.n_documents) for r in mixing.shares(mixing.mix(docs, "id", "source", F.col("n"), goals), "source", goals).collect()] == [(0.0, 0)]
    docs, goals = setup(spark, [(1, "a", 10), (2, "b", 10)], [])
    assert mixing.mix(docs, "id", "source", F.col("n"), goals).count() == 0
    docs, goals = setup(spark, [(1, "a", 10), (2, "b", 10)], [("a", 0.4, 2), ("b", 0.4, 2), ("missing", 0.2, 5), ("c", None, 1), (None, 0.5, 1), ("b", 0.1, 1)])
    assert {r.id: r.n_uses for r in mixing.mix(docs, "id", "source", F.col("n"), goals).collect()} == {1: 2, 2: 2}
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix(docs, "id", "source", F.col("n"), goals)
