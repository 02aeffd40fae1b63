import random

import numpy as np
from pyspark.sql import functions as F

from gazeloom.functions import scalars
from gazeloom.operators import cleaning, evaluate


def test_auc_with_ties(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(2), rng.randrange(8) / 2) for k in (1, 2) for _ in range(60)] + [(3, 1, 1.0), (1, None, 9.0), (1, 1, None)]
    got = {r.k: r.auc for r in evaluate.auc(spark.createDataFrame(rows, "k int, y int, s double"), ["k"], "y", "s").collect()}
    for k in (1, 2):
        p, q = ([s for i, y, s in rows if i == k and y == t and s is not None] for t in (1, 0))
        want = np.mean([(a > b) + (a == b) / 2 for a in p for b in q])
        assert abs(got[k] - want) < 1e-12
    assert got[3] is None


def test_auc_of_a_continuous_score_and_null_groups(spark):
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else i % 3, rng.randrange(2), rng.random()) for i in range(900)]
    got = {r.k: r.auc for r in evaluate.auc(spark.createDataFrame(rows, "k int, y int, s double").repartition(7), ["k"], "y", "s").collect()}
    for k in (None, 1, 2):
        p, q = ([s for i, y, s in rows if i == k and y == t] for t in (1, 0))
        assert abs(got[k] - np.mean([(a > b) + (a == b) / 2 for a in p for b in q])) < 1e-12


def test_positions_of_sparse_orders(spark):
    times = [1_700_000_000_000_000 + i * 11_111_111 for i in range(500)]
    rows = spark.createDataFrame([(t, str(t)) for t in random.Random(2).sample(times, 500)], "t bigint, s string")
    for order in ("t", "s"):
        got = evaluate.positions(rows, order).orderBy("t").collect()
        assert [r["at"] for r in got] == list(range(500)) and {r["n"] for r in got} == {500}
    assert evaluate.positions(rows.limit(0), "t").count() == 0


def test_no_task_holds_all_rows(spark):
    plan = evaluate.positions(spark.range(1000), "id")._jdf.queryExecution().executedPlan().toString()
    windows = plan.count("Exchange SinglePartition")
    assert windows <= 1 and "rangepartitioning" not in plan  # the counts of the ranges; the rows are read from a table


def test_folds_and_splits(spark):
    ids = spark.createDataFrame([(i * 3,) for i in range(11)], "id bigint")
    folds = [r.fold for r in evaluate.positional_folds(ids, "id", 5).orderBy("id").collect()]
    assert folds == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, None]
    parts = [r.part for r in evaluate.ratio_split(ids, "id", 0.8).orderBy("id").collect()]
    assert parts == ["train"] * 8 + ["test"] * 3
    assert {r.fold for r in evaluate.positional_folds(ids.limit(3), "id", 5).collect()} == {None}


def test_scaling_and_scores(spark):
    train = spark.createDataFrame([(0.0, 5.0), (2.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in evaluate.standardized(train, train, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    z = [r.z for r in evaluate.z_scores(train, ["a"]).orderBy("a").collect()]
    assert abs(z[0] + 2**-0.5) < 1e-12 and abs(z[1] - 2**-0.5) < 1e-12


def test_forest_learns_and_importance_finds_the_feature(spark):
    rng = random.Random(1)
    rows = [(i, x, rng.random(), int(x > 0.5)) for i, x in ((i, rng.random()) for i in range(240))]
    df = spark.createDataFrame(rows, "id bigint, good double, noise double, y int")
    scores, importances = evaluate.cross_validated(df, "id", ["good", "noise"], "y", 2, evaluate.forest(trees=5))
    assert scores.count() == 240 and evaluate.auc(scores, [], "y", "score").first().auc > 0.95
    assert evaluate.mean_importance(importances, "feature", "importance").first().feature == "good"
    scores, importances = evaluate.cross_validated(df, "id", ["good", "noise"], "y", 2, evaluate.margins("poly2"), repeats=2)
    found = {r.feature: r.importance for r in evaluate.mean_importance(importances, "feature", "importance").collect()}
    assert found["good"] > 0.3 and abs(found["noise"]) < 0.1 and evaluate.audit(scores, "id").first()[:] == (240, 240, 2, True)


def test_even_folds(spark):
    got = evaluate.shuffled_folds(spark.range(23), "id", 5).groupBy("fold").count().collect()
    assert sorted((r.fold, r["count"]) for r in got) == [(0, 5), (1, 5), (2, 5), (3, 4), (4, 4)]
    assert {r.fold for r in evaluate.shuffled_folds(spark.range(3), "id", 5).collect()} == {0, 1, 2}


def test_rows_by_key(spark):
    df = spark.createDataFrame([(1, "a", 1, 5.0), (1, None, 2, 7.0), (2, "b", 1, None), (2, "a", 3, 1.0), (None, "a", 1, 1.0)], "k int, v string, o int, x double")
    kept = cleaning.only_mapped(df, ["k"], F.col("v").isin("a", "b")).collect()
    assert {r.k for r in kept} == {2} and len(kept) == 2
    assert len(cleaning.without_matching(df, {"k": 1, "v": None}).collect()) == 4 and len(cleaning.without_matching(df, {"v": "a"}).collect()) == 2
    assert sorted((r.k, r.o, r.x) for r in cleaning.from_start(df.where("k = 1"), ["k"], "o", ["x"]).collect()) == [(1, 1, 0.0), (1, 2, 2.0)]


def test_selection(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 5, "c"), (None, 1, "n")], "k int, o int, v string")
    assert {(r.k, r.v) for r in cleaning.keep_first(df, ["k"], ["o"]).collect()} == {(1, "a"), (2, "c"), (None, "n")}
    assert {(r.k, r.v) for r in cleaning.keep_last(df, ["k"], ["o"]).collect()} == {(1, None), (2, "c"), (None, "n")}
    assert sorted(r.o for r in cleaning.first_rows(df.where("k = 1"), ["k"], ["o"], 1, skip=1).collect()) == [2]
    assert cleaning.without_columns(df.withColumn("label", F.lit(1)), cleaning.NOT_FEATURES["expertise"]).columns == ["k", "o", "v"]
    names = spark.createDataFrame([("Saccade",), ("other",)], "n string").select(scalars.unmapped(F.col("n"), scalars.MOVEMENT_NAMES))
    assert [r[0] for r in names.collect()] == [1, None]
