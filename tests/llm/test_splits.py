import itertools
import random

import numpy as np

from gazeloom.llm import splits

SCHEMA = "id bigint, a string, b string, y int, label string, group_id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def brute(rows):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a, b, _ in rows:
        if i is None:
            continue
        root(("id", i))
        for k, v in (("a", a), ("b", b)):
            if v is not None:
                p, q = root(("id", i)), root((k, v.strip(" ").lower()))
                parent[p] = q
    groups = {}
    for i in {r[0] for r in rows if r[0] is not None}:
        groups.setdefault(root(("id", i)), []).append(i)
    return {i: (min(g), len(g)) for g in groups.values() for i in g}


def found(spark, rows):
    got = splits.connected_groups(table(spark, rows), "id", ["a", "b"]).collect()
    assert len({r.id for r in got}) == len(got)
    return {r.id: (r.group_id, r.group_size) for r in got}


def test_groups(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, f"A{rng.randrange(60)}", f" a{rng.randrange(60)} "]), rng.choice([None, f"f{rng.randrange(90)}"]), i % 2) for i in rng.sample(range(1000), 120)]
    rows += rows[:10] + [(None, "a1", "f1", 0), (rows[0][0], "a59", None, 0)]
    assert found(spark, rows) == brute(rows)


def test_long_chain(spark):
    order = list(range(64))
    random.Random(3).shuffle(order)
    rows = [(i, f"k{p // 2}", f"m{(p + 1) // 2}", 0) for p, i in enumerate(order)]
    assert found(spark, rows) == {i: (0, 64) for i in range(64)}


def test_edges(spark):
    assert found(spark, []) == {}
    assert found(spark, [(5, None, None, 0), (6, None, None, 0), (7, "", None, 0), (8, " ", None, None)]) == {5: (5, 1), 6: (6, 1), 7: (7, 2), 8: (7, 2)}
    # one column's value is another's only within the column
    assert found(spark, [(1, "x", None, 0), (2, None, "x", 0)]) == {1: (1, 1), 2: (2, 1)}


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(1)
    rows = [(i, f"a{int(rng.expovariate(0.01))}", None, int(rng.random() < 0.2)) for i in range(3000)]
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = splits.assign_splits(table(spark, rows), "id", ["a", "b"], "y", shares).toPandas()
    assert len(got) == got["id"].nunique() == 3000 and got.groupby("group_id")["split"].nunique().max() == 1
    label = {r[0]: r[3] for r in rows}
    for split, share in shares.items():
        ids = got.loc[got["split"] == split, "id"]
        assert abs(len(ids) / 3000 - share) < 0.015
        assert abs(sum(label[i] for i in ids) / len(ids) - 0.2) < 0.05


def test_splits_of_small_groups_and_edges(spark):
    rows = [(i, f"a{i // 2}", None, i % 4 // 2 if i % 7 else None) for i in range(2000)]
    got = splits.assign_splits(table(spark, rows), "id", ["a"], "y", {"train": 0.5, "test": 0.5}).toPandas()
    assert len(got) == 2000 and abs((got["split"] == "train").mean() - 0.5) < 0.03 and got.groupby("group_id")["split"].nunique().max() == 1
    assert splits.assign_splits(table(spark, []), "id", ["a"], "y", {"train": 1.0}).count() == 0
    assert splits.assign_splits(table(spark, [(1, None, None, None)]), "id", ["a"], "y", {"train": 0.8, "test": 0.2}).count() == 1


def test_text_ids(spark):
    rows = [(f"r{i}", f"a{i // 3}", i % 2) for i in range(90)]
    got = splits.assign_splits(spark.createDataFrame(rows, "id string, a string, y int"), "id", ["a"], "y", {"train": 0.5, "test": 0.5}).toPandas()
    assert len(got) == 90 and got.groupby("group_id")["split"].nunique().max() == 1 and abs((got["split"] == "train").mean() - 0.5) < 0.05


def deviation(vectors, groups, dealt, shares):
    weight = vectors / (groups @ vectors)
    return ((dealt.T @ weight - np.array(shares)[:, None]) ** 2).sum()


def test_dealing_is_near_the_best():
    rng = np.random.default_rng(3)
    for _ in range(20):
        vectors, groups, shares = rng.integers(1, 40, (6, 2)).astype(float), np.ones(6, np.int64), [0.6, 0.2, 0.2]
        dealt = splits.deal_profiles(vectors, groups, shares)
        assert (dealt.sum(1) == groups).all()
        best = min(deviation(vectors, groups, np.eye(3)[list(c)], shares) for c in itertools.product(range(3), repeat=6))
        assert deviation(vectors, groups, dealt, shares) <= best * 1.6 + 1e-3
    vectors, groups = rng.integers(0, 9, (300, 3)).astype(float), rng.integers(1, 1000, 300)
    assert deviation(vectors, groups, splits.deal_profiles(vectors, groups, [0.8, 0.1, 0.1]), [0.8, 0.1, 0.1]) < 1e-9
