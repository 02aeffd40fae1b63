import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

import pytest

from gazeloom import session
from gazeloom.operators import islands, ordered

START = 1_700_000_000_000_000


def series(spark, gaps):
    """Two keys, the second with one lone row far off; orders are microseconds."""
    rng = random.Random(6)
    rows, t = [], START
    for i in range(400):
        t += rng.choice(gaps)
        rows.append((1, t, i % 7))
    rows += [(2, 5, 1), (2, t, 2), (2, t + (1 << 45), 3)]
    return spark.createDataFrame(rng.sample(rows, len(rows)), "k int, o bigint, v int")


@pytest.mark.parametrize("gaps", [(1, 2), (10_000, 11_111), (1 << 33, 3)])
@pytest.mark.parametrize("span", [4, 1 << 14])
def test_blocks_of_sparse_orders(spark, monkeypatch, gaps, span):
    monkeypatch.setattr(ordered, "SPAN", span)
    df = series(spark, gaps)
    rows = ordered.in_blocks(df, ["k"], "o", 2, 1, size=16)
    w = W.partitionBy("k", "_block").orderBy("_at")
    got = rows.withColumns({"a": F.lag("v", 2).over(w), "b": F.lead("v").over(w)}).where("_core").select("k", "o", "_at", "a", "b").collect()
    whole = W.partitionBy("k").orderBy("o")
    want = df.select("k", "o", (F.row_number().over(whole) - 1).alias("_at"), F.lag("v", 2).over(whole).alias("a"), F.lead("v").over(whole).alias("b")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) or sorted(map(repr, got)) == sorted(map(repr, want))
    sums = islands.with_running_sums(df, ["k"], "o", {"s": F.col("v")}, chunk_rows=16).select("k", "o", "s").collect()
    assert sorted(map(tuple, sums)) == sorted(map(tuple, df.select("k", "o", F.sum("v").over(whole)).collect()))
    chunked = df.withColumn("_c", F.floor(F.col("o") / 16))
    near = ordered.with_next(ordered.with_previous(chunked, ["k"], "_c", ["o"], ["v"], "p"), ["k"], "_c", ["o"], ["v"], "n").select("k", "o", "p.v", "n.v").collect()
    assert sorted(map(repr, map(tuple, near))) == sorted(map(repr, map(tuple, df.select("k", "o", F.lag("v").over(whole), F.lead("v").over(whole)).collect())))


def test_tables_need_a_shared_folder(spark, monkeypatch):
    first = session.cut_lineage(spark.range(5))
    second = session.cut_lineage(first, after=(first,))
    assert second.count() == 5
    with pytest.raises(Exception):  # noqa: B017  the first table is gone
        spark.read.parquet(first._lineage_table).count()

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        session._table_folder(Session())
