import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

SMALL = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value.item() if hasattr(value, "item") else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if v is None or v != v else plain(v) for v in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    connection = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    want = connection.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, str(SMALL)).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
