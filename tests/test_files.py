import math
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

GAZE = pa.schema([("recording_id", pa.int64()), ("tracker_id", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("timestamp", pa.float64()), ("gaze_point_validity", pa.string()), ("left_z", pa.float64())])
VALUES = (None, math.nan, math.inf, -math.inf, 5e-324, 1e23, 0.1 + 0.2)
TEXTS = (None, "", " 1 ", "a\nb", "a\r\nb", '"', '""', "a,b", "\\", 'a"b",', "NULL")


def exact(rows):
    """Rows with null and NaN kept apart, the other numbers to the last bit."""
    return Counter(tuple(repr(v) for v in row) for row in rows)


def agrees(spark, folder, name, table, schema, rows):
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema), f"{folder}/{table}.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = connection.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, str(folder)).select(*want.columns)
    assert exact(got.collect()) == exact(want.fetchall())


GAZE_ROWS = {
    "numbers": [(1, 2, v, w, 0.5, "1", v) for v in VALUES for w in VALUES],
    "texts": [(1, 2, float(i), 1.0, 0.5, t, None) for i, t in enumerate(TEXTS)],
    "ids": [(r, t, 1.0, 1.0, 0.5, "1", 1.0) for r in (None, -5, 0, 2**63 - 1, -(2**63)) for t in (None, -1, 0, 7)],
    "none": [],
}


@pytest.mark.parametrize("case", GAZE_ROWS)
def test_gaze_csv_files_on_odd_rows(spark, tmp_path, case):
    agrees(spark, tmp_path, "gaze_csv_files", "gaze", GAZE, GAZE_ROWS[case])


MOVEMENT = pa.schema([("recording_id", pa.int64()), ("ord", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("eye_movement_type", pa.int32())])
MOVEMENT_ROWS = {
    "numbers": [(1, i, v, w, 0) for i, v in enumerate(VALUES) for w in VALUES],
    "codes": [(1, i, 1.0, 2.0, c) for i, c in enumerate((None, 0, 1, 2, 3, 4, -1, 2**31 - 1))],
    "ids": [(r, o, 1.0, 2.0, 1) for r in (None, -5, 0, 2**63 - 1, -(2**63)) for o in (None, -1, 0, 7)],
    "none": [],
}


@pytest.mark.parametrize("case", MOVEMENT_ROWS)
def test_pattern_tsv_files_on_odd_rows(spark, tmp_path, case):
    agrees(spark, tmp_path, "pattern_tsv_files", "movement", MOVEMENT, MOVEMENT_ROWS[case])
