import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeloom import plugins
from gazeloom.operators.ivt import classify
from gazeloom.session import ship
from gazeloom.sources import readers
from gazeloom.streaming.velocity import stream_velocity


def test_csv_json_and_paths(spark, tmp_path):
    for date, image, text in (("01.02.2020", "a.png", "x,y,timestamp,gaze_point_validity\n1,2,3,True\n"), ("02.02.2020", "b.png", "timestamp,extra,x\n5,q,7\n")):
        folder = tmp_path / date / image
        folder.mkdir(parents=True)
        (folder / "gaze.csv").write_text(text)
        (folder / "meta.json").write_text(json.dumps({"radiologist": "a1", "fname": image}) if image == "a.png" else "{broken")
    first = readers.read_gaze_csv(spark, f"{tmp_path}/01*/*/gaze.csv").first()
    assert (first.recording, first.x, first.gaze_point_validity, first.left_z) == ("01.02.2020/a.png", 1.0, "True", None)
    second = readers.read_gaze_csv(spark, f"{tmp_path}/02*/*/gaze.csv").first()
    assert (second.x, second.timestamp, second.y) == (7.0, 5.0, None)
    good, bad = readers.read_meta_json(spark, f"{tmp_path}/*/*/meta.json")
    assert [r.fname for r in good.collect()] == ["a.png"] and [r.recording for r in bad.collect()] == ["02.02.2020/b.png"]
    (tmp_path / "tsv" / "deep").mkdir(parents=True)
    (tmp_path / "tsv" / "deep" / "f.tsv").write_text("Filename\tX_coord\tPattern\nq\t1.5\tF\n")
    row = readers.read_tsv(spark, f"{tmp_path}/tsv").first()
    assert (row.X_coord, row.Pattern, row.parent) == (1.5, "F", "deep") and "Filename" not in row.asDict()


def test_arff_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r1", i, float(i), i / 4) for i in range(5)] + [("r2", 0, None, 1.0)], "rec string, ord int, x double, time double")
    readers.write_arff(df, "rec", "ord", ["x", "time"], {"width_px": 10, "DISTANCE": 0.5}, f"{tmp_path}/arff")
    rows, metadata = readers.read_arff(spark, f"{tmp_path}/arff/*/*.txt", ["x", "time"])
    assert sorted((r.x, r.time) for r in rows.collect() if r.x is not None) == [(float(i), i / 4) for i in range(5)] and rows.count() == 6
    named = {(r.name, r.value) for r in readers.screen_metadata(metadata).collect()}
    assert named == {("width_px", 10.0), ("distance_mm", 500.0)}
    text = ["% number after speed is the window", "%@METADATA width_px 1", "@RELATION old", "@ATTRIBUTE x NUMERIC", "%@METADATA late 2"]
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(text)], "recording string, line_no int, line string")
    tidy = [r.line for r in readers.tidy_arff_headers(lines).orderBy("line_no").collect()]
    assert tidy == [text[2], text[1], text[3], text[4]]


def test_model_plugins(spark):
    ship(spark)
    df = spark.createDataFrame([(1, [[0.0, 1.0], [2.0, 3.0]]), (2, [[5.0, 1.0], [9.0, 0.0]]), (3, [[float("nan"), 0.0], [0.0, 0.0]])], "id bigint, w array<array<double>>")
    last = lambda: lambda windows: windows[:, -1, :]
    first = lambda: lambda windows: np.stack([windows[:, 0, 0], windows[:, 0, 0] * 0 + 3], 1)
    got = sorted((r.id, r.model, r.prediction) for r in plugins.predict_windows(df, ["id"], "w", [last, first]).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 0, 0), (2, 1, 0)]
    with pytest.raises(ValueError):
        plugins.predict_windows(df, ["id"], "w", [])


def test_stream_equals_batch(spark, tmp_path):
    ship(spark)
    rng = np.random.default_rng(0)
    rows = [(rec, i, float(500 + rng.normal(0, 40)), float(300 + rng.normal(0, 40)), 650.0, i / 90) for rec in (1, 2) for i in range(40)]
    schema = "recording_id bigint, ord bigint, x double, y double, z double, t double"
    for k, part in enumerate((rows[:15] + rows[40:50], rows[15:40] + rows[50:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream_velocity(stream).writeStream.format("memory").queryName("velocities").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.recording_id, r.ord): r.point for r in spark.table("velocities").where("ord >= 2").collect()}
    batch = classify(spark.createDataFrame(rows, schema), ["recording_id"], "t", "ord", "z").collect()
    assert got == {(r.recording_id, r.at): r.point for r in batch} and len(got) == 76


def test_benchmark_files_and_arrays(spark, tmp_path):
    for name in ("one/benchmarks/a.arff", "two/benchmarks/b.arff", "two/other/c.arff", "d.arff"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("@RELATION x")
    assert sorted(r.prefix for r in readers.benchmark_files(spark, str(tmp_path)).collect()) == ["one", "two"]
    df = spark.createDataFrame([(1, 0, 1.5, 2), (1, 1, None, None), (1, readers.NPZ_ROWS, 3.0, 0), (None, 5, 9.0, 1)], "k int, o int, x double, y int")
    files = readers.pack_npz(df, ["k"], "o", ["x"], "y")
    assert files.count() == 3
    got = readers.unpack_npz(files, ["k"], ["x"], "y").collect()
    assert sorted((r.part, r.place, r.y) for r in got if r.k == 1) == [(0, 0, 2), (0, 1, -1), (1, 0, 0)]
