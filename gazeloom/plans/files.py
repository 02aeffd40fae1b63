"""Queries that write a table in one of the recordings' file formats and read it back, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.functions import scalars as S
from gazeloom.plans.data_care import PARSED_SQL
from gazeloom.plans.registry import Registry
from gazeloom.session import read, scratch_folder
from gazeloom.sources import readers

REGISTRY = Registry()


def _named(column: str, key: str) -> Column:
    """The number in a folder's name key=number."""
    return F.regexp_extract(column, f"{key}=(-?[0-9]+)", 1).cast("bigint")


def _read_back(found: Callable[[], DataFrame], schema: str) -> DataFrame:
    """What found reads from a folder that was just written; no rows if nothing was, as then there is no file with a header."""
    try:
        return found()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return SparkSession.active().createDataFrame([], schema)


@REGISTRY.add("select distinct recording_id, tracker_id, x, y, timestamp, gaze_point_validity, left_z from gaze where recording_id is not null and tracker_id is not null")
def gaze_csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """The samples from CSV files, two levels of folders, a file per recording and tracker."""
    gaze = read(spark, folder, "gaze").select("recording_id", "tracker_id", "x", "y", "timestamp", "gaze_point_validity", "left_z").distinct()
    root = scratch_folder(spark)
    readers.write_csv_by_recording(gaze.where("recording_id is not null and tracker_id is not null"), root, ["tracker_id", "recording_id"])
    rows = _read_back(lambda: readers.read_gaze_csv(spark, f"{root}/*/*/*.csv", multiline=True), f"date string, image string, {readers.GAZE_SCHEMA}")
    return rows.select(_named("image", "recording_id").alias("recording_id"), _named("date", "tracker_id").cast("int").alias("tracker_id"), "x", "y", "timestamp", "gaze_point_validity", "left_z")


PATTERNS = {v: k for k, v in S.PATTERN_CODES.items() if k != "3"}


@REGISTRY.add("select distinct recording_id, ord, x, y, eye_movement_type as code from movement where recording_id is not null")
def pattern_tsv_files(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled samples from tab-separated files with letters for the patterns, found at any depth; a code without a letter is written as its number."""
    rows = read(spark, folder, "movement").select("recording_id", "ord", "x", "y", "eye_movement_type").distinct().where("recording_id is not null")
    code = F.col("eye_movement_type")
    pattern = F.coalesce(S.mapped(code, PATTERNS), code.cast("string"))
    letters = rows.select("recording_id", F.lit("a file").alias("Filename"), "ord", F.col("x").alias("X_coord"), F.col("y").alias("Y_coord"), F.lit(1.0).alias("Confidence"), pattern.alias("Pattern"))
    root = scratch_folder(spark)
    readers.write_csv_by_recording(letters, root, ["recording_id"], "\t")
    found = _read_back(lambda: readers.read_tsv(spark, root), "ord string, X_coord double, Y_coord double, Pattern string, parent string")
    code = F.coalesce(S.pattern_code(F.col("Pattern")).cast("int"), F.col("Pattern").try_cast("int"))
    return found.select(_named("parent", "recording_id").alias("recording_id"), F.col("ord").cast("int").alias("ord"), F.col("X_coord").alias("x"), F.col("Y_coord").alias("y"), code.alias("code"))


META_COLUMNS = [f.name for f in readers.META_SCHEMA]


@REGISTRY.add(f"select distinct {', '.join(META_COLUMNS)} from meta where fname is not null")
def meta_json_files(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings' metadata from files of one JSON object each; those without an image aren't readable."""
    root = scratch_folder(spark)
    readers.write_meta_json(read(spark, folder, "meta").select(*META_COLUMNS).distinct(), f"{root}/meta/all")
    return readers.read_meta_json(spark, f"{root}/meta/all/*.json")[0].select(*META_COLUMNS)


@REGISTRY.add(
    PARSED_SQL + "select count(*) as n_files, count(*) filter (where sound and json_type(json_extract(case when sound then raw else '{}' end, '$.fname')) = 'VARCHAR') as n_sound "
    "from o where regexp_full_match(raw, '[^\\n\\r]+')"
)
def raw_meta_scan(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the raw metadata objects, written as one file each, there are and can be read; the others are skipped."""
    raw = read(spark, folder, "raw_records").where("kind = 'meta'").select("record_id", "raw").distinct().where(F.col("raw").rlike(r"^[^\n\r]+$"))
    root = scratch_folder(spark)
    raw.select("raw").write.option("maxRecordsPerFile", 1).text(f"{root}/meta/all")
    sound, bad = readers.read_meta_json(spark, f"{root}/meta/all/*.txt")
    files = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    both = files(sound, "n_sound").join(F.broadcast(files(bad, "n_bad")))  # one row each
    return both.select((F.col("n_sound") + F.col("n_bad")).alias("n_files"), "n_sound")


ARFF = ["ord", "x", "y", "timestamp", "eye_movement_type"]


def _arff(spark: SparkSession, folder: str) -> str:
    rows = read(spark, folder, "movement").select("recording_id", *ARFF).distinct().where("recording_id is not null")
    root = scratch_folder(spark)
    readers.write_arff(rows, "recording_id", "timestamp", ARFF, {"PIXELX": 1920, "DIMENSIONX": 0.5, "height_px": 1080}, root)
    return root


@REGISTRY.add("select distinct recording_id, cast(ord as double) as ord, case when not isnan(x) then x end as x, case when not isnan(y) then y end as y, timestamp, cast(eye_movement_type as double) as eye_movement_type from movement where recording_id is not null")
def arff_files(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled samples from ARFF relations, one per recording."""
    rows, _ = readers.read_arff(spark, f"{_arff(spark, folder)}/*/*.txt", ARFF)
    numbers = {c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y")}
    return rows.withColumns(numbers).select(_named("recording", "_r").alias("recording_id"), *ARFF)


@REGISTRY.add("select distinct recording_id, unnest(['width_px', 'width_mm', 'height_px']) as name, unnest([1920.0, 500.0, 1080.0]) as value from movement where recording_id is not null")
def arff_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata of those relations in its present names and units."""
    _, metadata = readers.read_arff(spark, f"{_arff(spark, folder)}/*/*.txt", ARFF)
    return readers.screen_metadata(metadata).select(_named("recording", "_r").alias("recording_id"), "name", "value")


@REGISTRY.add("select distinct recording_id, case when not isnan(x) then x end as x, case when not isnan(y) then y end as y, coalesce(eye_movement_type, -1) as eye_movement_type from movement")
def npz_files(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled samples from files of arrays."""
    rows = read(spark, folder, "movement").select("recording_id", "ord", "x", "y", "eye_movement_type").distinct()
    root = scratch_folder(spark)
    readers.pack_npz(rows, ["recording_id"], "ord", ["x", "y"], "eye_movement_type").write.parquet(root)
    back = readers.unpack_npz(spark.read.parquet(root), ["recording_id"], ["x", "y"], "eye_movement_type")
    return back.select("recording_id", F.when(~F.isnan("x"), F.col("x")).alias("x"), F.when(~F.isnan("y"), F.col("y")).alias("y"), "eye_movement_type").distinct()
