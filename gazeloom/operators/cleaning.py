"""Cleaning, deduplication and row selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazeloom.functions.scalars import is_valid
from gazeloom.operators.ordered import clean_number, in_blocks

# Columns of a feature table that don't enter a model, by task.
NOT_FEATURES = {
    "expertise": (
        "acceleration_mean", "acceleration_std", "case", "fname", "win_w", "win_h", "label", "x", "y", "Unnamed: 0",
        "speed_mean", "speed_std", "steps_back", "timestamp", "rad_name", "gaze_path",
    ),
    "error": (
        "acceleration_mean", "acceleration_std", "case", "fname", "win_w", "win_h", "x", "y", "Unnamed: 0",
        "speed_mean", "speed_std", "steps_back", "timestamp", "rad_name", "gaze_path", "radiologist",
    ),
}


def distinct_samples(gaze: DataFrame) -> DataFrame:
    """The samples, each once: rows of one (recording_id, ord) are the same but for the time of receipt."""
    return gaze.drop("received_at").distinct()


def valid_samples(gaze: DataFrame) -> DataFrame:
    """Distinct valid samples with both coordinates, NaN being none."""
    return valid_rows(distinct_samples(gaze))


def valid_rows(gaze: DataFrame) -> DataFrame:
    """Valid rows with both coordinates, repeated ones as often as they are."""
    rows = gaze.where(is_valid(F.col("gaze_point_validity")))
    rows = rows.withColumns({c: clean_number(c) for c in ("x", "y")})
    return rows.where("x is not null and y is not null")


def keep_first(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """Of the rows that agree in subset (nulls agree) the first by order. Partial results are combined before the shuffle."""
    rest = [c for c in df.columns if c not in subset]
    first = df.groupBy(*subset).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*subset, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """Of the rows that agree in subset the last by order."""
    rest = [c for c in df.columns if c not in subset]
    last = df.groupBy(*subset).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*subset, "_row.*").select(*df.columns)


def decimate(df: DataFrame, keys: list[str], order: str, above: int, least: int = 2) -> DataFrame:
    """Every other row of keys with more than `above` rows; keys with fewer than `least` rows are left out."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = in_blocks(df, keys, order, 0).where("_core").join(counts, keys)
    kept = placed.where((F.col("_n") >= least) & ((F.col("_n") <= above) | (F.col("_at") % 2 == 0)))
    return kept.drop("_n", "_at", "_block", "_core")


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int, skip: int = 0) -> DataFrame:
    """Up to n rows of each key after the first `skip`. The ranks stop at skip + n, also before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= skip + n).where(F.col("_rank") > skip).drop("_rank")


def without_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """df without those of the columns it has; NOT_FEATURES names them for the two tasks."""
    return df.drop(*names)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null or NaN in the columns."""
    return df.dropna("any", subset=columns)


def union_by_name(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both; a column that one lacks is null there."""
    return first.unionByName(second, allowMissingColumns=True)


def without_matching(df: DataFrame, values: dict) -> DataFrame:
    """df without the rows that have all of the values; a null matches a null only, and no row is lost for having one."""
    match = reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()])
    return df.where(~match)


def only_mapped(df: DataFrame, keys: list[str], mapped: Column) -> DataFrame:
    """The rows of keys all of whose rows are mapped; one that isn't, or null, leaves its key out. Null keys are left out."""
    sound = df.groupBy(*keys).agg(F.bool_and(F.coalesce(mapped, F.lit(False))).alias("_ok")).where("_ok").select(*keys)
    return df.join(sound, keys, "left_semi")


def from_start(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The columns less their value in the key's first row by order."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_first"))
    return df.join(first, keys).withColumns({c: F.col(c) - F.col("_first")[c] for c in columns}).drop("_first")


def no_coordinates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of which all x and all y are missing; a missing column counts as missing values."""
    count = lambda c: F.count(clean_number(F.col(c).cast("double"))) if c in df.columns else F.lit(0)
    return df.groupBy(*keys).agg(count("x").alias("n_x"), count("y").alias("n_y")).where("n_x = 0 and n_y = 0").select(*keys)


def window_relative(df: DataFrame) -> DataFrame:
    """x and y from the window's corner."""
    return df.withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")})


def screen_share(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """x and y as shares of the window's size; null where that is 0."""
    return df.withColumns({"x": F.try_divide(F.col("x"), width), "y": F.try_divide(F.col("y"), height)})
