"""Column functions of gaze data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The classes of readers and of eye movements.
EXPERTISE = {"a": 0, "b": 0, "c": 0, "d": 1}
READER_CLASS = {"a": 0, "b": 1, "c": 2, "d": 3}
MOVEMENT_NAMES = {0: "Fixation", 1: "Saccade", 2: "Smooth Pursuit", 3: "Blinks/Noise"}
PATTERN_CODES = {"F": 0, "S": 1, "P": 2, "B": 3, "3": 3}


def steady(column: Column | str) -> Column:
    """Rounded to 6 places for comparison between engines; exact halves are moved off the edge first."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column + F.lit(1.7e-9), 6)


def is_valid(validity: Column) -> Column:
    """Text, number or boolean that means a valid sample; null does not. Spark writes a boolean true in lower case."""
    return F.coalesce(validity.cast("string").isin("1", "1.0", "True", "true"), F.lit(False))


def mapped(column: Column, mapping: dict) -> Column:
    """The mapping's value, or null where it has none."""
    literal = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return F.try_element_at(literal, column)


def unmapped(column: Column, mapping: dict) -> Column:
    """The key whose value the column has, or null: mapped, the other way round."""
    return mapped(column, {v: k for k, v in mapping.items()})


def normalized(column: Column) -> Column:
    return F.lower(F.trim(column))


def without_prefix(column: Column, prefix: str) -> Column:
    return F.when(column.startswith(prefix), F.substr(column, F.lit(len(prefix) + 1))).otherwise(column)


def pattern_code(column: Column) -> Column:
    """Letter of an eye movement pattern (or the number 3) as code; null for anything else."""
    return mapped(column.cast("string"), PATTERN_CODES)


def angle_between(first: list[Column], second: list[Column]) -> Column:
    """Degrees between two vectors; null if one has no length or a null part."""
    dot = reduce(lambda a, b: a + b, [a * b for a, b in zip(first, second)])
    norms = [F.sqrt(reduce(lambda a, b: a + b, [c * c for c in v])) for v in (first, second)]
    cosine = F.try_divide(dot, norms[0] * norms[1])
    return _degrees_of(cosine)


def angle_between_arrays(first: Column, second: Column) -> Column:
    """The same for arrays of numbers of equal length."""
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    dot = total(F.zip_with(first, second, lambda a, b: a.cast("double") * b.cast("double")))
    norms = [F.sqrt(total(F.transform(v, lambda a: a.cast("double") * a.cast("double")))) for v in (first, second)]
    cosine = F.try_divide(dot, norms[0] * norms[1])
    return _degrees_of(cosine)


def _degrees_of(cosine: Column) -> Column:
    """Angle of a cosine that rounding may have carried past 1; null for null, which greatest and least would pass over."""
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def pixels_per_degree(width_px: Column, height_px: Column, width_mm: Column, height_mm: Column, distance_mm: Column) -> tuple[Column, Column]:
    """Mean of both axes' pixels per degree, and whether they differ by more than a fifth of it."""
    degrees = lambda mm: F.degrees(2 * F.atan(mm / (2 * distance_mm)))
    x, y = F.try_divide(width_px, degrees(width_mm)), F.try_divide(height_px, degrees(height_mm))
    mean = (x + y) / 2
    return mean, F.abs(x - y) > 0.2 * mean


def nan_to(column: Column, value: float) -> Column:
    """The column with NaN as the value; null stays null."""
    return F.nanvl(column, F.lit(value))


def argmax(scores: Column) -> Column:
    """0-based place of the largest score, the first of equals."""
    return F.array_position(scores, F.array_max(scores)) - 1


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of the columns that df has."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    raise ValueError(f"none of {names} in {df.columns}")


def whole_number(column: Column) -> Column:
    """True for null and for values without a fraction."""
    return F.coalesce(column == F.floor(column), F.lit(True))
