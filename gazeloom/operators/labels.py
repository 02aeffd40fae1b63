"""Joining recordings with their attributes and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL_KEYS = ["fname", "global_ind", "num_part", "num_img"]


def distinct_meta(meta: DataFrame) -> DataFrame:
    """Recordings, each once, with the radiologist's name in plain form."""
    return meta.withColumn("radiologist", F.lower(F.trim("radiologist"))).distinct()


def label_states(recordings: DataFrame, labels: DataFrame, ident: str, keys: list[str], label: str) -> DataFrame:
    """Per recording: n_labels, n_known (labels that aren't null), label and state.

    state is 'missing' without a label row, 'ambiguous' with more than one different row, 'unlabelled'
    with a null label, else 'labelled'. Repeated equal rows count once.
    """
    distinct = labels.select(*keys, F.col(label).alias("_label")).distinct()
    counted = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_labels"), F.count("_label").alias("n_known"), F.min("_label").alias("_label"))
    joined = recordings.join(counted, keys, "left")
    n = F.coalesce("n_labels", F.lit(0).cast("bigint"))
    state = F.when(n == 0, "missing").when(n > 1, "ambiguous").when(F.col("_label").isNull(), "unlabelled").otherwise("labelled")
    return joined.select(ident, n.alias("n_labels"), F.coalesce("n_known", F.lit(0).cast("bigint")).alias("n_known"), F.when(n == 1, F.col("_label")).alias(label), state.alias("state"))


def labelled(recordings: DataFrame, labels: DataFrame, ident: str, keys: list[str], label: str, strict: bool = False) -> DataFrame:
    """The recordings that have one label, with it. strict: an ambiguous label is an error."""
    states = label_states(recordings, labels, ident, keys, label)
    if strict:
        clash = F.raise_error(F.concat(F.lit("more than one label: "), F.col(ident).cast("string")))
        states = states.withColumn("state", F.when(F.col("state") == "ambiguous", clash).otherwise(F.col("state")))
    return recordings.join(states.where("state = 'labelled'").select(ident, label), ident)


def with_recording(samples: DataFrame, recordings: DataFrame, columns: list[str]) -> DataFrame:
    """Samples with attributes of their recording. The recordings' side is broadcast if Spark finds it small."""
    return samples.join(recordings.select("recording_id", *columns), "recording_id")


def not_written(todo: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to be done: rows of todo whose keys aren't written."""
    return todo.join(written.select(*keys).distinct(), keys, "left_anti")


def written(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is done: rows of todo whose keys are there."""
    return todo.join(done.select(*keys).distinct(), keys, "left_semi")


def completeness(expected: DataFrame, actual: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per `by`: how many keys are expected, present and missing."""
    present = actual.select(*keys).distinct().withColumn("_present", F.lit(1))
    rows = expected.select(*keys, *by).distinct().join(present, keys, "left")
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(n.alias("n_expected"), F.count("_present").alias("n_present"), (n - F.count("_present")).alias("n_missing"))
