"""Splits, folds, scores and classifiers for recording-level samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazeloom.operators.ordered import BEFORE, ranged, with_position
from gazeloom.session import cut_lineage



def positions(df: DataFrame, order: str, out: str = "at") -> DataFrame:
    """Adds the 0-based position of each row by order, and n, the number of rows; nulls come first.

    Rows are sorted into ranges (ordered.ranged); the ranges' counts, a row each, are added up and
    broadcast. order may be of any type that can be sorted; ties fall in any order.
    """
    rows = ranged(df, [order])
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(*BEFORE)  # a row per range
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(F.lit(0))).alias("n"))
    placed = rows.join(F.broadcast(counts), "_part")
    return placed.withColumn(out, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")


def ratio_split(df: DataFrame, order: str, share: float) -> DataFrame:
    """Adds part: train for the first share of the rows by order, test for the others."""
    rows = positions(df, order)
    return rows.withColumn("part", F.when(F.col("at") < F.floor(F.col("n") * share), "train").otherwise("test")).drop("at", "n")


def positional_folds(df: DataFrame, order: str, folds: int) -> DataFrame:
    """Adds fold: contiguous blocks of floor(n / folds) rows; the rest is null, in training always."""
    rows = positions(df, order)
    fold = F.try_divide(F.col("at"), F.floor(F.col("n") / folds))
    fold = F.when(F.floor(F.col("n") / folds) > 0, F.floor(fold))
    return rows.withColumn("fold", F.when(fold < folds, fold.cast("int"))).drop("at", "n")


def hashed_folds(df: DataFrame, ident: str, folds: int, seed: int = 42) -> DataFrame:
    """Adds fold by a hash of ident (or of a group's id): no shuffle, and the same for every run."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(ident), F.lit(seed)), F.lit(folds)).cast("int"))


def auc(df: DataFrame, by: list[str], truth: str, score: str) -> DataFrame:
    """Area under the ROC curve per group, exact, ties counting half; null without both classes.

    Scores are counted per value first. The cumulative sum runs over distinct scores, within ranges
    of (by, score) on top of the ranges before, so a continuous score isn't gathered in one task.
    """
    counts = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("q"))
    rows = ranged(counts, [*by, score])
    parts = rows.groupBy(*by, "_part").agg(F.sum("q").alias("_q"))  # a row per range and group in it
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(*BEFORE)
    parts = parts.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_part").alias("_p"), F.coalesce(F.sum("_q").over(earlier), F.lit(0)).alias("_before"))
    same = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.col("_part") == F.col("_p"))
    inside = W.partitionBy(*by, "_part").orderBy(score).rowsBetween(*BEFORE)
    below = F.col("_before") + F.coalesce(F.sum("q").over(inside), F.lit(0))
    wins = rows.join(parts, same).withColumn("_w", F.col("p") * (below + F.col("q") / 2))
    sums = wins.groupBy(*by).agg(F.sum("p").alias("n_positive"), F.sum("q").alias("n_negative"), F.sum("_w").alias("_w"))
    return sums.withColumn("auc", F.try_divide(F.col("_w"), F.col("n_positive") * F.col("n_negative"))).drop("_w")


def mean_and_deviation(df: DataFrame, value: str) -> DataFrame:
    """One row: mean and population standard deviation over folds."""
    return df.agg(F.avg(value).alias(f"mean_{value}"), F.stddev_pop(value).alias(f"std_{value}"))


def mean_importance(df: DataFrame, feature: str, importance: str) -> DataFrame:
    """Mean over folds by feature, largest first."""
    means = df.groupBy(feature).agg(F.avg(importance).alias(importance))
    return means.orderBy(F.desc(importance), feature)


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds z: the sum of the columns' z scores over all rows, by the sample standard deviation."""
    sums = df.agg(*[F.avg(c).alias(f"_m{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s{c}") for c in columns])
    z = reduce(lambda a, b: a + b, [F.try_divide(F.col(c) - F.col(f"_m{c}"), F.col(f"_s{c}")) for c in columns])
    return df.join(F.broadcast(sums)).withColumn("z", z).select(*df.columns, "z")  # one row


def standardized(train: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """`other` with the columns scaled by train's mean and population standard deviation (1 where that is 0)."""
    sums = train.agg(*[F.avg(c).alias(f"_m{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s{c}") for c in columns])
    scaled = {c: (F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") > 0, F.col(f"_s{c}")).otherwise(1.0) for c in columns}
    return other.join(F.broadcast(sums)).withColumns(scaled).select(*other.columns)  # one row


def shuffled_folds(df: DataFrame, ident: str, folds: int, seed: int = 42) -> DataFrame:
    """Adds fold: even folds of the rows in a random order, that of a digest of seed and ident.

    The first rows % folds folds have one row more. A row's fold doesn't depend on where it is stored.
    """
    rows = positions(df.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.col(ident)).cast("binary"))), "_order")
    size, more = F.floor(F.col("n") / folds), F.col("n") % folds
    in_larger = F.col("at") < more * (size + 1)
    fold = F.when(in_larger, F.floor(F.col("at") / (size + 1))).otherwise(more + F.floor((F.col("at") - more * (size + 1)) / size))
    return rows.withColumn("fold", fold.cast("int")).drop("_order", "at", "n")


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


@dataclass(frozen=True)
class Fitted:
    """A classifier fitted on a fold: it adds the column score to rows of the features; importance is by feature, if it has one."""

    score: Callable[[DataFrame], DataFrame]
    importance: list[float] | None = None


Learner = Callable[[DataFrame, list[str], str], Fitted]


def forest(trees: int = 100, depth: int = 5, seed: int = 10) -> Learner:
    """Random forests with impurity importance."""

    def fit(train: DataFrame, features: list[str], label: str) -> Fitted:
        model = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(_assembled(train.coalesce(1 + int(train.count() >> 16)), features))
        score = lambda df: model.transform(_assembled(df, features)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        return Fitted(score, model.featureImportances.toArray().tolist())

    return fit


def margins(kernel: str = "linear", waves: int = 64, seed: int = 42) -> Learner:
    """Support vector machines on features scaled by the training rows, with calibrated scores.

    kernel: linear (importance: absolute coefficients), poly2 and poly3 (on products of features), or
    rbf (on `waves` random Fourier features, as for a kernel of width 1 / number of features). The
    margin is turned into a probability by a logistic regression on the training rows.
    """
    if kernel not in ("linear", "poly2", "poly3", "rbf"):
        raise ValueError(kernel)

    def fit(train: DataFrame, features: list[str], label: str) -> Fitted:
        sums = train.agg(*[F.avg(c).alias(f"_m{c}") for c in features], *[F.stddev_pop(c).alias(f"_s{c}") for c in features]).first()
        scaled = lambda c: (F.col(c) - F.lit(sums[f"_m{c}"])) / F.lit(sums[f"_s{c}"] or 1.0)

        def spread(df: DataFrame) -> DataFrame:
            if kernel == "rbf":
                rng = np.random.default_rng(seed)
                turns, shifts = rng.normal(0, (2 / len(features)) ** 0.5, (waves, len(features))), rng.uniform(0, 2 * np.pi, waves)
                angles = [reduce(Column.__add__, [scaled(c) * F.lit(float(t)) for c, t in zip(features, turn)]) + F.lit(float(s)) for turn, s in zip(turns, shifts)]
                return df.withColumn("features", array_to_vector(F.array(*[F.cos(a) for a in angles])))
            vectors = df.withColumn("features", array_to_vector(F.array(*[scaled(c) for c in features])))
            if kernel == "linear":
                return vectors
            expand = PolynomialExpansion(degree=int(kernel[-1]), inputCol="features", outputCol="_expanded")
            return expand.transform(vectors).drop("features").withColumnRenamed("_expanded", "features")

        vectors = cut_lineage(spread(train).select(label, "features").coalesce(1 + int(train.count() >> 16)))  # a pass per step: few tasks of 2 ** 16 rows
        machine = LinearSVC(labelCol=label, maxIter=50, regParam=0.01).fit(vectors)

        def margin(spread_rows: DataFrame) -> DataFrame:
            side = machine.transform(spread_rows).withColumn("_margin", vector_to_array("rawPrediction")[1])
            return _assembled(side.drop("features", "rawPrediction", "prediction"), ["_margin"])

        calibration = LogisticRegression(labelCol=label, maxIter=25, tol=1e-4).fit(margin(vectors))
        score = lambda df: calibration.transform(margin(spread(df))).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", "_margin")
        return Fitted(score, np.abs(machine.coefficients.toArray()).tolist() if kernel == "linear" else None)

    return fit


def _constant(classes: list[float], n_features: int) -> Fitted:
    return Fitted(lambda df: df.withColumn("score", F.lit(float(classes[0]) if classes else 0.5)), [0.0] * n_features)


def cross_validated(df: DataFrame, ident: str, features: list[str], label: str, folds: int, learner: Learner, repeats: int = 0) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores (ident, fold, label, score), and importances (fold, feature, importance).

    Folds are shuffled_folds. Where all rows to learn from have one label, each score is that label,
    and where there are none, 0.5. Importances are the learner's own or, with repeats, the mean fall of
    the fold's AUC over that many permutations of each feature among the fold's held-out rows.
    """
    data = cut_lineage(shuffled_folds(df, ident, folds).select(ident, "fold", F.col(label).cast("double").alias(label), *features))
    scores, importances = [], []
    for fold in range(folds):  # folds are a small parameter
        train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        classes = [row[0] for row in train.select(label).distinct().limit(2).collect()]
        model = learner(train, features, label) if len(classes) > 1 else _constant(classes, len(features))
        scores.append(model.score(test).select(ident, "fold", label, "score"))
        if repeats:
            importances.append(_permutation(model, test, ident, features, label, repeats).withColumn("fold", F.lit(fold)))
        elif model.importance is not None:
            importances.append(df.sparkSession.createDataFrame([(f, v, fold) for f, v in zip(features, model.importance)], "feature string, importance double, fold int"))
    table = reduce(DataFrame.unionByName, importances) if importances else df.sparkSession.createDataFrame([], "feature string, importance double, fold int")
    return reduce(DataFrame.unionByName, scores), table


def _permutation(model: Fitted, test: DataFrame, ident: str, features: list[str], label: str, repeats: int, seed: int = 42) -> DataFrame:
    """Mean fall of the AUC per feature: (feature, importance).

    In each repeat the rows stand in two random orders; a row takes the feature from the row of its
    place in the other order. All repeats and features are scored in one pass.
    """
    copies = test.withColumn("_r", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))

    def placed(salt: int) -> DataFrame:
        order = F.xxhash64(ident, "_r", F.lit(seed + salt))
        rows = copies.withColumn("_order", order).withColumn("_chunk", F.shiftright(order, 54))
        return with_position(rows, ["_r"], "_chunk", ["_order", ident], "_place").drop("_order", "_chunk")

    donors = placed(1).select("_r", "_place", F.struct(*features).alias("_other"))
    rows = placed(0).join(donors, ["_r", "_place"])
    changed = F.array(*[F.struct(F.lit(f).alias("feature"), *[(F.col("_other")[c] if c == f else F.col(c)).alias(c) for c in features]) for f in features])
    scored = model.score(rows.select(ident, label, "_r", F.inline(changed)))
    base = auc(model.score(test), [], label, "score").select(F.col("auc").alias("_base"))
    falls = auc(scored, ["feature", "_r"], label, "score").join(F.broadcast(base))  # one row
    return falls.groupBy("feature").agg(F.avg(F.col("_base") - F.col("auc")).alias("importance"))


def audit(scores: DataFrame, ident: str) -> DataFrame:
    """One row about out-of-fold scores: n, n_distinct ids, folds, and whether all are between 0 and 1."""
    ok = F.bool_and(F.coalesce(F.col("score").between(0, 1), F.lit(False)))
    return scores.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(ident).alias("n_distinct"), F.count_distinct("fold").alias("n_folds"), ok.alias("in_range"))


def reader_classes(column: Column, classes: dict[str, int]) -> Column:
    """Class of a reader by the first letter of the plain name; null for a letter without one."""
    from gazeloom.functions.scalars import mapped, normalized

    return mapped(F.substring(normalized(column), 1, 1), classes)
