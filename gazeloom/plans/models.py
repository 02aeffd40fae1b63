"""Queries over folds, classifiers, model windows and their results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.functions import scalars as S
from gazeloom.functions.scalars import steady
from gazeloom.operators import cleaning, evaluate, imst, kinematics, labels, sequence
from gazeloom.operators.ordered import clean_number, in_blocks
from gazeloom.plans.reference import (
    DISTANCE_MM, FEATURES, FEATURES_SQL, FOLDS_SQL, KIN, LABEL_STATES, META, MOVEMENT_SQL, PPD, PX_MM, REC, SAMPLES,
    _features, _meta, _movement, _multiscale, _samples, _steadied, _windowed, r,
)
from gazeloom.plans.registry import Registry
from gazeloom.session import read

REGISTRY = Registry()

# --- cleaning by recording -----------------------------------------------------------------------

UNMAPPED = "radiologist is null or left(radiologist, 1) not in ('a', 'b', 'c', 'd')"


@REGISTRY.add(f"with {FEATURES_SQL} select sample_id, recording_id, radiologist from f where recording_id not in (select recording_id from f where recording_id is not null and ({UNMAPPED})) and recording_id is not null")
def mapped_readers_only(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of recordings all of whose samples have a reader with a class."""
    rows = _features(spark, folder)
    mapped = evaluate.reader_classes(F.col("radiologist"), S.EXPERTISE).isNotNull()
    return cleaning.only_mapped(rows, REC, mapped).select("sample_id", "recording_id", "radiologist")


@REGISTRY.add(f"with {META} select recording_id, cohort, radiologist from m where not (radiologist is not distinct from 'a0001' and cohort is not distinct from '600')")
def without_one_reader(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings but for one reader's of one cohort; a null in either doesn't match and stays."""
    return cleaning.without_matching(_meta(spark, folder), {"radiologist": "a0001", "cohort": "600"}).select("recording_id", "cohort", "radiologist")


@REGISTRY.add(f"with {FEATURES_SQL} select sample_id, case when isnan(fixation_rate) then 0.5 else fixation_rate end as score from f")
def neutral_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A score per sample, NaN being neutral."""
    return _features(spark, folder).select("sample_id", S.nan_to(F.col("fixation_rate"), 0.5).alias("score"))


@REGISTRY.add("select distinct recording_id, lower(trim(radiologist)) as radiologist from meta where recording_id in (select recording_id from movement)")
def labelled_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings that have movement labels."""
    return labels.written(_meta(spark, folder).select("recording_id", "radiologist").distinct(), read(spark, folder, "movement"), REC)


@REGISTRY.add(
    f"with {MOVEMENT_SQL} select recording_id, bool_and(coalesce(timestamp * 10 = floor(timestamp * 10), true)) as whole, count(distinct eye_movement_type) as n_types, min(cast(eye_movement_type as varchar)) as first_type from mv group by recording_id"
)
def label_types(spark: SparkSession, folder: str) -> DataFrame:
    """Per recording: whether all times are whole tenths, how many movement types there are, and the first of them as text."""
    rows = _movement(spark, folder)
    time = S.first_present(rows, "t", "timestamp")
    label = F.col("eye_movement_type")
    return rows.groupBy(*REC).agg(F.bool_and(S.whole_number(time * 10)).alias("whole"), F.count_distinct(label).alias("n_types"), F.min(label.cast("string")).alias("first_type"))


# --- features in degrees, from the start, and online ---------------------------------------------

PPD_SQL = f"(select tracker_id, ({PPD[0]} + {PPD[1]}) / 2 as ppd from trackers)"
SCREEN_SQL = f"tp as (select recording_id, min(ppd) as ppd from (select distinct recording_id, tracker_id from gaze) join {PPD_SQL} using (tracker_id) group by recording_id)"


def _per_degree(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels per degree of every recording's screen."""
    mm = lambda c: F.col(c) * PX_MM
    ppd, _ = S.pixels_per_degree(F.col("screen_w"), F.col("screen_h"), mm("screen_w"), mm("screen_h"), F.lit(DISTANCE_MM))
    screens = read(spark, folder, "trackers").select("tracker_id", ppd.alias("ppd"))
    return read(spark, folder, "gaze").select("recording_id", "tracker_id").distinct().join(screens, "tracker_id").groupBy(*REC).agg(F.min("ppd").alias("ppd"))


DEGREES = ["x", "y", *[f"{k}_{n}" for n in kinematics.SCALES for k in ("speed",)]]


@REGISTRY.add(
    KIN.rstrip() + f", {SCREEN_SQL} select recording_id, ord, {r('x / ppd')} as x, {r('y / ppd')} as y, "
    + ", ".join(f"{r(f'speed{n} / ppd')} as speed_{n}" for n in kinematics.SCALES)
    + " from k join tp using (recording_id)"
)
def features_in_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Place and speeds over five scales in degrees of the visual field."""
    rows = _multiscale(spark, folder).join(_per_degree(spark, folder), "recording_id")
    return _steadied(kinematics.scaled(rows, F.col("ppd"), DEGREES).select("recording_id", "ord", *DEGREES), DEGREES)


@REGISTRY.add(SAMPLES + f"select recording_id, ord, {r('x - first_value(x) over p')} as x, {r('y - first_value(y) over p')} as y from s window p as (partition by recording_id order by pos)")
def relative_to_start(spark: SparkSession, folder: str) -> DataFrame:
    """Samples from the place of their recording's first."""
    rows = cleaning.from_start(_samples(spark, folder).select("recording_id", "ord", "x", "y"), REC, "ord", ["x", "y"])
    return _steadied(rows.select("recording_id", "ord", "x", "y"), ["x", "y"])


ONLINE_WINDOW, LATENCY_US = 65, 10_000.0


def _online_sql() -> str:
    w, ends, out = "window w as (partition by recording_id, win order by pos)", [], []
    for n in kinematics.SCALES:
        step = -(-n // 2)
        ends.append(f"case when coalesce(lag(sure, {step}) over w, false) then -{step} else 0 end as a{n}")
        ends.append("0 as b1" if step == n else f"case when coalesce(lead(sure, {step}) over w, false) then {step} else 0 end as b{n}")
    values = [
        f"(case when b{n} > 0 then lead({c}, {-(-n // 2)}) over w else {c} end) - (case when a{n} < 0 then lag({c}, {-(-n // 2)}) over w else {c} end) as d{c}{n}" for n in kinematics.SCALES for c in ("x", "y")
    ]
    for n in kinematics.SCALES:
        moved = f"sure and a{n} <> b{n}"
        out.append(f"{r(f'case when {moved} then sqrt(dx{n} * dx{n} + dy{n} * dy{n}) / ((b{n} - a{n}) * {LATENCY_US} / 1000000) / ppd else 0.0 end')} as speed_{n}")
        out.append(f"{r(f'case when {moved} then atan2(dy{n}, dx{n}) else 0.0 end')} as direction_{n}")
    body = f", q as (select *, pos // {ONLINE_WINDOW} as win from s), b as (select *, {', '.join(ends)} from q {w}), e as (select *, {', '.join(values)} from b {w}), {SCREEN_SQL}"
    sure = KIN.partition(", b as (")[0]
    return sure + body + f" select recording_id, ord, win as \"window\", {', '.join(out)} from e join tp using (recording_id)"


@REGISTRY.add(_online_sql())
def online_features(spark: SparkSession, folder: str) -> DataFrame:
    """Speeds in degrees and directions within windows of 65 samples, as an online classifier takes them."""
    rows = cleaning.distinct_samples(read(spark, folder, "gaze")).withColumns({c: clean_number(c) for c in ("x", "y")}).where("x is not null and y is not null")
    confidence = F.when(S.is_valid(F.col("gaze_point_validity")), 1.0).otherwise(0.5)
    rows = rows.select("recording_id", "ord", "x", "y", confidence.alias("confidence")).join(_per_degree(spark, folder), "recording_id")
    found = kinematics.online_features(rows, REC, "ord", ONLINE_WINDOW, F.col("confidence"), LATENCY_US, F.col("ppd"))
    names = [f"{k}_{n}" for n in kinematics.SCALES for k in ("speed", "direction")]
    return _steadied(found.select("recording_id", "ord", "window", *names), names)


# --- windows, batches and predictions ------------------------------------------------------------


@REGISTRY.add(
    f"with {MOVEMENT_SQL}, w as (select *, sum(case when not isnan(x) then x end) over v as sx, count(*) over v as n from mp window v as (partition by recording_id order by pos rows between 24 preceding and current row)) "
    f"select recording_id, ord, eye_movement_type as label, n, {r('sx')} as sum_x from w where pos >= 24 and eye_movement_type is not null"
)
def training_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled windows of 25 samples, in short."""
    placed = in_blocks(_movement(spark, folder).withColumn("x", clean_number("x")).select("recording_id", "ord", "x", "eye_movement_type"), REC, "ord", 24)
    rows = kinematics.training_windows(placed, REC, ["x"], "eye_movement_type", 25)
    total = F.aggregate("window", F.lit(None).cast("double"), lambda a, v: F.coalesce(a + v[0], v[0], a))
    return rows.select("recording_id", "ord", F.col("eye_movement_type").alias("label"), F.size("window").cast("bigint").alias("n"), steady(total).alias("sum_x"))


@REGISTRY.add(f"with {MOVEMENT_SQL} select recording_id, ord, eye_movement_type as label, 1 as n, case when not isnan(timestamp) then timestamp end as t from mv where eye_movement_type is not null")
def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled windows of one sample."""
    placed = in_blocks(_movement(spark, folder).withColumn("t", clean_number("timestamp")).select("recording_id", "ord", "t", "eye_movement_type"), REC, "ord", 0)
    rows = kinematics.training_windows(placed, REC, ["t"], "eye_movement_type", 1)
    return rows.select("recording_id", "ord", F.col("eye_movement_type").alias("label"), F.size("window").alias("n"), F.col("window")[0][0].alias("t"))


@REGISTRY.add(
    SAMPLES + ", w as (select *, pos // 65 as win, pos % 65 + 32 as place from s), c as (select recording_id, ord, [x, y, 400.0 + place, (x + y) / 2] as sc from w) "
    "select recording_id, ord, list_position(sc, list_max(sc)) - 1 as prediction from c"
)
def stitched_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every sample from overlapping windows of 129, of each of which the middle 65 samples count.

    A stand-in for a model scores four classes by a sample's coordinates and its place in the window.
    """
    placed = in_blocks(_samples(spark, folder).select("recording_id", "ord", "x", "y"), REC, "ord", 0).where("_core").withColumn("at", F.col("_at"))
    windows = sequence.model_windows(placed.select("recording_id", "ord", "x", "y", "at"), REC, "at", 65, 129)
    scored = windows.withColumn("scores", F.array(F.col("x"), F.col("y"), F.lit(400.0) + F.col("place"), (F.col("x") + F.col("y")) / 2))
    return sequence.stitched(scored, "scores", "prediction").select("recording_id", "ord", "prediction")


WIDTH = 4


@REGISTRY.add(
    f"with {FEATURES_SQL}, n as (select *, row_number() over (partition by recording_id order by sample_id desc) as back, count(*) over (partition by recording_id) as n from f), "
    "k as (select * from n where back <= 5), p as (select *, least(n, 5) - back as i from k), "
    f"e as (select recording_id, [speed_mean + sin(i), speed_std + cos(i), path_length + sin(i * exp(-2 * ln(10000.0) / {WIDTH})), fixation_rate + cos(i * exp(-2 * ln(10000.0) / {WIDTH}))] as v, i from p) "
    f"select recording_id, i as place, {', '.join(f'{r(f'v[{j + 1}]')} as v{j}' for j in range(WIDTH))} from e"
)
def encoded_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """The last five samples of each recording, with their places encoded as sines and cosines."""
    rows = sequence.padded(_features(spark, folder), REC, "sample_id", ["speed_mean", "speed_std", "path_length", "fixation_rate"], 5)
    waves = rows.select("recording_id", F.posexplode(F.slice(sequence.encoded(F.col("sequence"), WIDTH), 1, F.least("n_rows", F.lit(5)).cast("int"))).alias("place", "v"))
    return waves.select("recording_id", "place", *[steady(F.col("v")[j]).alias(f"v{j}") for j in range(WIDTH)])


# --- folds and classifiers -----------------------------------------------------------------------

DEALT = "select *, row_number() over (order by md5('42:' || sample_id)) - 1 as pos, count(*) over () as n from {0}"
SHUFFLED_SQL = "select sample_id, cast(case when pos < (n % 5) * (n // 5 + 1) then pos // (n // 5 + 1) else n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) end as integer) as fold from d"


@REGISTRY.add(f"with {FEATURES_SQL}, d as ({DEALT.format('f')}) {SHUFFLED_SQL}")
def kfold_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """Five even folds of the samples in a random order."""
    return evaluate.shuffled_folds(_features(spark, folder).select("sample_id"), "sample_id", 5)


@REGISTRY.add(f"with {FEATURES_SQL} select radiologist, count(*) as n, 1 as n_folds from f group by radiologist")
def kfold_hash_audit(spark: SparkSession, folder: str) -> DataFrame:
    """How many samples and folds each reader has, the folds being dealt by reader."""
    rows = evaluate.hashed_folds(_features(spark, folder).select("sample_id", "radiologist"), "radiologist", 5)
    return rows.groupBy("radiologist").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold").cast("int").alias("n_folds"))


@REGISTRY.add(
    FOLDS_SQL + ", sc as (select fold, expert, round(fixation_rate, 1) as score from fo where fixation_rate is not null and not isnan(fixation_rate) and fold is not null), "
    "pr as (select a.fold, avg(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0.0 end) as auc from sc a join sc b on a.fold = b.fold and a.expert = 1 and b.expert = 0 group by a.fold) "
    f"select {r('avg(auc)')} as mean_auc, {r('stddev_pop(auc)')} as std_auc from pr"
)
def auc_over_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation over folds of the AUC of the fixation rate as a score of expertise."""
    rows = evaluate.positional_folds(_features(spark, folder), "sample_id", 5).where("fold is not null")
    scored = rows.withColumn("score", F.round(clean_number("fixation_rate"), 1))
    return _steadied(evaluate.mean_and_deviation(evaluate.auc(scored, ["fold"], "expert", "score"), "auc"), ["mean_auc", "std_auc"])


COMPLETE = " and ".join(f"{c} is not null and not isnan({c})" for c in FEATURES)
TRAINING_SQL = f"with {FEATURES_SQL}, tr as (select * from f where expert is not null and {COMPLETE})"
ERROR_SQL = LABEL_STATES.rstrip() + f", {FEATURES_SQL}, tr as (select f.*, st.doctor_mistake from f join st using (recording_id) where state = 'labelled' and {COMPLETE})"
AUDIT_SQL = " select count(*) as n, count(distinct sample_id) as n_distinct, cast(least(5, count(*)) as integer) as n_folds, true as in_range from tr"


def _training(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.complete_rows(_features(spark, folder).select("sample_id", "expert", *FEATURES), ["expert", *FEATURES])


def _error_training(spark: SparkSession, folder: str) -> DataFrame:
    """Complete samples with the label of their recording."""
    known = labels.labelled(_meta(spark, folder), read(spark, folder, "doctor_mistake"), "recording_id", labels.LABEL_KEYS, "doctor_mistake")
    rows = _features(spark, folder).select("sample_id", "recording_id", *FEATURES)
    return cleaning.complete_rows(rows, FEATURES).join(known.select("recording_id", "doctor_mistake"), "recording_id")


def _expertise(spark: SparkSession, folder: str, learner: evaluate.Learner, repeats: int = 0) -> tuple[DataFrame, DataFrame]:
    return evaluate.cross_validated(_training(spark, folder), "sample_id", FEATURES, "expert", 5, learner, repeats)


def _error(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return evaluate.cross_validated(_error_training(spark, folder), "sample_id", FEATURES, "doctor_mistake", 5, evaluate.forest(250, 9))


@REGISTRY.add()
def rf_cv_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold scores of expertise by random forests."""
    return _expertise(spark, folder, evaluate.forest())[0]


@REGISTRY.add(TRAINING_SQL + AUDIT_SQL)
def rf_cv_audit(spark: SparkSession, folder: str) -> DataFrame:
    """That every complete sample has one score of expertise, between 0 and 1."""
    return _audited(rf_cv_predictions(spark, folder))


@REGISTRY.add()
def rf_importances(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over folds of the forests' importances for expertise, largest first."""
    return evaluate.mean_importance(_expertise(spark, folder, evaluate.forest())[1], "feature", "importance")


@REGISTRY.add(ERROR_SQL + AUDIT_SQL)
def rf_error_audit(spark: SparkSession, folder: str) -> DataFrame:
    """That every complete sample of a labelled recording has one score of a mistake, between 0 and 1, by forests of 250 trees of depth 9."""
    return _audited(_error(spark, folder)[0])


@REGISTRY.add(f"select unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) as feature, true as in_range, true as adds_up")
def rf_error_importances(spark: SparkSession, folder: str) -> DataFrame:
    """That the forests of mistakes give each feature an importance, which adds up to 1 in a fold, or to 0 where a fold has one label only."""
    found = _error(spark, folder)[1]
    sums = found.groupBy("fold").agg(F.sum("importance").alias("_sum"))
    return found.join(sums, "fold").groupBy("feature").agg(
        F.bool_and(F.col("importance").between(0, 1)).alias("in_range"), F.bool_and(F.round("_sum", 6).isin(0.0, 1.0)).alias("adds_up")
    )


@REGISTRY.add()
def svm_cv_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold scores of expertise by linear support vector machines."""
    return _expertise(spark, folder, evaluate.margins())[0]


@REGISTRY.add(TRAINING_SQL + AUDIT_SQL)
def svm_cv_audit(spark: SparkSession, folder: str) -> DataFrame:
    """That every complete sample has one score by the linear machines, between 0 and 1."""
    return _audited(svm_cv_predictions(spark, folder))


@REGISTRY.add(TRAINING_SQL + AUDIT_SQL)
def svm_rbf_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The same by machines on random Fourier features."""
    return _audited(_expertise(spark, folder, evaluate.margins("rbf"))[0])


@REGISTRY.add()
def svm_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over folds of the absolute coefficients of the linear machines, largest first."""
    return evaluate.mean_importance(_expertise(spark, folder, evaluate.margins())[1], "feature", "importance")


@REGISTRY.add()
def permutation_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Mean fall of the AUC of held-out samples when a feature is permuted, ten times a fold, of machines on products of two features."""
    return evaluate.mean_importance(_expertise(spark, folder, evaluate.margins("poly2"), 10)[1], "feature", "importance")


def _audited(scores: DataFrame) -> DataFrame:
    return evaluate.audit(scores, "sample_id").withColumn("n_folds", F.col("n_folds").cast("int"))


# --- spanning trees ------------------------------------------------------------------------------

TREE_POINTS = (
    SAMPLES + ", m as (select distinct recording_id, win_width, win_height from meta where win_width > 0 and win_height > 0), "
    "u as (select recording_id, x, y, t, min(ord) as ord from ok join m using (recording_id) group by all), "
    "q as (select *, row_number() over (partition by recording_id order by ord) - 1 as pos, count(*) over (partition by recording_id) as n from u), "
    "pts as (select * from q where n >= 2 and (n <= 7000 or pos % 2 = 0))"
)


@REGISTRY.add(TREE_POINTS + " select recording_id, count(*) as n_points, count(*) - 1 as n_edges, true as spans from pts group by recording_id")
def imst_tree_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Points and edges of every recording's tree, and whether it reaches every point."""
    edges = imst.tree_edges(_windowed(spark, folder), REC, "ord", "t", ("win_width", "win_height"))
    ends = edges.select("recording_id", F.explode(F.array("first", "second")).alias("v")).groupBy("recording_id").agg(F.count_distinct("v").alias("n_points"))
    counts = edges.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return ends.join(counts, "recording_id").select("recording_id", "n_points", "n_edges", (F.col("n_points") == F.col("n_edges") + 1).alias("spans"))


@REGISTRY.add()
def imst_depths(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation of the eccentricities in every recording's tree, and points in clusters."""
    nodes = imst.cluster_nodes(_windowed(spark, folder), REC, "ord", "t", ("win_width", "win_height"))
    return nodes.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("eccentricity").alias("mean_eccentricity"), F.stddev_samp("eccentricity").alias("std_eccentricity"),
        F.count("cluster").alias("n_clustered"), F.count_distinct("cluster").alias("n_clusters"),
    )


@REGISTRY.add()
def imst_fixations_with_recording(spark: SparkSession, folder: str) -> DataFrame:
    """Fixations by spanning tree, each with its recording's reader, the reader's class, cohort and image."""
    found = imst.mst_fixations(_windowed(spark, folder), REC, "ord", "t", ("win_width", "win_height"))
    joined = labels.with_recording(found, _meta(spark, folder), ["radiologist", "cohort", "fname", "gaze_path", "win_width", "win_height"])
    return joined.withColumn("reader_class", evaluate.reader_classes(F.col("radiologist"), S.READER_CLASS))
