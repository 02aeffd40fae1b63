"""Queries over gaze, movement, features and their attributes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.functions import scalars as S
from gazeloom.functions.scalars import steady
from gazeloom.operators import cleaning, evaluate, idt, ihmm, imst, ivt, kinematics, labels, sequence, stats
from gazeloom.operators.ordered import clean_number, in_blocks
from gazeloom.plans.registry import Registry
from gazeloom.session import read

REGISTRY = Registry()
REC = ["recording_id"]
FEATURES = ["speed_mean", "speed_std", "acceleration_mean", "fixation_rate", "duration_mean", "path_length"]

SAMPLES = """with g as (select distinct recording_id, ord, tracker_id, x, y, left_z, timestamp as t, gaze_point_validity as v from gaze),
ok as (select * from g where v in ('1', '1.0', 'True', 'true') and x is not null and y is not null and not isnan(x) and not isnan(y)),
s as (select *, row_number() over (partition by recording_id order by ord) - 1 as pos from ok)
"""
META = "m as (select distinct * replace (lower(trim(radiologist)) as radiologist) from meta)"


def r(expression: str) -> str:
    """The SQL of scalars.steady."""
    return f"round(({expression}) + 1.7e-9, 6)"


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.valid_samples(read(spark, folder, "gaze")).withColumnRenamed("timestamp", "t")


def _meta(spark: SparkSession, folder: str) -> DataFrame:
    return labels.distinct_meta(read(spark, folder, "meta"))


def _movement(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "movement").distinct()


def _features(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "features").distinct()
    return rows.withColumns({"radiologist": S.normalized(F.col("radiologist")), "fname": S.normalized(F.col("fname"))})


FEATURES_SQL = "f as (select distinct * replace (lower(trim(radiologist)) as radiologist, lower(trim(fname)) as fname) from features)"
MOVEMENT_SQL = "mv as (select distinct * from movement), mp as (select *, row_number() over (partition by recording_id order by ord) - 1 as pos from mv)"


# --- cleaning and joins --------------------------------------------------------------------------


@REGISTRY.add(SAMPLES + "select recording_id, ord, x, y, t from ok")
def validity_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The valid samples."""
    return _samples(spark, folder).select("recording_id", "ord", "x", "y", "t")


@REGISTRY.add(
    SAMPLES + f", {META} select recording_id, ord, cohort, {r('x - x0')} as x, {r('y - y0')} as y, "
    f"{r('(x - x0) / nullif(win_width, 0)')} as share_x, {r('(y - y0) / nullif(win_height, 0)')} as share_y from ok join m using (recording_id)"
)
def origin_shift_meta_join(spark: SparkSession, folder: str) -> DataFrame:
    """Samples from their window's corner, in pixels and as shares of the window."""
    joined = labels.with_recording(_samples(spark, folder), _meta(spark, folder), ["cohort", "x0", "y0", "win_width", "win_height"])
    moved = cleaning.window_relative(joined)
    shares = {"share_x": F.try_divide("x", "win_width"), "share_y": F.try_divide("y", "win_height")}
    return moved.withColumns(shares).select("recording_id", "ord", "cohort", *[steady(c).alias(c) for c in ("x", "y", "share_x", "share_y")])


LABEL_STATES = (
    f"with {META}, l as (select fname, global_ind, num_part, num_img, count(*) as n, count(doctor_mistake) as k, min(doctor_mistake) as d "
    "from (select distinct fname, global_ind, num_part, num_img, doctor_mistake from doctor_mistake) group by all), "
    "st as (select recording_id, coalesce(n, 0) as n_labels, coalesce(k, 0) as n_known, case when n = 1 then d end as doctor_mistake, "
    "case when n is null then 'missing' when n > 1 then 'ambiguous' when d is null then 'unlabelled' else 'labelled' end as state "
    "from m left join l using (fname, global_ind, num_part, num_img))\n"
)


@REGISTRY.add(LABEL_STATES + "select recording_id, radiologist, cohort, st.doctor_mistake from m join st using (recording_id) where state = 'labelled'")
def label_join_4key(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings with their one label."""
    rows = labels.labelled(_meta(spark, folder), read(spark, folder, "doctor_mistake"), "recording_id", labels.LABEL_KEYS, "doctor_mistake")
    return rows.select("recording_id", "radiologist", "cohort", "doctor_mistake")


@REGISTRY.add(
    f"with {META}, l as (select fname, global_ind, count(*) as n, min(doctor_mistake) as d from "
    "(select distinct fname, global_ind, doctor_mistake from doctor_mistake) group by all) "
    "select recording_id, d as doctor_mistake from m join l using (fname, global_ind) where cohort = '600' and n = 1 and d is not null"
)
def label_join_2key(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings of cohort 600 with the one label of their image and index."""
    recordings = _meta(spark, folder).where("cohort = '600'")
    rows = labels.labelled(recordings, read(spark, folder, "doctor_mistake"), "recording_id", ["fname", "global_ind"], "doctor_mistake")
    return rows.select("recording_id", "doctor_mistake")


@REGISTRY.add(LABEL_STATES + "select * from st")
def label_cardinality_audit(spark: SparkSession, folder: str) -> DataFrame:
    """How many labels each recording has, and what follows."""
    return labels.label_states(_meta(spark, folder), read(spark, folder, "doctor_mistake"), "recording_id", labels.LABEL_KEYS, "doctor_mistake")


@REGISTRY.add(
    f"with {META}, a as (select distinct recording_id, 1 as present from gaze) "
    "select cohort, count(*) as n_expected, count(present) as n_present, count(*) - count(present) as n_missing from (select distinct recording_id, cohort from m) left join a using (recording_id) group by cohort"
)
def completeness_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings with and without gaze, by cohort."""
    return labels.completeness(_meta(spark, folder), read(spark, folder, "gaze"), REC, ["cohort"])


@REGISTRY.add("select distinct recording_id from meta where recording_id not in (select recording_id from movement where recording_id is not null)")
def not_yet_labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings without movement labels yet."""
    todo = _meta(spark, folder).select("recording_id").distinct()
    return labels.not_written(todo, read(spark, folder, "movement"), REC)


@REGISTRY.add(
    SAMPLES + f", {META}, " + LABEL_STATES.partition(", ")[2].rstrip() + f" select recording_id, ord, {r('x - x0')} as x, {r('y - y0')} as y, t, cohort, m.radiologist, m.fname, st.doctor_mistake "
    "from ok join m using (recording_id) join st using (recording_id) where state = 'labelled'"
)
def prepared_gaze(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned, labelled samples, as they enter every later step."""
    recordings = labels.labelled(_meta(spark, folder), read(spark, folder, "doctor_mistake"), "recording_id", labels.LABEL_KEYS, "doctor_mistake")
    joined = labels.with_recording(_samples(spark, folder), recordings, ["cohort", "radiologist", "fname", "x0", "y0", "doctor_mistake"])
    moved = cleaning.window_relative(joined)
    return moved.select("recording_id", "ord", steady("x").alias("x"), steady("y").alias("y"), "t", "cohort", "radiologist", "fname", "doctor_mistake")


@REGISTRY.add(SAMPLES + "select recording_id, second, arg_min(ord, ord) as ord, arg_min(x, ord) as x, arg_min(y, ord) as y from (select *, cast(floor(t) as bigint) as second from ok) group by all")
def dedupe_timestamp_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first sample of every whole second."""
    rows = _samples(spark, folder).select("recording_id", F.floor("t").alias("second"), "ord", "x", "y")
    return cleaning.keep_first(rows, ["recording_id", "second"], ["ord"])


@REGISTRY.add(SAMPLES + "select recording_id, x, y, min(ord) as ord from ok group by all")
def dedupe_xy_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first sample at every place of a recording."""
    return cleaning.keep_first(_samples(spark, folder).select("recording_id", "x", "y", "ord"), ["recording_id", "x", "y"], ["ord"])


@REGISTRY.add(
    "select distinct recording_id, case when starts_with(gaze_path, '600/') then substr(gaze_path, 5) else gaze_path end as short_path, "
    "split_part(case when starts_with(gaze_path, '600/') then substr(gaze_path, 5) else gaze_path end, '/', 1) as head, split_part(gaze_path, '/', 2) as date from meta"
)
def prefix_split_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of the recordings' paths."""
    short = S.without_prefix(F.col("gaze_path"), "600/")
    slash = F.lit("/")
    meta = read(spark, folder, "meta").select("recording_id", "gaze_path").distinct()
    return meta.select("recording_id", short.alias("short_path"), F.split_part(short, slash, F.lit(1)).alias("head"), F.split_part("gaze_path", slash, F.lit(2)).alias("date"))


@REGISTRY.add(
    f"with {FEATURES_SQL} select detector, count(*) as n, count(*) filter (where radiologist is null or left(radiologist, 1) not in ('a', 'b', 'c', 'd')) as n_invalid, "
    f"{r('count(*) filter (where radiologist is null or left(radiologist, 1) not in (chr(97), chr(98), chr(99), chr(100))) * 100.0 / count(*)')} as percent_invalid from f group by detector"
)
def unmapped_reader_report(spark: SparkSession, folder: str) -> DataFrame:
    """Samples whose reader has no class, by detector."""
    unmapped = evaluate.reader_classes(F.col("radiologist"), S.EXPERTISE).isNull()
    rows = stats.quality_counts(_features(spark, folder), ["detector"], unmapped)
    return rows.withColumn("percent_invalid", steady("percent_invalid"))


@REGISTRY.add(
    f"with {FEATURES_SQL} select sample_id, radiologist, speed_mean, speed_std from f where detector in ('ivt', 'idt') and radiologist is not null "
    "and speed_mean is not null and not isnan(speed_mean) and (detector = 'idt' or (speed_std is not null and not isnan(speed_std)))"
)
def union_by_name_dropna(spark: SparkSession, folder: str) -> DataFrame:
    """Two detectors' samples as one table, those without a reader or speed left out."""
    rows = _features(spark, folder)
    first = cleaning.complete_rows(rows.where("detector = 'ivt'").select("sample_id", "radiologist", "speed_mean", "speed_std"), ["speed_std"])
    second = cleaning.without_columns(rows.where("detector = 'idt'").select("sample_id", "radiologist", "speed_mean", "speed_std", "x"), ("x", "not_there"))
    return cleaning.complete_rows(cleaning.union_by_name(first, second), ["radiologist", "speed_mean"])


@REGISTRY.add(f"with {FEATURES_SQL} select recording_id, detector, max(sample_id) as sample_id, arg_max(row(path_length), sample_id)[1] as path_length from f group by recording_id, detector")
def last_row_features(spark: SparkSession, folder: str) -> DataFrame:
    """The last sample of every recording and detector."""
    rows = _features(spark, folder).select("recording_id", "detector", "sample_id", "path_length")
    return cleaning.keep_last(rows, ["recording_id", "detector"], ["sample_id"])


@REGISTRY.add(SAMPLES + ", n as (select recording_id, count(*) as n from s group by all) select recording_id, ord, x, y from s join n using (recording_id) where n >= 2 and (n <= 300 or pos % 2 = 0)")
def decimate_long(spark: SparkSession, folder: str) -> DataFrame:
    """Every other sample of recordings with more than 300."""
    return cleaning.decimate(_samples(spark, folder).select("recording_id", "ord", "x", "y"), REC, "ord", 300)


@REGISTRY.add(
    f"with {FEATURES_SQL} select recording_id from f group by recording_id having count(case when not isnan(x) then x end) = 0 and count(case when not isnan(y) then y end) = 0"
)
def recordings_without_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings of which no feature row has coordinates."""
    return cleaning.no_coordinates(_features(spark, folder), REC)


# --- angles and kinematics -----------------------------------------------------------------------

ANGLE = "degrees(acos(greatest(-1.0, least(1.0, {dot} / nullif({norms}, 0))))) + 0 * ({dot} / nullif({norms}, 0))"


@REGISTRY.add(
    "with e as (select vec_id, list_transform(embedding, lambda v: cast(v as double)) as e from embeddings), p as (select a.vec_id, a.e as a, b.e as b from e a join e b on b.vec_id = a.vec_id + 1) "
    f"select vec_id, {r(ANGLE.format(dot='list_dot_product(a, b)', norms='sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))'))} as angle from p"
)
def embedding_angles(spark: SparkSession, folder: str) -> DataFrame:
    """Degrees between each embedding and the next."""
    rows = read(spark, folder, "embeddings").select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following"))
    return rows.join(following, "vec_id").select("vec_id", steady(S.angle_between_arrays(F.col("embedding"), F.col("following"))).alias("angle"))


PX_MM, DISTANCE_MM = 0.16, 725.0
PPD = [f"{px} / degrees(2 * atan({px} * {PX_MM} / (2 * {DISTANCE_MM})))" for px in ("screen_w", "screen_h")]


@REGISTRY.add(
    SAMPLES + f", k as (select tracker_id, ({PPD[0]} + {PPD[1]}) / 2 as ppd, abs({PPD[0]} - {PPD[1]}) > 0.2 * ({PPD[0]} + {PPD[1]}) / 2 as uneven from trackers) "
    f"select recording_id, count(*) as n, {r('min(ppd)')} as ppd, bool_or(uneven) as uneven, {r('min(x / ppd)')} as least_x, {r('max(y / ppd)')} as most_y from ok join k using (tracker_id) group by recording_id"
)
def ppd_from_screen(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings' extent in degrees, by their screen's pixels per degree."""
    mm = lambda c: F.col(c) * PX_MM
    ppd, uneven = S.pixels_per_degree(F.col("screen_w"), F.col("screen_h"), mm("screen_w"), mm("screen_h"), F.lit(DISTANCE_MM))
    screens = read(spark, folder, "trackers").select("tracker_id", ppd.alias("ppd"), uneven.alias("uneven"))
    rows = kinematics.scaled(_samples(spark, folder).join(screens, "tracker_id"), F.col("ppd"), ["x", "y"])
    sums = rows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.min("ppd").alias("ppd"), F.bool_or("uneven").alias("uneven"), F.min("x").alias("least_x"), F.max("y").alias("most_y"))
    return sums.withColumns({c: steady(c) for c in ("ppd", "least_x", "most_y")})


DX, DY, DT = ("{c} - lag({c}) over w".format(c=c) for c in ("x", "y", "t"))
OVER = "window w as (partition by recording_id order by pos)"


@REGISTRY.add(SAMPLES + f"select recording_id, ord, {r(f'case when {DT} > 0 then sqrt(({DX}) * ({DX}) + ({DY}) * ({DY})) / ({DT}) when {DT} <= 0 then 0.0 end')} as speed from s {OVER}")
def p2p_speed(spark: SparkSession, folder: str) -> DataFrame:
    """Speed of each sample from the one before."""
    rows = kinematics.step_speed(in_blocks(_samples(spark, folder).select("recording_id", "ord", "x", "y", "t"), REC, "ord", 1), REC, "t")
    return rows.select("recording_id", "ord", steady("speed").alias("speed"))


CONFIDENT = """with g as (select distinct recording_id, ord, x, y, timestamp as t, gaze_point_validity as v from gaze),
c as (select *, coalesce(v in ('1', '1.0', 'True', 'true'), false) as sure from g where x is not null and y is not null and not isnan(x) and not isnan(y)),
s as (select *, row_number() over (partition by recording_id order by ord) - 1 as pos from c)
"""


def _multiscale_sql(scales: tuple[int, ...]) -> str:
    """CTEs b (interval ends), e (values at the ends) and k (speed, direction, displacement and deviation)."""
    w = OVER
    ends, values, out = [], [], []
    for n in scales:
        step = -(-n // 2)
        ends.append(f"case when coalesce(lag(sure, {step}) over w, false) then -{step} else 0 end as a{n}")
        ends.append("0 as b1" if step == n else f"case when coalesce(lead(sure, {step}) over w, false) then {step} else 0 end as b{n}")
        for c in ("x", "y", "t"):
            values.append(f"(case when b{n} > 0 then lead({c}, {step}) over w else {c} end) - (case when a{n} < 0 then lag({c}, {step}) over w else {c} end) as d{c}{n}")
        spread = lambda p, q: f"(stddev_pop(x) over (partition by recording_id order by pos rows between {p} and {q}) + stddev_pop(y) over (partition by recording_id order by pos rows between {p} and {q})) / 2"
        back, ahead = f"{step} preceding", f"{step} following"
        both = f"when a{n} < 0 and b{n} > 0 then {spread(back, ahead)} when b{n} > 0 then {spread('current row', ahead)}" if step != n else ""
        values.append(f"case when not (sure and a{n} <> b{n}) then 0.0 {both} else {spread(back, 'current row')} end as sd{n}")
        moved = f"sure and a{n} <> b{n}"
        length = f"sqrt(dx{n} * dx{n} + dy{n} * dy{n})"
        out.append(f"case when {moved} and dt{n} <> 0 then {length} / dt{n} else 0.0 end as speed{n}")
        out.append(f"case when {moved} and dt{n} <> 0 then atan2(dy{n}, dx{n}) else 0.0 end as direction{n}")
        out.append(f"case when {moved} then {length} else 0.0 end as displacement{n}")
    return (
        CONFIDENT + f", b as (select *, {', '.join(ends)} from s {w}), e as (select *, {', '.join(values)} from b {w}), k as (select *, {', '.join(out)} from e)\n"
    )


KIN = _multiscale_sql(kinematics.SCALES)


def _multiscale(spark: SparkSession, folder: str) -> DataFrame:
    rows = cleaning.distinct_samples(read(spark, folder, "gaze")).withColumns({c: clean_number(c) for c in ("x", "y")}).where("x is not null and y is not null")
    rows = rows.select("recording_id", "ord", "x", "y", F.col("timestamp").alias("t"), F.when(S.is_valid(F.col("gaze_point_validity")), 1.0).otherwise(0.5).alias("confidence"))
    reach = kinematics.REACH
    return kinematics.multiscale(in_blocks(rows, REC, "ord", reach, reach), REC, "t", F.col("confidence"))


def _kinds(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    rows = _multiscale(spark, folder)
    return rows.select("recording_id", "ord", *[steady(f"{k}_{n}").alias(f"{k}_{n}") for k in kinds for n in kinematics.SCALES])


@REGISTRY.add(KIN + f"select recording_id, ord, {', '.join(f'{r(f"{k}{n}")} as {k}_{n}' for k in ('speed', 'direction') for n in kinematics.SCALES)} from k")
def annotate_speed_direction(spark: SparkSession, folder: str) -> DataFrame:
    """Speed and direction of every sample over five scales."""
    return _kinds(spark, folder, "speed", "direction")


@REGISTRY.add(KIN + f"select recording_id, ord, {', '.join(f'{r(f"displacement{n}")} as displacement_{n}' for n in kinematics.SCALES)} from k")
def annotate_displacement(spark: SparkSession, folder: str) -> DataFrame:
    """Displacement over five scales."""
    return _kinds(spark, folder, "displacement")


@REGISTRY.add(KIN + f"select recording_id, ord, {', '.join(f'round(sd{n} + 1.7e-5, 2) as standard_dev_{n}' for n in kinematics.SCALES)} from k")
def annotate_deviation(spark: SparkSession, folder: str) -> DataFrame:
    """Deviation over five scales; to 2 places, as wrong readings carry it to nine digits before the point."""
    rows = _multiscale(spark, folder)
    return rows.select("recording_id", "ord", *[F.round(F.col(f"standard_dev_{n}") + 1.7e-5, 2).alias(f"standard_dev_{n}") for n in kinematics.SCALES])


def _acceleration(n: int) -> str:
    v = [f"(speed{n} * {f}(direction{n}) - lag(speed{n} * {f}(direction{n})) over w) / nullif({DT}, 0)" for f in ("cos", "sin")]
    return f"case when sure and coalesce(lag(sure) over w, false) and {DT} <> 0 then sqrt(pow({v[0]}, 2) + pow({v[1]}, 2)) else 0.0 end"


@REGISTRY.add(KIN + f"select recording_id, ord, {', '.join(f'round({_acceleration(n)} + 1.7e-5, 2) as acceleration_{n}' for n in kinematics.SCALES)} from k {OVER}")
def annotate_acceleration(spark: SparkSession, folder: str) -> DataFrame:
    """Acceleration over five scales; to 2 places, as it reaches ten digits before the point."""
    rows = _multiscale(spark, folder)
    return rows.select("recording_id", "ord", *[F.round(F.col(f"acceleration_{n}") + 1.7e-5, 2).alias(f"acceleration_{n}") for n in kinematics.SCALES])


LADDER = kinematics.lag_ladder(8, 1, 4)


@REGISTRY.add(
    SAMPLES + "select * exclude (pos) from (select recording_id, ord, pos, "
    + ", ".join(
        f"{r(f'sqrt(pow(x - lag(x, {n}) over w, 2) + pow(y - lag(y, {n}) over w, 2)) / ({n} / 8.0)')} as lag_speed_{k}, {r(f'atan2(y - lag(y, {n}) over w, x - lag(x, {n}) over w)')} as lag_direction_{k}"
        for k, n in enumerate(LADDER)
    )
    + f" from s {OVER}) where pos >= 8"
)
def fixed_lag_features(spark: SparkSession, folder: str) -> DataFrame:
    """Speed and direction over the lags of a ladder."""
    placed = in_blocks(_samples(spark, folder).select("recording_id", "ord", "x", "y"), REC, "ord", max(LADDER))
    rows = kinematics.fixed_lag_features(placed, REC, 8, 1, 4)
    return rows.select("recording_id", "ord", *[steady(f"lag_{c}_{k}").alias(f"lag_{c}_{k}") for k in range(len(LADDER)) for c in ("speed", "direction")])


@REGISTRY.add(f"with {MOVEMENT_SQL} select recording_id, ord, eye_movement_type, lead(eye_movement_type, 5) over w as target from mp {OVER}")
def target_offset(spark: SparkSession, folder: str) -> DataFrame:
    """Each sample's label and that of five samples later."""
    placed = in_blocks(_movement(spark, folder).select("recording_id", "ord", "eye_movement_type"), REC, "ord", 0, 5)
    return kinematics.shifted(placed, REC, "eye_movement_type", 5, "target")


@REGISTRY.add(
    SAMPLES + f"select recording_id, ord, 10 as n, {r('sx')} as sum_x, first_x, last_y from (select *, sum(x) over v as sx, first_value(x) over v as first_x, last_value(y) over v as last_y from s "
    "window v as (partition by recording_id order by pos rows between 9 preceding and current row)) where pos >= 9"
)
def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of ten samples, in short."""
    placed = in_blocks(_samples(spark, folder).select("recording_id", "ord", "x", "y"), REC, "ord", 9)
    rows = kinematics.sliding_windows(placed, REC, ["x", "y"], 10)
    total = F.aggregate("window", F.lit(0.0), lambda a, v: a + v[0])
    return rows.select("recording_id", "ord", F.size("window").alias("n"), steady(total).alias("sum_x"), F.col("window")[0][0].alias("first_x"), F.col("window")[9][1].alias("last_y"))


# --- fixations -----------------------------------------------------------------------------------

IVT_POINTS = (
    SAMPLES
    + """, u as (select recording_id, t, arg_min(ord, ord) as ord, arg_min(x, ord) as x, arg_min(y, ord) as y, arg_min({'z': left_z}, ord).z as left_z from (select * replace (case when isnan(left_z) then null else left_z end as left_z) from ok) group by recording_id, t),
o as (select *, row_number() over (partition by recording_id order by ord) - 1 as pos, t - first_value(t) over (partition by recording_id order by ord) as rt, x / 7.21 as vx, y / 7.21 as vy from u),
l as (select *, lag(vx) over w as wx, lag(vy) over w as wy, lag(left_z) over w as wz from o window w as (partition by recording_id order by pos)),
q as (select *, (degrees(acos(greatest(-1.0, least(1.0, (vx * wx + vy * wy + left_z * wz) / nullif(sqrt(wx * wx + wy * wy + wz * wz) * sqrt(vx * vx + vy * vy + left_z * left_z), 0))))) + 0 * ((vx * wx + vy * wy + left_z * wz) / nullif(sqrt(wx * wx + wy * wy + wz * wz) * sqrt(vx * vx + vy * vy + left_z * left_z), 0))) * 90 as velocity from l),
pt as (select recording_id, pos, x, y, left_z as z, rt, velocity, case when velocity < 30 then 1 when velocity > 30 then 0 else -1 end as point from q where pos >= 2),
i as (select *, coalesce(sum(case when point = 0 then 1 else 0 end) over (partition by recording_id order by pos rows unbounded preceding), 0) as island, count(*) filter (where point = 0) over (partition by recording_id) as sacc from pt),
fx as (select recording_id, island, avg(x) as x, avg(y) as y, avg(z) as z, (stddev_samp(x) + stddev_samp(y)) / 2 as spread, arg_min(rt, pos) as start_time, arg_max(rt, pos) as end_time, count(*) as n,
  arg_max(rt, pos) - arg_min(rt, pos) as elapsed from i where point = 1 and island < sacc group by recording_id, island),
pr as (select *, row_number() over (partition by recording_id order by island) - 1 as pos, lead(x) over w as x2, lead(y) over w as y2, lead(z) over w as z2, lead(spread) over w as spread2,
  lead(start_time) over w as start2, lead(end_time) over w as end2, lead(elapsed) over w as elapsed2 from fx window w as (partition by recording_id order by island)),
cl as (select *, coalesce(start2 - end_time < 0.075 and pos >= 1 and
  (degrees(acos(greatest(-1.0, least(1.0, (x * x2 + y * y2 + z * z2) / nullif(sqrt(x * x + y * y + z * z) * sqrt(x2 * x2 + y2 * y2 + z2 * z2), 0))))) + 0 * ((x * x2 + y * y2 + z * z2) / nullif(sqrt(x * x + y * y + z * z) * sqrt(x2 * x2 + y2 * y2 + z2 * z2), 0))) / nullif((start2 + end2) / 2 - (start_time + end_time) / 2, 0) <= 100.0, false) as close from pr)
"""
)
LOOSE = ivt.Thresholds(merge_velocity=100.0)
"""A limit at which fixations of these recordings do merge."""


def _islands(spark: SparkSession, folder: str) -> DataFrame:
    samples = cleaning.valid_rows(read(spark, folder, "gaze")).withColumn("left_z", clean_number("left_z"))
    samples = samples.select("recording_id", "ord", "x", "y", "left_z", F.col("timestamp").alias("t"))
    return ivt.velocity_fixations(samples, REC, "t", "ord", "left_z")


def _steadied(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: steady(c) for c in columns})


FIX = ["x", "y", "z", "spread", "start_time", "end_time", "elapsed"]


@REGISTRY.add(IVT_POINTS + f"select recording_id, cast(island as bigint) as island, n, {', '.join(f'{r(c)} as {c}' for c in FIX)} from fx")
def ivt_fixations(spark: SparkSession, folder: str) -> DataFrame:
    """Fixations by velocity threshold, before merging."""
    return _steadied(_islands(spark, folder).select("recording_id", "island", "n", *FIX), FIX)


def _compat_sql(c: str) -> str:
    return f"case when close then elapsed / greatest(elapsed, elapsed2) * {c} + elapsed2 / greatest(elapsed, elapsed2) * {c}2 else {c} end"


@REGISTRY.add(
    IVT_POINTS + f", me as (select recording_id, {', '.join(f'{_compat_sql(c)} as {c}' for c in ('x', 'y', 'z', 'spread'))}, case when close then elapsed + elapsed2 else elapsed end as elapsed, "
    f"start_time, case when close then end2 else end_time end as end_time from cl) select recording_id, {', '.join(f'{r(c)} as {c}' for c in FIX)} from me where elapsed > 0.06"
)
def ivt_merged_compat(spark: SparkSession, folder: str) -> DataFrame:
    """Fixations merged as the published method's program does."""
    return _steadied(ivt.merged_compat(_islands(spark, folder), REC, LOOSE), FIX)


@REGISTRY.add(
    IVT_POINTS + ", ch as (select *, sum(case when prev then 0 else 1 end) over (partition by recording_id order by pos rows unbounded preceding) as chain from (select *, coalesce(lag(close) over (partition by recording_id order by pos), false) as prev from cl)), "
    f"me as (select recording_id, chain, {', '.join(f'coalesce(sum({c} * elapsed) / nullif(sum(case when {c} is not null then elapsed end), 0), avg({c})) as {c}' for c in ('x', 'y', 'z', 'spread'))}, sum(elapsed) as elapsed, min(start_time) as start_time, max(end_time) as end_time from ch group by all) "
    f"select recording_id, {', '.join(f'{r(c)} as {c}' for c in FIX)} from me where elapsed > 0.06"
)
def ivt_merged_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Fixations merged by chains, weighted by duration."""
    return _steadied(ivt.merged_weighted(_islands(spark, folder), REC, LOOSE), FIX)


@REGISTRY.add(
    SAMPLES.replace("with g", "with recursive g", 1)
    + """, c as (select *, coalesce(abs(x - lag(x) over w) + abs(y - lag(y) over w) <= 120, false) as near, count(*) over (partition by recording_id) as n from s window w as (partition by recording_id order by pos)),
sg as (select *, sum(case when near then 0 else 1 end) over (partition by recording_id order by pos rows unbounded preceding) as seg from c),
pairs as (select a.recording_id, a.pos as i, b.pos as j, a.n, max(b.x) over k - min(b.x) over k + max(b.y) over k - min(b.y) over k as disp
  from sg a join sg b on a.recording_id = b.recording_id and a.seg = b.seg and b.pos >= a.pos window k as (partition by a.recording_id, a.pos order by b.pos rows unbounded preceding)),
reach as (select recording_id, i, max(j) as e from pairs where disp <= 120 and (j < i + 6 or j < n - 1) group by all),
nxt as (select s.recording_id, s.pos as i, case when e >= s.pos + 5 then e + 1 else s.pos + 1 end as go, coalesce(e >= s.pos + 5, false) as hit from s left join reach on reach.recording_id = s.recording_id and reach.i = s.pos),
walk as (select recording_id, i, go, hit from nxt where i = 0 union all select nxt.recording_id, nxt.i, nxt.go, nxt.hit from walk join nxt on nxt.recording_id = walk.recording_id and nxt.i = walk.go)
"""
    + f"select walk.recording_id, walk.i as first_at, count(*) as n, {r('avg(x)')} as x, {r('avg(y)')} as y, min(t) as t from walk join s on s.recording_id = walk.recording_id and s.pos >= walk.i and s.pos < walk.go where hit group by walk.recording_id, walk.i"
)
def idt_fixations(spark: SparkSession, folder: str) -> DataFrame:
    """Fixations by dispersion threshold."""
    rows = idt.dispersion_fixations(_samples(spark, folder).select("recording_id", "ord", "x", "y", "t"), REC, "ord", "t", 120.0, 6)
    return _steadied(rows, ["x", "y"])


@REGISTRY.add(
    f"with {MOVEMENT_SQL}, i as (select *, sum(case when eye_movement_type = 1 then 1 else 0 end) over (partition by recording_id order by pos rows unbounded preceding) as grp, max(pos) over (partition by recording_id) as last from mp) "
    f"select recording_id, cast(grp as bigint) as \"group\", min(pos) as first_order, count(*) as n, {r('avg(case when not isnan(x) then x end)')} as x, {r('avg(case when not isnan(y) then y end)')} as y, {r('avg(timestamp)')} as t from i where eye_movement_type = 0 and pos < last group by all"
)
def hmm_decode_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Centroids of the groups that a given labelling decodes to."""
    placed = in_blocks(_movement(spark, folder), REC, "ord", 0).where("_core").withColumns({"x": clean_number("x"), "y": clean_number("y"), "at": F.col("_at")})
    rows = ihmm.decode_groups(placed, REC, "at", F.col("eye_movement_type"), ["x", "y", "timestamp"]).withColumnRenamed("timestamp", "t")
    return _steadied(rows, ["x", "y", "t"])


@REGISTRY.add()
def ihmm_fixations(spark: SparkSession, folder: str) -> DataFrame:
    """Fixations by a hidden Markov model of speeds."""
    return ihmm.hmm_fixations(_samples(spark, folder).select("recording_id", "ord", "x", "y", "t"), REC, "ord", "t")


def _windowed(spark: SparkSession, folder: str) -> DataFrame:
    meta = _meta(spark, folder).where("win_width > 0 and win_height > 0")
    return labels.with_recording(_samples(spark, folder), meta, ["win_width", "win_height"]).select("recording_id", "ord", "x", "y", "t", "win_width", "win_height")


@REGISTRY.add()
def imst_mst_weight(spark: SparkSession, folder: str) -> DataFrame:
    """Weight of every recording's minimum spanning tree."""
    return imst.mst_weight(_windowed(spark, folder), REC, "ord", "t", ("win_width", "win_height"))


@REGISTRY.add()
def imst_fixations(spark: SparkSession, folder: str) -> DataFrame:
    """Fixations by a minimum spanning tree."""
    return imst.mst_fixations(_windowed(spark, folder), REC, "ord", "t", ("win_width", "win_height"))


# --- labels, sequences and votes -----------------------------------------------------------------


@REGISTRY.add(
    f"with {MOVEMENT_SQL}, k as (select cohort, eye_movement_type, count(*) as n from mv join (select distinct recording_id, cohort from meta) using (recording_id) group by all) "
    f"select cohort, eye_movement_type, case eye_movement_type when 0 then 'Fixation' when 1 then 'Saccade' when 2 then 'Smooth Pursuit' when 3 then 'Blinks/Noise' end as name, n, percent from (select *, {r('n * 100.0 / sum(n) over (partition by cohort)')} as percent from k) where eye_movement_type is not null"
)
def movement_percentages(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the eye movement types by cohort."""
    cohorts = _meta(spark, folder).select("recording_id", "cohort").distinct()
    rows = stats.label_percentages(_movement(spark, folder).join(cohorts, "recording_id"), ["cohort"], "eye_movement_type")
    return rows.select("cohort", "eye_movement_type", S.mapped(F.col("eye_movement_type"), S.MOVEMENT_NAMES).alias("name"), "n", steady("percent").alias("percent"))


@REGISTRY.add(
    f"with {MOVEMENT_SQL}, l as (select *, lag(eye_movement_type) over w as was, x - lag(x) over w as dx, y - lag(y) over w as dy, abs(timestamp - lag(timestamp) over w) as gap from (select * replace (case when not isnan(x) then x end as x, case when not isnan(y) then y end as y) from mp) {OVER}) "
    f"select recording_id, count(*) as n, {r('avg(sqrt(dx * dx + dy * dy))')} as mean_distance, {r('stddev_pop(sqrt(dx * dx + dy * dy))')} as std_distance, {r('min(gap)')} as least_gap, {r('avg(gap)')} as mean_gap "
    "from l where (was = 0 and eye_movement_type = 2) or (was = 2 and eye_movement_type = 0) group by recording_id"
)
def fix_pursuit_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Changes between fixation and pursuit by recording."""
    rows = _movement(spark, folder).withColumns({"x": clean_number("x"), "y": clean_number("y")})
    changes = stats.transitions(rows, REC, "ord", "timestamp", "eye_movement_type", (0, 2))
    return _steadied(stats.transition_summary(changes, REC), ["mean_distance", "std_distance", "least_gap", "mean_gap"])


@REGISTRY.add(
    f"with {MOVEMENT_SQL}, v as (select recording_id, ord, (eye_movement_type + (ord * p) % 3) % 4 as vote from mv, (values (1), (2), (3), (5), (7)) t(p) where eye_movement_type is not null), k as (select recording_id, ord, vote, count(*) as n from v group by all) "
    "select recording_id, ord, cast(arg_max(vote, (n, -vote)) as integer) as vote from k group by recording_id, ord"
)
def majority_vote(spark: SparkSession, folder: str) -> DataFrame:
    """The vote of five models on each sample, here five disturbed copies of the label."""
    models = F.explode(F.array(*[F.lit(p) for p in (1, 2, 3, 5, 7)]))
    votes = _movement(spark, folder).select("recording_id", "ord", "eye_movement_type", models.alias("p"))
    votes = votes.withColumn("vote", ((F.col("eye_movement_type") + (F.col("ord") * F.col("p")) % 3) % 4).cast("int"))
    return sequence.majority(votes, ["recording_id", "ord"], "vote")


@REGISTRY.add(
    f"with {FEATURES_SQL}, n as (select *, row_number() over (partition by recording_id order by sample_id desc) as back, count(*) over (partition by recording_id) as n from f) "
    f"select recording_id, n as n_rows, greatest(0, 5 - n) as n_filled, {r('sum(fixation_rate) + greatest(0, 5 - n) * -1.0')} as total from n where back <= 5 and recording_id not in "
    "(select recording_id from n where back <= 5 and (fixation_rate is null or isnan(fixation_rate))) group by recording_id, n"
)
def pad_truncate(spark: SparkSession, folder: str) -> DataFrame:
    """The last five samples of each recording, filled up, in short."""
    rows = sequence.padded(_features(spark, folder), REC, "sample_id", ["fixation_rate"], 5)
    known = rows.where(~F.exists("sequence", lambda v: v[0].isNull())).where(~sequence.not_finite(F.col("sequence")))
    total = F.aggregate("sequence", F.lit(0.0), lambda a, v: a + v[0])
    return known.select("recording_id", "n_rows", F.greatest(F.lit(0).cast("bigint"), 5 - F.col("n_rows")).alias("n_filled"), steady(total).alias("total"))


@REGISTRY.add(SAMPLES + "select recording_id, w as \"window\", count(*) as n, count(*) filter (where pos >= w * 65 and pos < w * 65 + 65) as n_inside, min(pos) as first_at from s, lateral (select unnest(range(greatest(0, cast(ceil((pos - 96) / 65.0) as bigint)), cast(floor((pos + 32) / 65.0) as bigint) + 1)) as w) group by all")
def model_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping model windows of 129 samples, 65 of which count."""
    placed = in_blocks(_samples(spark, folder).select("recording_id", "ord"), REC, "ord", 0).where("_core").withColumn("at", F.col("_at"))
    rows = sequence.model_windows(placed.select("recording_id", "at"), REC, "at", 65, 129)
    return rows.groupBy("recording_id", "window").agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("n_inside"), F.min("at").alias("first_at"))


@REGISTRY.add(f"with {FEATURES_SQL} select doctor_mistake, count(*) as n from f left join (select distinct recording_id, fname, global_ind, num_part, num_img from meta) m using (recording_id) left join (select fname, global_ind, num_part, num_img, min(doctor_mistake) as doctor_mistake from doctor_mistake group by all) l on l.fname = m.fname and l.global_ind = m.global_ind and l.num_part = m.num_part and l.num_img = m.num_img group by doctor_mistake")
def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Feature samples by label of their recording."""
    lowest = read(spark, folder, "doctor_mistake").groupBy(*labels.LABEL_KEYS).agg(F.min("doctor_mistake").alias("doctor_mistake"))
    keys = read(spark, folder, "meta").select("recording_id", *labels.LABEL_KEYS).distinct()
    rows = _features(spark, folder).drop("fname").join(keys, "recording_id", "left").join(lowest, labels.LABEL_KEYS, "left")
    return stats.distribution(rows, "doctor_mistake")


# --- evaluation ----------------------------------------------------------------------------------


@REGISTRY.add(f"with {FEATURES_SQL} select sample_id, case when row_number() over (order by sample_id) - 1 < floor(count(*) over () * 0.8) then 'train' else 'test' end as part from f")
def ratio_split(spark: SparkSession, folder: str) -> DataFrame:
    """The first 80 % of the samples for training."""
    return evaluate.ratio_split(_features(spark, folder).select("sample_id"), "sample_id", 0.8)


FOLDS_SQL = f"with {FEATURES_SQL}, k as (select *, (row_number() over (order by sample_id) - 1) // (count(*) over () // 5) as b from f), fo as (select * exclude (b), case when b < 5 then cast(b as integer) end as fold from k)"


@REGISTRY.add(FOLDS_SQL + " select sample_id, fold from fo")
def kfold_positional(spark: SparkSession, folder: str) -> DataFrame:
    """Five contiguous folds."""
    return evaluate.positional_folds(_features(spark, folder).select("sample_id"), "sample_id", 5)


@REGISTRY.add()
def kfold_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Five folds by a hash of the reader, so that a reader is in one fold."""
    return evaluate.hashed_folds(_features(spark, folder).select("sample_id", "radiologist"), "radiologist", 5)


@REGISTRY.add(
    FOLDS_SQL + ", sc as (select fold, expert, round(fixation_rate, 1) as score from fo where fixation_rate is not null and not isnan(fixation_rate) and fold is not null), "
    "pr as (select a.fold, sum(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0.0 end) as w from sc a join sc b on a.fold = b.fold and a.expert = 1 and b.expert = 0 group by a.fold) "
    f"select c.fold, c.p as n_positive, c.q as n_negative, {r('w / nullif(c.p * c.q, 0)')} as auc from (select fold, count(*) filter (where expert = 1) as p, count(*) filter (where expert <> 1) as q from sc group by fold) c left join pr using (fold)"
)
def fold_auc(spark: SparkSession, folder: str) -> DataFrame:
    """AUC of the fixation rate as a score of expertise, by fold."""
    rows = evaluate.positional_folds(_features(spark, folder), "sample_id", 5).where("fold is not null")
    scored = rows.withColumn("score", F.round(clean_number("fixation_rate"), 1))
    return _steadied(evaluate.auc(scored, ["fold"], "expert", "score"), ["auc"])


@REGISTRY.add(
    f"with {FEATURES_SQL}, u as (unpivot (select detector, {', '.join(FEATURES)} from f) on {', '.join(FEATURES)} into name feature value v), "
    "d as (select detector, feature, avg(v) as importance from u where v is not null and not isnan(v) group by all) "
    f"select feature, {r('avg(importance)')} as importance from d group by feature"
)
def mean_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over the detectors of every feature's mean, in the form of importances by fold."""
    rows = _features(spark, folder).unpivot(["detector"], FEATURES, "feature", "v").where("v is not null and not isnan(v)")
    per_fold = rows.groupBy("detector", "feature").agg(F.avg("v").alias("importance"))
    return _steadied(evaluate.mean_importance(per_fold, "feature", "importance"), ["importance"])


@REGISTRY.add(
    f"with {FEATURES_SQL}, d as (select detector, avg(case when not isnan(speed_mean) then speed_mean end) as speed, avg(case when not isnan(duration_mean) then duration_mean end) as duration from f group by detector) "
    f"select detector, {r('(speed - avg(speed) over ()) / nullif(stddev_samp(speed) over (), 0) + (duration - avg(duration) over ()) / nullif(stddev_samp(duration) over (), 0)')} as z from d"
)
def z_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Detectors by the sum of two measures' z scores."""
    means = _features(spark, folder).groupBy("detector").agg(F.avg(clean_number("speed_mean")).alias("speed"), F.avg(clean_number("duration_mean")).alias("duration"))
    return _steadied(evaluate.z_scores(means, ["speed", "duration"]).select("detector", "z"), ["z"])
