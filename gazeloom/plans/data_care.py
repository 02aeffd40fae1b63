"""Queries p1, p3, p4, p6 and p7: rows that fail to parse, spikes, grids, small files, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.operators.grid import regular_grid
from gazeloom.operators.intervals import covered_periods, fixation_intervals
from gazeloom.operators.parse_errors import parse_raw_records
from gazeloom.operators.spikes import FENCE, IQR_OF_DIFFERENCES, LEVEL, LONGEST_SPIKE, PRIOR, spike_flags
from gazeloom.plans.registry import Registry
from gazeloom.session import read, scratch_folder
from gazeloom.sources.archive import GAZE_COLUMNS, consolidate, gaze_file_records, intact_files, pack_containers, read_containers, repeated_records, write_containers

REGISTRY = Registry()
# The spellings of gaze_point_validity that mean valid.
VALID = ("1", "1.0", "True")

# SQL: a field of a CSV line, a line of them, a number; an object's tokens may not be what SQL's reader lets pass.
FIELD_SQL = '("([^"]|"")*"|[^",]*)'
NUMBER_SQL = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?"
JSON_NUMBER_SQL = "-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][+-]?[0-9]+)?"
STRING_SQL = '"([^"\\\\]|\\\\.)*"'
META_KEYS = ("radiologist", "fname", "global_ind", "num_part", "num_img", "x0", "y0", "win_width", "win_height")
META_INTEGERS = ("global_ind", "num_part", "num_img")


def _number_sql(c: str) -> str:
    return f"(regexp_full_match(lower(trim({c})), '{NUMBER_SQL}') and isfinite(coalesce(try_cast(lower(trim({c})) as double), 'inf'::double)))"


def _parsed_sql() -> str:
    """CTEs g (gaze lines with reason and fields f) and o (meta objects with reason)."""
    gaze_ok = " and ".join([*[f"(trim(f[{i}]) = '' or {_number_sql(f'f[{i}]')})" for i in (1, 2, 5)], _number_sql("f[3]"), "try_cast(lower(trim(f[3])) as double) >= 0", "lower(trim(f[4])) in ('1', '1.0', 'true', '0', '0.0', 'false')"])
    value = lambda k: f"json_extract(raw, '$.{k}')"
    numbers = [k for k in META_KEYS if k not in ("radiologist", "fname")]
    meta_ok = " and ".join(
        [f"json_type({value(k)}) = 'VARCHAR'" for k in ("radiologist", "fname")]
        + ["regexp_full_match(lower(trim(raw ->> '$.radiologist')), '[a-d][0-9]{4,}')", "ends_with(lower(trim(raw ->> '$.fname')), '.png')"]
        + [f"regexp_full_match(cast({value(k)} as varchar), '{JSON_NUMBER_SQL}')" for k in numbers]
    )
    keys = ", ".join(f"'{k}'" for k in sorted(META_KEYS))
    return f"""
with r as (select distinct record_id, kind, raw from raw_records),
g0 as (select record_id, raw, regexp_full_match(raw, '{FIELD_SQL}(,{FIELD_SQL})*', 's') as quoted from r where kind = 'gaze'),
g1 as (select *, case when quoted then list_transform(regexp_extract_all(raw || ',', '{FIELD_SQL},', 1, 's'),
  lambda v: case when starts_with(v, '"') then replace(substr(v, 2, length(v) - 2), '""', '"') else v end) end as f from g0),
g as (select *, case when quoted is not true then 'malformed' when len(f) <> 6 then 'column_count' when not coalesce({gaze_ok}, false) then 'invalid_value' end as reason from g1),
o0 as (select record_id, raw, coalesce(json_valid(raw) and json_type(try_cast(raw as json)) = 'OBJECT'
  and not regexp_matches(regexp_replace(raw, '{STRING_SQL}', 's', 'gs'), ',\\s*[}}\\]]|[Nn][Aa][Nn]|[Ii][Nn][Ff]'), false) as sound from r where kind = 'meta'),
o as (select *, case when not sound then 'malformed' when list_sort(json_keys(case when sound then raw else '{{}}' end)) <> [{keys}] then 'column_count'
  when not coalesce({meta_ok.replace('raw', "(case when sound then raw else '{}' end)")}, false) then 'invalid_value' end as reason from o0)
"""


PARSED_SQL = _parsed_sql()


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return parse_raw_records(read(spark, folder, "raw_records").select("record_id", "kind", "raw"))


@REGISTRY.add(PARSED_SQL + "select record_id, reason from g where reason is not null union all select record_id, reason from o where reason is not null")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The raw records that fail, with the first reason."""
    return _parsed(spark, folder).where("reason is not null").select("record_id", "reason")


@REGISTRY.add(
    PARSED_SQL + "select record_id, "
    + ", ".join(f"try_cast(nullif(lower(trim(f[{i}])), '') as double) as {n}" for i, n in ((1, "x"), (2, "y"), (3, "timestamp"), (5, "left_z")))
    + ", lower(trim(f[4])) in ('1', '1.0', 'true') as gaze_point_validity, f[6] as remark from g where reason is null"
)
def p1_gaze_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The sound gaze lines as typed rows."""
    return _parsed(spark, folder).where("reason is null and kind = 'gaze'").select("record_id", "gaze.*")


@REGISTRY.add(
    PARSED_SQL + "select record_id, lower(trim(raw ->> '$.radiologist')) as radiologist, lower(trim(raw ->> '$.fname')) as fname, "
    + ", ".join(f"cast(cast(json_extract(raw, '$.{k}') as double) as {'bigint' if k in META_INTEGERS else 'double'}) as {k}" for k in META_KEYS[2:])
    + " from o where reason is null"
)
def p1_meta_objects(spark: SparkSession, folder: str) -> DataFrame:
    """The sound meta objects as typed rows."""
    return _parsed(spark, folder).where("reason is null and kind = 'meta'").select("record_id", "meta.*")


def _spikes(spark: SparkSession, folder: str) -> DataFrame:
    screens = read(spark, folder, "trackers").select("tracker_id", "screen_w", "screen_h")
    gaze = read(spark, folder, "gaze").join(screens, "tracker_id", "left")
    limits = {a: (F.col(size) * -0.1, F.col(size) * 1.1) for a, size in (("x", "screen_w"), ("y", "screen_h"))}
    hour = F.floor(F.col("timestamp") / 3600) % 24
    return spike_flags(gaze, ["recording_id"], "ord", ["x", "y"], F.col("gaze_point_validity").isin(*VALID), limits, hour)


def _certain_sql(axis: str, size: str) -> str:
    """CTEs: readings of an axis, runs of equal values, and the ords that are impossible or stuck."""
    return f"""r{axis} as (select recording_id, ord, {axis} as v, {size} as size, case when {axis} = lag({axis}) over w then 0 else 1 end as fresh from g
  where {axis} is not null and not isnan({axis}) window w as (partition by recording_id order by ord, {axis})),
q{axis} as (select *, sum(fresh) over (partition by recording_id order by ord, v rows unbounded preceding) as run from r{axis}),
f{axis} as (select recording_id, ord, v < -0.1 * size or v > 1.1 * size as impossible, count(*) over (partition by recording_id, run) >= 12 as stuck from q{axis})"""


CERTAIN = f"""
with g as (select distinct recording_id, ord, x, y, screen_w, screen_h from gaze left join trackers using (tracker_id) where gaze_point_validity in ('1', '1.0', 'True') and recording_id is not null and ord is not null),
{_certain_sql('x', 'screen_w')}, {_certain_sql('y', 'screen_h')},
f as (select *, 'x' as axis from fx union all select *, 'y' from fy)
select recording_id, ord, axis, coalesce(impossible, false) as impossible, stuck from f where impossible or stuck
"""


def _scatter_sql(values: str) -> str:
    """The scatter of a group's steps by exact quartiles, or wider quantiles where these are equal."""
    spread = lambda low, high: f"(quantile_cont({values}, {high}) - quantile_cont({values}, {low}))"
    usual, wide = f"{spread(0.25, 0.75)} / {IQR_OF_DIFFERENCES}", f"{spread(0.1, 0.9)} / {IQR_OF_DIFFERENCES * 1.9}"
    return f"case when {usual} > 0 then {usual} when {wide} > 0 then {wide} end"


def _flags_sql() -> str:
    excursions = []
    for k in range(1, LONGEST_SPIKE + 1):
        before, after = "lag(v) over w", f"lead(v, {k}) over w"
        apart = f"least(coalesce(abs({before} - lag(v, 2) over w), 0), coalesce(abs(lead(v, {k + 1}) over w - {after}), 0))"
        leaves = " and ".join(f"abs(lead(v, {j}) over w - ({before} + {after}) / 2) > {FENCE} * sc" for j in range(k))
        excursions.append(f"coalesce(abs({before} - {after}) <= {LEVEL} * sc and {apart} <= {LEVEL} * sc and {leaves}, false) as e{k}")
    spike = " or ".join(f"coalesce(lag(e{k}, {j}) over w, false)" if j else f"e{k}" for k in range(1, LONGEST_SPIKE + 1) for j in range(k))
    return (
        CERTAIN.partition("select recording_id, ord, axis, coalesce(impossible")[0].rstrip()
        + f""", g2 as (select distinct recording_id, ord, x, y, cast(floor(timestamp / 3600) as bigint) % 24 as h from gaze where gaze_point_validity in ('1', '1.0', 'True')),
v as (select f.*, g2.h, case when axis = 'x' then g2.x else g2.y end as v from f join g2 using (recording_id, ord)),
t as (select *, case when not coalesce(impossible, false) then v - lag(v) over (partition by recording_id, axis order by ord, v) end as step from v),
sh as (select recording_id, axis, h, {_scatter_sql('step')} as own, count(step) as n from t group by all),
sr as (select recording_id, axis, {_scatter_sql('step')} as source from t group by all),
sc as (select recording_id, axis, h, coalesce((own * n + source * {PRIOR}) / (n + {PRIOR}), source) as sc from sh join sr using (recording_id, axis)),
e as (select recording_id, axis, ord, v, impossible, stuck, {', '.join(excursions)} from t join sc using (recording_id, axis, h) window w as (partition by recording_id, axis order by ord, v)),
k as (select recording_id, axis, ord, coalesce(impossible, false) as impossible, stuck, {spike} as spike from e window w as (partition by recording_id, axis order by ord, v))
"""
    )


FLAGS = _flags_sql()


@REGISTRY.add(FLAGS + "select distinct recording_id, ord from k where impossible or stuck or spike")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The valid samples that cannot be true readings."""
    flags = _spikes(spark, folder)
    return flags.groupBy("recording_id", "ord").agg(F.count(F.lit(1)).alias("n")).select("recording_id", F.col("ord").cast("int").alias("ord"))


@REGISTRY.add(FLAGS + "select recording_id, ord, axis, impossible, stuck, spike from k where impossible or stuck or spike")
def p3_flags(spark: SparkSession, folder: str) -> DataFrame:
    """The same by axis and kind."""
    return _spikes(spark, folder).withColumn("ord", F.col("ord").cast("int"))


@REGISTRY.add(CERTAIN)
def p3_certain(spark: SparkSession, folder: str) -> DataFrame:
    """The flags that don't rest on a scatter: impossible and stuck readings by axis."""
    rows = _spikes(spark, folder).where("impossible or stuck")
    return rows.select("recording_id", F.col("ord").cast("int").alias("ord"), "axis", "impossible", "stuck")


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    gaze = read(spark, folder, "gaze")
    return regular_grid(gaze, ["recording_id"], "timestamp", ["x", "y"], 10, F.col("gaze_point_validity").isin(*VALID))


GAP_SLOTS = """
with slots as (
  select distinct recording_id, cast(floor(timestamp * 10) as bigint) as s from gaze
  where gaze_point_validity in ('1', '1.0', 'True') and x is not null and y is not null and not isnan(x) and not isnan(y)),
spans as (select recording_id, s, lead(s) over (partition by recording_id order by s) as n from slots)
select recording_id, u.slot from spans, lateral (select unnest(range(s + 1, n)) as slot) u where n > s + 1
"""


@REGISTRY.add(GAP_SLOTS)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The slots of 0.1 s without a usable sample."""
    return _grid(spark, folder).where("status = 'gap'").select("recording_id", "slot")


GRID = """
with u as (select distinct recording_id, timestamp as t, x, y from gaze
  where gaze_point_validity in ('1', '1.0', 'True') and x is not null and y is not null and not isnan(x) and not isnan(y) and recording_id is not null and timestamp is not null),
s as (select *, cast(floor(t * 10) as bigint) as slot, lead(t) over w as tn, lead(x) over w as xn, lead(y) over w as yn from u window w as (partition by recording_id order by t, x, y)),
c as (select *, unnest(range(slot, coalesce(cast(floor(tn * 10) as bigint), slot) + 1)) as cell from s),
p as (select *, greatest(t, cell / 10.0) as since, least(tn, (cell + 1) / 10.0) as until, tn - t as len from c),
o as (select *, case when len > 0 then greatest(until - since, 0.0) else 0.0 end as overlap, case when len > 0 then ((since + until) / 2 - t) / len end as mid from p),
k as (select recording_id, cell as slot, sum(case when cell = slot then 1 else 0 end) as n_readings, sum(overlap) as ov, sum(coalesce((x + (xn - x) * mid) * overlap, 0.0)) as ix,
  sum(coalesce((y + (yn - y) * mid) * overlap, 0.0)) as iy, avg(case when cell = slot then x end) as x, avg(case when cell = slot then y end) as y from o group by recording_id, cell)
"""
GRID_VALUES = "round(case when ov > 0 then i{c} / ov else {c} end + 1.7e-5, 3) as {c}"


@REGISTRY.add(
    GRID + f"select recording_id, slot, {GRID_VALUES.format(c='x')}, {GRID_VALUES.format(c='y')}, cast(n_readings as bigint) as n_readings, case when n_readings > 0 then 'observed' else 'gap' end as status from k"
)
def p4_grid(spark: SparkSession, folder: str) -> DataFrame:
    """x and y for every 0.1 s of each recording, to a thousandth of a pixel."""
    rows = _grid(spark, folder)
    return rows.withColumns({c: F.round(F.col(c) + 1.7e-5, 3) for c in ("x", "y")})


HEADER = ",".join(GAZE_COLUMNS)
RECORDS = f"""
with l as (select unnest(string_split_regex(content, '\\r\\n|\\n|\\r')) as line from (select distinct file_id, path, content from gaze_files)),
v as (select string_split(line, ',') as v from l where line <> '' and lower(trim(line)) <> '{HEADER}'),
f as (select trim(v[7]) as fname, trim(v[6]) as radiologist, trim(v[3]) as ts from v),
k as (select fname, radiologist, coalesce(cast(round(try_cast(ts as decimal(38, 9)) * 1000000) as bigint), cast(round(try_cast(ts as double) * 1000000) as bigint)) as ts_us from f)
select fname, radiologist, ts_us from k where fname is not null and radiologist is not null and ts_us is not null group by all
"""


@REGISTRY.add(RECORDS + "having count(*) > 1")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records that occur more than once in all files together, read from the containers."""
    containers = pack_containers(read(spark, folder, "gaze_files"), "file_id", "path", "content")
    return repeated_records(gaze_file_records(intact_files(containers))).select("fname", "radiologist", "ts_us")


def _rewritten(spark: SparkSession, folder: str) -> str:
    """The folder of written containers in which every record is once."""
    written = scratch_folder(spark)
    write_containers(consolidate(read(spark, folder, "gaze_files"), "file_id", "path", "content"), written)
    return written


@REGISTRY.add()
def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The small files rewritten into containers with every record once: the index, one row per packed file."""
    index = spark.read.parquet(f"{_rewritten(spark, folder)}/index")
    return index.select("container_id", F.col("ident").alias("file_id"), "path", "offset", "length", "checksum")


@REGISTRY.add(RECORDS)
def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the written containers, read back from them, as often as it is there."""
    records = gaze_file_records(intact_files(read_containers(spark, _rewritten(spark, folder))))
    return records.select("fname", "radiologist", "ts_us").dropna()


PERIODS = """
with iv as (
  select distinct fix_id, recording_id, detector, cast(round(start_time * 1e6) as bigint) as s,
    coalesce(cast(round(end_time * 1e6) as bigint), cast(round(start_time * 1e6) as bigint) + cast(round(elapsed_time * 1e6) as bigint)) as e
  from fixations),
ok as (
  select *, max(e) over (partition by recording_id, detector order by s, e rows between unbounded preceding and 1 preceding) as upto
  from iv where recording_id is not null and detector is not null and e >= s),
marked as (
  select *, sum(case when upto is null or s > upto then 1 else 0 end) over (partition by recording_id, detector order by s, e rows unbounded preceding) as p
  from ok),
periods as (select recording_id, detector, p, min(s) as s, max(e) as e, count(distinct fix_id) as n from marked group by all),
gaps as (select recording_id, detector, e, lead(s) over (partition by recording_id, detector order by p) as nxt from periods)
select 'merged' as kind, recording_id, detector, s as start_us, e as end_us from periods where n >= 2
union all
select 'gap', recording_id, detector, e, nxt from gaps where nxt is not null
"""


@REGISTRY.add(PERIODS)
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The periods of two or more fixations and the gaps between periods."""
    periods = covered_periods(fixation_intervals(read(spark, folder, "fixations")), ["recording_id", "detector"], "fix_id", "start_us", "end_us")
    kind = F.when(F.col("kind") == "gap", "gap").when(F.col("n_intervals") >= 2, "merged")
    return periods.select(kind.alias("kind"), "recording_id", "detector", "start_us", "end_us").where("kind is not null")
