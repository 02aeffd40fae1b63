"""Queries p2, p5, p8, p9 and p10: splits, event runs, packing, mixing, text quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.functions.scalars import steady
from gazeloom.llm.mixing import mix, shares
from gazeloom.llm.packing import fill_report, pack
from gazeloom.llm.quality import COMMON_WORDS, quality_statistics
from gazeloom.llm.runs import event_runs
from gazeloom.llm.splits import assign_splits, connected_groups
from gazeloom.llm.tokens import token_counts
from gazeloom.plans.registry import Registry
from gazeloom.session import read

REGISTRY = Registry()
CAPACITY = 2048
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
RELATED = ["radiologist", "fname"]

GROUPS = """
with recursive s as (select distinct sample_id, lower(trim(radiologist)) as r, lower(trim(fname)) as f from features),
edges as (
  select a.lo as u, s.sample_id as v from s join (select r, min(sample_id) as lo from s where r is not null group by r) a on s.r = a.r
  union
  select a.lo, s.sample_id from s join (select f, min(sample_id) as lo from s where f is not null group by f) a on s.f = a.f),
links as (select u, v from edges union select v, u from edges),
reach as (select sample_id as n, sample_id as g from s union select l.v, r.g from reach r join links l on l.u = r.n where r.g <= l.v)
select n as sample_id, min(g) as group_id from reach group by n
"""
GROUPS_FOUND = f"""
with g as ({GROUPS})
select sample_id, group_id from g where group_id in (select group_id from g group by group_id having count(*) > 1)
"""


@REGISTRY.add(GROUPS_FOUND)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The samples that share a radiologist or an fname with another, and their group."""
    groups = connected_groups(read(spark, folder, "features"), "sample_id", RELATED)
    return groups.where("group_size > 1").select("sample_id", "group_id")


@REGISTRY.add()
def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every sample."""
    return assign_splits(read(spark, folder, "features"), "sample_id", RELATED, "expert", SHARES)


@REGISTRY.add(f"with g as ({GROUPS}) select group_id, count(*) as n_samples, 1 as n_splits from g group by group_id")
def p2_groups_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The groups' sizes and numbers of splits, as p2_splits has dealt them."""
    splits = F.count_distinct("split").cast("int").alias("n_splits")
    return p2_splits(spark, folder).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_samples"), splits)


RUNS = """
with m as (
  select distinct recording_id, ord, timestamp as t, eye_movement_type as e from movement where eye_movement_type is not null and timestamp is not null),
marked as (
  select *, case when e = lag(e) over w and t - lag(t) over w <= 0.5 then 0 else 1 end as fresh from m
  window w as (partition by recording_id order by t, ord)),
runs as (select *, sum(fresh) over (partition by recording_id order by t, ord rows unbounded preceding) as run from marked)
"""


@REGISTRY.add(RUNS + "select recording_id, cast(min(ord) as integer) as first_ord, cast(max(ord) as integer) as last_ord from runs group by recording_id, run having count(*) >= 2")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of two or more samples of one eye movement type."""
    runs = _movement_runs(spark, folder).where("n_events >= 2")
    return runs.select("recording_id", F.col("first_order").cast("int").alias("first_ord"), F.col("last_order").cast("int").alias("last_ord"))


@REGISTRY.add(
    RUNS
    + """select recording_id, e as eye_movement_type, cast(arg_min(ord, (t, ord)) as integer) as first_ord, count(*) as n_samples,
       round(max(t) - min(t), 6) as duration from runs group by recording_id, run, e"""
)
def p5_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs, with their number of samples and duration."""
    return _movement_runs(spark, folder).select(
        "recording_id", F.col("event").cast("int").alias("eye_movement_type"), F.col("first_order").cast("int").alias("first_ord"),
        F.col("n_events").alias("n_samples"), F.round("duration", 6).alias("duration"),
    )


def _movement_runs(spark: SparkSession, folder: str) -> DataFrame:
    return event_runs(read(spark, folder, "movement"), ["recording_id"], "timestamp", "ord", F.col("eye_movement_type"), 0.5)


@REGISTRY.add()
def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text or part of a text."""
    return pack(read(spark, folder, "documents"), "doc_id", token_counts(F.col("text")), CAPACITY)


@REGISTRY.add()
def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p8_pack(spark, folder), CAPACITY)


@REGISTRY.add()
def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The selected documents with their number of uses."""
    return mix(read(spark, folder, "documents"), "doc_id", "source", token_counts(F.col("text")), read(spark, folder, "mix_targets"))


@REGISTRY.add()
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of all tokens that the sources reach."""
    return shares(p9_mix(spark, folder), "source", read(spark, folder, "mix_targets"))


def _mixed(spark: SparkSession, folder: str, **how) -> DataFrame:
    targets = read(spark, folder, "mix_targets")
    return shares(mix(read(spark, folder, "documents"), "doc_id", "source", token_counts(F.col("text")), targets, **how), "source", targets)


@REGISTRY.add()
def p9_limited(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of a mix of the size of all documents that is as even as the repetition limits allow, by bisecting the exponent."""
    return _mixed(spark, folder, passes=1.0, exponent=0.0)


@REGISTRY.add()
def p9_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of a mix whose entropy is 1.6 nats, by bisecting the exponent."""
    return _mixed(spark, folder, entropy_goal=1.6)


@REGISTRY.add()
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are natural prose."""
    return quality_statistics(read(spark, folder, "documents"), "doc_id", "text").where("kind = 'prose'").select("doc_id")


WORD = "([A-Za-z]|[^\\x00-\\x7F])+"
COMMON_SQL = ", ".join(f"'{v}'" for v in dict.fromkeys(COMMON_WORDS))
PLAIN = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{WORD}') as words, regexp_replace(t, '[\\t\\n\\x0B\\f\\r ]', '', 'g') as ink, regexp_replace(t, '[\\x00-@\\[-`\\x7B-\\x7F]', '', 'g') as letters from d),
c as (select *, len(words) as n_words, octet_length(encode(ink)) as n_ink, octet_length(encode(letters)) as n_letters, len(regexp_extract_all(ink, '[0-9]')) as n_digits,
  len(list_filter(words, lambda v: lower(v) in ({COMMON_SQL}))) as n_common,
  list_filter(list_transform(string_split_regex(t, '[\\n\\r]'), lambda l: regexp_replace(regexp_replace(l, '^[\\t\\x0B\\f ]+', ''), '[\\t\\x0B\\f ]+$', '')), lambda l: l <> '') as lines from w),
e as (select *, len(list_filter(lines, lambda l: regexp_matches(case when length(l) > 1 and right(l, 1) in ('"', chr(39), ')', '*', '_') then left(l, length(l) - 1) else l end, '[.!?]$'))) as n_ended from c)
select doc_id, n_words, round(coalesce(n_letters / nullif(n_words, 0), 0) + 1.7e-9, 6) as mean_word_length, round(coalesce((n_ink - n_letters - n_digits) / nullif(n_ink, 0), 0) + 1.7e-9, 6) as symbol_ratio,
  round(coalesce(n_ended / nullif(len(lines), 0), 0) + 1.7e-9, 6) as punctuated_line_share, round(coalesce(n_common / nullif(n_words, 0), 0) + 1.7e-9, 6) as common_word_share from e
"""


@REGISTRY.add(PLAIN)
def p10_plain_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every document that don't rest on the labels of its lines."""
    names = ["mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share"]
    return p10_statistics(spark, folder).select("doc_id", "n_words", *[steady(n).alias(n) for n in names])


@REGISTRY.add()
def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics and kind of every document."""
    return quality_statistics(read(spark, folder, "documents"), "doc_id", "text")
