"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeloom.operators.ordered import with_position
from gazeloom.session import cut_lineage

MAX_ROUNDS = 60
EXACT = 16
"""Counts of a label below this are told apart in a profile; larger ones to a sixteenth of their power of two."""
MAX_PROFILES = 1_000_000
"""Profiles of groups that the driver deals; more is an error, which takes labels of many values."""
SWAPS = 400
"""Profiles, those of the largest groups, whose groups are also tried in exchange for each other."""
STARTS = 8
CHUNKS = 1024
"""Parts into which the groups of one profile are cut to number them."""


def entity_key(column: str) -> Column:
    """An entity's name without letter case and outer spaces."""
    return F.lower(F.trim(F.col(column).cast("string")))


def connected_groups(records: DataFrame, ident: str, entities: list[str]) -> DataFrame:
    """The group of every record: (ident, group_id, group_size), group_id the group's smallest ident.

    Records that share a value in one of the entity columns, directly or through others, are one
    group. Values are compared without letter case and outer spaces; null shares with nothing, an
    empty text is a value. Repeated idents are one record that has all their values. Rows with a
    null ident are left out. An empty table gives no groups; other columns are ignored.

    Minimum-label propagation on the bipartite graph of records and entities. Records with equal
    values are one node, labelled with their smallest ident. In each round an entity takes the
    least label of its nodes, and all nodes of one label take the least of all their entities, and
    then what the nodes of that label have taken. So labels merge whole, and the distance they
    travel doubles: rounds grow with the logarithm of the longest chain. Every round is written to
    the checkpoint folder. Whether a label has changed is all that reaches the driver.
    """
    rows = records.select(F.col(ident).alias("_id"), *[entity_key(e).alias(f"_e{i}") for i, e in enumerate(entities)]).where("_id is not null").distinct()
    columns = [f"_e{i}" for i in range(len(entities))]
    values = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(c))) for i, c in enumerate(columns)]), lambda v: v.isNotNull())
    rows = rows.select("_id", values.alias("_values"))
    repeated = rows.groupBy("_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_values")))).alias("_values"))  # as many values as an ident has rows
    nodes = cut_lineage(repeated.groupBy("_values").agg(F.min("_id").alias("own")))
    # a record without a value is a group of its own
    labels = nodes.where("size(_values) > 0").select("own", F.col("own").alias("label"), "_values")
    written: tuple[DataFrame, ...] = ()
    for _ in range(MAX_ROUNDS):
        least = labels.select("label", F.explode("_values").alias("_value")).groupBy("_value").agg(F.min("label").alias("_least"))
        heard = labels.select("label", F.explode("_values").alias("_value")).join(least, "_value").groupBy("label").agg(F.min("_least").alias("_hook"))
        hooks = cut_lineage(heard)
        beyond = hooks.select(F.col("label").alias("_hook"), F.col("_hook").alias("_beyond"))
        jumps = hooks.join(beyond, "_hook", "left").select("label", F.least("_hook", F.coalesce("_beyond", "_hook")).alias("_new"))
        changed = hooks.where("_hook < label").limit(1).count()
        labels = cut_lineage(labels.join(jumps, "label").select("own", F.col("_new").alias("label"), "_values"), after=(*written, hooks))
        written = (labels,)
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")
    found = labels.select("_values", "label")
    grouped = repeated.where("size(_values) > 0").join(found, "_values").select("_id", F.col("label").alias("group_id"))
    alone = repeated.where("size(_values) = 0").select("_id", F.col("_id").alias("group_id"), F.lit(1).cast("bigint").alias("group_size"))
    sizes = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    sized = grouped.join(sizes, "group_id").select("_id", "group_id", "group_size")
    return sized.unionByName(alone).withColumnRenamed("_id", ident)


def assign_splits(records: DataFrame, ident: str, entities: list[str], label: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """The split of every record: (ident, group_id, split), whole groups to splits of the given shares.

    Groups are those of connected_groups. A group's profile is its number of records per label;
    deal_profiles finds how many groups of each profile go to each split so that every split's
    counts per label are near its share of them. Groups, large and small alike, learn their split
    from their number within their profile, in a random order, counted in CHUNKS parts so that no
    task holds a profile as a whole. One group may be larger than a split's share; shares are then
    met as nearly as whole groups allow.

    A null label counts as a label. Labels are few (classes). The driver sees a row per profile and
    label: counts from EXACT on are put together by a sixteenth of their power of two, so profiles
    grow with the logarithm of the groups' sizes. A repeated ident has its smallest label. Idents
    may be of any type that can be sorted. Empty tables give no rows.
    """
    groups = connected_groups(records, ident, entities)
    classes = records.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.coalesce(F.min(F.col(label).cast("string")), F.lit("")).alias("_label"))
    members = cut_lineage(groups.join(classes, ident))
    counts = members.groupBy("group_id", "_label").agg(F.count(F.lit(1)).alias("n"))
    unit = F.when(F.col("n") < EXACT, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n")) - 4))
    coarse = F.struct("_label", F.floor(F.col("n") / unit).cast("bigint").alias("k"), unit.cast("bigint").alias("unit"))
    profiles = counts.groupBy("group_id").agg(F.array_sort(F.collect_list(coarse)).cast("string").alias("_profile"), F.map_from_entries(F.collect_list(F.struct("_label", "n"))).alias("_by"))
    profiles = cut_lineage(profiles)  # arrays of as many entries as there are classes
    sums = profiles.select("_profile", F.explode("_by").alias("_label", "n")).groupBy("_profile", "_label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    rows = sums.limit(MAX_PROFILES + 1).collect()
    if len(rows) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles of groups: too many labels")
    names, labels = sorted({r["_profile"] for r in rows}), sorted({r["_label"] for r in rows})
    vectors, groups_of = np.zeros((len(names), len(labels))), np.zeros(len(names), np.int64)
    at, column = {n: i for i, n in enumerate(names)}, {c: i for i, c in enumerate(labels)}
    for r in rows:
        groups_of[at[r["_profile"]]] = r["groups"]
        vectors[at[r["_profile"]], column[r["_label"]]] = r["n"] / r["groups"]
    dealt = deal_profiles(vectors, groups_of, list(shares.values()))
    upto = np.cumsum(dealt, 1).tolist()
    table = records.sparkSession.createDataFrame(list(zip(names, upto)), "_profile string, _upto array<bigint>")
    rows = profiles.select("group_id", "_profile", F.xxhash64("group_id", F.lit(seed)).alias("_order"))
    rows = rows.withColumn("_chunk", F.shiftright("_order", 64 - CHUNKS.bit_length() + 1))
    numbered = with_position(rows, ["_profile"], "_chunk", ["_order", "group_id"], "_rank").join(table, "_profile")
    split = F.get(F.array(*[F.lit(s) for s in shares]), F.size(F.filter("_upto", lambda u: u <= F.col("_rank"))))
    return members.join(numbered.select("group_id", split.alias("split")), "group_id").select(ident, "group_id", "split")


def deal_profiles(vectors: np.ndarray, groups: np.ndarray, shares: list[float]) -> np.ndarray:
    """How many of each profile's groups go to each split: [profiles, splits].

    vectors[p, c] is the number of records of label c in a group of profile p. Least is the sum,
    over splits and labels, of the squared difference of the split's count from its share, as a
    part of the label's count. Each profile is dealt by shares, rounded down; the groups left go one
    by one where they do most; then groups are moved from split to split, or exchanged, the best
    move first, until no move makes the sum less. The best of STARTS orders of the groups left
    counts: the largest first, and random ones.
    """
    largest = np.lexsort((np.arange(len(vectors)), -vectors.sum(1)))
    orders = [largest, *[np.random.default_rng(i).permutation(len(vectors)) for i in range(1, STARTS)]]
    return min((_deal(vectors, groups, shares, order) for order in orders), key=lambda d: d[0])[1]


def _deal(vectors: np.ndarray, groups: np.ndarray, shares: list[float], order: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum reached from one order, and the numbers of groups."""
    weight = vectors / np.maximum(groups @ vectors, 1) if len(vectors) else vectors
    wanted = np.array(shares) / sum(shares)
    dealt = np.floor(groups[:, None] * wanted + 1e-9).astype(np.int64)
    lack = wanted[:, None] * (groups @ weight) - dealt.T @ weight  # [splits, labels]
    for p in order:
        for _ in range(groups[p] - dealt[p].sum()):
            s = int(np.argmax(lack @ weight[p]))  # taking w from lack changes the sum by |w|^2 - 2 lack w
            dealt[p, s] += 1
            lack[s] -= weight[p]
    large = np.argsort(-vectors.sum(1), kind="stable")[:SWAPS]
    own = (weight**2).sum(1)
    for _ in range(len(weight) * len(shares) + 1000):
        best = (-1e-15, None)
        pull = weight @ lack.T  # [profiles, splits]
        for s in range(len(shares)):
            for t in range(len(shares)):
                if s == t:
                    continue
                change = 2 * (own + pull[:, s] - pull[:, t])
                change[dealt[:, s] == 0] = 0
                p = int(np.argmin(change)) if len(change) else 0
                if len(change) and change[p] < best[0]:
                    best = (change[p], (p, None, s, t))
                if s < t:  # p goes from s to t, q back
                    moved = weight[large][:, None] - weight[large][None]
                    change = 2 * ((moved**2).sum(2) + moved @ (lack[s] - lack[t]))
                    change[dealt[large, s] == 0] = 0
                    change[:, dealt[large, t] == 0] = 0
                    p, q = np.unravel_index(int(np.argmin(change)), change.shape) if change.size else (0, 0)
                    if change.size and change[p, q] < best[0]:
                        best = (change[p, q], (int(large[p]), int(large[q]), s, t))
        if best[1] is None:
            break
        p, q, s, t = best[1]
        for profile, a, b in [(p, s, t)] + ([(q, t, s)] if q is not None else []):
            dealt[profile, a] -= 1
            dealt[profile, b] += 1
            lack[a] += weight[profile]
            lack[b] -= weight[profile]
    return float((lack**2).sum()), dealt
