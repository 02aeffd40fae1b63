"""Mixing sources to target weights, with repeats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeloom.operators.ordered import prefix_sums
from gazeloom.session import cut_lineage

BLOCK_BITS = 12
"""A source's random order is cut into 2 to this power blocks."""
MAX_SOURCES = 100_000
"""Sources of the target table; more is an error, as the table is worked on by the driver."""
STEPS = 60


def temperature_weights(supply: dict[str, float], exponent: float, targets: dict[str, float] | None = None) -> dict[str, float]:
    """Normalised weights. Without targets the natural shares to the power of exponent; with them
    the natural shares tilted towards the targets: share * (target / share) ** exponent, which is
    natural at 0 and the targets at 1. Sources without supply or weight get nothing.
    """
    total = sum(supply.values())
    raw = {}
    for s, n in supply.items():
        goal = targets.get(s, 0.0) if targets is not None else None
        if n <= 0 or (goal is not None and goal <= 0):
            continue
        p = n / total
        raw[s] = math.exp(exponent * math.log(p)) if goal is None else math.exp((1 - exponent) * math.log(p) + exponent * math.log(goal))
    scale = sum(raw.values())
    return {s: w / scale for s, w in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def exponent_for_entropy(supply: dict[str, float], target: float) -> float:
    """The exponent in [0, 1] whose weights have the target entropy (nats); the nearer end if none has."""
    low, high = 0.0, 1.0  # entropy falls as the exponent rises
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(temperature_weights(supply, middle)) > target else (low, middle)
    return (low + high) / 2


def repeats_needed(weights: dict[str, float], supply: dict[str, float], repeats: dict[str, float], total: float) -> float:
    """How far the source nearest its repetition limit goes towards it; above 1 the limit is broken."""
    return max((w * total / (supply[s] * repeats[s]) if repeats[s] else math.inf for s, w in weights.items()), default=0.0)


def exponent_for_limits(
    supply: dict[str, float], repeats: dict[str, float], total: float, targets: dict[str, float] | None = None, wanted: float = 1.0
) -> float:
    """The exponent nearest to wanted, towards the natural mix, at which total tokens keep within the limits; wanted if the natural mix doesn't."""
    natural = 0.0 if targets is not None else 1.0
    fits = lambda e: repeats_needed(temperature_weights(supply, e, targets), supply, repeats, total) <= 1
    if fits(wanted) or not fits(natural):
        return wanted
    good, bad = natural, wanted
    for _ in range(STEPS):
        middle = (good + bad) / 2
        good, bad = (middle, bad) if fits(middle) else (good, middle)
    return good


def largest_total(weights: dict[str, float], supply: dict[str, float], repeats: dict[str, float]) -> float:
    """The most tokens that can be drawn by these weights within the repetition limits."""
    return min((supply[s] * repeats[s] / w for s, w in weights.items()), default=0.0)


def mix(
    documents: DataFrame, ident: str, source: str, size: Column, targets: DataFrame, passes: float | None = None,
    exponent: float | None = None, entropy_goal: float | None = None, seed: int = 42,
) -> DataFrame:
    """A selection by target shares: (ident, source, n_tokens, n_uses), documents that are used.

    targets: source, target_share, max_repeats; of repeated sources the largest share counts.

    - As it is, the weights are the target shares and the selection is the largest in which they
      hold exactly within the repetition limits.
    - exponent: the weights are the natural shares to this power (1 natural, 0 even for all sources),
      and target shares only say which sources take part. entropy_goal (nats): likewise, at the
      exponent, found by bisection, whose weights' entropy is nearest the goal.
    - passes: the wanted size, in multiples of all tokens of the sources taken part. Where the limits
      don't allow it, the exponent is moved by bisection towards the natural mix, no further than
      needed. Where the natural mix breaks a limit too, it stays, and the selection shrinks to what
      it allows.

    Shares need not sum to 1. Documents without a source, of a source without a positive target
    share, or with null id take no part; nor do null or zero sizes, which can't be weighed. Repeated
    ids count once. A target source without documents can't be met: the others keep their
    proportions. Empty tables give an empty selection.

    A source's budget is its weight of the total: every document is used once for each full pass
    the budget allows; what remains goes to a random permutation of the source, in blocks whose
    token sums are added up first, so that no task holds a source as a whole. The last document is
    taken if at least half of it is within the budget. Of all documents only the token counts,
    which are written once, pass through; the driver sees a row per source.
    """
    goals = _goals(targets)
    wanted = goals.limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    part = documents.select(F.col(ident).alias("_id"), F.col(source).alias("_s"), size.cast("bigint").alias("_n"))
    part = part.join(F.broadcast(goals.select(F.col("s").alias("_s"))), "_s", "left_semi")  # at most MAX_SOURCES rows
    measured = cut_lineage(part.where("_id is not null and _n > 0").groupBy("_id").agg(F.min("_s").alias("_s"), F.max("_n").alias("_n")))
    supply = {row["_s"]: float(row["n"]) for row in measured.groupBy("_s").agg(F.sum("_n").alias("n")).collect()}  # a row per source
    goal = {row["s"]: row["t"] for row in wanted if row["s"] in supply}
    repeats = {row["s"]: row["r"] for row in wanted if row["s"] in supply}
    tilt = goal if exponent is None and entropy_goal is None else None
    wished = exponent_for_entropy(supply, entropy_goal) if entropy_goal is not None else 1.0 if exponent is None else exponent
    total = math.inf if passes is None else passes * sum(supply.values())
    if passes is not None:
        wished = exponent_for_limits(supply, repeats, total, tilt, wished)
    weights = temperature_weights(supply, wished, tilt)
    total = min(total, largest_total(weights, supply, repeats))
    budgets = []
    for s, w in weights.items():
        full = min(math.floor(w * total / supply[s] + 1e-9), int(repeats[s]))
        budgets.append((s, full, 0.0 if full == repeats[s] else max(0.0, w * total - full * supply[s])))
    spark = documents.sparkSession
    budget = spark.createDataFrame(budgets, "_s string, _passes bigint, _rest double")
    shuffled = measured.withColumn("_order", F.xxhash64("_id", F.lit(seed))).withColumn("_block", F.shiftright("_order", 64 - BLOCK_BITS))
    before = prefix_sums(shuffled, ["_s"], "_block", {"_before": F.col("_n")})
    return _draw(shuffled, before, budget, ident, source)


def _goals(targets: DataFrame) -> DataFrame:
    goals = targets.select(F.col("source").alias("s"), F.col("target_share").cast("double").alias("t"), F.col("max_repeats").cast("double").alias("r"))
    goals = goals.where("s is not null and t > 0 and t < double('inf') and r >= 1")
    return goals.groupBy("s").agg(F.max_by("t", "t").alias("t"), F.max_by("r", "t").alias("r"))


def _draw(shuffled: DataFrame, before: DataFrame, budget: DataFrame, ident: str, source: str) -> DataFrame:
    from pyspark.sql import Window as W

    inside = W.partitionBy("_s", "_block").orderBy("_order", "_id").rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("_n").over(inside)
    drawn = shuffled.join(before, ["_s", "_block"]).withColumn("_middle", upto - F.col("_n") / 2).join(F.broadcast(budget), "_s")  # at most MAX_SOURCES rows
    uses = F.col("_passes") + (F.col("_middle") <= F.col("_rest")).cast("bigint")
    return drawn.select(F.col("_id").alias(ident), F.col("_s").alias(source), F.col("_n").alias("n_tokens"), uses.alias("n_uses")).where("n_uses > 0")


def shares(selection: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, share reached, tokens, documents, the most uses of one, and the entropy of all shares reached."""
    tokens = F.sum(F.col("n_tokens") * F.col("n_uses"))
    got = selection.groupBy(F.col(source).alias("source")).agg(tokens.alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("n_uses").alias("most_uses"))
    whole = got.agg(F.sum("n_tokens").alias("_all"), F.sum(F.col("n_tokens") * F.ln("n_tokens")).alias("_weighed"))
    wanted = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"])
    rows = wanted.join(got, "source", "left").join(F.broadcast(whole))  # one row
    none = F.lit(0).cast("bigint")
    return rows.select(
        "source", "target_share", F.coalesce(F.try_divide(F.col("n_tokens"), F.col("_all")), F.lit(0.0)).alias("share"),
        *[F.coalesce(c, none).alias(c) for c in ("n_tokens", "n_documents", "most_uses")], "max_repeats",
        (F.ln("_all") - F.try_divide(F.col("_weighed"), F.col("_all"))).alias("entropy"),
    )
