"""Fixations by a two-state hidden Markov model of speeds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeloom.operators.batches import whole_groups
from gazeloom.operators.islands import with_running_sums
from gazeloom.operators.kinematics import speed_between
from gazeloom.operators.ordered import BLOCK, carried, known
from gazeloom.session import cut_lineage

PIECE = 1 << 15
"""Steps that one task holds of a key. The model of a longer key is fitted on summaries of its pieces."""
ROUNDS = 100
TOLERANCE = 1e-2
FLOOR = 1e-3
"""Least variance, as in the usual implementations."""


def decode_groups(df: DataFrame, keys: list[str], order: str, state: Column, values: list[str]) -> DataFrame:
    """Centroids of decoded states: (keys, group, first_order, n, the values' means).

    Rows of state 0 are gathered; a row of state 1 ends a group; the key's last row is never used
    and ends none. Other states and null neither add nor end.
    """
    last = df.groupBy(*keys).agg(F.max(order).alias("_last"))
    rows = with_running_sums(df, keys, order, {"group": (F.coalesce(state, F.lit(-1)) == 1).cast("bigint")}).join(last, keys)
    kept = rows.where((state == 0) & (F.col(order) < F.col("_last")))
    return kept.groupBy(*keys, "group").agg(F.min(order).alias("first_order"), F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])


def hmm_states(df: DataFrame, keys: list[str], order: str, time: str) -> DataFrame:
    """Adds at (row number) and state of the step from each row to the next: 0 the slower, 1 the faster; null in the last row.

    A Gaussian model of two states is fitted by expectation maximisation and decoded by its most
    likely path, per key. It starts from the halves below and above the median speed, so results
    are repeatable. A key of more than PIECE steps has one model too, which no task holds whole: per
    round every piece gives its expected counts for each pair of states before it and at its end,
    and a key's pieces, one row each, are put together. The same goes for the path.
    """
    rows = known(df.withColumn("_chunk", F.floor(F.col(order) / BLOCK)), [*keys, "_chunk"]).repartition(*keys, "_chunk")
    place = ["x", "y", time]
    edges = carried(rows, keys, "_chunk", [order], {"_base": F.lit(1)}, first=place)
    w = W.partitionBy(*keys, "_chunk").orderBy(order)
    placed = rows.withColumns({"_inside": F.row_number().over(w) - 1, "_lead": F.lead(F.struct(*place)).over(w)}).join(edges, [*keys, "_chunk"])
    following = F.coalesce("_lead", "_next")
    speed = speed_between(*[following[c] - F.col(c) for c in place])
    placed = placed.select(*df.columns, (F.col("_base") + F.col("_inside")).alias("at"), F.when(~F.isnan(speed), speed).alias("speed"))
    placed = cut_lineage(placed)
    schema = T.StructType([*df.schema.fields, T.StructField("at", T.LongType()), T.StructField("state", T.IntegerType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, fresh in whole_groups(batches, keys, TOGETHER):
            speeds = table.column("speed").to_numpy()
            there = np.flatnonzero(~np.isnan(speeds))
            group = np.cumsum(fresh)[there]
            states = np.zeros(len(speeds), np.int32)
            if len(there):
                states[there] = two_states_of_each(speeds[there], np.flatnonzero(np.diff(group, prepend=0)))
            found = table.drop_columns(["speed"]).append_column("state", pa.array(states, mask=np.isnan(speeds)))
            yield from found.combine_chunks().to_batches()

    steps = placed.where("speed is not null").select(*keys, F.floor(F.col("at") / PIECE).alias("piece"), "at", "speed")
    long = steps.groupBy(*keys).agg(F.min("piece").alias("_first"), F.max("piece").alias("_last")).where("_last > _first").select(*keys, "_first")
    long = cut_lineage(long)  # at most a row per PIECE steps
    some = not long.isEmpty()
    short = placed.join(long, keys, "left_anti") if some else placed
    labelled = short.repartition(*keys).sortWithinPartitions(*keys, "at").mapInArrow(label, schema)
    if some:
        pieces = steps.join(long, keys).withColumn("piece", F.col("piece") - F.col("_first")).drop("_first")
        of_steps = T.StructType([*[steps.schema[k] for k in keys], *schema.fields[-2:]])
        states = _long_states(cut_lineage(pieces), keys, of_steps)
        whole = placed.drop("speed").join(long.select(*keys), keys, "left_semi").join(states, [*keys, "at"], "left")
        labelled = labelled.unionByName(whole)
    return cut_lineage(labelled)


def _halves(steps: DataFrame, keys: list[str]) -> DataFrame:
    """The model that each key starts from: (keys, model), by the exact median and without a window over a key's rows."""
    near = steps.groupBy(*keys).agg(F.percentile_approx("speed", [0.499, 0.501], 10000).alias("_q"), F.count(F.lit(1)).alias("_n"))
    rows = steps.join(near, keys)
    below = rows.groupBy(*keys).agg(F.count_if(F.col("speed") < F.col("_q")[0]).alias("_below"))
    middle = rows.where(F.col("speed").between(F.col("_q")[0], F.col("_q")[1])).groupBy(*keys, "_n", "speed").agg(F.count(F.lit(1)).alias("_c")).join(below, keys)
    upto = F.col("_below") + F.sum("_c").over(W.partitionBy(*keys).orderBy("speed"))  # the distinct speeds of about 0.2 % of a key's rows
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("speed")))
    median = middle.withColumn("_upto", upto).groupBy(*keys).agg(((at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2).alias("_median"))
    most = steps.groupBy(*keys).agg(F.max("speed").alias("_most"))
    rows = steps.join(median, keys).join(most, keys)
    high = F.when(F.col("_median") < F.col("_most"), F.col("speed") > F.col("_median")).otherwise(F.col("speed") >= F.col("_most"))
    low = rows.groupBy(*keys).agg(
        *[f(F.when(c, F.col("speed"))).alias(n) for n, f, c in (("m0", F.avg, ~high), ("m1", F.avg, high), ("v0", F.var_pop, ~high), ("v1", F.var_pop, high))]
    )
    m0, m1, v0, v1 = (F.coalesce(n, o) for n, o in (("m0", "m1"), ("m1", "m0"), ("v0", "v1"), ("v1", "v0")))  # all speeds equal: one half is empty
    fixed = [F.lit(v) for v in (0.5, 0.5, 0.9, 0.1, 0.1, 0.9)]
    return low.select(*keys, F.array(m0, m1, v0 + FLOOR, v1 + FLOOR, *fixed).alias("model"))


def _long_states(steps: DataFrame, keys: list[str], schema: T.StructType) -> DataFrame:
    """States of keys of any length, from pieces."""
    numbers, of = T.ArrayType(T.DoubleType()), [schema[k] for k in keys]
    state = T.StructType([*of, T.StructField("model", numbers), T.StructField("likelihood", T.DoubleType()), T.StructField("done", T.BooleanType())])
    piece_state = T.StructType([*of, T.StructField("piece", T.LongType()), *state.fields[len(of) :], T.StructField("values", numbers)])

    def summary(of_piece):
        def give(piece: pd.DataFrame) -> pd.DataFrame:
            piece = piece.sort_values("at")
            values = of_piece(piece["speed"].to_numpy(), np.array(piece["model"].iloc[0]), piece["piece"].iloc[0] == 0)
            return piece[[*keys, "piece", "model", "likelihood", "done"]].head(1).assign(values=[values.ravel().tolist()])

        return give

    def improve(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("piece")
        first = pieces[[*keys, "model", "likelihood", "done"]].head(1)
        model, likelihood = _combined(np.stack(pieces["values"].to_list()).reshape(-1, 2, 2, 12))
        done = bool(likelihood - first["likelihood"].iloc[0] < TOLERANCE)
        return first.assign(model=[model.tolist()], likelihood=likelihood, done=done)

    def ends(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("piece")
        path = _piece_ends(np.stack(pieces["values"].to_list()).reshape(-1, 2, 2))
        return pieces.assign(values=[[float(a), float(b)] for a, b in path])

    def decode(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values("at")
        model, (entry, last) = np.array(piece["model"].iloc[0]), piece["values"].iloc[0]
        speeds = piece["speed"].to_numpy()
        path = _paths(speeds, Sequences.at(np.zeros(1, int), len(speeds)), model[None], _entries(model, piece["piece"].iloc[0] == 0)[int(entry)], int(last))
        return piece[[*keys, "at"]].assign(state=(path if model[0] <= model[1] else 1 - path).astype(np.int32))

    models = cut_lineage(_halves(steps, keys).select(*keys, "model", F.lit(float("-inf")).alias("likelihood"), F.lit(False).alias("done")))
    for _ in range(ROUNDS):
        if models.where("not done").isEmpty():
            break
        pieces = steps.join(models.where("not done"), keys).groupBy(*keys, "piece").applyInPandas(summary(_expected), piece_state)
        models = cut_lineage(pieces.groupBy(*keys).applyInPandas(improve, state).unionByName(models.where("done").select(*state.names)))
    pieces = steps.join(models, keys).groupBy(*keys, "piece").applyInPandas(summary(_best_scores), piece_state)
    placed = cut_lineage(pieces.groupBy(*keys).applyInPandas(ends, piece_state))
    return steps.join(placed.select(*keys, "piece", "model", "values"), [*keys, "piece"]).groupBy(*keys, "piece").applyInPandas(decode, schema)


# A model is ten numbers: means, variances, start and, by row, steps.


def _log_densities(speeds: np.ndarray, model: np.ndarray) -> np.ndarray:
    mean, var = model[:2], model[2:4]
    return -0.5 * (np.log(2 * np.pi * var) + (speeds[:, None] - mean) ** 2 / var)


def _entries(model: np.ndarray, first: bool) -> np.ndarray:
    """Chances of a piece's first state, by the state before the piece. A key's first piece has none, that is twice the start."""
    return np.array([model[4:6]] * 2) if first else model[6:].reshape(2, 2)


def _expected(speeds: np.ndarray, model: np.ndarray, first: bool) -> np.ndarray:
    """Twelve numbers for each state before a piece and each state at its end.

    The logarithm of the likelihood; given both states, the chance of state 0 at the first step, the
    weight, mean and squares about the mean of either state, and the counts of steps inside the piece.
    """
    logs = _log_densities(speeds, model)
    top = logs.max(1)
    moves = model[6:].reshape(2, 2) * np.exp(logs - top[:, None])[:, None]
    moves[0] = _entries(model, first) * np.exp(logs[0] - top[0])
    ahead, back, scale = _all_products(moves)
    whole = ahead[-1]
    out = np.zeros((2, 2, 12))
    with np.errstate(divide="ignore"):
        out[:, :, 0] = np.log(whole) + scale + top.sum()
    for i, j in np.argwhere(whole > 0):
        weight = ahead[:, i] * back[:, :, j]
        weight /= weight.sum(1, keepdims=True)
        pairs = ahead[:-1, i, :, None] * moves[1:] * back[1:, None, :, j]
        pairs = (pairs / pairs.sum((1, 2), keepdims=True)).sum(0)
        total = np.maximum(weight.sum(0), 1e-300)
        mean = (weight * speeds[:, None]).sum(0) / total
        square = (weight * (speeds[:, None] - mean) ** 2).sum(0)
        out[i, j] = [out[i, j, 0], weight[0, 0], *weight.sum(0), *mean, *square, *pairs.ravel()]
    return out


def _combined(pieces: np.ndarray) -> tuple[np.ndarray, float]:
    """The next model, and the logarithm of the present one's likelihood, from the numbers of a key's pieces in order."""
    n, logs = len(pieces), pieces[..., 0]
    before, after = np.zeros((n + 1, 2)), np.zeros((n + 1, 2))
    before[0] = [0, -np.inf]
    for k in range(n):
        before[k + 1] = np.logaddexp(*(before[k][:, None] + logs[k]))
    for k in range(n - 1, -1, -1):
        after[k] = np.logaddexp(*(logs[k] + after[k + 1]).T)
    likelihood = float(np.logaddexp(*before[n]))
    chance = np.exp(before[:-1, :, None] + logs + after[1:, None, :] - likelihood)
    weight = chance[..., None] * pieces[..., 2:4]
    total = np.maximum(weight.sum((0, 1, 2)), 1e-12)
    mean = (weight * pieces[..., 4:6]).sum((0, 1, 2)) / total
    var = (chance[..., None] * pieces[..., 6:8] + weight * (pieces[..., 4:6] - mean) ** 2).sum((0, 1, 2)) / total + FLOOR
    entered = np.stack([chance * pieces[..., 1], chance * (1 - pieces[..., 1])], -1)
    pairs = (chance[..., None] * pieces[..., 8:]).sum((0, 1, 2)).reshape(2, 2) + entered[1:].sum((0, 2))
    return np.concatenate([mean, var, entered[0].sum((0, 1)), (pairs / pairs.sum(1, keepdims=True)).ravel()]), likelihood


def _best_scores(speeds: np.ndarray, model: np.ndarray, first: bool) -> np.ndarray:
    """Logarithm of the best path's likelihood for each state before a piece and each state at its end."""
    with np.errstate(divide="ignore"):
        steps, entries = np.log(model[6:].reshape(2, 2)), np.log(_entries(model, first))
    moves = _log_densities(speeds, model)[:, None] + steps
    moves[0] += entries - steps
    local = _prefixes(_in_rows(moves, NO_MOVE_LOG), _best_product)[-1]
    best = local[0]
    for piece in local[1:]:
        best = (best[:, :, None] + piece).max(1)
    return best


def _piece_ends(scores: np.ndarray) -> list[tuple[int, int]]:
    """The states of the best path before and at the end of each of a key's pieces."""
    best, came = np.array([0, -np.inf]), []
    for piece in scores:
        ways = best[:, None] + piece
        came.append(ways.argmax(0))
        best = ways.max(0)
    state, ends = int(best[1] > best[0]), []
    for back in reversed(came):
        ends.append((int(back[state]), state))
        state = ends[-1][0]
    return ends[::-1]


# Sequences are cut into rows of ROW steps, on which all work goes on at once, step by step; what
# enters a row is then carried from row to row. A step is a 2 x 2 matrix from the state before to the
# state after; steps in a row are multiplied, and a row is filled up with steps that change nothing.

ROW = 128
TOGETHER = 1 << 16
"""Steps of short keys, about, whose models are fitted at once."""
NO_MOVE = np.eye(2)
with np.errstate(divide="ignore"):
    NO_MOVE_LOG = np.log(NO_MOVE)


def _in_rows(moves: np.ndarray, fill: np.ndarray, places: tuple[np.ndarray, np.ndarray] | None = None, rows: int = 0) -> np.ndarray:
    """The moves as [ROW, rows, 2, 2]; places are (place in the row, row) of each."""
    if places is None:
        at = np.arange(len(moves))
        places, rows = (at % ROW, at // ROW), -(-len(moves) // ROW)
    out = np.empty((ROW, rows, 2, 2))
    out[:] = fill
    out[places] = moves
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., :, 0, None] * b[..., 0, None, :] + a[..., :, 1, None] * b[..., 1, None, :]


def _best_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a[..., :, 0, None] + b[..., 0, None, :], a[..., :, 1, None] + b[..., 1, None, :])


def _prefixes(rows: np.ndarray, product) -> np.ndarray:
    """Products of each row's moves up to and with each place."""
    out = np.empty_like(rows)
    out[0] = rows[0]
    for t in range(1, len(rows)):
        out[t] = product(out[t - 1], rows[t])
    return out


def _scaled_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, each divided by its sum, and the logarithm of what a row's last was divided by."""
    out, scale = np.empty_like(rows), np.zeros(rows.shape[1])
    here = np.broadcast_to(NO_MOVE, rows.shape[1:])
    for t in range(len(rows)):
        here = _product(here, rows[t])
        total = here.sum((1, 2), keepdims=True)
        total[total == 0] = 1e-300
        here = out[t] = here / total
        scale += np.log(total[:, 0, 0])
    return out, scale


def _scaled_suffixes(rows: np.ndarray) -> np.ndarray:
    """Products of the moves after each place, divided by their sums."""
    out = np.empty_like(rows)
    here = out[-1] = np.broadcast_to(NO_MOVE, rows.shape[1:])
    for t in range(len(rows) - 2, -1, -1):
        here = _product(rows[t + 1], here)
        here = out[t] = here / np.maximum(here.sum((1, 2), keepdims=True), 1e-300)
    return out


def _all_products(moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of one sequence: the products up to and with each move and of those after it, up to a factor, and the logarithm of that of the last."""
    rows = _in_rows(moves, NO_MOVE)
    ahead, scales = _scaled_prefixes(rows)
    back = _scaled_suffixes(rows)
    n = rows.shape[1]
    into, after = np.empty((n, 2, 2)), np.empty((n, 2, 2))
    into[0], after[-1], scale = NO_MOVE, NO_MOVE, 0.0
    for r in range(n):
        product = _product(into[r], ahead[-1, r])
        total = product.sum()
        scale += np.log(total) + scales[r]
        if r + 1 < n:
            into[r + 1] = product / total
    for r in range(n - 1, 0, -1):
        product = _product(ahead[-1, r], after[r])
        after[r - 1] = product / product.sum()
    flat = lambda a: a.swapaxes(0, 1).reshape(-1, 2, 2)[: len(moves)]
    ahead = _product(into[None], ahead)
    return flat(ahead / ahead[-1, -1].sum()), flat(_product(back, after[None])), scale


@dataclass
class Sequences:
    """Places of several sequences' steps, one after the other, in rows."""

    begins: np.ndarray
    count: np.ndarray
    first_row: np.ndarray
    rows_of: np.ndarray
    rows: int
    places: tuple[np.ndarray, np.ndarray]
    of: np.ndarray

    @classmethod
    def at(cls, begins: np.ndarray, total: int) -> Sequences:
        count = np.diff(np.append(begins, total))
        rows_of = -(-count // ROW)
        first_row = np.cumsum(rows_of) - rows_of
        of = np.repeat(np.arange(len(begins)), count)
        place = np.arange(total) - begins[of]
        return cls(begins, count, first_row, rows_of, int(rows_of.sum()), (place % ROW, first_row[of] + place // ROW), of)

    def carried(self, into: np.ndarray, advance, forward: bool) -> np.ndarray:
        """Fills into [rows, ...] from each sequence's first row on (or last row back): into[next] = advance(rows, into[rows])."""
        for k in range(1, int(self.rows_of.max(initial=1))):
            some = np.flatnonzero(self.rows_of > k)
            here = self.first_row[some] + (k - 1 if forward else self.rows_of[some] - k)
            into[here + (1 if forward else -1)] = advance(here, into[here])
        return into

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.begins)


def two_states(speeds: np.ndarray) -> np.ndarray:
    """State 0 or 1 of each speed, 0 being the state of the lower mean."""
    return two_states_of_each(speeds, np.zeros(1, int)) if len(speeds) else np.zeros(0, int)


def two_states_of_each(speeds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The same for several sequences, which begin at `begins`, each with a model of its own."""
    states = np.zeros(len(speeds), int)
    ends = np.append(begins[1:], len(speeds))
    varied = [(b, e) for b, e in zip(begins, ends) if e - b > 1 and np.ptp(speeds[b:e])]
    models = np.array([_start_model(speeds[b:e]) for b, e in varied]).reshape(-1, 10)
    before, open_ = np.full(len(varied), -np.inf), np.arange(len(varied))
    pick = lambda chosen: (np.concatenate([speeds[slice(*varied[k])] for k in chosen]), np.cumsum([0, *[varied[k][1] - varied[k][0] for k in chosen[:-1]]]))
    for _ in range(ROUNDS):
        if not len(open_):
            break
        models[open_], likelihood = _improved(*pick(open_), models[open_])
        going = likelihood - before[open_] >= TOLERANCE
        before[open_] = likelihood
        open_ = open_[going]
    if len(varied):
        values, at = pick(np.arange(len(varied)))
        path = _paths(values, Sequences.at(at, len(values)), models)
        path = np.where((models[:, 0] <= models[:, 1])[np.repeat(np.arange(len(varied)), [e - b for b, e in varied])], path, 1 - path)
        for (b, e), p in zip(varied, at):
            states[b:e] = path[p : p + e - b]
    return states


def _start_model(speeds: np.ndarray) -> np.ndarray:
    high = speeds > np.median(speeds)
    if not high.any():
        high = speeds >= speeds.max()
    return np.array([speeds[~high].mean(), speeds[high].mean(), speeds[~high].var() + FLOOR, speeds[high].var() + FLOOR, 0.5, 0.5, 0.9, 0.1, 0.1, 0.9])


def _logs_of_each(speeds: np.ndarray, models: np.ndarray, of: np.ndarray) -> np.ndarray:
    mean, var = models[of, :2], models[of, 2:4]
    return -0.5 * (np.log(2 * np.pi * var) + (speeds[:, None] - mean) ** 2 / var)


def _improved(speeds: np.ndarray, begins: np.ndarray, models: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences' next models, and the logarithm of the present ones' likelihood."""
    q = Sequences.at(begins, len(speeds))
    logs = _logs_of_each(speeds, models, q.of)
    top = logs.max(1)
    density = np.exp(logs - top[:, None])
    moves = models[q.of, 6:].reshape(-1, 2, 2) * density[:, None]
    moves[begins] = (models[:, 4:6] * density[begins])[:, None]  # whatever state is said to be before
    rows = _in_rows(moves, NO_MOVE, q.places, q.rows)
    ahead, scale = _scaled_prefixes(rows)
    back = _scaled_suffixes(rows)
    whole = ahead[-1]
    on = lambda v, m: (v[:, :, None] * m).sum(1)
    share = lambda v: v / np.maximum(v.sum(1, keepdims=True), 1e-300)
    into = q.carried(np.tile([1.0, 0.0], (q.rows, 1)), lambda r, v: share(on(v, whole[r])), True)
    after = q.carried(np.ones((q.rows, 2)), lambda r, v: share((whole[r] * v[:, None]).sum(2)), False)
    with np.errstate(divide="ignore"):
        likelihood = np.add.reduceat(scale + np.log(on(into, whole).sum(1)), q.first_row) + q.sums(top)
    alpha = (into[None, :, :, None] * ahead).sum(2)
    alpha /= np.maximum(alpha.sum(2, keepdims=True), 1e-300)
    beta = (back * after[None, :, None]).sum(3)[q.places]
    previous = np.concatenate([into[None], alpha[:-1]])[q.places]
    weight = share(alpha[q.places] * beta)
    pairs = previous[:, :, None] * moves * beta[:, None]
    pairs /= np.maximum(pairs.sum((1, 2), keepdims=True), 1e-300)
    pairs[begins] = 0
    pairs = q.sums(pairs)
    total = np.maximum(q.sums(weight), 1e-12)
    mean = q.sums(weight * speeds[:, None]) / total
    var = q.sums(weight * (speeds[:, None] - mean[q.of]) ** 2) / total + FLOOR
    step = pairs / pairs.sum(2, keepdims=True)
    return np.concatenate([mean, var, weight[begins], step.reshape(-1, 4)], 1), likelihood


def _paths(speeds: np.ndarray, q: Sequences, models: np.ndarray, entry: np.ndarray | None = None, last: int | None = None) -> np.ndarray:
    """The most likely states of each sequence; entry and last give one sequence's chances of the first state and the state at its end."""
    logs = _logs_of_each(speeds, models, q.of)
    with np.errstate(divide="ignore"):
        steps = np.log(models[:, 6:].reshape(-1, 2, 2))[q.of]
        moves = logs[:, None] + steps
        moves[q.begins] = (np.log(models[:, 4:6] if entry is None else entry[None]) + logs[q.begins])[:, None]
    local = _prefixes(_in_rows(moves, NO_MOVE_LOG, q.places, q.rows), _best_product)
    into = q.carried(np.zeros((q.rows, 2)), lambda r, v: (v[:, :, None] + local[-1, r]).max(1), True)
    best = (into[None, :, :, None] + local).max(2)
    before = np.concatenate([into[None], best[:-1]])[q.places]
    came = np.tile(np.array([0, 1], np.int8), (ROW, q.rows, 1))  # state before, by state after; the filling's are alike
    came[q.places] = before[:, 1, None] + steps[:, 1] > before[:, 0, None] + steps[:, 0]
    ends = q.first_row + q.rows_of - 1
    final = best[-1, ends]
    state = np.zeros(q.rows, int)
    state[ends] = final[:, 1] > final[:, 0] if last is None else last
    to_end = np.empty((ROW, q.rows, 2), np.int8)  # state at a place, by the row's last
    to_end[-1] = [0, 1]
    row = np.arange(q.rows)[:, None]
    for t in range(ROW - 2, -1, -1):
        to_end[t] = came[t + 1, row, to_end[t + 1]]
    q.carried(state, lambda r, v: came[0, r, to_end[0, r, v]], False)
    return to_end[q.places[0], q.places[1], state[q.places[1]]].astype(int)


def hmm_fixations(df: DataFrame, keys: list[str], order: str, time: str) -> DataFrame:
    """Fixations of the decoded model: (keys, first_order, n, x, y, t)."""
    states = hmm_states(df, keys, order, time)
    groups = decode_groups(states, keys, "at", F.col("state"), ["x", "y", time])
    return groups.select(*keys, "first_order", "n", "x", "y", F.col(time).alias("t"))
