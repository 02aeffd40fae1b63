"""Velocity classes of samples as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gazeloom.operators.ivt import Thresholds

OUT = "recording_id bigint, ord bigint, velocity double, point int"
STATE = "ord bigint, x double, y double, z double, t double"


def stream_velocity(samples: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Velocity and class of each sample of a stream (recording_id, ord, x, y, z, t): see ivt.classify.

    The state of a recording is its last sample. Within a trigger samples are put in order; one that
    arrives after a later one of its recording has been seen, or repeats a time, is passed over. A
    recording's first sample has no velocity and class -1.
    """

    def classify(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values("ord")
        last = state.get if state.exists else None
        if last is not None:
            frame = frame[frame["ord"] > last[0]]
        frame = frame.drop_duplicates("ord").drop_duplicates("t")
        if last is not None:
            frame = frame[frame["t"] != last[4]]
        if not len(frame):
            return
        values = frame[["x", "y", "z"]].to_numpy(float)
        before = np.vstack([values[:1] * np.nan if last is None else np.array([last[1:4]], float), values[:-1]])
        velocity = _angle(before, values, limits.px_per_mm) * limits.frequency
        point = np.where(velocity < limits.fixation, 1, np.where(velocity > limits.saccade, 0, -1))
        end = frame.iloc[-1]
        state.update((int(end["ord"]), *(float(end[c]) for c in ("x", "y", "z", "t"))))
        yield pd.DataFrame({"recording_id": key[0], "ord": frame["ord"].to_numpy(), "velocity": velocity, "point": point.astype(np.int32)})

    rows = samples.selectExpr("recording_id", "cast(ord as bigint) ord", "x", "y", "z", "t")
    return rows.groupBy("recording_id").applyInPandasWithState(classify, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _angle(first: np.ndarray, second: np.ndarray, px_per_mm: float) -> np.ndarray:
    scale = np.array([px_per_mm, px_per_mm, 1.0])
    a, b = first / scale, second / scale
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
    return np.degrees(np.arccos(np.clip(cosine, -1, 1)))
