"""Neural models as plug-ins over windows of features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class WindowModel(Protocol):
    """A model of one fold: scores [n, classes] of windows [n, rows, features]."""

    def __call__(self, windows: np.ndarray) -> np.ndarray: ...


def onnx_model(weights: bytes) -> WindowModel:
    """A model from ONNX bytes, if onnxruntime is installed."""
    import onnxruntime

    session = onnxruntime.InferenceSession(weights, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name
    return lambda windows: session.run(None, {name: windows.astype(np.float32)})[0]


def predict_windows(df: DataFrame, keys: list[str], window: str, loaders: list[Callable[[], WindowModel]], batch: int = 512) -> DataFrame:
    """One row per window and model: (keys, model, prediction), prediction the class of the largest score.

    A task loads each model once and scores `batch` windows at a time. Windows with a missing or
    infinite number, which no model can judge, are left out. The votes of the models are counted
    with sequence.majority.
    """
    if not loaders:
        raise ValueError("no model")
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("model", T.IntegerType()), T.StructField("prediction", T.IntegerType())])

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [load() for load in loaders]
        for frame in frames:
            for begin in range(0, len(frame), batch):
                part = frame.iloc[begin : begin + batch]
                windows = np.array([[list(r) for r in w] for w in part[window]], float)
                sound = np.isfinite(windows).all(axis=tuple(range(1, windows.ndim)))
                if sound.any():
                    for i, model in enumerate(models):
                        chosen = model(windows[sound]).argmax(1).astype(np.int32)
                        yield part.loc[sound, keys].assign(model=np.int32(i), prediction=chosen)[schema.names]

    return df.select(*keys, window).mapInPandas(predict, schema)
