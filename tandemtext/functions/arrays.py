"""Sums of fixed-size arrays over all tasks, in two levels, so that no task holds more than a bounded part."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCKS, FIRST_LEVEL = 16, 256


#: What a task sends beside its parts of the array.
ASIDE = -1


def summed(df: DataFrame, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over all tasks of an array that each task makes with start() and fills with add() from its batches.

    The array's size is fixed by the caller and does not grow with the data. Tasks send it in blocks, which are summed by
    task number modulo 256 first and then in all.
    """
    return added_up(partial_sums(df, start, add), start)


def partial_sums(df: DataFrame, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, pa.RecordBatch], bytes | None]) -> DataFrame:
    """Each task's array in blocks: `block, part, data`. What add() returns goes along as rows of the block ASIDE."""
    size = math.ceil(start().size / BLOCKS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = start(), False
        names = ["block", "part", "data"]
        for b in batches:
            if b.num_rows:
                seen = True
                if (aside := add(total, b)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([ASIDE], pa.int32()), pa.array([0], pa.int32()), pa.array([aside], pa.binary())], names)
        if seen:
            flat = total.ravel()
            part = TaskContext.get().partitionId() % FIRST_LEVEL
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([part] * BLOCKS, pa.int32()), pa.array([flat[i * size : (i + 1) * size].tobytes() for i in range(BLOCKS)], pa.binary())], names)

    return df.mapInArrow(partial, "block int, part int, data binary")


def added_up(rows: DataFrame, start: Callable[[], np.ndarray]) -> np.ndarray:
    """The sum of all tasks' arrays."""
    shape, kind = start().shape, start().dtype

    def add_up(x: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(x["data"].iloc[0], kind).copy()
        for d in x["data"].iloc[1:]:
            total += np.frombuffer(d, kind)
        return pd.DataFrame({"block": x["block"].iloc[:1], "part": [0], "data": [total.tobytes()]})

    rows = rows.where(f"block <> {ASIDE}")
    for keys in (["block", "part"], ["block"]):
        rows = rows.groupBy(*keys).applyInPandas(add_up, "block int, part int, data binary")
    parts = {r["block"]: np.frombuffer(r["data"], kind) for r in rows.collect()}
    return np.concatenate([parts[i] for i in range(BLOCKS)]).reshape(shape) if parts else start()
