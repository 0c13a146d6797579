"""Adding up large arrays that tasks count, without sending all of them to one place."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assaykit.llm.memory import lean

#: An array is dealt out in this many equal parts.
PARTS = 32


def _packed(values: np.ndarray) -> bytes:
    """The numbers, or only those that aren't 0 with their places if that is shorter."""
    at = np.flatnonzero(values)
    size = values.dtype.itemsize
    return b"D" + values.tobytes() if len(at) * (4 + size) >= len(values) * size else b"S" + at.astype(np.int32).tobytes() + values[at].tobytes()


def _add_to(total: np.ndarray, data: bytes) -> None:
    if data[:1] == b"D":
        total += np.frombuffer(data, total.dtype, offset=1)
        return
    n = (len(data) - 1) // (4 + total.dtype.itemsize)
    total[np.frombuffer(data, np.int32, n, 1)] += np.frombuffer(data, total.dtype, n, 1 + 4 * n)


def sum_arrays(rows: DataFrame, count: Callable, size: int, dtype=np.float64) -> np.ndarray:
    """The sum over all tasks of the arrays of the given size that count(batches) returns; size is a multiple of PARTS.

    What reaches the driver is one array. Each part is added up by a task that holds one partial sum at a time.
    """
    step = size // PARTS

    def partial(batches):
        total = np.asarray(count(batches), dtype)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([_packed(total[i * step : (i + 1) * step]) for i in range(PARTS)], pa.binary())], names=["part", "data"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _add_to(sums.setdefault(part, np.zeros(step, dtype)), data)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_packed(v) for v in sums.values()], pa.binary())], names=["part", "data"])

    found = rows.mapInArrow(lean(partial), "part int, data binary").repartition("part").mapInArrow(lean(add), "part int, data binary").collect()
    out = np.zeros(size, dtype)
    for part, data in found:
        _add_to(out[part * step : (part + 1) * step], bytes(data))
    return out
