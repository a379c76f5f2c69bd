"""UDFs that go through Spark's batches in small steps.

A batch has up to 10,000 rows or 64 MB, whatever the rows become in Python. In steps a worker holds the batch as Arrow has it, and only one
step's values and results as Python objects; results leave step by step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of a step's texts, and its rows; one row is a step at least.
STEP_BYTES, STEP_ROWS = 500_000, 2_000


def cuts(columns: tuple[pa.Array, ...], expected: int | None = None) -> list[tuple[int, int]]:
    """(first row, rows) of the steps; `expected` is the column that says how many bytes a row is going to have."""
    n = len(columns[0])
    size = np.zeros(n, np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    if expected is not None:
        size += np.clip(pc.fill_null(columns[expected], 0).to_numpy(zero_copy_only=False), 0, STEP_BYTES)
    before = np.cumsum(size) - size
    step = np.maximum.accumulate(before // STEP_BYTES)
    starts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), n]
    return [(at, min(STEP_ROWS, z - at)) for a, z in zip(starts, starts[1:]) for at in range(a, z, STEP_ROWS)]


def in_steps(returns: T.DataType, start: Callable[[], Callable[..., list]], expected: int | None = None) -> Callable:
    """A UDF. start() is called once in a task; what it gives makes a list of results of lists, one for each column, of a step's values."""
    kind = to_arrow_type(returns)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        results = start()
        for got in batches:
            columns = got if isinstance(got, tuple) else (got,)
            for at, n in cuts(columns, expected):
                yield pa.array(results(*(c.slice(at, n).to_pylist() for c in columns)), kind)

    return F.arrow_udf(run, returns)


def each_in_steps(returns: T.DataType, f: Callable, expected: int | None = None) -> Callable:
    """A UDF of f, which makes one row's result of its values."""
    return in_steps(returns, lambda: lambda *columns: [f(*row) for row in zip(*columns)], expected)
