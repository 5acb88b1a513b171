"""Small helpers over the arrays of a row, given to Python as Arrow values so that no row becomes a table of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: How many rows at a time go to Python, as their arrays may be long.
ROWS = 500
#: How many bytes of results are held before they are told on.
BYTES = 16 << 20


def bounded(spark: SparkSession) -> None:
    """From now on Python workers of the session get at most ``ROWS`` rows at a time; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))


def by_row(of: Callable, arrow: pa.DataType, returns: str) -> Callable[..., Column]:
    """A column function that gives ``of`` the Arrow values of one row after the other."""

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([of(*row) for row in zip(*columns, strict=True)], arrow)

    return F.arrow_udf(run, returns)


def batched(of: Callable[..., tuple], schema: pa.Schema, most: int = BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: a row of texts or bytes for each row, told on as soon as ``most`` bytes or ``ROWS`` rows are held, so that a few large rows are no large batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        tell = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                held.append(of(*(x.as_py() for x in row)))
                size += sum(len(x) for x in held[-1] if x is not None)
                if size >= most or len(held) >= ROWS:
                    yield tell()
                    held, size = [], 0
        if held:
            yield tell()

    return run


def starts(sizes: pa.Array) -> pa.Array:
    """For each array of sizes the sums of those before each."""
    flat, ends = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes.value_lengths().to_numpy(zero_copy_only=False))
    sums, begins = np.append(0, np.cumsum(flat)), np.append(0, ends)
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array((sums[:-1] - np.repeat(sums[begins[:-1]], np.diff(begins))), pa.int32()))


def codes(words: pa.Array, n: int) -> np.ndarray:
    """A number for every run of ``n`` words, the same where runs are equal."""
    own = words.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    code = own[: max(len(own) - n + 1, 0)]
    for k in range(1, n if len(code) else 1):
        code = np.unique(code * (own.max() + 1) + own[k : k + len(code)], return_inverse=True)[1]
    return code
