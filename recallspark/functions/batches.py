"""Rows between the engine and Python: how they are dealt to tasks, and how many are objects of Python at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows, and about so many bytes of input, that are objects of Python at a time.
ROWS, BYTES = 512, 2 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to all tasks. Files are split by bytes and row groups, of which compact tables have few, however many rows they hold; Python's work goes by the row. A stream stays as it is."""
    if rows.isStreaming:
        return rows
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def in_slices(batches: Iterator[tuple[pa.Array, ...]], row: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """What row makes of each row of batches of columns, as arrays of kind; neither a batch nor its results are held as objects of Python as a whole."""
    for columns in batches:
        n = len(columns[0])
        step = max(1, min(ROWS, BYTES * n // max(1, sum(c.nbytes for c in columns))))
        for k in range(0, n, step):
            yield pa.array([row(*x) for x in zip(*(c.slice(k, step).to_pylist() for c in columns), strict=True)], kind)
