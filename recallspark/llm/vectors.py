"""Reading of vector columns in the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors from which directions and pivots are learned.
SAMPLE = 4096


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """Rows of a list column whose vectors all have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def dimensions(rows: DataFrame, vector: str) -> list[int]:
    """The lengths of vectors that occur."""
    return sorted(r[0] for r in rows.select(F.size(vector).alias("n")).distinct().collect())


def sample(rows: DataFrame, key: str, vector: str, size: int = SAMPLE) -> np.ndarray:
    """At most size vectors, one for each slot of a hash of the key: the bound holds for any input."""
    order = F.xxhash64(F.col(key), F.col(vector))
    slot = F.pmod(order, F.lit(size))
    found = rows.select(slot.alias("slot"), F.struct(order.alias("order"), F.col(vector).alias("v")).alias("x")).groupBy("slot").agg(F.min_by("x", "x.order").alias("x"))
    taken = found.orderBy("slot").select("x.v").toArrow()
    return matrix(taken.column("v")) if taken.num_rows else np.zeros((0, 0))
