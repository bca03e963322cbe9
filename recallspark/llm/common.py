"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.sources.tables import shared_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What runs in here removes its shuffle files when it ends. Else they stay until the driver happens to collect its garbage, which on large tables is far too late."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables that an operator writes to the shared folder on its way: lineage ends there, and a lost executor costs nothing.

    A table goes when the operator drops it; those that its result is still read from go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self._kept = spark, fresh_path(spark, f"scratch-{name}"), []
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._at(self.path))

    def keep(self, df: DataFrame, *old: DataFrame) -> DataFrame:
        """df as a written table. Tables in old, which are not needed beyond it, are dropped."""
        path = f"{self.path}/{len(self._kept)}"
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._kept.append((out, path))
        self.drop(*old)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for kept, path in self._kept:
            if any(kept is x for x in tables):
                self._fs.delete(self._at(path), True)


def salted_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """many joined on key with few, which has each key once: a key's rows in many go to so many tasks, and few is repeated that often.

    The salt comes from all of a row's columns, so a repeated row stays with its copies.
    """
    salt = "__salt" + "_" * max(map(len, many.columns))
    left = many.withColumn(salt, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in many.columns)), F.lit(salts)).cast("int"))
    right = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.hint("merge").join(right, [key, salt], how).drop(salt)


#: Rows of an Arrow batch between the engine and Python.
BATCH_ROWS = 1000


def of_texts(df: DataFrame) -> DataFrame:
    """df, for a function over its rows in Python. Where rows hold texts, batches of the engine's 10,000 rows take tens of MB on both sides of each task, so a session that leaves that number as it is gets a smaller one."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def tokenizer_path(name: str) -> str:
    """The place of a vocabulary file: an absolute path as it is, else a file of the installed public vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Numbers(dict):
    """Numbers words as they come, from first on; new holds those that came since it was emptied."""

    def __init__(self, first: int = 0):
        self.first, self.new = first, []

    def __missing__(self, word):
        self.new.append(word)
        number = self[word] = self.first + len(self)
        return number


def release_memory() -> None:
    """Gives freed memory back to the system at the end of a task: a worker lives on for other tasks and other operators."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has its own way
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task's function over batches that gives memory back when it is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def small_batches(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about max_bytes at most (a longer single text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_offsets(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + max_bytes, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def text_offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets (rows + 1) of a string or binary column in its data buffer."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    found = np.frombuffer(column.buffers()[1], dtype=kind, count=column.offset + len(column) + 1)
    return found[column.offset :].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and the offsets (rows + 1) into them. Nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    at = text_offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def connected_components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node with an edge to another node, the smallest node it is connected to.

    Alternating large-star and small-star steps (Kiveris et al. 2014): a node's smallest neighbour is a pre-aggregated
    minimum, joined back by a join that splits hot nodes. Each round is written to the shared folder and replaces the one
    before; the rounds grow as the logarithm of the longest chain, and each but the last changes the edges, of which
    there are finitely many stars to reach, so they end. Only counts come to the driver. Edges with a null end and loops
    are left out.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now, before = scratch.keep(now), None
    while True:
        # large star: each neighbour larger than the node is linked to the smallest node of the neighbourhood
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m")).union(now.select(F.col("v").alias("n"), F.col("u").alias("m")))
        lows = both.groupBy("n").agg(F.min("m").alias("low"))
        star = both.where("m > n").join(lows, "n").select(F.col("m").alias("u"), F.least("n", "low").alias("v")).distinct()
        # small star: the smaller neighbours, and the node itself, are linked to the smallest of them
        lows = star.groupBy("u").agg(F.min("v").alias("low"))
        rest = star.join(lows, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = scratch.keep(rest.union(lows.select("u", F.col("low").alias("v"))).distinct(), now)
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
