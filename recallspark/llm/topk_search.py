"""Exact top-k by integer inner product, with a pivot-distance index.

Inner products become distances: with a further coordinate sqrt(M - |x|^2), M the largest squared norm, all vectors lie on one
sphere, a query has 0 there, and a larger product is a smaller distance. The index keys each vector by its nearest pivot
and its distance from that; sorted by this key the vectors are cut into blocks, each an annulus of one pivot (iDistance,
Jagadish et al. 2005). A query first scores the nearest annuli that hold enough vectors. The least score it then has
bounds its search: by the triangle inequality an annulus holds no score above a bound computed from the query's distance from
the pivot and the two radii, so only annuli whose bound reaches the least score are visited. Queries travel in chunks
to blocks by an equi-join on the block; a visit is one matrix product.

The list of annuli is bounded (ANNULI, beyond which they grow), so the driver and the tasks may hold it; an annulus is
stored in rows of BLOCK vectors each, whatever its size, and these are visited by tasks of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.llm.common import Scratch, releasing
from recallspark.llm.vectors import dimensions, matrix, sample, usable

TOP, EVERY, SCALE = 5, 50, 256
PIVOTS, BLOCK, ANNULI, CHUNK = 32, 2048, 32768, 512
#: Bounds of queries by annuli that a worker computes at once.
CELLS = 1 << 21

_BLOCK = "block long, pivot int, low double, high double, n int, ids binary, vectors binary"
_VISIT = "block long, query_ids binary, query_vectors binary"


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Points that are far from one another: each is the farthest from those before."""
    taken = [0]
    away = ((points - points[0]) ** 2).sum(axis=1)
    while len(taken) < min(n, len(points)):
        k = int(away.argmax())
        if away[k] <= 0:
            break
        taken.append(k)
        away = np.minimum(away, ((points - points[k]) ** 2).sum(axis=1))
    return points[taken]


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """x with the coordinate that brings it to the sphere."""
    return np.concatenate([x, np.sqrt(np.maximum(0, most - (x**2).sum(axis=1)))[:, None]], axis=1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * x @ pivots.T))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers: in double precision where no sum can leave it, else with Python's integers, kept within a long."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0**53:
        exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
        return np.clip(exact, -(1 << 63), (1 << 63) - 1)
    return (a @ b.T).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of scores the k highest (ids, scores) of others than the row's own id, ties to the smaller id."""
    out = []
    for row, me in zip(scores, own.tolist(), strict=True):
        at = np.flatnonzero(ids != me)
        if len(at) > k:
            part = np.array(row[at])
            at = at[part >= np.partition(part, len(part) - k)[len(part) - k]]
        order = np.lexsort((ids[at], -row[at].astype(object) if row.dtype == object else ~row[at]))[:k]
        out.append((ids[at[order]], row[at[order]]))
    return out


def search(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, every: int = EVERY, scale: float = SCALE,
    pivots: int = PIVOTS, block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products of each row whose id is divisible by every with all other rows.

    Components become floor(scale * x). Rows with a null id, and vectors that are null, empty or hold null or non-finite
    components (also after scaling), take no part; vectors of different lengths do not meet. A row that is repeated is a
    candidate each time and a query once; rows with the query's own id are no candidates; equal scores are in order of
    the smaller id. Other columns are not read.
    """
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * F.lit(float(scale)))  # floor comes with the matrices
    every_row = rows.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    fine = every_row.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    scratch, found = Scratch(rows.sparkSession, "topk"), None
    for n in dimensions(fine, "v"):
        one = _search(scratch, fine.where(F.size("v") == n), k, every, pivots, block, chunk)
        found = one if found is None else found.union(one)
    if found is None:
        found = fine.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(scratch: Scratch, fine: DataFrame, k: int, every: int, n_pivots: int, block: int, chunk: int) -> DataFrame:
    most = float(fine.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) + 1, F.lit(2.0))))).first()[0])
    huge = not most < 1e280  # no squares in double precision: one pivot, and every annulus is visited
    points = np.zeros((1, 1)) if huge else choose_pivots(lifted(np.floor(sample(fine, "vec_id", "v")), most), n_pivots)

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.floor(matrix(batch.column("v")))
                away = np.zeros((len(x), 1)) if huge else distances(lifted(x, most), points)
                pivot = away.argmin(axis=1).astype(np.int32)
                v = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(away[np.arange(len(x)), pivot]), batch.column("vec_id"), v], ["pivot", "r", "vec_id", "v"])

    def cut(batches):
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, 0
        last = None

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            r = part.column("r").to_numpy()
            row = ((task << 32) + made, part.column("pivot")[0].as_py(), float(r.min()), float(r.max()), part.num_rows, part.column("vec_id").to_numpy().tobytes(), b"".join(part.column("v").to_pylist()))
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], ["block", "pivot", "low", "high", "n", "ids", "vectors"])

        for batch in batches:
            pivot = batch.column("pivot").to_numpy()
            a = 0
            while a < len(pivot):
                if pivot[a] != last or held >= size:  # a new annulus
                    made, held, last = made + 1, 0, pivot[a]
                same = np.flatnonzero(pivot[a:] != last)
                b = min(a + (int(same[0]) if len(same) else len(pivot) - a), a + block, a + size - held)
                yield one(batch.slice(a, b - a))
                held, a = held + b - a, b

    size = max(block, math.ceil(fine.count() / ANNULI))
    spread = fine.mapInArrow(releasing(keyed), "pivot int, r double, vec_id long, v binary")
    index = scratch.keep(spread.repartitionByRange("pivot", "r", "vec_id").sortWithinPartitions("pivot", "r", "vec_id").mapInArrow(releasing(cut), _BLOCK))
    annuli = index.groupBy("block").agg(F.first("pivot").alias("pivot"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("block").toPandas()
    chunk = max(1, min(chunk, CELLS // max(1, len(annuli))))
    name, of, low, high, held_n = (annuli[c].to_numpy() for c in ("block", "pivot", "low", "high", "n"))
    queries = fine.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))

    def bound(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest score that each annulus can hold, a little above for rounding, and the distance of its pivot."""
        if huge:
            return np.full((len(x), len(of)), np.inf), np.zeros((len(x), len(of)))
        square = (x**2).sum(axis=1)[:, None] + most
        away = np.sqrt(np.maximum(0, square - 2 * x @ points[:, :-1].T))[:, of]
        least = np.maximum(0, np.maximum(away - high, low - away))
        return (square - least**2) / 2 + 1e-9 * square + 1e-3, away

    def visits(ids: np.ndarray, x: np.ndarray, go: np.ndarray):
        rows = [(name[b], ids[at].tobytes(), x[at].tobytes()) for b in np.flatnonzero(go.any(axis=0)) for at in [np.flatnonzero(go[:, b])]]
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["block", "query_ids", "query_vectors"])

    def nearest(reach: np.ndarray, away: np.ndarray) -> np.ndarray:
        """The annuli of highest bound, nearest pivot first, that hold more than k vectors."""
        order = np.lexsort((away, -reach), axis=1)
        before = np.cumsum(held_n[order], axis=1) - held_n[order]
        go = np.zeros(reach.shape, bool)
        np.put_along_axis(go, order, before <= k, axis=1)
        return go

    def chunks(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                part = batch.slice(a, chunk)
                yield part, part.column("vec_id").to_numpy(), np.floor(matrix(part.column("v")))

    def first(batches):
        for _, ids, x in chunks(batches):
            yield visits(ids, x, nearest(*bound(x)))

    def later(batches):
        for part, ids, x in chunks(batches):
            reach, away = bound(x)
            least = part.column("least").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.float64)
            yield visits(ids, x, (reach >= least[:, None]) & ~nearest(reach, away))

    def visit(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, q = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
                scores = products(np.frombuffer(row["query_vectors"]).reshape(len(q), -1), np.frombuffer(row["vectors"]).reshape(len(ids), -1))
                each = best(scores, ids, q, k)
                n = [len(i) for i, _ in each]
                columns = [np.repeat(q, n), np.concatenate([i for i, _ in each]), np.concatenate([s for _, s in each]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    def scored(visited: DataFrame) -> DataFrame:
        pairs = index.select("block", "ids", "vectors").join(visited.hint("merge"), "block").drop("block")
        return pairs.mapInArrow(releasing(visit), "query_id long, vec_id long, score long")

    near = scratch.keep(scored(queries.mapInArrow(releasing(first), _VISIT)))
    least = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.element_at(F.sort_array(F.collect_list("score"), asc=False), k)).alias("least"))
    rest = queries.join(least, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "least")
    return near.union(scored(rest.mapInArrow(releasing(later), _VISIT)))
