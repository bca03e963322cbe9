"""Near-duplicate vectors by an epsilon grid order join.

On unit vectors a cosine of at least c is a distance of at most eps = sqrt(2 - 2c). Vectors are placed on leading
principal directions of a bounded sample, with the length of what these leave as a further coordinate; both never lengthen
a distance, so two vectors whose places are more than eps apart cannot be linked. Grid cells of width eps on these
directions, compared one after the other, order the vectors (epsilon grid order, Böhm et al. 2001). The order is cut into
intervals at quantiles of the sample, and an interval that holds too many vectors into blocks by a hash of the id. Each
pair of blocks whose intervals' bounds allow a link is one task, which halves the two recursively, skips pairs of
intervals whose bounds are more than eps apart, and compares what is left as a matrix product, verified in double
precision near the threshold. A task returns counts of links by vector and a forest that connects what its links connect,
never the links themselves, so a group of mutual links costs rows in proportion to its vectors.

Blocks have a fixed size in bytes for any input; the number of intervals is bounded, so the driver may hold their bounds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from recallspark.llm.common import Scratch, connected_components, release_memory, releasing
from recallspark.llm.vectors import dimensions, matrix, sample, usable

COSINE = 0.9
#: Leading directions of the grid; bytes of a block's vectors in double precision; intervals at most.
DIRECTIONS, BLOCK_BYTES, INTERVALS = 6, 8 << 20, 1024
LEAF = 512
#: How far single precision can be off for unit vectors; pairs so near to the threshold are computed in double precision.
MARGIN = 1e-5


def grid_order(places: np.ndarray, eps: float) -> np.ndarray:
    """The order of places by their grid cells, dimension by dimension, and within a cell by the places themselves."""
    return np.lexsort(np.concatenate([places[:, ::-1].T, np.floor(places / eps).T[::-1]]))


def apart(a: np.ndarray, b: np.ndarray) -> float:
    """The least distance of points in the bounds of two intervals of places."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float(np.sqrt((gap**2).sum()))


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.top(x), self.top(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def interval_join(units: np.ndarray, spots: np.ndarray, weights: np.ndarray, split: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows before and from split on, or among all rows if split is 0, all in grid order: counts by row weighted with the other's weight, and the forest's root of each row."""
    eps = math.sqrt(max(0.0, 2 - 2 * least)) * (1 + 1e-9) + 1e-9
    small = units.astype(np.float32)
    count, forest = np.zeros(len(units), np.int64), _Forest(len(units))

    def leaf(a: slice, b: slice, same: bool) -> None:
        near = small[a] @ small[b].T
        i, j = np.nonzero(near >= np.float32(least - MARGIN))
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return
        i, j = i + a.start, j + b.start
        ok = np.einsum("ij,ij->i", units[i], units[j]) >= least
        i, j = i[ok], j[ok]
        np.add.at(count, i, weights[j])
        np.add.at(count, j, weights[i])
        if len(i):  # of a vector's links in this leaf one by one only until all are connected
            root = np.array([forest.top(x) for x in range(a.start, a.stop)])[i - a.start]
            other = np.array([forest.top(x) for x in range(b.start, b.stop)])[j - b.start]
            pairs = np.unique(np.stack([root, other])[:, root != other], axis=1)
            forest.link(pairs[0], pairs[1])

    def join(a: slice, b: slice, same: bool) -> None:
        na, nb = a.stop - a.start, b.stop - b.start
        if not na or not nb or not same and apart(spots[a], spots[b]) > eps:
            return
        if na <= LEAF and nb <= LEAF:
            leaf(a, b, same)
        elif same:
            mid = a.start + na // 2
            low, high = slice(a.start, mid), slice(mid, a.stop)
            join(low, low, True)
            join(high, high, True)
            join(low, high, False)
        elif na >= nb:
            mid = a.start + na // 2
            join(slice(a.start, mid), b, False)
            join(slice(mid, a.stop), b, False)
        else:
            mid = b.start + nb // 2
            join(a, slice(b.start, mid), False)
            join(a, slice(mid, b.stop), False)

    n = len(units)
    join(slice(0, split or n), slice(split, n), not split)
    return count, np.array([forest.top(x) for x in range(n)], np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1, also of components whose squares leave double precision."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def places(units: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Coordinates on the directions, and the length of the rest."""
    at = units @ directions.T
    return np.concatenate([at, np.linalg.norm(units - at @ directions, axis=1)[:, None]], axis=1)


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: other vectors with a cosine of at least `least`, and the smallest id reachable by links.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors of different lengths, are not
    linked; each length that occurs is joined by itself. Equal vectors are compared once and counted as often as they occur; two rows with one id
    (repeated or not) are two vectors of one node. A null id is kept and has no component. Other columns are not read.
    least is above 0.
    """
    scratch = Scratch(rows.sparkSession, "near-vectors")
    single = isinstance(rows.schema[vector_col].dataType.elementType, FloatType)  # these stay as they are: half the bytes
    kind = "float" if single else "double"
    every = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    zero = F.forall("v", lambda x: x == 0)
    fine = every.where(usable(F.col("v")) & ~zero & F.col("vec_id").isNotNull())
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))  # -0.0 is 0.0
    alike = scratch.keep(fine.groupBy(plain.alias("v")).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times")))
    found = None
    for n in dimensions(alike, "v"):
        one = _links(scratch, alike.where(F.size("v") == n), n, least, np.float32 if single else np.float64)
        found = one if found is None else found.union(one)
    if found is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = scratch.keep(found)
    nodes = fine.select("vec_id", plain.alias("v")).hint("merge").join(alike.select("v", F.col("vec_id").alias("rep"), "times"), "v").select("vec_id", "rep", "times")
    nodes = scratch.keep(nodes, alike)
    edges = found.where("a <> b").select("a", "b").union(nodes.where("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b")))
    group = connected_components(scratch, edges)
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    n_links = F.coalesce("n", F.lit(0).cast("long")) + F.col("times") - 1
    counted = nodes.join(links, "rep", "left").groupBy("vec_id").agg(F.max(n_links).alias("n_links"))
    named = counted.join(group.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    out = every.select("vec_id").join(named, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(scratch: Scratch, alike: DataFrame, n: int, least: float, kind: type) -> DataFrame:
    """(a, n, b) from each task that links a: the number of a's links there, and the root b of its tree."""
    eps = math.sqrt(max(0.0, 2 - 2 * least))
    units = unit(sample(alike, "vec_id", "v"))
    _, _, directions = np.linalg.svd(units - units.mean(axis=0), full_matrices=False)
    directions = np.ascontiguousarray(directions[: min(DIRECTIONS, n)])
    size = max(1, BLOCK_BYTES // (8 * n))
    total = alike.count()
    intervals = max(1, min(INTERVALS, math.ceil(total / size), len(units)))
    at = places(units, directions)
    order = grid_order(at, eps)
    # a vector's interval: how many bounds (cell by cell, then place by place) are not above it
    rank = lambda at: np.concatenate([np.floor(at / eps), at], axis=1)
    bounds = rank(at)[[order[len(order) * k // intervals] for k in range(1, intervals)]] if intervals > 1 else np.zeros((0, 2 * at.shape[1]))

    def placed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"))
            at = places(unit(v), directions)
            mine = rank(at)
            block = np.zeros(len(v), np.int32)
            for a in range(0, len(v), 1024):
                own = mine[a : a + 1024]
                tied, done = np.ones((len(own), len(bounds)), bool), np.zeros((len(own), len(bounds)), bool)
                for c in range(own.shape[1] if len(bounds) else 0):
                    done |= tied & (own[:, c : c + 1] > bounds[:, c])
                    tied &= own[:, c : c + 1] == bounds[:, c]
                block[a : a + 1024] = (done | tied).sum(axis=1)
            data = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("times"), pa.array(block), data, pa.array(at.tolist(), pa.list_(pa.float64()))], ["vec_id", "times", "block", "v", "at"])

    put = scratch.keep(alike.select("vec_id", "times", "v").mapInArrow(releasing(placed), "vec_id long, times long, block int, v binary, at array<double>"))
    limits = [f(F.col("at")[k]).alias(f"{w}{k}") for w, f in (("low", F.min), ("high", F.max)) for k in range(at.shape[1])]
    box = {r["block"]: r for r in put.groupBy("block").agg(F.count("*").alias("n"), *limits).collect()}  # INTERVALS rows at most
    low, high = (np.array([[box[b][f"{w}{k}"] if b in box else np.inf for k in range(at.shape[1])] for b in range(intervals)]) for w in ("low", "high"))
    subs = np.array([-(-box[b]["n"] // size) if b in box else 0 for b in range(intervals)], np.int64)
    base = np.cumsum(subs) - subs
    meets = np.zeros((intervals, intervals), bool)
    for i in sorted(box):
        gap = np.nan_to_num(np.maximum(0, np.maximum(low - high[i], low[i] - high)), nan=np.inf, posinf=np.inf)
        meets[i] = np.sqrt((gap**2).sum(axis=1)) <= eps * (1 + 1e-9) + 1e-9
    meets &= (subs > 0)[None, :]

    def spread(batches):
        """Each block's vectors of a batch, once for each block that they may have links with."""
        for batch in batches:
            ids, of = batch.column("vec_id").to_numpy(), batch.column("block").to_numpy().astype(np.int64)
            spot = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % np.maximum(subs[of], 1)
            mine = base[of] + spot
            times, v = batch.column("times").to_numpy(), batch.column("v").to_pylist()
            for own in np.unique(mine).tolist():
                at = np.flatnonzero(mine == own)
                i = int(of[at[0]])
                data = [ids[at].tobytes(), times[at].tobytes(), b"".join([v[k] for k in at.tolist()])]
                others = np.concatenate([np.zeros(0, np.int64), *(base[j] + np.arange(subs[j]) for j in np.flatnonzero(meets[i]))])
                for k in range(0, len(others), 16):
                    part = others[k : k + 16]
                    columns = [np.minimum(part, own), np.maximum(part, own), part >= own]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.array([x] * len(part), pa.binary()) for x in data)], ["x", "y", "first", "ids", "times", "vs"])

    def compared(table: pa.Table) -> pa.Table:
        join = lambda c, t: np.frombuffer(b"".join(t.column(c).to_pylist()), np.int64)
        first = table.filter(table.column("first"))
        second = table.filter(pc.invert(table.column("first")))
        v = [np.frombuffer(b"".join(t.column("vs").to_pylist()), kind).reshape(-1, n).astype(np.float64) for t in (first, second)]
        v = [unit(x) if len(x) else x for x in v]
        at = [places(x, directions) for x in v]
        orders = [grid_order(x, eps) for x in at]
        ids, times = (np.concatenate([join(c, t)[o] for t, o in zip((first, second), orders, strict=True)]) for c in ("ids", "times"))
        whole, spots = (np.concatenate([x[o] for x, o in zip(each, orders, strict=True)]) for each in (v, at))
        split = len(v[0]) if len(v[1]) else 0
        same = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        if not same and not (len(v[0]) and len(v[1])):  # the other block has no vectors
            return pa.table({"a": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        count, root = interval_join(whole, spots, times, split, least)
        on = count > 0
        out = pa.table({"a": ids[on], "n": count[on], "b": ids[root][on]})
        del table, first, second, v, whole
        release_memory()
        return out

    sent = put.select("vec_id", "times", "block", "v").mapInArrow(releasing(spread), "x long, y long, first boolean, ids binary, times binary, vs binary")
    return sent.groupBy("x", "y").applyInArrow(compared, "a long, n long, b long")
