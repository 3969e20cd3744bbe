"""Centroid clustering on integer vectors; the nearest centroid is found by the threshold algorithm.

For each dimension the centroids stand in a list sorted by their component. A vector walks all
lists outward from its own value at once. A centroid met for the first time is measured in full;
the frontiers, the next unmet gap in each list, add up to a bound below which no unmet centroid
can lie. The walk stops when this bound strictly exceeds the best exact distance, so centroids
that tie with the best are all met and the smallest number wins.

All arithmetic is on integers, so results do not depend on how rows are dealt out. Tasks return one
partial sum per centroid; what goes to the driver are ``k`` centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import store

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
#: Components from here on take their row out: squared distances would leave 64 bits.
LARGEST = 1 << 27
#: Vectors walked at once.
BLOCK = 512


def integer_vectors(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: rows with exactly ``dimensions`` finite components x, as floor(scale * x)."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / scale))
    kept = rows.select("vec_id", "embedding").filter((F.size("embedding") == dimensions) & good)
    return kept.select("vec_id", F.transform(e, lambda x: F.floor(x * scale).cast("int")).alias("v"))


def sorted_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each dimension the centroids' numbers in the order of their component, and these components."""
    order = np.argsort(centroids, axis=0, kind="stable")
    return order, np.take_along_axis(centroids, order, axis=0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each row, its squared distance, and how many centroids were measured."""
    n, (k, dims) = len(x), centroids.shape
    order, values = sorted_lists(centroids)
    best = np.full(n, np.iinfo(np.int64).max)
    number, measured = np.full(n, k), np.zeros(n, np.int64)
    met = np.zeros((n, k), bool)
    every = np.arange(dims)
    # list positions: left of and right of the frontier
    right = np.stack([np.searchsorted(values[:, d], x[:, d]) for d in range(dims)], axis=1) if n else np.zeros((0, dims), np.int64)
    left = right - 1
    active = np.arange(n)
    far = np.int64(1) << 60

    def gaps(rows):
        lo, hi = left[rows], right[rows]
        down = np.where(lo >= 0, x[rows] - values[np.maximum(lo, 0), every], far)
        up = np.where(hi < k, values[np.minimum(hi, k - 1), every] - x[rows], far)
        return down, up

    while len(active):
        down, up = gaps(active)
        go_left = down <= up
        at = np.where(go_left, left[active], right[active])
        open_ = np.minimum(down, up) < far
        found = order[np.clip(at, 0, k - 1), every]
        left[active] -= go_left & open_
        right[active] += ~go_left & open_
        fresh = np.zeros((len(active), k), bool)
        i, d = np.nonzero(open_)
        fresh[i, found[i, d]] = True
        fresh &= ~met[active]
        met[active] |= fresh
        i, c = np.nonzero(fresh)
        rows = active[i]
        exact = ((x[rows] - centroids[c]) ** 2).sum(1)
        measured += np.bincount(rows, minlength=n)
        # of equal distances the smaller number
        by = np.lexsort((c, exact, rows))
        first = by[np.r_[True, rows[by][1:] != rows[by][:-1]]] if len(by) else by
        r = rows[first]
        better = (exact[first] < best[r]) | ((exact[first] == best[r]) & (c[first] < number[r]))
        best[r[better]], number[r[better]] = exact[first][better], c[first][better]
        # the frontier: the next gap in every list; a list walked to its end has shown all centroids
        down, up = gaps(active)
        gap = np.minimum(down, up)
        ended = (gap >= far).any(1)
        bound = (np.where(gap < far, gap, 0) ** 2).sum(1)
        active = active[~ended & (bound <= best[active])]
    return number, best, measured


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _assign(batches: Iterable[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for s in range(0, b.num_rows, BLOCK):
            part = b.slice(s, BLOCK)
            x = _matrix(part.column(part.schema.get_field_index("v")))
            number, distance, _ = nearest(x, centroids)
            yield part, x, number, distance


def _sums(centroids: np.ndarray):
    """A map that returns each task's count and componentwise sum per centroid."""

    def run(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x, number, _ in _assign(batches, centroids):
            np.add.at(count, number, 1)
            np.add.at(total, number, x)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(count[some], pa.int64()), "total": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

    return run


def _members(centroids: np.ndarray):
    def run(batches):
        for part, _, number, distance in _assign(batches, centroids):
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("vec_id")), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def starts(vectors: DataFrame, k: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``2:<vec_id>``, ties to the smaller vector."""
    name = F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [list(r.v) for r in vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def cluster(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for each vector that takes part.

    Vectors that are null, of another length than ``dimensions``, or that hold null or non-finite
    components, or components of ``LARGEST / scale`` or more, take no part. Centroids start as
    the ``k`` vectors whose ids hash lowest (all, if there are fewer; a missing id hashes as empty). Each round replaces
    every centroid that has vectors by the exact floor of their mean; others stay. Rows that
    repeat a vec_id are vectors of their own; ties go to the smaller centroid. Extra columns are not used;
    without vectors the result is empty.
    """
    spark = rows.sparkSession
    kind = rows.schema["vec_id"].dataType.simpleString()
    v = store(integer_vectors(rows, dimensions, scale), "centroid-vectors")
    centres = np.array(starts(v, k), np.int64).reshape(-1, dimensions)
    if not len(centres):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        partial = v.select("v").mapInArrow(_sums(centres), "cluster int, n long, total array<long>")
        sums = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(dimensions)]).alias("total"))
        for r in sums.collect():  # k rows at most
            centres[r.cluster] = [t // r.n for t in r.total]
    members = store(v.mapInArrow(_members(centres), f"vec_id {kind}, cluster int, distance long"), "centroid-members")
    found = {r.cluster: r.total for r in members.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    facts = [(c, total, sum(found.values()), names[c]) for c, total in found.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
