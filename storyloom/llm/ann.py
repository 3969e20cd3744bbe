"""Approximate nearest neighbours over learned partitions.

A neighbour graph of a bounded sample is cut into equally large parts with few edges between
them; a small network learns which part a vector belongs to. Every vector is filed under its
most probable part, every query is routed to the several most probable parts, whose vectors
are ranked by their exact distance. How many parts a query visits is measured on vectors of
the sample that the network has not seen: the fewest that find ``TARGET`` of their nearest
others in the sample. Vectors without any structure thus visit most parts.

Large parts are split into blocks, and queries of a part as well, so that one task holds one
block of each. Of equal vectors a block ranks the ``k + 1`` smallest ids, which are all that a
result can name; so copies of one vector, however many, cost no more than a few rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import store

#: Upper bound of the vectors that the graph and the router are fitted on.
SAMPLE_ROWS = 4_000
#: Rows per part aimed at, and the most parts that such a sample can teach.
PART_ROWS = 4_000
MAX_PARTS = 64
#: Recall on held-out vectors of the sample that fixes the number of parts to visit.
TARGET = 0.96
HELD_OUT = 5
NEIGHBOURS = 10
BLOCK_ROWS = 20_000
BLOCK_QUERIES = 4_000
_UNITS = 1 << 30


def valid(rows: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the vectors that take part, each of the most frequent length."""
    e = F.col("embedding")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    v = rows.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & good)
    lengths = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    return v.filter(F.size("embedding") == (lengths[0].d if lengths else 0))


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The ``k`` nearest other rows of each row."""
    k = min(k, len(x) - 1)
    sq, out = (x * x).sum(1), np.zeros((len(x), k), np.int64)
    for s in range(0, len(x), 1000):
        d = sq[None, :] - 2 * x[s : s + 1000] @ x.T
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        out[s : s + 1000] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def _bisect(x: np.ndarray, edges: np.ndarray, share: float, rounds: int = 20) -> np.ndarray:
    """True for ``share`` of the rows: a cut along the widest direction, mended by balanced exchanges over the graph."""
    centred = x - x.mean(0)
    direction = np.linalg.svd(centred[: min(len(x), 2000)], full_matrices=False)[2][0]
    n = round(len(x) * share)
    side = np.zeros(len(x), bool)
    side[np.argsort(centred @ direction, kind="stable")[:n]] = True
    if not len(edges):
        return side
    a, b = edges[:, 0], edges[:, 1]
    for _ in range(rounds):
        apart = np.where(side[a] != side[b], 1.0, -1.0)
        gain = np.bincount(a, apart, len(x)) + np.bincount(b, apart, len(x))
        i, j = np.flatnonzero(side), np.flatnonzero(~side)
        i, j = i[np.argsort(-gain[i], kind="stable")], j[np.argsort(-gain[j], kind="stable")]
        m = min(len(i), len(j))
        good = int((gain[i[:m]] + gain[j[:m]] > 0).sum())
        if not good:
            break
        good = max(1, good // 2)  # half of them: neighbours that move together lose their gain
        side[i[:good]], side[j[:good]] = False, True
        after = (side[a] != side[b]).sum()
        if after >= (apart > 0).sum():
            side[i[:good]], side[j[:good]] = True, False
            break
    return side


def partition(x: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row: recursive balanced bisection of the neighbour graph."""
    out = np.zeros(len(x), np.int64)
    if parts < 2 or len(x) < 2:
        return out
    near = neighbour_graph(x)
    edges = np.column_stack([np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()])
    todo = [(np.arange(len(x)), parts, 0)]
    while todo:
        rows, n, first = todo.pop()
        if n < 2 or len(rows) < 2:
            out[rows] = first
            continue
        back = np.full(len(x), -1)
        back[rows] = np.arange(len(rows))
        own = back[edges]
        side = _bisect(x[rows], own[(own >= 0).all(1)], (n // 2) / n)
        todo += [(rows[side], n // 2, first), (rows[~side], n - n // 2, first + n // 2)]
    return out


class Router:
    """One hidden layer; softmax over the parts."""

    def __init__(self, arrays: list[np.ndarray]):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = arrays

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2


def train_router(x: np.ndarray, labels: np.ndarray, parts: int, hidden: int = 96, epochs: int = 40) -> list[np.ndarray]:
    rng = np.random.default_rng(7)
    mean, scale = x.mean(0), np.full(x.shape[1], max(float(x.std()), 1e-12))
    z = (x - mean) / scale
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(z))
        for s in range(0, len(z), 256):
            at = order[s : s + 256]
            h = np.maximum(z[at] @ p[0] + p[1], 0)
            o = h @ p[2] + p[3]
            o = np.exp(o - o.max(1, keepdims=True))
            o /= o.sum(1, keepdims=True)
            o[np.arange(len(at)), labels[at]] -= 1
            o /= len(at)
            back = (o @ p[2].T) * (h > 0)
            grads, t = [z[at].T @ back, back.sum(0), h.T @ o, o.sum(0)], t + 1
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for i, g in enumerate(grads):
                g = g + 1e-4 * p[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return [mean, scale, *p]


def fit_router(x: np.ndarray, parts: int, k: int) -> tuple[list[np.ndarray], int]:
    """The network's arrays and the number of parts to visit, from distinct vectors."""
    labels = partition(x, parts)
    seen = np.arange(len(x)) % HELD_OUT > 0
    if seen.all() or parts < 2:
        return train_router(x, labels, parts), parts
    arrays = train_router(x[seen], labels[seen], parts)
    odds = Router(arrays).log_odds(x)
    filed, order = odds.argmax(1), np.argsort(-odds[~seen], axis=1, kind="stable")
    near = filed[neighbour_graph(x, k)[~seen]]
    place = np.argsort(order, axis=1)  # of each part in a query's order
    needed = np.sort(np.take_along_axis(place, near, axis=1).ravel()) + 1
    return arrays, int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) if len(needed) else parts


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _rank(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """For each query its ``k`` nearest rows by (distance, id), itself left out, as arrays (query, id, distance)."""
    order = np.argsort(ids, kind="stable")
    rows, ids = np.ascontiguousarray(rows[order]), ids[order]
    # equal vectors once, with their k + 1 smallest ids
    whole = rows.view([("", rows.dtype)] * rows.shape[1]).ravel()
    _, first, group = np.unique(whole, return_index=True, return_inverse=True)
    by = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[by], np.arange(len(first)))
    sizes = np.minimum(np.diff(np.r_[starts, len(by)]), k + 1)
    distinct = rows[first]
    sq, out = (distinct**2).sum(1), []
    take = min(len(distinct), k + 1)
    for s in range(0, len(queries), 200):
        q = queries[s : s + 200]
        rough = sq[None, :] - 2 * q @ distinct.T + (q**2).sum(1)[:, None]
        edge = np.partition(rough, take - 1, axis=1)[:, take - 1]
        # rounding may exchange close ones: keep what is as near up to it
        slack = 1e-9 * (np.abs(edge) + sq.max() + (q**2).sum(1))
        for i in range(len(q)):
            near = np.flatnonzero(rough[i] <= edge[i] + slack[i])
            dist = np.sqrt(((distinct[near] - q[i]) ** 2).sum(1))
            n = sizes[near]
            at = np.repeat(starts[near] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            found, dist = ids[by[at]], np.repeat(dist, n)
            other = found != q_ids[s + i]
            found, dist = found[other], dist[other]
            best = np.lexsort((found, dist))[:k]
            out.append((np.full(len(best), q_ids[s + i]), found[best], dist[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search(rows: DataFrame, is_query, k: int = 10, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``is_query`` holds its ``k`` nearest others found.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller vec_id.
    Vectors that are null, zero, or of another length than most, or that hold null or
    non-finite components, and rows without a vec_id take no part. A query visits further
    parts until they hold ``k + 1`` vectors. Rows that repeat a vec_id are each candidates of
    other ids. Extra columns are not used; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    schema = "query_id long, vec_id long, score double"
    v = store(valid(rows).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "ann-vectors")
    n = v.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = max(1, min(4, n // 100), min(MAX_PARTS, n // PART_ROWS))
    chosen = v.filter(F.pmod(F.xxhash64("vec_id", F.lit("ann")), F.lit(_UNITS)) < int(min(1.0, sample_rows / n) * _UNITS))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x = np.array(g.sort_values("vec_id")["embedding"].tolist(), np.float64)
        x = np.unique(x, axis=0)  # copies teach nothing
        arrays, probes = fit_router(x, parts, k)
        fitted = [np.array([float(probes)]), *arrays]
        return pd.DataFrame({"i": range(len(fitted)), "shape": [list(a.shape) for a in fitted], "values": [a.ravel().tolist() for a in fitted]})

    model = chosen.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(fit, "i int, shape array<int>, values array<double>").orderBy("i").collect()
    fitted = [np.array(r["values"]).reshape(r["shape"]) for r in model]
    probes = int(fitted[0][0]) if fitted else parts
    held = spark.sparkContext.broadcast(fitted[1:] or None)

    def file(batches):
        for b in batches:
            x = _matrix(b.column("embedding"))
            part = Router(held.value).log_odds(x).argmax(1) if held.value and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], names=[*b.schema.names, "part"])

    kind = v.schema["embedding"].dataType.simpleString()
    filed = store(v.mapInArrow(file, f"vec_id long, embedding {kind}, part int"), "ann-filed")
    sizes = {r.part: r.n for r in filed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}

    def route(batches):
        size = np.array([sizes.get(p, 0) for p in range(parts)])
        for b in batches:
            x = _matrix(b.column("embedding"))
            odds = Router(held.value).log_odds(x) if held.value and len(x) else np.zeros((len(x), parts))
            odds = np.where(size > 0, odds, -np.inf)
            order = np.argsort(-odds, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            use = ((np.arange(parts) < probes) | (before < k + 1)) & (size[order] > 0)
            i, j = np.nonzero(use)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(i)), b.column("embedding").take(pa.array(i)), pa.array(order[i, j].astype(np.int32))], names=["query_id", "query", "part"])

    routed = filed.filter(is_query).select("vec_id", "embedding").mapInArrow(route, f"query_id long, query {kind}, part int")
    routed = store(routed, "ann-routed")
    asked = {r.part: r.n for r in routed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    # one row for each part at most
    plan = spark.createDataFrame(
        [(p, -(-s // BLOCK_ROWS), -(-asked.get(p, 0) // BLOCK_QUERIES)) for p, s in sizes.items() if asked.get(p)] or [(-1, 1, 1)], "part int, cuts int, q_cuts int"
    )
    salt = lambda c, n: F.pmod(F.xxhash64(c, F.lit("block")), F.col(n)).cast("int")
    left = filed.join(F.broadcast(plan), "part").withColumn("cut", salt("vec_id", "cuts"))
    left = left.withColumn("q_cut", F.explode(F.sequence(F.lit(0), F.col("q_cuts") - 1))).select("part", "cut", "q_cut", "vec_id", "embedding")
    right = routed.join(F.broadcast(plan), "part").withColumn("q_cut", salt("query_id", "q_cuts"))
    right = right.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("part", "cut", "q_cut", "query_id", "query")

    def rank(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            ids, q_ids = (t.column(c).to_numpy() for t, c in ((a, "vec_id"), (b, "query_id")))
            found = _rank(_matrix(b.column("query")), q_ids, _matrix(a.column("embedding")), ids, k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    key = ["part", "cut", "q_cut"]
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rank, schema)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
