"""Nearest-neighbour joins: queries are a table of any size, routed to blocks of the base.

Every vector is filed under a cell and, for the exact join, under a ring of like distance to the
cell's pivot; a block is one ring of one cell. The exact join visits, for each query, the blocks of
the lowest bounds first, until they hold a few times k rows. The k-th distance found there is the
query's radius. By the triangle inequality a vector o under pivot p is at least ``|d(q, p) - d(o, p)|``
from q, so what is beyond the radius is left out. On vectors without any structure nearly all are within it.

Neighbouring blocks share a tile of about BLOCK_ROWS rows. A query is copied once to each tile that holds
a block within its radius, not once to each block, large tiles are cut by a hash of the id, and one task
holds one cut of a tile and some of its queries. There products of matrices tell which few rows can be
among the k best, and only of these the distances are taken. Each task returns its k best per query; the
best of these are the answer.

What goes to the driver: at most PIVOTS pivots, and one line per block, of which there are at
most RINGS for each pivot and vector length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from storyloom.session import durable

PIVOTS = 128
RINGS = 16
#: Rows of the base that one pivot stands for, while there are fewer than PIVOTS.
PIVOT_ROWS = 256
#: Rows of a tile and queries that one task takes.
BLOCK_ROWS = 20_000
BLOCK_QUERIES = 20_000
#: Queries and rows that are compared at once, and pairs whose distance is taken at once.
CHUNK, PIECE, PAIRS = 128, 2_048, 50_000
#: Copies of queries in one Arrow batch.
BATCH = 20_000
#: The first visit ends when its blocks hold so many times k rows.
FIRST = 4
BLOCK = ["dims", "cell", "ring"]
HITS = "query_id long, id long, distance double, dims int, cell int, ring int, cut int, pairs long"


def comparable(rows: DataFrame) -> DataFrame:
    """Rows whose vector has no null and no non-finite component; a null vector takes no part."""
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(good & (F.size("vector") > 0))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the batch's vectors, for each length."""
    column = batch.column(batch.schema.get_field_index("vector"))
    ends = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(ends)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, flat[ends[at][:, None] + np.arange(n)]


def _gaps(x: np.ndarray, pivots: dict[int, np.ndarray]) -> np.ndarray:
    """Distance of each row to each pivot of its length; without a pivot, to the origin."""
    p = pivots.get(x.shape[1])
    p = np.zeros((1, x.shape[1])) if p is None else p
    out = np.empty((len(x), len(p)))
    for i, v in enumerate(p):
        out[:, i] = np.sqrt(((x - v) ** 2).sum(1))
    return out


def choose_pivots(base: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """At most ``pivots`` vectors by the hash of their id, by length."""
    n = base.count()
    rows = base.orderBy(F.xxhash64("id"), "id").limit(max(1, min(pivots, n // PIVOT_ROWS))).collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(len(r.vector), []).append(list(r.vector))
    return {d: np.unique(np.array(v, np.float64), axis=0) for d, v in out.items()}


def filed(base: DataFrame, pivots: dict[int, np.ndarray], rings: int = RINGS) -> DataFrame:
    """``id, vector, dims, cell, ring, gap``: nearest pivot, distance to it and its ring in the cell."""
    kind = base.schema["vector"].dataType.simpleString()

    def run(batches):
        for b in batches:
            cell, gap, dims = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
            for at, x in _matrices(b):
                g = _gaps(x, pivots)
                cell[at], gap[at], dims[at] = g.argmin(1), g.min(1), x.shape[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims), pa.array(cell), pa.array(gap)], names=["id", "vector", "dims", "cell", "gap"])

    rows = durable(base.select("id", "vector").mapInArrow(run, f"id long, vector {kind}, dims int, cell int, gap double"))
    shares = F.array(*[F.lit(i / rings) for i in range(1, rings)])
    edges = rows.groupBy("dims", "cell").agg(F.percentile_approx("gap", shares).alias("_edges"))
    ring = F.size(F.filter("_edges", lambda e: e < F.col("gap"))).cast("int")
    return rows.join(edges, ["dims", "cell"]).select("id", "vector", "dims", "cell", ring.alias("ring"), "gap")


class Blocks:
    """What is known of each block: rows, and the least and greatest distance to its pivot."""

    def __init__(self, rows: list):
        self.by_dims: dict[int, tuple] = {}
        for d in sorted({r.dims for r in rows}):
            own = [r for r in rows if r.dims == d]
            self.by_dims[d] = tuple(np.array([r[c] for r in own]) for c in ("cell", "ring", "n", "low", "high"))

    def order(self, gaps: np.ndarray, dims: int, k: int):
        """For each query its blocks by lower bound: ``(cell, ring, first)``; ``first`` marks the first visit."""
        cell, ring, n, low, high = self.by_dims[dims]
        own = gaps[:, cell]
        bound = np.maximum(np.maximum(own - high, low - own), 0)
        at = np.lexsort((own, bound), axis=1)
        held = np.cumsum(n[at], axis=1) - n[at]
        return cell[at], ring[at], held < FIRST * k

    def tiles(self) -> list[tuple[int, int, int, int, int]]:
        """``dims, cell, ring, tile, n``: neighbouring blocks share a tile of at most BLOCK_ROWS rows, larger ones have their own."""
        out, tile = [], -1
        for d, (cell, ring, n, _, _) in self.by_dims.items():
            held = BLOCK_ROWS + 1
            for i in np.lexsort((ring, cell)):
                if held + n[i] > BLOCK_ROWS:
                    tile, held = tile + 1, 0
                held += int(n[i])
                out.append((d, int(cell[i]), int(ring[i]), tile, int(n[i])))
        return out

    def bounds(self, gaps: np.ndarray, dims: int) -> np.ndarray:
        """For each query and block the least distance that the pivots allow, blocks by cell and ring."""
        cell, ring, _, low, high = self.by_dims[dims]
        at = np.lexsort((ring, cell))
        own = gaps[:, cell[at]]
        return np.maximum(np.maximum(own - high[at], low[at] - own), 0)


def _copied(ids: pa.Array, vectors: pa.Array, radius: np.ndarray, i: np.ndarray, dims: int, cell: np.ndarray, ring: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Copies of the queries at ``i`` for the blocks or tiles ``cell, ring``, in batches of bounded size."""
    for lo in range(0, len(i), BATCH):
        c = slice(lo, lo + BATCH)
        rows = pa.array(i[c])
        yield pa.RecordBatch.from_arrays(
            [ids.take(rows), vectors.take(rows), pa.array(np.full(len(rows), dims, np.int32)), pa.array(cell[c].astype(np.int32)), pa.array(ring[c].astype(np.int32)), pa.array(radius[i[c]])],
            names=["query_id", "vector", "dims", "cell", "ring", "radius"],
        )


def _routed(queries: DataFrame, pivots: dict[int, np.ndarray], blocks: Blocks, k: int, first: bool) -> DataFrame:
    """A row for each query and block of its first visit, or for each query and tile (as ``cell``) within its ``radius``."""
    kind = queries.schema["vector"].dataType.simpleString()
    tile_of = {d: np.array([t for e, _, _, t, _ in blocks.tiles() if e == d]) for d in blocks.by_dims}

    def run(batches):
        for b in batches:
            ids, vectors = (b.column(b.schema.get_field_index(c)) for c in ("query_id", "vector"))
            radius = np.full(b.num_rows, np.inf) if first else b.column(b.schema.get_field_index("radius")).to_numpy(zero_copy_only=False)
            for at, x in _matrices(b):
                dims = x.shape[1]
                if dims not in blocks.by_dims:
                    continue
                gaps = _gaps(x, pivots)
                if first:
                    cell, ring, head = blocks.order(gaps, dims, k)
                    i, j = np.nonzero(head)
                    yield from _copied(ids, vectors, radius, at[i], dims, cell[i, j], ring[i, j])
                else:
                    tiles, starts = np.unique(tile_of[dims], return_index=True)
                    bound = np.minimum.reduceat(blocks.bounds(gaps, dims), starts, axis=1)
                    i, j = np.nonzero(bound <= radius[at][:, None] * (1 + 1e-9) + 1e-12)
                    yield from _copied(ids, vectors, radius, at[i], dims, tiles[j], np.zeros(len(j)))

    return queries.mapInArrow(run, f"query_id long, vector {kind}, dims int, cell int, ring int, radius double")


def _closest(i: np.ndarray, d: np.ndarray, queries: int, k: int) -> np.ndarray:
    """The k-th smallest ``d`` of each query number in ``i``, infinite where there are fewer."""
    order = np.lexsort((d, i))
    starts = np.searchsorted(i[order], np.arange(queries))
    ends = np.append(starts[1:], len(i))
    out = np.full(queries, np.inf)
    full = ends - starts >= k
    out[full] = d[order][starts[full] + k - 1]
    return out


def _compared(x: np.ndarray, parts: list, gap: np.ndarray, v: np.ndarray, gaps: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row) that can be among a query's k nearest, and with how many rows each was compared.

    A product of matrices gives squares of distances up to ``error``; what is beyond the k-th by more is left out.
    """
    norms, own = (np.einsum("ij,ij->i", m, m) for m in (x, v))
    error = (x.shape[1] + 8) * 1e-15 * (norms.max() + own)
    limit, compared = reach**2 + error, np.zeros(len(v), np.int64)
    i, j, d, next_cut = np.zeros(0, int), np.zeros(0, int), np.zeros(0), 8 * k * len(v)
    for s, (begin, end) in enumerate(parts):
        lo = begin + np.searchsorted(gap[begin:end], gaps[:, s] - reach)
        hi = begin + np.searchsorted(gap[begin:end], gaps[:, s] + reach, side="right")
        met = np.flatnonzero(hi > lo)
        for a in range(lo[met].min(), hi[met].max(), PIECE) if len(met) else ():
            use = met[(lo[met] < a + PIECE) & (hi[met] > a)]
            b = min(a + PIECE, hi[met].max())
            square = norms[a:b] + own[use][:, None] - 2 * (v[use] @ x[a:b].T)
            if b - a > k and not np.isfinite(limit[use]).all():
                limit[use] = np.minimum(limit[use], np.partition(square, k - 1, axis=1)[:, k - 1] + 2 * error[use])
            n, m = np.nonzero(square <= limit[use][:, None])
            compared[use] += b - a
            i, j, d = np.append(i, use[n]), np.append(j, m + a), np.append(d, square[n, m])
            if len(i) > next_cut:
                limit = np.minimum(limit, _closest(i, d, len(v), k) + 2 * error)
                near = d <= limit[i]
                i, j, d = i[near], j[near], d[near]
                next_cut = 8 * k * len(v) + 2 * len(i)
    near = d <= np.minimum(limit, _closest(i, d, len(v), k) + 2 * error)[i]
    return i[near], j[near], compared


def _best(k: int, pivots: dict[int, np.ndarray] | None = None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest rows of one cut of a block or tile for each of its queries, ties by id. base: ``id, vector, pivot, gap``.

    With ``pivots`` rows beyond a query's radius are left out by their ``gap`` to their ``pivot``.
    """

    def run(base: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if base.num_rows and queries.num_rows:
            base = base.sort_by([("pivot", "ascending"), ("gap", "ascending")])
            gap, ids, pivot = (base.column(c).to_numpy() for c in ("gap", "id", "pivot"))
            x = np.concatenate([m for b in base.to_batches() for _, m in _matrices(b)])
            block = [base.column(c)[0].as_py() for c in (*BLOCK, "cut")]
            asked, radius = (queries.column(c).to_numpy() for c in ("query_id", "radius"))
            q = np.concatenate([m for b in queries.to_batches() for _, m in _matrices(b)])
            used, starts = np.unique(pivot, return_index=True)
            parts = list(zip(starts, np.append(starts[1:], len(x)), strict=True))
            if pivots is None:
                parts, gaps, radius = [(0, len(x))], np.zeros((len(q), 1)), np.full(len(q), np.inf)
            else:
                gaps = _gaps(q, {d: p[used] for d, p in pivots.items() if d == q.shape[1]})
            order = np.lexsort((gaps.min(1), gaps.argmin(1)))  # queries side by side have rows in common
            for c in range(0, len(q), CHUNK):
                at = order[c : c + CHUNK]
                i, j, compared = _compared(x, parts, gap, q[at], gaps[at], radius[at] * (1 + 1e-9) + 1e-12, k)
                dist = np.zeros(len(i))
                for lo in range(0, len(i), PAIRS):
                    diff = x[j[lo : lo + PAIRS]] - q[at[i[lo : lo + PAIRS]]]
                    dist[lo : lo + PAIRS] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                best = np.lexsort((ids[j], dist, i))
                i, j, dist = i[best], j[best], dist[best]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j, dist = i[top], j[top], dist[top]
                out.append((asked[at[i]], ids[j], dist, *(np.full(len(i), n) for n in block), compared[i]))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * len(kinds)
        names = [f.split()[0] for f in HITS.split(", ")]
        return pa.table({n: pa.array(c, t) if len(c) else pa.array([], t) for n, c, t in zip(names, columns, kinds, strict=True)})

    return run


def _visited(rows: DataFrame, counts: list, routed: DataFrame, k: int, pivots: dict[int, np.ndarray] | None = None) -> DataFrame:
    """The k best of each block cut for each query routed to it. rows: ``id, vector, *BLOCK, pivot, gap``."""
    spark = rows.sparkSession
    asked = {tuple(r[c] for c in BLOCK): r.n for r in routed.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = [(*at, -(-n // BLOCK_ROWS), -(-asked[at] // BLOCK_QUERIES)) for at, n in ((tuple(r[c] for c in BLOCK), r.n) for r in counts) if at in asked]
    # one line for each visited block
    plan = F.broadcast(spark.createDataFrame(plan, "dims int, cell int, ring int, cuts int, q_cuts int"))
    salt = lambda c, n: F.pmod(F.xxhash64(c, F.lit("cut")), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(plan, BLOCK).withColumn("cut", salt("id", "cuts")).withColumn("q_cut", each("q_cuts"))
    left = left.select(*BLOCK, "cut", "q_cut", "id", "vector", "pivot", "gap")
    right = routed.join(plan, BLOCK).withColumn("q_cut", salt("query_id", "q_cuts")).withColumn("cut", each("cuts"))
    right = right.select(*BLOCK, "cut", "q_cut", "query_id", "vector", "radius")
    key = [*BLOCK, "cut", "q_cut"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(k, pivots), HITS)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def visits(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of every visited tile cut for each query, with ``pairs``, the rows compared there."""
    base = comparable(base.select(F.col("id").cast("long").alias("id"), "vector"))
    queries = durable(comparable(queries.select(F.col("query_id").cast("long").alias("query_id"), "vector")))
    pivots = choose_pivots(base)
    rows = durable(filed(base, pivots).withColumn("pivot", F.col("cell")))
    counts = rows.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high")).collect()
    blocks = Blocks(counts)
    first = _visited(rows, counts, durable(_routed(queries, pivots, blocks, k, True)), k)
    radius = _top(first, k).where(F.col("rank") == k).select("query_id", F.col("distance").alias("radius"))
    more = queries.join(radius, "query_id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
    # the second visit is whole: it meets the blocks of the first again
    spark, tiles = rows.sparkSession, blocks.tiles()
    held = {}
    for d, _, _, t, n in tiles:
        held[d, t] = held.get((d, t), 0) + n
    sizes = [Row(dims=d, cell=t, ring=0, n=n) for (d, t), n in held.items()]
    place = F.broadcast(spark.createDataFrame([x[:4] for x in tiles], "dims int, cell int, ring int, tile int"))
    tiled = rows.join(place, BLOCK).select("id", "vector", "dims", F.col("tile").alias("cell"), F.lit(0).alias("ring"), "pivot", "gap")
    return _visited(tiled, sizes, durable(_routed(more, pivots, blocks, k, False)), k, pivots)


def knn(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact k nearest: ``query_id, rank, id, distance``, ties by id.

    ``base``: id, vector; ``queries``: query_id, vector, one row per query_id. Only vectors of the
    query's length are compared; null vectors, and those with null or non-finite components, take no part.
    """
    k = max(1, int(k))
    return _top(visits(base, queries, k), k).select("query_id", "rank", "id", "distance")


def pairs_compared(visited: DataFrame) -> DataFrame:
    """``query_id, pairs``: how many rows each query was compared with."""
    per = visited.groupBy("query_id", *BLOCK, "cut").agg(F.max("pairs").alias("pairs"))
    return per.groupBy("query_id").agg(F.sum("pairs").alias("pairs"))


def knn_cells(celled: DataFrame, centers: np.ndarray, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """Approximate k nearest among the ``nprobe`` cells closest to each query.

    ``celled``: id, vector, cell, stored by cell or not; of a stored table only the probed cells
    are read. With ``nprobe`` = all cells the answer is the exact one.
    """
    k, dims = max(1, int(k)), centers.shape[1]
    queries = comparable(queries.select(F.col("query_id").cast("long").alias("query_id"), "vector")).where(F.size("vector") == dims)
    kind = queries.schema["vector"].dataType.simpleString()
    nprobe = min(int(nprobe), len(centers))

    def route(batches):
        for b in batches:
            for at, x in _matrices(b):
                near = np.argsort(_gaps(x, {dims: centers}), axis=1, kind="stable")[:, :nprobe]
                rows = pa.array(np.repeat(at, nprobe))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(near.ravel().astype(np.int32))], names=["query_id", "vector", "cell"])

    # a query sees its cells whole: no distance to a pivot, no radius
    whole = {"dims": F.lit(dims), "ring": F.lit(0)}
    routed = durable(queries.mapInArrow(route, f"query_id long, vector {kind}, cell int").withColumns({**whole, "radius": F.lit(float("inf"))}))
    probed = [r.cell for r in routed.select("cell").distinct().collect()]  # at most one for each centre
    rows = comparable(celled.where(F.col("cell").isin(probed)).select(F.col("id").cast("long").alias("id"), "vector", F.col("cell").cast("int").alias("cell")))
    rows = rows.where(F.size("vector") == dims).withColumns({**whole, "pivot": F.lit(0), "gap": F.lit(0.0)})
    counts = rows.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n")).collect()
    return _top(_visited(rows, counts, routed, k), k).select("query_id", "rank", "id", "distance")


def probes_for(celled: DataFrame, centers: np.ndarray, k: int, target: float = 0.95, sample: int = 256) -> int:
    """The fewest cells to probe so that ``target`` of the k nearest of at most ``sample`` rows are found."""
    rows = comparable(celled).where(F.size("vector") == centers.shape[1])
    asked = durable(rows.orderBy(F.xxhash64("id", F.lit("probe")), "id").limit(sample).select(F.col("id").alias("query_id"), "vector"))
    # of each neighbour: how many cells are nearer to the query than the neighbour's own
    near = knn(rows, asked, k + 1).where("query_id <> id").join(rows.select("id", "cell"), "id").join(asked, "query_id")

    def place(batches):
        for b in batches:
            out, cell = np.zeros(b.num_rows, np.int32), b.column(b.schema.get_field_index("cell")).to_numpy()
            for at, x in _matrices(b):
                order = np.argsort(_gaps(x, {x.shape[1]: centers}), axis=1, kind="stable")
                out[at] = (order == cell[at][:, None]).argmax(1) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["place"])

    placed = near.select("vector", F.col("cell").cast("int").alias("cell")).mapInArrow(place, "place int")
    return placed.agg(F.percentile("place", target).alias("p")).select(F.ceil("p")).first()[0] or 1
