"""Vector queries: the mean vector of each label searches the whole table."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from storyloom.operators import search, vectors
from storyloom.operators.feed import Store
from storyloom.plans.registry import query
from storyloom.plans.search_queries import OCC, RANK, REQUESTS, TERMS, TOP, requests
from storyloom.session import durable, shared_dir

K = 10
NPROBE = 10
CENTERS = """
    centers AS (SELECT query_id, list(x ORDER BY i) AS v FROM (
        SELECT label AS query_id, i, avg(x) AS x FROM (
            SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY 1, 2) GROUP BY 1)"""
KNN = f"""
    {CENTERS},
    knn AS (SELECT * FROM (SELECT query_id, vec_id AS id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (
        SELECT c.query_id, e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), c.v) AS d FROM embeddings e, centers c)) WHERE rank <= {{k}})"""


def base(e):
    return e.vectors().select(F.col("article_id").alias("id"), "vector", "label")


def centers(e):
    return vectors.centroids(base(e), "label")


@query("knn_exact", f"WITH {KNN.format(k=K)} SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INT) AS rank, id, round(d, 6) AS distance FROM knn")
def knn_exact(e):
    out = vectors.knn(base(e), centers(e), K)
    return out.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query("knn_deep", f"WITH {KNN.format(k=150)} SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INT) AS rank, id, round(d, 6) AS distance FROM knn")
def knn_deep(e):
    out = vectors.knn(base(e), centers(e), 150)
    return out.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query("knn_every_row", """
    SELECT query_id, CAST(rank AS INT) AS rank, id, round(d, 6) AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM (
            SELECT q.vec_id AS query_id, e.vec_id AS id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS d
            FROM embeddings q, embeddings e)) WHERE rank <= 3""")
def knn_every_row(e):
    rows = base(e)
    out = vectors.knn(rows, rows.select(F.col("id").alias("query_id"), "vector"), 3)
    return out.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def _cells(e):
    """The cell table, stored, and its centres."""
    rows = base(e)
    model = vectors.fit_cells(rows)
    path = f"{shared_dir(e.spark)}/cells-{uuid.uuid4().hex}"
    vectors.write_cells(vectors.assign_cells(rows, model), path, splits=4)
    return e.spark.read.parquet(path), np.array(model.clusterCenters())


@query("knn_ivf", """
    SELECT CAST(vec_id AS BIGINT) AS query_id, CAST(count(*) OVER () AS BIGINT) AS queries, 10 AS found, true AS enough, true AS measured FROM embeddings
    WHERE vec_id % 10 = 0 AND embedding IS NOT NULL""")
def knn_ivf(e):
    """A tenth of all rows as queries: how many rows each found, whether the recall over all of them reaches 0.9, and whether every score is the distance."""
    celled, cell_centers = _cells(e)
    rows = base(e)
    asked = rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), "vector")
    out = durable(vectors.knn_cells(celled, cell_centers, asked, K, vectors.probes_for(celled, cell_centers, K)))
    share = vectors.recall(out, vectors.knn(rows, asked, K)).agg(F.avg("recall").alias("share"))
    own = out.join(rows.select("id", F.col("vector").alias("v")), "id").join(asked, "query_id")
    gap = F.sqrt(F.aggregate(F.zip_with("v", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x))
    per = own.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("found"), F.every(F.abs(gap - F.col("distance")) < 1e-9).alias("measured"))
    return per.select("query_id", per.agg(F.count(F.lit(1))).scalar().alias("queries"), "found", (share.scalar() >= 0.9).alias("enough"), "measured")


@query("knn_ivf_all_cells", f"WITH {KNN.format(k=K)} SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INT) AS rank, id, round(d, 6) AS distance FROM knn")
def knn_ivf_all_cells(e):
    celled, cell_centers = _cells(e)
    out = vectors.knn_cells(celled, cell_centers, centers(e), K, len(cell_centers))
    return out.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query("embedding_check", """
    SELECT article_id, model_key, 'wrong_size' AS problem FROM fx_embedding WHERE len(vector) <> 64
    UNION ALL SELECT article_id, model_key, 'repeated' FROM fx_embedding GROUP BY 1, 2 HAVING count(*) > 1""")
def embedding_check(e):
    return vectors.embedding_check(e.embedding(), e.embedding_model())


@query("search_hybrid", f"""
    WITH {OCC}, {TERMS}, {RANK},
    lex AS ({TOP.format(k=30)}),
    {KNN.format(k=30)},
    both_lists AS (SELECT query_id, id, rank, 'lexical' AS kind FROM lex
             UNION ALL SELECT query_id, id, rank, 'semantic' FROM knn WHERE query_id IN ({", ".join(str(i) for i, _ in REQUESTS)})),
    fused AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, CASE WHEN count(*) > 1 THEN 'hybrid' ELSE min(kind) END AS match
              FROM both_lists GROUP BY 1, 2)
    SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score, match, CAST(rank AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fused) WHERE rank <= 30""")
def search_hybrid(e):
    asked = requests(e)
    lexical = search.search_many(Store.of(e), asked, 30)
    # a request's vector is the mean vector of the label with its id
    wanted = centers(e).join(asked.select(F.col("query_id").cast("int").alias("query_id")), "query_id", "left_semi")
    semantic = vectors.knn(base(e), wanted, 30)
    out = search.hybrid(lexical, semantic, 30)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "match", "rank")
