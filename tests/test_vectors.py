"""Every way of the vector search gives the exact answer where it should."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import vector_join, vectors


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 8)).round(2)
    base[50] = base[51]  # a tie
    queries = np.vstack([rng.normal(size=(30, 8)).round(2), base[50:51]])
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id long, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<double>")
    want = {}
    for i, v in enumerate(queries):
        d = np.sqrt(((base - v) ** 2).sum(axis=1))
        want[i] = sorted(range(len(base)), key=lambda n: (d[n], n))[:5]
    return b, q, want


def ids(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_exact(data):
    b, q, want = data
    assert ids(vectors.knn(b.repartition(3), q, 5)) == want


def test_cuts_of_blocks_and_queries(data, monkeypatch):
    b, q, want = data
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", 9)
    monkeypatch.setattr(vector_join, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(vector_join, "PIVOT_ROWS", 20)
    assert ids(vectors.knn(b, q, 5)) == want


def test_cells(data, monkeypatch):
    b, q, want = data
    model = vectors.fit_cells(b, cells=10)
    celled = vectors.assign_cells(b, model)
    centers = np.array(model.clusterCenters())
    assert ids(vectors.knn_cells(celled, centers, q, 5, nprobe=10)) == want
    few = vectors.knn_cells(celled, centers, q, 5, nprobe=4)
    share = vectors.recall(few, vectors.knn(b, q, 5)).agg(F.avg("recall")).first()[0]
    assert share > 0.6
    narrow = ids(few)
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", 9)
    monkeypatch.setattr(vector_join, "BLOCK_QUERIES", 7)
    assert ids(vectors.knn_cells(celled, centers, q, 5, nprobe=10)) == want
    assert ids(vectors.knn_cells(celled, centers, q, 5, nprobe=4)) == narrow
    probes = vectors.probes_for(celled, centers, 5, target=0.95, sample=100)
    wide = vectors.knn_cells(celled, centers, q, 5, nprobe=probes)
    assert 4 < probes <= 10 and vectors.recall(wide, vectors.knn(b, q, 5)).agg(F.avg("recall")).first()[0] >= 0.9


def test_bounds_leave_pairs_out(spark, monkeypatch):
    """Vectors in clusters: a query meets its own neighbourhood only, and the answer is exact."""
    monkeypatch.setattr(vector_join, "PIVOT_ROWS", 40)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(40, 1, 6)) * 20 + rng.normal(size=(40, 30, 6))).reshape(-1, 6)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(4)
    asked = rows.select(F.col("id").alias("query_id"), "vector")
    got = ids(vectors.knn(rows, asked, 4))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert got == {i: sorted(range(len(x)), key=lambda n: (d[i, n], n))[:4] for i in range(len(x))}
    pairs = vectors.pairs_compared(vectors.visits(rows, asked, 4)).agg(F.sum("pairs"), F.count("*")).first()
    assert pairs[1] == len(x) and pairs[0] < len(x) ** 2 / 4


def test_vectors_that_cannot_be_compared(spark):
    nan = float("nan")
    b = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0]), (4, None), (5, []), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [0.0, 0.0])]
    q = [(1, [0.0, 0.0]), (2, [2.0]), (3, [1.0, 2.0, 3.0]), (4, None), (5, [nan, 0.0])]
    rows = spark.createDataFrame(b, "id long, vector array<double>")
    asked = spark.createDataFrame(q, "query_id long, vector array<double>")
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in vectors.knn(rows, asked, 9).collect()}
    assert got == {(1, 1): (1, 0.0), (1, 2): (8, 0.0), (1, 3): (2, 5.0), (2, 1): (3, 1.0)}
    assert vectors.knn(rows.where("id < 0"), asked, 3).count() == 0


def test_one_vector_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", 50)
    rows = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [float(i), 0.0]) for i in range(900)], "id long, vector array<double>")
    got = ids(vectors.knn(rows, spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>"), 4))
    assert got == {1: [1, 2, 4, 5]}


def test_no_queries(data):
    b, q, _ = data
    assert vectors.knn(b, q.where("query_id < 0"), 5).count() == 0


def test_checks(spark):
    rows = spark.createDataFrame(
        [(1, "default", [1.0]), (1, "default", [1.0, 2.0]), (2, "other", [1.0])], "article_id long, model_key string, vector array<double>"
    )
    models = spark.createDataFrame([("default", 2)], "key string, dimensions int")
    got = {(r.article_id, r.problem) for r in vectors.embedding_check(rows, models).collect()}
    assert got == {(1, "wrong_size"), (1, "repeated"), (2, "unknown_model")}


def test_language_accuracy(entities):
    from storyloom.operators import extract

    docs = entities.t.documents
    model = extract.train_languages(docs)
    got = extract.detect_language(docs.select("doc_id", "text"), "doc_id", model)
    right = docs.join(got, "doc_id").agg(F.avg((F.col("lang") == F.col("language")).cast("int"))).first()[0]
    assert right > 0.9
    empty = docs.sparkSession.createDataFrame([(1, ""), (2, None), (3, "123")], "doc_id long, text string")
    assert {r.language for r in extract.detect_language(empty, "doc_id", model).collect()} == {"und"}


def test_a_query_is_copied_once_to_a_tile(spark, monkeypatch):
    """Vectors without structure reach nearly every block; the copies follow the tiles, and batches of them stay small."""
    monkeypatch.setattr(vector_join, "PIVOT_ROWS", 20)
    monkeypatch.setattr(vector_join, "BATCH", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16))
    x[7] = x[300]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    made = []
    routed = vector_join._routed
    monkeypatch.setattr(vector_join, "_routed", lambda *a: made.append(routed(*a)) or made[-1])
    got = ids(vectors.knn(rows, rows.select(F.col("id").alias("query_id"), "vector"), 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert got == {i: sorted(range(len(x)), key=lambda n: (d[i, n], n))[:3] for i in range(len(x))}
    assert len(made) == 2 and made[1].count() == len(x)
