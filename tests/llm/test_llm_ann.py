"""Learned partitions on vectors with structure: few parts are visited, and the nearest are found."""

import numpy as np
from pyspark.sql import functions as F

from storyloom.llm import ann


def clusters(n, dims=16, groups=60, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) * 4
    return (centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.5).round(4)


def test_router_visits_few_parts_of_structured_vectors():
    x = clusters(2000)
    arrays, probes = ann.fit_router(x, 16, 10)
    assert probes <= 4
    odds = ann.Router(arrays).log_odds(x)
    filed, order = odds.argmax(1), np.argsort(-odds, axis=1, kind="stable")[:, :probes]
    near = filed[ann.neighbour_graph(x, 10)]
    found = (near[:, :, None] == order[:, None, :]).any(2).mean()
    assert found >= 0.9
    assert np.bincount(ann.partition(x, 16)).max() <= 2000 / 16 * 1.2


def test_search_over_visited_parts_only(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 200)
    x = clusters(3000)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.search(rows, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & got[q])
    assert len(got) == 30 and hits / 300 >= 0.9
