"""Centroid clustering and the filter audit against brute force, and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations
from math import floor

import numpy as np
import pytest

from storyloom.llm import centroids, filter_audit

# -- centroids -----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, cluster string, distance string, V long, n int"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, e, "x", "y", 1, 2) for i, e in rows], VECTORS).repartition(parts)


def brute_clusters(rows, k, rounds, dims, scale=256):
    kept = [(i, [floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(((name(i), v) for i, v in kept))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for c, vs in groups.items():
            centres[c] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 4).round(1).tolist()) for i in range(120)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, None), (200, []), (201, [1.0]), (202, [1.0, 2.0, 3.0, None])]
    rows += [(203, [1.0, 2.0, 3.0, float("nan")]), (204, [1.0, 2.0, 3.0, float("inf")]), (205, [0.0] * 4), (206, [-0.001] * 4), (207, [1e5] * 4)]
    got = centroids.cluster(vectors(spark, rows), k=7, rounds=3, dimensions=4)
    assert rows_of(got) == brute_clusters(rows, 7, 3, 4)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 6.0])]
    assert rows_of(centroids.cluster(vectors(spark, rows), dimensions=2)) == brute_clusters(rows, 40, 5, 2)
    got = centroids.cluster(vectors(spark, []), dimensions=2)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


@pytest.mark.parametrize("seed,dims,k,spread", [(1, 2, 40, 3), (2, 8, 30, 50), (3, 64, 40, 200), (4, 1, 12, 5), (5, 3, 1, 9)])
def test_threshold_walk_finds_the_smallest_number_among_ties(seed, dims, k, spread):
    rng = np.random.default_rng(seed)
    c = rng.integers(-spread, spread + 1, (k, dims))
    x = rng.integers(-spread - 5, spread + 6, (1300, dims))
    d = ((x[:, None, :] - c[None]) ** 2).sum(2)
    number, best, measured = centroids.nearest(x, c)
    assert (number == d.argmin(1)).all() and (best == d.min(1)).all() and (measured <= k).all()


def test_threshold_walk_stops_early():
    rng = np.random.default_rng(9)
    c = rng.integers(-10_000, 10_000, (40, 2))
    _, _, measured = centroids.nearest(c[rng.integers(0, 40, 500)] + rng.integers(-3, 4, (500, 2)), c)
    assert measured.mean() < 10


# -- filter audit --------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, mask long, good string, part string, digest int, _text string"
LABELS = "doc_id long, quality int, toxic int, part string, n long"
LONG = " ".join(f"word{i}" for i in range(150_000))


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = sum("A" <= c <= "Z" for c in text)
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * capitals > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
    }


def brute_audit(docs, labels):
    judged = []
    for i, text, lang in docs:
        f = fails(text or "")
        f["E"] = any(i is not None and j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        says = [r for r in labels if r[0] is not None and r[0] == i]
        judged.append((lang or "", f, any(r[1] == 1 for r in says), any(r[2] == 1 for r in says)))
    out = []
    for part in {p for p, *_ in judged}:
        rows, removed_by = [r for r in judged if r[0] == part], Counter()
        found = []
        for order in permutations("ABCDE"):
            alive = rows
            for step, name in enumerate(order, 1):
                gone, stay = [r for r in alive if r[1][name]], [r for r in alive if not r[1][name]]
                earlier = sum(r[1][name] and any(r[1][o] for o in order[: step - 1]) for r in rows)
                only = sum(r[1][name] and sum(r[1].values()) == 1 for r in rows)
                found.append((part, "".join(order), step, len(stay), len(gone), earlier, only, sum(r[2] for r in gone), sum(r[3] for r in gone)))
                removed_by[name] += len(gone)
                alive = stay
        out += [(*r, removed_by[r[1][r[2] - 1]]) for r in found]
    return sorted(out, key=repr)


def audited(spark, docs, labels, parts=3):
    d = spark.createDataFrame([(*r, 1, "x", "y", 2, "z") for r in docs], DOCS).repartition(parts)
    return filter_audit.audit(d, spark.createDataFrame([(*r, "p", 3) for r in labels], LABELS))


def test_audit_of_odd_documents(spark):
    docs = [
        (1, None, None), (2, "", ""), (3, "", "en"), (4, LONG, "en"), (5, LONG, "de"), (5, LONG, "de"), (6, "SHOUT", "en"), (7, "a # b", "en"),
        (None, LONG, "en"), (None, "x", None), (8, "x", None), (9, "a " * 120, "en"), (10, "ÄÖÜ" * 9, "de"), (11, "ABCDEFGHIJ" + "é" * 90, "de"),
        (12, "ABCDEFGHIJK" + "é" * 90, "de"), (13, "\x85 \xa0 x\x0by\x1c", "en"),
    ]
    labels = [(4, 1, 0), (5, 0, 1), (5, 1, 0), (6, None, 1), (None, 1, 1), (99, 1, 1), (9, 0, None)]
    assert rows_of(audited(spark, docs, labels)) == brute_audit(docs, labels)


def test_audit_without_labels_and_without_documents(spark):
    docs = [(1, "one", "en"), (2, "one", "en"), (3, "One", "en")]
    assert rows_of(audited(spark, docs, [])) == brute_audit(docs, [])
    assert audited(spark, [], []).count() == 0


def test_words_are_counted_over_chunks():
    text = " one two\x0bone\x85two\n\nthree ".encode() * 7
    for chunk in (1, 2, 3, 5, 8, 1000):
        n, distinct = filter_audit.word_counts(text, chunk)
        words = re.findall(rb"[^\x20\x09-\x0D]+", text)
        assert (n, distinct) == (len(words), len(set(words)))


def test_gray_walk_visits_every_subset():
    masks, counts = [0, 1, 3, 4, 7], [(1, 0, 0), (2, 1, 0), (4, 0, 1), (8, 2, 2), (16, 0, 0)]
    states = filter_audit.gray_walk(masks, counts, 3)
    for s in range(8):
        assert states[s] == tuple(sum(c[i] for m, c in zip(masks, counts, strict=True) if not m & s) for i in range(3))
