"""Cover-density rank against hand-worked values and a brute-force sweep."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import search, similarity


def rank(spark, text, q):
    article = spark.createDataFrame([(1, text)], "id long, text string")
    queries = spark.createDataFrame([(7, q)], "query_id int, q string")
    rows = search.ranked_articles(article, queries).collect()
    return round(rows[0].score, 6) if rows else None


@pytest.mark.parametrize(
    "text, q, score",
    [
        ("a b c", "a", 0.1),
        ("a b a", "a", 0.2),
        ("a b", "a b", 0.1),
        ("a x b", "a b", 0.05),
        ("a b a", "a b", 0.2),
        ("a a b", "a b", 0.1),
        ("a x x b c", "a b c", round(0.1 / 3, 6)),
        ("a b c a", "a b c", 0.2),
        ("a c", "a b", None),
        ("A B", "b a a", 0.1),
        ("é x", "e", 0.1),
        ("e x", "é", 0.1),
        ("anything", "", None),
    ],
)
def test_rank(spark, text, q, score):
    assert rank(spark, text, q) == score


def brute(words, terms):
    """All intervals holding every term and none smaller inside."""
    spots = [i for i, w in enumerate(words) if w in terms]
    covers = [
        (a, b) for a, b in itertools.product(spots, spots) if a <= b and set(terms) <= set(words[a : b + 1])
    ]
    minimal = [c for c in covers if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in covers)]
    total = 0.0
    for a, b in minimal:
        inside = sum(words[i] in terms for i in range(a, b + 1))
        total += 0.1 / (1 + (b - a + 1) - inside)
    return round(total, 6)


def test_rank_matches_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdexyz") for _ in range(rng.randint(3, 25))) for _ in range(60)]
    article = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = [(1, "a b"), (2, "a b c"), (3, "a b c d")]
    got = {
        (r.query_id, r.id): round(r.score, 6)
        for r in search.ranked_articles(article, spark.createDataFrame(asked, "query_id int, q string")).collect()
    }
    want = {
        (i, n): brute(t.split(), q.split())
        for i, q in asked
        for n, t in enumerate(texts)
        if set(q.split()) <= set(t.split())
    }
    assert got == want


def test_strict_keeps_query_accents(spark):
    article = spark.createDataFrame([(1, "über alles")], "id long, text string")
    queries = spark.createDataFrame([(1, "über")], "query_id int, q string")
    assert search.ranked_articles(article, queries).count() == 1
    assert search.ranked_articles(article, queries, strict=True).count() == 0


def test_top_stories_with_shared_article(spark):
    """Pruning by article must not change the k best stories."""
    import datetime as dt

    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    stories = [(i, rng.choice([0, 0, 0, 1, 2, 3]), t0 + dt.timedelta(minutes=rng.randint(0, 20))) for i in range(200)]
    scores = [(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.9), (2, 0, 0.1), (2, 3, 0.3)]
    sdf = spark.createDataFrame(stories, "id long, article_id long, created_at timestamp")
    got = search.top_stories(spark.createDataFrame(scores, "query_id int, id long, score double"), sdf, 15).collect()
    for q in (1, 2):
        pool = [(-s, -(c - t0).total_seconds(), i) for (qq, a, s) in scores if qq == q for (i, aa, c) in stories if aa == a]
        want = [i for _, _, i in sorted(pool)[:15]]
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_fuzzy_domains(spark):
    stories = spark.createDataFrame([("example.com",), ("exampel.com",), ("other.org",), (None,)], "domain string")
    names = spark.createDataFrame([("example.com",)], "name string")
    assert {r.domain for r in search.fuzzy_domains(stories, names).collect()} == {"example.com", "exampel.com"}


def test_fuzzy_titles(spark):
    stories = spark.createDataFrame([(1, "A new engine"), (2, "a new engine!"), (3, "old news"), (4, None)], "id long, title string")
    names = spark.createDataFrame([("new engines",)], "name string")
    got = {r.id: round(r.similarity, 4) for r in search.fuzzy_titles(stories, names, 0.4).collect()}
    assert set(got) == {1, 2} and got[1] == got[2]


def _grams(text):
    out = set()
    for w in re.findall(r"[^\W_]+", text.lower()):
        w = f"  {w} "
        out |= {w[i : i + 3] for i in range(len(w) - 2)}
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.5, 0.7, 0.8, 1.0])
def test_similar_pairs_are_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 10))
    words = ["site", "sites", "news", "new", "example", "exampel", "blog", "x", "com", "org", "é"]
    texts = sorted({".".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(120)}) + ["--", ""]
    df = spark.createDataFrame([(t,) for t in texts] * 2 + [(None,)], "text string")
    want = {}
    for a, b in itertools.combinations(texts, 2):
        x, y = _grams(a), _grams(b)
        if x | y and len(x & y) / len(x | y) >= threshold:
            want[tuple(sorted((a, b), key=str.encode))] = round(len(x & y) / len(x | y), 9)
    got = {(r.a, r.b): round(r.similarity, 9) for r in similarity.similar_pairs(df, threshold=threshold).collect()}
    assert got == want and want or threshold == 1.0
    two = similarity.similar_pairs(df.where("text < 'f'"), df.where("text >= 'f'"), threshold).collect()
    assert {(r.a, r.b) for r in two} == {p for p in want if p[0].encode() < b"f" <= p[1].encode()}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_similar_pairs_of_common_grams_meet_by_blocks(spark, monkeypatch, threshold):
    rng = random.Random(5)
    words = ["site", "sites", "new", "newer", "𝔸x", "é", "ab12"]
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(150)})
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("--",)], "text string")
    monkeypatch.setattr(similarity, "MEETINGS", 1)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", (16, 16))
    want = {}
    for a, b in itertools.product(texts, texts):
        x, y = _grams(a), _grams(b)
        if len(x & y) / len(x | y) >= threshold:
            want[a, b] = round(len(x & y) / len(x | y), 9)
    found = similarity.similar_pairs(df, threshold=threshold)
    rows = found.collect()
    assert {(r.a, r.b): round(r.similarity, 9) for r in rows} == {p: s for p, s in want.items() if p[0].encode() < p[1].encode()}
    assert len({(r.a, r.b) for r in rows}) == len(rows)
    two = similarity.similar_pairs(df, df, threshold).collect()
    assert len(two) == len(want) and {(r.a, r.b): round(r.similarity, 9) for r in two} == want
    # no row for each meeting of two texts in a gram
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()


def _titles(n, seed):
    rng = random.Random(seed)
    parts = ["er", "th", "ing", "on", "ti", "and", "re", "es", "ou", "le"]
    return sorted({" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9)))[:80] for _ in range(n)})


def test_similar_pairs_of_common_grams_make_no_prefixes(spark, monkeypatch):
    texts = _titles(300, 3)
    df = spark.createDataFrame([(t,) for t in texts], "text string")

    def made(*_):
        raise AssertionError("a row for each gram of each text")

    monkeypatch.setattr(similarity, "MEETINGS", 4)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", (64, 64))
    monkeypatch.setattr(similarity, "_prefixes", made)
    want = {}
    for a, b in itertools.combinations(texts, 2):
        x, y = _grams(a), _grams(b)
        if len(x & y) / len(x | y) >= 0.6:
            want[a, b] = round(len(x & y) / len(x | y), 9)
    got = similarity.similar_pairs(df, threshold=0.6).collect()
    assert want and len(got) == len(want) and {(r.a, r.b): round(r.similarity, 9) for r in got} == want


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_least_meetings_are_no_more_than_those_of_the_prefixes(spark, threshold):
    own = similarity._texts(spark.createDataFrame([(t,) for t in [*_titles(200, 4), "zq", "xy qz", "jj kk ll"]], "text string"))
    sets = similarity.gram_sets(own)
    counts = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    prefixes = similarity._prefixes(sets, counts, threshold)
    least = similarity._least_meetings(counts, own, threshold)
    assert 0 < least <= similarity._meetings(prefixes, prefixes) + 1e-9
    assert similarity._least_meetings(counts.limit(0), own.limit(0), threshold) == 0


def test_packed_blocks_hold_the_grams_of_the_texts_in_few_bytes(spark):
    odd = ["İstanbul", "ΣΑΣ", "ß-Straße", "𝔸x 𝔹", "١٢ Ⅷ", "a\u0301b", "a\nb\tc", "x", " y  z ", "ﬁn\u0000e"]
    texts = _titles(3_000, 6)
    df = spark.createDataFrame([(t,) for t in texts + odd], "text string")
    own = similarity._texts(df)
    plan = [(r.n, 1, 0, 2) for r in own.select("n").distinct().collect()]
    pieces = [(r.bytes, r.data) for r in similarity._packed(own, plan).collect()]
    known = {}
    block = similarity._Block(pieces, known)
    letters = lambda c: "".join(map(chr, (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF)))
    names = [letters(c) for c in known]
    got = {t: {names[g] for g in block.grams(np.array([i]))[0]} for i, t in enumerate(block.texts.to_pylist())}
    assert got == {r.text: set(r.grams) for r in df.select("text", similarity.trigrams(F.col("text")).alias("grams")).collect()}
    assert [len(got[t]) for t in block.texts.to_pylist()] == block.n.tolist() == sorted(block.n)
    assert sum(len(d) for _, d in pieces) < sum(len(t.encode()) for t in texts + odd)  # a number for each gram would be eight times that
