"""The stored search index: equal to the full ranking, pruned, refreshed by a small segment."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators import search, search_index

WORDS = "abcdefgh"


def texts(rng, n, longest=60):
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, longest)))) for i in range(n)]


def postings(df):
    return {(r.term, r.id): list(r.positions) for r in df.collect()}


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = texts(rng, 500) + [(500, None), (501, ""), (502, "rare a b"), (503, " ".join("ab" * 40))]
    article = spark.createDataFrame(rows, "id long, text string").repartition(4)
    stories = [(i, rng.randrange(504), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(50))) for i in range(900)]
    stories += [(900, None, dt.datetime(2024, 1, 1))]
    root = str(tmp_path_factory.mktemp("index"))
    sliced = search_index.SLICE_ROWS
    search_index.SLICE_ROWS = 40  # several slices of one class
    try:
        index = search_index.build(article, root, buckets=5)
    finally:
        search_index.SLICE_ROWS = sliced
    return article, spark.createDataFrame(stories, "id long, article_id long, created_at timestamp"), index


QUERIES = [(1, "a b"), (2, "a"), (3, "rare"), (4, "a b c d e f g h"), (5, "none a"), (6, ""), (7, "rare h"), (8, "B a A")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id int, q string")


def scores(df):
    return {(r.query_id, r.id): round(r.score, 9) for r in df.collect()}


def test_postings_are_those_of_the_articles(corpus):
    article, _, index = corpus
    assert postings(index.postings()) == postings(search.postings(article))


def test_full_ranking_and_matching(corpus, asked):
    article, _, index = corpus
    want = scores(search.ranked_articles(article, asked))
    assert scores(search_index.ranked(index, asked)) == want and want
    assert {tuple(r) for r in search_index.matching(index, asked).collect()} == set(want)


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_best_k_equal_the_full_ranking(corpus, asked, k):
    article, stories, index = corpus
    want = search.top_stories(search.ranked_articles(article, asked), stories, k)
    got = search_index.search_many(index, stories, asked, k).drop("match")
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    assert key(got) == key(want)


def test_bounds_leave_articles_unscored(corpus, asked):
    article, stories, index = corpus
    all_ = search.ranked_articles(article, asked).groupBy("query_id").count()
    few = search_index.contenders(index, asked, stories, 5).groupBy("query_id").agg(F.count("*").alias("scored"))
    rows = {r.query_id: (r["count"], r.scored) for r in all_.join(few, "query_id").collect()}
    assert rows[2][1] < rows[2][0] / 2 and rows[1][1] < rows[1][0] and all(scored <= n for n, scored in rows.values())


def test_bound_holds_for_every_article(corpus, asked):
    article, _, index = corpus
    terms = search.query_terms(asked)
    live = search_index.live_slices(index, terms, list(range(index.buckets)))
    best = search.ranked_articles(article, asked).groupBy("query_id").agg(F.max("score").alias("best"))
    top = live.groupBy("query_id").agg(F.max("bound").alias("bound")).join(best, "query_id").collect()
    assert top and all(r.bound >= r.best for r in top)


def test_a_query_scans_no_text(corpus, asked):
    _, stories, index = corpus
    plan = search_index.matching(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "text" not in plan


def test_refresh_writes_a_small_segment_and_equals_a_rebuild(spark, corpus, asked, tmp_path):
    article, stories, _ = corpus
    root = str(tmp_path / "idx")
    index = search_index.build(article, root, buckets=5)
    before = files(root)
    ids = spark.createDataFrame([(3,), (4,), (503,), (502,), (9000,), (None,), (3,)], "id long")
    new = article.where("id not in (4, 503)").withColumn("text", F.when(F.col("id") == 3, "rare fresh a").otherwise(F.col("text")))
    new = new.unionByName(spark.createDataFrame([(9000, "b a fresh")], "id long, text string"))
    fresh = search_index.refresh(index, new, ids)
    after = files(root)
    assert {f: t for f, t in after.items() if f in before} == before
    added = sum(os.path.getsize(f) for f in after if f not in before)
    assert added < sum(os.path.getsize(f) for f in before)
    want = postings(search.postings(new))
    assert postings(fresh.postings()) == want
    assert scores(search_index.ranked(fresh, asked)) == scores(search.ranked_articles(new, asked))
    key = lambda df: sorted((r.query_id, r["rank"], r.id) for r in df.collect())
    assert key(search_index.search_many(fresh, stories, asked, 6)) == key(search.top_stories(search.ranked_articles(new, asked), stories, 6))
    # the older index is as it was
    assert postings(index.postings()) == postings(search.postings(article))
    again = search_index.refresh(fresh, article, ids)
    assert postings(again.postings()) == postings(search.postings(article))
    folded = search_index.merged(again, str(tmp_path / "folded"))
    assert len(folded.segments) == 1 and postings(folded.postings()) == postings(search.postings(article))
    assert scores(search_index.ranked(folded, asked)) == scores(search.ranked_articles(article, asked))


def test_no_articles(spark, tmp_path, asked):
    index = search_index.build(spark.createDataFrame([], "id long, text string"), str(tmp_path / "none"))
    assert index.postings().count() == 0 and search_index.ranked(index, asked).count() == 0


def test_identifiers_may_be_strings(spark, tmp_path):
    article = spark.createDataFrame([("x", "a b"), ("y", "b")], "id string, text string")
    index = search_index.build(article, str(tmp_path / "s"))
    asked = spark.createDataFrame([("q", "b a")], "query_id string, q string")
    assert [tuple(r) for r in search_index.matching(index, asked).collect()] == [("q", "x")]


def test_blocks_of_a_slice():
    """One slice to its blocks: rows of one id are one article, texts without words have no entry."""
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict(
        {"slice": pa.array([5, 5, 5, 5, 9], pa.int64()), "id": pa.array([1, 2, 2, 3, 1], pa.int64()), "text": ["b a b", "a", "a c", "", "b"]}
    )
    parts = [rows.slice(0, 1), rows.slice(1, 1), rows.slice(2)]  # a slice may come in several batches
    made = [r for b in search_index._slice_blocks(iter(parts)) for r in b.to_pylist()]
    entry = lambda i, p: {"id": i, "positions": p}
    want = [
        {"term": "a", "slice": 5, "n": 2, "most": 2, "entries": [entry(1, [2]), entry(2, [1, 1])]},
        {"term": "b", "slice": 5, "n": 1, "most": 2, "entries": [entry(1, [1, 3])]},
        {"term": "b", "slice": 9, "n": 1, "most": 1, "entries": [entry(1, [1])]},
        {"term": "c", "slice": 5, "n": 1, "most": 1, "entries": [entry(2, [2])]},
    ]
    assert sorted(made, key=lambda r: (r["term"], r["slice"])) == want
    assert not list(search_index._slice_blocks(iter([]))) and all(b.num_rows == 0 for b in search_index._slice_blocks(iter([rows.slice(3, 1)])))


def test_blocks_are_scored_whole_in_the_tasks(spark, corpus, asked):
    """No row is made for an entry or an occurrence of a term; before, each entry was a row that carried the ids of its slice."""
    _, _, index = corpus
    plan = search_index.ranked(index, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


@pytest.mark.parametrize("cut", [1, 2, 5])
def test_scores_of_a_slice(cut):
    """Groups of blocks may be cut by batches; null ids and articles without one of the terms have no score."""
    import pyarrow as pa

    def block(query, slice_, term, entries):
        entries = [{"id": i, "positions": p} for i, p in entries]
        return {"query_id": query, "n_terms": 2 if query == 1 else 1, "floor": 0.0, "segment": 0, "slice": slice_, "term": term, "entries": entries}

    rows = [
        block(1, 3, "a", [(7, [1, 9]), (8, [2]), (None, [1])]), block(1, 3, "b", [(7, [4, 10]), (9, [1]), (None, [2])]),
        block(1, 4, "a", [(1, [1])]), block(1, 4, "b", [(2, [1])]), block(2, 3, "a", [(7, [1, 9]), (8, [2]), (None, [1])]),
    ]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("positions", pa.list_(pa.int32()))]))
    schema = pa.schema([("query_id", pa.int32()), ("n_terms", pa.int32()), ("floor", pa.float64()), ("segment", pa.int32()), ("slice", pa.int64()), ("term", pa.string()), ("entries", kind)])
    whole = pa.RecordBatch.from_pylist(rows, schema=schema)
    parts = [whole.slice(i, cut) for i in range(0, len(rows), cut)]
    made = [(r["query_id"], r["id"], r["_total"], r["_least"], round(r["score"], 9)) for b in search_index._score_slices(iter(parts)) for r in b.to_pylist()]
    covers = 0.1 / 3 + 0.1 / 5 + 0.1  # 1-4 with two words between, 4-9 with four, 9-10 with none
    assert made == [(1, 7, 4, 2, round(covers, 9)), (2, 7, 2, 2, 0.2), (2, 8, 1, 1, 0.1)]


def test_words_in_folded_texts():
    """ASCII texts come as they are and are cut into words in the tasks; no word goes on in the next text."""
    import pyarrow as pa

    words, row = search_index._words_in(pa.array(["skipped", "", "A-b C3,", "x", "", "y\x00\tZz_9", "é ǆ", "--"]).slice(1))
    assert list(zip(words.to_pylist(), row.tolist(), strict=True)) == [
        ("a", 1), ("b", 1), ("c3", 1), ("x", 2), ("y", 4), ("zz", 4), ("9", 4), ("é", 5), ("ǆ", 5)
    ]
    assert [len(x) for x in search_index._words_in(pa.array(["", ""]))] == [0, 0]


def test_index_of_mixed_texts(spark, tmp_path):
    rows = [(1, "Straße ÉTÉ x_y"), (2, "A1 b\x00c\x1fd\ne"), (3, "İstanbul ΣΑΣ Σ"), (4, "日本 ét K2"), (5, "  "), (6, None), (7, "l'été—l'hiver")]
    article = spark.createDataFrame(rows, "id long, text string")
    index = search_index.build(article, str(tmp_path / "mixed"))
    assert postings(index.postings()) == postings(search.postings(article))
    plan = search_index._words(article)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and "octet_length" in plan
