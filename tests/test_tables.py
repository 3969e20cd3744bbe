"""Upserts, state over runs, skew helpers and integrity on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from storyloom.operators import ingest, merge
from storyloom.operators.feed import FeedQuery, Store, feed
from storyloom.operators.skew import hot_keys, lookup

T0 = dt.datetime(2024, 1, 1)
STORY = (
    "id string, source string, hn_id int, title string, url string, domain string, author string, points int, "
    "comments_count int, created_at timestamp, fetched_at timestamp, article_id string"
)
INCOMING = "source string, hn_id int, title string, url string, author string, points int, comments_count int, created_at timestamp, seq long"
def now():
    return F.lit("2024-02-01").cast("timestamp")



def hours(n):
    return T0 + dt.timedelta(hours=n)


def upsert(spark, target, *batches):
    out = spark.createDataFrame(target, STORY)
    for rows in batches:
        out = merge.story_upsert(out, spark.createDataFrame(rows, INCOMING), now())
    return sorted(out.collect(), key=lambda r: (r.hn_id is None, r.hn_id or 0, r.title))


def test_story_upsert_rules(spark):
    target = [("1", "hn", 1, "old", "https://a.com", "a.com", "x", 5, None, hours(5), hours(5), "art")]
    rows = [
        ("hn", 1, "first", None, None, 9, 2, hours(7), 1),
        ("hn", 1, "second", "https://www.b.com/x", "y", None, None, hours(3), 2),
        ("blog", None, "loose", None, None, None, None, hours(1), 3),
        ("blog", None, "loose", None, None, None, None, hours(1), 4),
    ]
    got = upsert(spark, target, rows)
    one = got[0]
    assert (one.id, one.title, one.domain, one.author, one.points, one.comments_count) == ("1", "second", "b.com", "y", 9, 2)
    assert one.created_at == hours(3) and one.article_id == "art"
    assert len([r for r in got if r.hn_id is None]) == 2


def test_story_upsert_batches_equal_one_batch(spark):
    rows = [("hn", i % 3, f"t{i}", f"https://h{i}.com", None, i if i % 2 else None, None, hours(i), i) for i in range(9)]
    assert upsert(spark, [], rows) == upsert(spark, [], rows[:4], rows[4:])
    assert upsert(spark, [], rows, rows) == upsert(spark, [], rows)


def test_summary_upsert_keeps_documents(spark):
    target = spark.createDataFrame(
        [("s1", "a1", "m0", "en", "old", T0, "{}", "{}", None)],
        "id string, article_id string, model string, lang string, summary string, created_at timestamp, "
        "classification_json string, ui_json string, summarized_at timestamp",
    )
    new = spark.createDataFrame(
        [("a1", "m1", "fr", "new", None, '{"x":1}', T0, 1), ("a2", "m1", "en", "fresh", None, None, None, 2)],
        "article_id string, model string, lang string, summary string, classification_json string, ui_json string, summarized_at timestamp, seq long",
    )
    got = {r.article_id: r for r in merge.summary_upsert(target, new, now()).collect()}
    assert (got["a1"].id, got["a1"].summary, got["a1"].classification_json, got["a1"].ui_json) == ("s1", "new", "{}", '{"x":1}')
    assert got["a1"].created_at == T0 and got["a2"].summary == "fresh"


def test_vocab_upsert_keeps_existing_name(spark):
    tag = spark.createDataFrame([("tag:a", "a", "A", "meta")], "id string, slug string, name string, kind string")
    arriving = spark.createDataFrame([("a", "other", "tech", 1), ("b", "Second", "tech", 3), ("b", "First", "tech", 2)], "slug string, name string, kind string, seq long")
    got = {r.slug: (r.name, r.kind) for r in merge.vocab_upsert(tag, arriving, "tag:").collect()}
    assert got == {"a": ("A", "meta"), "b": ("First", "tech")}


def test_publish_once_and_null_keys(spark):
    jobs = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 3, "c"), (None, 4, "c")], "job_key string, seq long, v string")
    got = sorted((r.job_key or "", r.seq) for r in ingest.publish_once(jobs, ["v"]).collect())
    assert got == [("", 3), ("", 4), ("k", 1)]


def test_kept_runs_follow_the_last_kept(spark):
    days = [1, 2, 7, 8, 9, 15, 16, 30]
    rows = [(1, dt.date(2024, 1, d)) for d in days for _ in range(3)]
    got = ingest.kept_runs(spark.createDataFrame(rows, "id int, d date"), F.col("d")).collect()
    assert sorted(r.run.day for r in got) == [1, 8, 15, 30]


def test_lookup_spreads_hot_keys_without_changing_the_result(spark):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 100).cast("long").alias("k")
    )
    right = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        salted = lookup(left, right, "k", how, min_rows=500)
        key = lambda r: (r["id"],)
        cols = plain.columns
        assert sorted(plain.select(*cols).collect(), key=key) == sorted(salted.select(*cols).collect(), key=key)
    assert left.select(hot_keys(left, "k", 500).alias("h")).first().h == {7: 4}


def test_lookup_really_spreads(spark):
    left = spark.range(4000).select("id", F.lit(7).cast("long").alias("k"))
    right = spark.createDataFrame([(7, "x")], "k long, v string")
    plan = lookup(left, right, "k", "left", min_rows=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_detach_keeps_newest(spark):
    rows = [("1", "a", hours(1), hours(0)), ("2", "a", hours(2), hours(0)), ("3", "a", None, hours(9)), ("4", None, hours(1), hours(0))]
    got = merge.detach_older_stories(spark.createDataFrame(rows, "id string, article_id string, fetched_at timestamp, created_at timestamp"))
    assert {r.id: r.article_id for r in got.collect()} == {"1": None, "2": "a", "3": None, "4": None}


def test_pages_join_up(entities):
    store = Store.of(entities)
    whole = [r.id for r in feed(store, FeedQuery(sort="newest", limit=30)).items.orderBy(F.col("created_at").desc(), "id").collect()]
    parts, offset = [], 0
    while offset is not None and len(parts) < 30:
        page = feed(store, FeedQuery(sort="newest", limit=10, offset=offset))
        parts += [r.id for r in page.items.orderBy(F.col("created_at").desc(), "id").collect()]
        offset = page.next_offset
    assert parts[:30] == whole


def test_feed_query_clamps():
    q = FeedQuery(sort="odd", limit=1000, offset=-3, q="  x ")
    assert (q.sort, q.limit, q.offset, q.q) == ("hot", 100, 0, "x")
    assert FeedQuery(limit=0).limit == 1


def test_bad_since_is_ignored(entities):
    from storyloom.operators.feed import filtered

    store = Store.of(entities)
    assert filtered(store, FeedQuery(since="not a date")).count() == filtered(store, FeedQuery()).count()


def test_snapshot_versions(spark, tmp_path):
    a = merge.write_snapshot(spark.range(3), str(tmp_path), "t", 1)
    b = merge.write_snapshot(spark.read.parquet(a).where("id > 0"), str(tmp_path), "t", 2)
    assert (spark.read.parquet(a).count(), spark.read.parquet(b).count()) == (3, 2)


def test_integrity_reports_every_rule_from_one_scan_per_table(spark):
    def frame(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    at = hours(1)
    story = "id long, source string, title string, created_at timestamp, fetched_at timestamp, hn_id int, article_id long"
    tables = {
        "story": frame(story, (1, "hn", "t", at, at, 5, 10), (2, "hn", "t", at, at, 5, 10), (3, "x", "t", at, at, None, None), (4, "hn", None, at, at, 6, 99)),
        "article": frame("id long, text string, content_hash string", (10, "a", "h"), (11, "b", "h"), (12, None, "g")),
        "summary": frame("id string, article_id long", ("s1", 10), ("s2", 10), ("s3", 98)),
        "embedding": frame("article_id long, model_key string", (10, "m"), (10, "m"), (97, "m")),
        "tag": frame("id string, slug string, kind string", ("t1", "a", "tech"), ("t2", "a", "odd")),
        "topic": frame("id string, slug string", ("p1", "a"), ("p2", "a")),
        "story_tag": frame("story_id long, tag_id string", (1, "t1"), (96, "t1"), (1, "no")),
        "story_topic": frame("story_id long, topic_id string", (1, "p1"), (95, "p1"), (1, "no")),
        "rank_signals": frame("story_id long", (1,), (94,)),
    }
    report = merge.integrity_report(tables)
    got = {(r.rule, r.key, r.n) for r in report.collect()}
    assert got == {
        ("story.hn_id", "5", 2), ("story.article_id", "10", 2), ("story.source", "3", 1), ("story.not_null", "4", 1), ("story.article", "99", 1),
        ("article.content_hash", "h", 2), ("article.not_null", "12", 1), ("summary.article_id", "10", 2), ("summary.article", "98", 1),
        ("embedding.article_model", "10/m", 2), ("embedding.article", "97", 1), ("tag.slug", "a", 2), ("tag.kind", "t2", 1), ("topic.slug", "a", 2),
        ("story_tag.story", "96", 1), ("story_tag.tag", "no", 1), ("story_topic.story", "95", 1), ("story_topic.topic", "no", 1), ("rank_signals.story", "94", 1),
    }
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == len(tables) and "Join" not in plan


def test_texts_of_articles_pass_one_join_without_a_sort(entities):
    """Only narrow rows are sorted on the way to an article; its text is streamed past a table of hashes."""
    plan = entities.article()._jdf.queryExecution().executedPlan().toString()
    joined = [line for line in plan.splitlines() if "ShuffledHashJoin" in line]
    sorted_ = [line for line in plan.splitlines() if "Sort [" in line]
    assert len(joined) == 1 and all("text" not in line for line in sorted_)
    above = plan[: plan.index("ShuffledHashJoin")]
    assert "SortMergeJoin" not in above and "BroadcastHashJoin" not in above


def test_first_copies_are_the_articles(spark, tmp_path):
    """Rows that repeat an id and a text are articles each, an id with two texts is two, null ids and texts are none."""
    from storyloom.sources.entities import Entities

    rows = [(3, "a", "en"), (1, "b", "de"), (2, "a", "fr"), (2, "a", "it"), (5, "c", "en"), (5, "d", "en"), (None, "e", "en"), (4, None, "en"), (9, "b", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"https://www.h{i}.example/x") for i in range(3)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    made = sorted(tuple(r) for r in Entities(spark, str(tmp_path)).article().select("id", "language", "text").collect())
    assert made == [(1, "de", "b"), (2, "fr", "a"), (2, "it", "a"), (5, "en", "c"), (5, "en", "d")]


def test_posts_are_not_sorted_to_learn_their_first_copy(entities):
    plan = entities.stories()._jdf.queryExecution().executedPlan().toString()
    joined = next(line for line in plan.splitlines() if "[copy#" in line and "Join" in line)
    assert "ShuffledHashJoin" in joined and "BuildRight" in joined
