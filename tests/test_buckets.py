"""Merges rewrite the buckets they touch; marks are joined where they lie and expire by day."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from storyloom.operators import buckets, merge


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


STORY = "id string, source string, hn_id int, title string, url string, domain string, author string, points int, comments_count int, created_at timestamp, fetched_at timestamp, article_id string"
T0 = dt.datetime(2024, 1, 1)


def test_an_upsert_leaves_other_buckets_as_they_are(spark, tmp_path):
    path = str(tmp_path / "stories")
    rows = [(f"s{i}", "hn", i, f"t{i}", f"https://e.com/{i}", "e.com", "a", i, None, T0, T0, None) for i in range(400)]
    rows += [(f"u{i}", "blog", None, "t", "https://b.com/", "b.com", "a", 1, 1, T0, T0, None) for i in range(20)]
    target = spark.createDataFrame(rows, STORY)
    key = F.coalesce(F.col("hn_id").cast("string"), F.col("id"))
    arriving = F.coalesce(F.col("hn_id").cast("string"), F.sha2(F.concat(F.lit("seq:"), F.col("seq").cast("string")), 256))
    buckets.create(target, path, key, 32)
    incoming = spark.createDataFrame(
        [("hn", 7, "new", "https://e.com/7", "b", None, 3, T0, 1), ("hn", 9999, "x", "https://e.com/x", "b", 1, 1, T0, 2), ("blog", None, "y", None, "c", 1, 1, T0, 3)],
        "source string, hn_id int, title string, url string, author string, points int, comments_count int, created_at timestamp, seq long",
    )
    now = F.lit(T0 + dt.timedelta(days=1))
    before = files(path)
    touched = buckets.merge_into(path, incoming, key, arriving, lambda t, n: merge.story_upsert(t, n, now), 32)
    after = files(path)
    assert 1 <= len(touched) <= 3
    inside = lambda f: any(f"/bucket={b}/" in f for b in touched)
    assert {f: t for f, t in before.items() if not inside(f)} == {f: t for f, t in after.items() if not inside(f)}
    assert not any(f in after for f in before if inside(f))
    want = merge.story_upsert(target, incoming, now)
    assert sorted(map(tuple, buckets.read(spark, path).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    # a replay of the same rows changes nothing
    buckets.merge_into(path, incoming.where("hn_id is not null"), key, arriving, lambda t, n: merge.story_upsert(t, n, now), 32)
    assert buckets.read(spark, path).count() == want.count()
    assert buckets.merge_into(path, incoming.where("seq > 9"), key, arriving, lambda t, n: merge.story_upsert(t, n, now), 32) == []


def test_rows_that_leave_their_bucket_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, 0) for i in range(50)], "id long, n int")
    buckets.create(rows, path, F.col("id"), 16)
    with pytest.raises(ValueError):
        buckets.merge_into(path, rows.where("id = 1"), F.col("id"), F.col("id"), lambda t, n: t.withColumn("id", F.col("id") + 1), 16)
    assert sorted(r.id for r in buckets.read(spark, path).collect()) == list(range(50))


def test_marks_are_not_shuffled_and_expired_days_not_read(spark, tmp_path):
    table = f"marks_{uuid.uuid4().hex}"
    buckets.create_marks(spark, table, {"story_id": "string"}, 4, str(tmp_path / table))
    at = lambda day: dt.datetime(2024, 1, day, 12)
    buckets.add_marks(table, spark.createDataFrame([("a", at(1)), ("b", at(5)), ("c", at(9)), ("d", at(20))], "story_id string, done_at timestamp"))
    buckets.add_marks(table, spark.createDataFrame([("e", at(5))], "story_id string, done_at timestamp"))
    jobs = spark.createDataFrame([(x, i) for i, x in enumerate("abcdefa")], "story_id string, seq int")
    now = F.lit(at(10))
    left = buckets.without_marks(jobs, table, ["story_id"], now)
    assert sorted((r.story_id, r.seq) for r in left.collect()) == [("a", 0), ("a", 6), ("d", 3), ("f", 5)]
    plan = left._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 1, plan
    scan = left._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in scan and "Bucketed: true" in scan
    assert buckets.drop_expired(spark, table, dt.date(2024, 1, 6)) == 2
    assert {r.story_id for r in spark.table(table).collect()} == {"c", "d"}
    spark.sql(f"DROP TABLE {table}")
