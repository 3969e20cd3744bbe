"""Streams drained with availableNow: twins of the batch forms, replays, stages in a row."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from storyloom.operators import ingest, metrics
from storyloom.streaming import jobs as J


@pytest.fixture
def root(spark, tmp_path):
    """A fresh folder, with few state partitions and the RocksDB store while streaming."""
    wanted = {"spark.sql.shuffle.partitions": "2", "spark.sql.streaming.stateStore.providerClass": J.ROCKSDB}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield str(tmp_path)
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def drain(stream, path, name, mode="append"):
    q = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", f"{path}/ck-{name}").trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_first_seen_equals_batch_twin(spark, entities, root):
    entities.item_json().coalesce(1).write.parquet(f"{root}/items")
    out = drain(J.first_seen_in_event_time(J.item_stream(spark, f"{root}/items"), F.lit(0)), root, "seen")
    ids = {r.id for r in out.collect()}
    batch = entities.item().where(ingest.is_good(F.lit(0)))
    assert ids == {r.id for r in batch.select("id").distinct().collect()}
    assert out.count() == len(ids)  # all rows of one micro-batch: one per id


def test_daily_counters_equal_batch_twin(spark, entities, root):
    entities.metrics().coalesce(1).write.parquet(f"{root}/m")
    schema = spark.read.parquet(f"{root}/m").schema
    stream = J.daily_counters(spark.readStream.schema(schema).parquet(f"{root}/m"))
    got = drain(stream, root, "daily", "complete").select("day", "kind", "name", F.round("value", 3).alias("value"))
    want = metrics.daily(entities.metrics()).select("day", "kind", "name", F.round("value", 3).alias("value"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_publish_once(spark, root):
    rows = [("k", 1), ("k", 2), (None, 3), (None, 3)]
    spark.createDataFrame(rows, "job_key string, n int").coalesce(1).write.parquet(f"{root}/j")
    stream = spark.readStream.schema("job_key string, n int").parquet(f"{root}/j")
    out = drain(J.publish_once(stream), root, "once")
    assert out.where("job_key is null").count() == 2 and out.where("job_key = 'k'").count() == 1


def test_publish_once_forgets_keys_behind_the_watermark(spark, root):
    schema = "job_key string, n int, at long"

    def run(rows):
        _land(spark, f"{root}/j", 0, rows, schema)
        stream = spark.readStream.schema(spark.read.parquet(f"{root}/j").schema).parquet(f"{root}/j")
        got = []
        q = (
            J.publish_once(stream, at="at", within="100 seconds").writeStream.foreachBatch(lambda df, _: got.extend(r.n for r in df.collect()))
            .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
        )
        assert q.awaitTermination(120)
        return sorted(got)

    assert run([("k", 1, 1000), (None, 3, 1000)]) == [1, 3]
    assert run([("k", 4, 1050)]) == []
    assert run([("x", 5, 9000)]) == [5]
    assert run([("k", 6, 9001)]) == [6]


def test_mark_first_passes_a_key_once(spark, root):
    schema = "article_id string, model string, n int"
    spark.createDataFrame([("a", "m", 1), ("a", "m", 2), ("b", "m", 3)], schema).coalesce(1).write.parquet(f"{root}/s")
    seen = []
    stream = J.mark_first(spark.readStream.schema(schema).parquet(f"{root}/s"), ["article_id", "model"])
    q = (
        stream.writeStream.foreachBatch(lambda df, _: seen.extend((r.article_id, r.model) for r in df.collect()))
        .option("checkpointLocation", f"{root}/ck").trigger(processingTime="1 second").start()
    )
    try:
        end = time.time() + 60
        while not seen and time.time() < end and q.isActive:
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted(seen) == [("a", "m"), ("b", "m")]


def test_marks_keep_a_key_away_until_they_expire(spark, root):
    schema = "story_id string, seq int"

    def batch(rows):
        return spark.createDataFrame(rows, schema)

    def at(day):
        return lambda: F.lit(f"2024-01-{day:02d}").cast("timestamp")

    def kept(n, rows, day):
        stage = J.marking(lambda b: {"out": b}, root, ["story_id"], at(day), "seq")
        J.commit_batch(stage(batch(rows)), root, n)
        return sorted((r.story_id, r.seq) for r in J.read_table(spark, root, "out").where(F.col("batch") == n).collect())

    assert kept(0, [("a", 1), ("a", 2), ("b", 3)], 1) == [("a", 2), ("b", 3)]
    assert kept(1, [("a", 4), ("c", 5)], 3) == [("c", 5)]
    assert kept(2, [("a", 6), ("c", 7)], 8) == [("a", 6)]


def test_commit_is_one_write_and_replays_are_skipped(spark, root):
    frames = {"article": spark.range(3), "link": spark.createDataFrame([("s", 1)], "story string, n int")}
    assert J.commit_batch(frames, root, 5) is True
    assert J.commit_batch({**frames, "article": spark.range(99)}, root, 5) is False
    assert J.read_table(spark, root, "article").count() == 3
    assert J.read_table(spark, root, "link").first().story == "s"


def test_requeue(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "n int, visible_at long")
    out = J.requeue(rows, F.lit(10))
    assert {r.n for r in out["due"].collect()} == {1, 2} and {r.n for r in out["waiting"].collect()} == {3}


def test_stages_in_a_row(spark, entities, root):
    """Items to stories and jobs, jobs to articles, job text with broken rows, and a second
    drain of each stage that must change nothing."""
    items = entities.item_json()
    items.coalesce(1).write.parquet(f"{root}/items")
    from storyloom.operators import stages

    def ingest_once():
        stream = J.item_stream(spark, f"{root}/items").where(ingest.is_good(F.lit(0))).drop("ts")
        stage = J.marking(stages.ingest_stage, f"{root}/ingest", ["id"], lambda: F.lit("2024-02-01").cast("timestamp"), "seq")
        J.run_stage(stream, stage, f"{root}/ingest", f"{root}/ck1").awaitTermination(120)
        return J.read_table(spark, f"{root}/ingest", "job")

    jobs = ingest_once()
    n = jobs.count()
    assert n > 0 and ingest_once().count() == n
    log = J.read_table(spark, f"{root}/ingest", "story")
    assert J.current_stories(log).count() == log.select("id").distinct().count()

    bodies = entities.t.pages.select("url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), "html")

    def scrape_once():
        stream = J.follow_table(spark, f"{root}/ingest", "job").where("job_type = 'SCRAPE'").select("value")
        stage = J.scrape_stage(bodies, F.lit("en"), F.lit(0))
        J.run_stage(stream, stage, f"{root}/scrape", f"{root}/ck2").awaitTermination(180)
        return J.read_table(spark, f"{root}/scrape", "link")

    links = scrape_once()
    m = links.count()
    assert m == jobs.where("job_type = 'SCRAPE'").count() and scrape_once().count() == m
    articles = J.read_table(spark, f"{root}/scrape", "article")
    assert links.join(articles, "article_id", "left_anti").count() == 0
    assert J.read_table(spark, f"{root}/scrape", "summarize_job").count() == m


def test_job_text_is_never_lost(spark, entities, root):
    entities.job_raw().select("value").coalesce(1).write.text(f"{root}/raw")
    J.run_stage(J.text_stream(spark, f"{root}/raw"), J.decode_stage, f"{root}/out", f"{root}/ck").awaitTermination(120)
    good, dead = J.read_table(spark, f"{root}/out", "job"), J.read_table(spark, f"{root}/out", "dead")
    assert good.count() + dead.count() == entities.job_raw().count()
    assert {r.reason for r in dead.select("reason").distinct().collect()} == {"BAD_JSON", "BAD_PAYLOAD", "NO_URL"}


def test_seen_runs_against_day_by_day_walk(entities):
    """The batch form against a plain walk over the runs with a retained set."""
    good = entities.item().where(ingest.is_good(F.lit(0))).select("id", F.to_date(F.timestamp_seconds("time")).alias("run"))
    kept = {(r.id, r.run) for r in ingest.kept_runs(good, F.col("run")).collect()}
    marks, want = {}, set()
    for id_, run in sorted({(r.id, r.run) for r in good.collect()}, key=lambda x: (x[1], x[0])):
        if id_ not in marks or run - marks[id_] >= dt.timedelta(days=7):
            marks[id_] = run
            want.add((id_, run))
    assert kept == want


def _land(spark, root, n, rows, schema):
    """One more file for a file stream; event times are given in seconds."""
    df = spark.createDataFrame(rows, schema)
    for f in df.schema.fields:
        if f.name in ("at", "asked_at", "landed_at"):
            df = df.withColumn(f.name, F.timestamp_seconds(f.name))
    df.coalesce(1).write.mode("append").parquet(root)


def test_a_retry_job_is_held_over_micro_batches_and_released_once(spark, root):
    schema = "trace_id string, attempt int, visible_at long, value string, at long"
    out = []

    def run(rows):
        _land(spark, f"{root}/retry", 0, rows, schema)
        jobs = spark.readStream.schema(spark.read.parquet(f"{root}/retry").schema).parquet(f"{root}/retry")
        q = (
            J.delayed(jobs).writeStream.foreachBatch(lambda df, _: out.extend((r.trace_id, r.attempt, r.value) for r in df.collect()))
            .option("checkpointLocation", f"{root}/ck").outputMode("append").trigger(availableNow=True).start()
        )
        assert q.awaitTermination(120)
        found, out[:] = sorted(out), []
        return found

    assert run([("a", 1, 30_000, "A", 10), ("b", 1, 5_000, "B", 10), ("c", 1, None, "C", 10)]) in ([("b", 1, "B"), ("c", 1, "C")],)
    assert run([("a", 1, 30_000, "A", 20)]) == []  # not yet due, and no second copy of it
    assert run([("d", 2, 90_000, "D", 29)]) == []
    assert run([("x", 1, 500_000, "X", 40)]) == [("a", 1, "A")]
    assert run([("a", 1, 30_000, "A", 50), ("a", 2, 60_000, "A2", 50)]) == []  # the same attempt again, and a new one
    assert run([("y", 1, 500_000, "Y", 100)]) == [("a", 2, "A2"), ("d", 2, "D")]


def test_jobs_meet_late_missing_and_repeated_bodies(spark, root):
    job = "value string, trace_id string, url string, asked_at long"
    body = "url string, status int, content_type string, html string, landed_at long"
    page = lambda w: f"<html><article><p>{' '.join([w] * 120)}</p></article></html>"

    def ask(n, url):
        story = {"id": str(n), "hn_id": n, "source": "hn", "title": "t", "url": url, "domain": None, "author": None, "created_at": "2024-01-01T00:00:00.000Z"}
        return json.dumps({"trace_id": f"t{n}", "story": story, "attempt": 0, "schema_version": 1}), f"t{n}", url

    made = []

    def run(jobs, bodies):
        _land(spark, f"{root}/j", 0, jobs, job)
        _land(spark, f"{root}/b", 0, bodies, body)
        j, b = (spark.readStream.schema(spark.read.parquet(f"{root}/{x}").schema).parquet(f"{root}/{x}") for x in "jb")
        joined = J.jobs_with_bodies(j, b, wait="100 seconds", late="0 seconds")

        def write(batch, n):
            found = J.scrape_joined(batch, F.lit("en"), F.lit(0))
            trace = F.get_json_object("value", "$.trace_id")
            made.extend(("job", r[0]) for r in found["summarize_job"].select(trace).collect())
            made.extend(("retry", r.trace_id) for r in found["retry"].collect())

        q = joined.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/ck").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        got, made[:] = sorted(made), []
        return got

    u = "https://example.com/"
    # 1: body with the job; 2: body comes later; 3: never; 4: two bodies, one failed
    first = run(
        [(*ask(1, u + "1"), 1000), (*ask(2, u + "2"), 1000), (*ask(3, u + "3"), 1000), (*ask(4, u + "4"), 1000)],
        [(u + "1", 200, "text/html", page("one"), 1010), (u + "4", 503, "text/html", "", 1005), (u + "4", 200, "text/html", page("four"), 1006)],
    )
    assert first == [("job", "t1"), ("job", "t4")]
    assert run([(*ask(5, u + "5"), 1050)], [(u + "2", 200, "text/html", page("two"), 1060)]) == [("job", "t2")]
    # event time passes the window of jobs 3 and 5
    late = run([(*ask(6, u + "6"), 2000)], [(u + "9", 200, "text/html", page("nine"), 2000)])
    late += run([(*ask(7, u + "7"), 3000)], [(u + "8", 200, "text/html", page("eight"), 3000)])
    assert ("retry", "t3") in late and ("retry", "t5") in late and not [x for x in late if x[0] == "job"]


def test_followers_see_committed_batches_only(spark, root):
    frames = lambda n: {"a": spark.createDataFrame([(n,)], "n int")}
    J.commit_batch(frames(1), f"{root}/t", 1)
    # a batch that a lost driver left half written
    frames(9)["a"].select(F.lit("a").alias("kind"), F.struct("n").alias("a")).write.partitionBy("kind").parquet(f"{root}/t/_writing/batch=2")
    assert [r.n for r in J.read_table(spark, f"{root}/t", "a").collect()] == [1]
    assert J.commit_batch(frames(2), f"{root}/t", 2) is True
    out = drain(J.follow_table(spark, f"{root}/t", "a"), root, "followed")
    assert sorted(r.n for r in out.collect()) == [1, 2]
