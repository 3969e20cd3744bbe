"""Rules of the summarize job, and what a failed scrape job carries back."""

import json

import pytest
from pyspark.sql import functions as F

from storyloom.operators import ingest, results, stages

GOOD = {
    "trace_id": "t", "story": {"id": "1", "hn_id": 5, "source": "hn", "title": "a", "url": "u", "domain": "d", "created_at": "c"},
    "article": {"id": "a", "language": "en", "word_count": 3}, "hints": None, "metrics": None,
}


def put(path, value):
    job = json.loads(json.dumps(GOOD))
    if path.startswith("hints."):
        job["hints"] = {"source_reputation": 0.5}
    if path.startswith("metrics."):
        job["metrics"] = {"points": 1, "comments": None, "captured_at": None}
    *parts, last = path.split(".")
    here = job
    for p in parts:
        here = here[p]
    here[last] = value
    return json.dumps(job)


ACCEPTED = [
    ("trace_id", "x"), ("hints.source_reputation", 0.375), ("hints.source_reputation", 12.5), ("hints.source_reputation", "1.5"), ("hints.source_reputation", None),
    ("hints.candidate_tags", ["a"]), ("hints.candidate_tags", []), ("hints.candidate_tags", None), ("article.word_count", "12"), ("article.word_count", 12.0),
    ("article.word_count", None), ("article.headings", ["h"]), ("article.headings", None), ("article.is_pdf", "true"), ("attempt", "2"), ("attempt", 3),
    ("schema_version", 1), ("schema_version", "1"), ("metrics.points", 7.0),
]
REJECTED = [
    ("trace_id", 5), ("hints.source_reputation", "x"), ("hints.source_reputation", []), ("hints.candidate_tags", 5), ("hints.candidate_tags", [1]),
    ("article.word_count", 12.5), ("article.word_count", "zz"), ("article.headings", "abc"), ("article.headings", [None]), ("article.is_pdf", "maybe"),
    ("attempt", "zz"), ("attempt", None), ("schema_version", "abc"), ("schema_version", None), ("schema_version", 2), ("metrics.captured_at", 5), ("article.language", "e"),
]


def test_job_rules(spark):
    rows = [(i, put(p, v)) for i, (p, v) in enumerate(ACCEPTED + REJECTED)]
    got = {r.i: r for r in results.validate_jobs(spark.createDataFrame(rows, "i int, value string")).collect()}
    for i, (path, value) in enumerate(ACCEPTED + REJECTED):
        assert (got[i].reason is None) == (i < len(ACCEPTED)), (path, value, got[i].errors)
        if i >= len(ACCEPTED):
            assert got[i].errors == [path]


def test_retried_job_counts_up(spark):
    story = {"id": "1", "hn_id": 1, "source": "hn", "title": "t", "url": "https://a.example.com/x", "domain": None, "author": None, "created_at": "2024-01-01T00:00:00.000Z"}
    job = json.dumps({"trace_id": "t1", "story": story, "attempt": 0, "schema_version": 1})
    bodies = spark.createDataFrame([("https://a.example.com/x", 503, "text/html", "<p>later")], "url string, status int, content_type string, html string")
    seen, value = [], job
    for _ in range(4):
        out = stages.scrape_stage(spark.createDataFrame([(value,)], "value string"), bodies, F.lit("en"), F.lit(0).cast("long"))
        again = out["retry"].collect()
        if not again:
            assert out["dead"].count() == 1
            break
        seen.append(json.loads(again[0].value)["attempt"])
        assert json.loads(again[0].value)["visible_at"] == again[0].visible_at
        value = again[0].value
    else:
        pytest.fail("never a dead letter")
    assert seen == list(range(1, len(seen) + 1)) and seen
    assert ingest is not None


def test_fetched_body_wins(spark):
    story = {"id": "1", "hn_id": 1, "source": "hn", "title": "t", "url": "https://a.example.com/x", "domain": None, "author": None, "created_at": "2024-01-01T00:00:00.000Z"}
    jobs = spark.createDataFrame([(json.dumps({"trace_id": "t1", "story": story, "attempt": 0, "schema_version": 1}),)], "value string")
    for n in range(6):
        rows = [("https://a.example.com/x", 500, "text/html", f"<p>error {n}"), ("https://a.example.com/x", 200, "text/html", f"<p>page {n}")]
        out = stages.scrape_stage(jobs, spark.createDataFrame(rows, "url string, status int, content_type string, html string"), F.lit("en"), F.lit(0).cast("long"))
        assert [r.text for r in out["article"].collect()] == [f"page {n}"]


def test_result_messages_are_parsed_once(spark):
    from storyloom.operators import results, stages

    messages = spark.createDataFrame([('{"trace_id": "t"}', 1), ("{", 2)], "value string, seq long")
    plan = results.decode_results(messages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.count("parseJson") <= 1
    made = stages.persist_stage(messages)
    assert made["dead"].count() == 2 and made["summary"].count() == made["tag"].count() == 0
    assert all("json" not in made[k]._jdf.queryExecution().optimizedPlan().toString().lower().split("scan")[0] for k in ("tag", "story_topic"))
