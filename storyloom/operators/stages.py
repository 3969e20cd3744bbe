"""The curation stages as functions from tables to tables.

Each stage takes the rows that arrived and returns what it adds to the next tables; the
same functions serve a batch run and the micro-batches in ``storyloom.streaming``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions import urls as U
from storyloom.operators import extract, ingest, results
from storyloom.operators.skew import lookup
from storyloom.session import durable


def ingest_stage(items: DataFrame) -> dict[str, DataFrame]:
    """Good, unseen items to stories, jobs and text-only articles.

    A story's id comes from its item id, so the same item arriving again is the same story.
    """
    stories = ingest.items_to_stories(items).withColumns(
        {"id": F.sha2(F.concat(F.lit("hn:"), "hn_id"), 256), "domain": U.host_domain(F.col("url"))}
    )
    jobs = ingest.jobs_of(stories)
    # an empty URL is none
    only_text = stories.where("coalesce(length(url), 0) = 0 and length(text) > 0")
    return {
        "story": stories.drop("text"),
        "job": jobs,
        "article": only_text.select(
            F.col("id").alias("story_id"), F.lit("en").alias("language"), "text", T.word_count_js(F.col("text")).alias("word_count"),
            T.sha1_hash(F.col("text")).alias("content_hash"), ingest.text_article_id(F.col("text")).alias("article_id"), "seq",
        ),
    }


def scrape_stage(jobs: DataFrame, bodies: DataFrame, language: Column, now_ms: Column) -> dict[str, DataFrame]:
    """Scrape jobs to articles, summarize jobs, retries and dead letters.

    ``jobs``: value; ``bodies``: url, status, content_type, html. A page is extracted once
    however many stories link to it, and the link back spreads popular pages.
    """
    decoded = ingest.decode_jobs(jobs)
    good = decoded.where("reason is null").select(
        "value", "job", "job.trace_id", "job.attempt", F.col("job.story").alias("story"),
        U.canonical_url(F.col("job.story.url")).alias("url"),
    )
    bad = decoded.where("reason is not null").select("reason", "value")
    wanted = good.select("url").distinct()
    landed = bodies.withColumn("url", U.canonical_url(F.col("url"))).join(wanted, "url", "left_semi")
    # of several bodies of one page a fetched one is read, whatever failed before
    worse = ingest.status_class(F.col("status")).isin("retryable", "permanent")
    one = F.min_by(F.struct("status", "content_type", "html"), F.struct(F.coalesce(worse, F.lit(False)), F.xxhash64("html"))).alias("b")
    pages = landed.groupBy("url").agg(one).select("url", "b.*")
    words = T.word_count(F.col("text"))
    fetched = extract.read_pages(pages, "url", keep=["status", "content_type", "html"]).select(
        "url",
        extract.extract_route(F.col("status"), F.col("content_type"), F.col("url"), F.col("text")).alias("route"),
        "text", "headings", "author", words.alias("word_count"),
        ingest.paywalled(words, F.col("html")).alias("is_paywalled"),
    )
    # five tables are read from the extracted pages, which must not be parsed five times
    fetched = durable(fetched)
    done = lookup(good, fetched, "url", "left", spread="trace_id").withColumn("route", F.coalesce("route", F.lit("FETCH_RETRY")))
    ok = done.where("route = 'ok'")
    domain = U.host_domain(F.col("url"))
    rows = ok.select(
        "trace_id", F.col("story.id").alias("id"), F.col("story.hn_id").alias("hn_id"), F.col("story.source").alias("source"),
        F.col("story.title").alias("title"), F.col("story.url").alias("story_url"),
        F.try_to_timestamp("story.created_at").alias("created_at"),
        T.sha256_hash(language, domain, F.col("text")).alias("content_hash"), language.alias("language"),
        "text", "headings", "author", "word_count", "is_paywalled", domain.alias("domain"), "url",
    ).withColumn("article_id", F.concat(F.lit("a-"), "content_hash"))
    state = F.when(F.col("route") == "FETCH_RETRY", ingest.scrape_retry(F.col("attempt"), F.col("trace_id"), now_ms))
    failed = done.where("route <> 'ok'").withColumn("s", state)
    again = F.coalesce(F.col("s.route") == "retry", F.lit(False))
    # the job that comes back counts its attempts and says when it is due
    next_try = F.col("job").withField("attempt", F.col("s.attempt")).withField("visible_at", F.col("s.visible_at"))
    next_value = F.to_json(next_try, {"ignoreNullFields": "false"})
    dead = failed.where(~again).select(F.col("route").alias("reason"), "value").unionByName(bad)
    return {
        "article": rows.groupBy("content_hash").agg(
            F.min_by(F.struct("article_id", "language", "text", "word_count"), "id").alias("a")
        ).select("content_hash", "a.*"),
        "link": rows.select(F.col("id").alias("story_id"), "article_id", "domain", "author"),
        "summarize_job": extract.summarize_jobs(rows),
        "retry": failed.where(again).select("trace_id", "s.attempt", "s.visible_at", next_value.alias("value")),
        "dead": dead,
    }


def persist_stage(messages: DataFrame) -> dict[str, DataFrame]:
    """Result messages (``value``, ``seq``) to summary, tag, topic and link rows; unusable ones to dead letters as they came."""
    # six tables are read from the cleaned messages, which must not be parsed six times
    clean = durable(results.gate_results(results.clean_results(results.decode_results(messages.withColumn("_value", F.col("value"))))))
    usable = (F.size("errors") == 0) & F.col("skip").isNull()
    good = clean.where(usable)
    tags, topics = results.result_labels(good, "tags"), results.result_labels(good, "topics")
    why = F.coalesce("skip", F.lit("SCHEMA_MISMATCH"))
    return {
        "summary": results.result_summaries(good),
        "tag": tags.groupBy("slug").agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq")).withColumn("kind", F.lit("tech")),
        "topic": topics.groupBy("slug").agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq")),
        "story_tag": tags.select("story_id", "slug").distinct(),
        "story_topic": topics.select("story_id", "slug").distinct(),
        "dead": clean.where(~usable).select(why.alias("reason"), "errors", F.col("_value").alias("value")),
    }
