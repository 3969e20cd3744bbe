"""The stages chained over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import urls as U
from storyloom.operators import ingest, stages
from storyloom.plans.extract_queries import TEXT
from storyloom.plans.ingest_queries import GOOD, NOW_MS, RUN_AT
from storyloom.plans.registry import query
from storyloom.plans.text_queries import CLEAN, LABELS
from storyloom.session import durable
from storyloom.sources.entities import ts


LINK = "regexp_replace(regexp_replace({0}, '#.*$', ''), '\\?utm_source=feed$', '')"
STATUS = "CASE WHEN length(link) % 7 = 0 THEN 404 WHEN length(link) % 5 = 0 THEN 503 ELSE 200 END"


def _answers(jobs):
    """What a model might answer to summarize jobs: one message for each, every eighth without a summary."""
    said = lambda path: F.get_json_object("value", path)
    head = F.coalesce(F.trim(F.regexp_replace(said("$.article.text_head"), r"\s+", " ")), F.lit(""))
    message = F.struct(
        said("$.trace_id").alias("trace_id"), said("$.story.id").alias("story_id"), said("$.article.id").alias("article_id"), F.lit("m1").alias("model"),
        said("$.article.language").alias("lang"), F.when(F.length(said("$.story.url")) % 8 != 0, F.concat(F.lit("About "), said("$.story.domain"), F.lit(": "), head)).alias("summary"),
        F.struct(F.lit("article").alias("type"), F.array(said("$.story.source"), F.lit("read")).alias("tags"), F.array(said("$.story.domain")).alias("topics")).alias("classification"),
        F.struct(F.substring(head, 1, 20).alias("summary_140")).alias("ui"), F.create_map(F.lit("summarized_at"), F.lit("2024-02-02T00:00:00Z")).alias("timestamps"),
    )
    return jobs.select(F.to_json(message).alias("value"), F.abs(F.xxhash64("value") % 1_000_000_000).alias("seq"))


@query("stages_end_to_end", f"""
    WITH good AS (SELECT id, arg_max(url, seq) AS url, arg_max(text, seq) AS text FROM fx_item WHERE {GOOD} GROUP BY id),
    canon AS (SELECT g.*, {LINK.format('g.url')} AS link FROM good g WHERE g.url IS NOT NULL),
    landed AS (SELECT DISTINCT {LINK.format('url')} AS link FROM pages WHERE length({LINK.format('url')}) % 6 <> 0),
    fate AS (SELECT c.*, CASE WHEN l.link IS NULL THEN 503 ELSE {STATUS.replace('link', 'c.link')} END AS status,
             regexp_replace(lower(regexp_extract(c.link, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM canon c LEFT JOIN landed l USING (link)),
    page AS (SELECT {LINK.format('url')} AS link, min({TEXT}) AS text FROM pages GROUP BY 1),
    got AS (SELECT f.*, p.text AS body FROM fate f JOIN page p USING (link) WHERE f.status = 200),
    told AS (SELECT * FROM got WHERE length(url) % 8 <> 0)
    SELECT 'story' AS stage, count(*) AS n FROM good
    UNION ALL SELECT 'scrape_job', count(*) FROM good WHERE url IS NOT NULL
    UNION ALL SELECT 'text_job', 3 * count(*) FROM good WHERE url IS NULL
    UNION ALL SELECT 'article', count(DISTINCT (host, body)) FROM got
    UNION ALL SELECT 'link', count(*) FROM got
    UNION ALL SELECT 'summarize_job', count(*) FROM got
    UNION ALL SELECT 'retry', count(*) FROM fate WHERE status = 503
    UNION ALL SELECT 'dead', count(*) FROM fate WHERE status = 404
    UNION ALL SELECT 'summary', count(*) FROM told
    UNION ALL SELECT 'result_dead', count(*) FROM got WHERE length(url) % 8 = 0
    UNION ALL SELECT 'tag', CASE WHEN count(*) > 0 THEN 2 ELSE 0 END FROM told
    UNION ALL SELECT 'story_topic', count(*) FROM told""")
def stages_end_to_end(e):
    """Items to stories, jobs, articles, summarize jobs, answers and vocabulary, each stage fed by the one before."""
    good = ingest.current_items(ingest.good_items(e.item(), ts(RUN_AT)))
    first = stages.ingest_stage(good)
    jobs = first["job"].where("job_type = 'SCRAPE'").select("value")
    link = F.length(U.canonical_url(F.col("url")))
    status = F.when(link % 7 == 0, 404).when(link % 5 == 0, 503).otherwise(200)
    bodies = e.t.pages.where(link % 6 != 0).select("url", status.alias("status"), F.lit("text/html").alias("content_type"), "html")
    second = stages.scrape_stage(jobs, bodies, F.lit("en"), F.lit(NOW_MS))
    # read by several tables: the answers are made once
    third = stages.persist_stage(durable(_answers(second["summarize_job"])))
    counted = {
        "story": first["story"], "scrape_job": jobs, "text_job": first["job"].where("job_type <> 'SCRAPE'"),
        **{k: second[k] for k in ("article", "link", "summarize_job", "retry", "dead")},
        **{k: third[k] for k in ("summary", "tag", "story_topic")}, "result_dead": third["dead"],
    }
    out = None
    for name, df in counted.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("persist_result", f"""
    WITH {CLEAN}, {LABELS}
    SELECT 'summary' AS made, count(*) AS n FROM clean WHERE errors = ''
    UNION ALL SELECT 'dead', count(*) FROM clean WHERE errors <> ''
    UNION ALL SELECT 'tag', count(DISTINCT slug) FROM labels_of WHERE kind = 'tag'
    UNION ALL SELECT 'story_topic', count(*) FROM (SELECT DISTINCT story_id, slug FROM labels_of WHERE kind = 'topic')""")
def persist_result(e):
    """What the landed result messages add to the tables."""
    made = stages.persist_stage(e.result_json())
    out = None
    for name in ("summary", "dead", "tag", "story_topic"):
        part = made[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("made"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("retry_twice", f"""
    WITH j AS (SELECT page_id, url FROM pages WHERE url LIKE 'http%'), first AS (
        SELECT 't' || page_id AS trace_id, page_id % 3 AS kind FROM j)
    SELECT trace_id, CASE kind WHEN 0 THEN 'article' WHEN 1 THEN 'dead' ELSE 'dead' END AS fate,
           CAST(CASE kind WHEN 2 THEN 1 ELSE 0 END AS INT) AS passes FROM first""")
def retry_twice(e):
    """Every third page is fetched, fails for good, or fails twice: the second failure is dead."""
    pages = e.t.pages.where("url like 'http%'")
    status = F.element_at(F.array(F.lit(200), F.lit(404), F.lit(503)), (F.col("page_id") % 3 + 1).cast("int"))
    host = F.concat(F.lit("https://retry.example.com/"), F.col("page_id"))
    bodies = pages.select(host.alias("url"), status.alias("status"), F.lit("text/html").alias("content_type"), F.concat(F.lit("<p>"), host).alias("html"))
    none = F.lit(None).cast("string")
    story = F.struct(
        F.col("page_id").cast("string").alias("id"), F.lit(None).cast("int").alias("hn_id"), F.lit("hn").alias("source"), F.lit("t").alias("title"),
        host.alias("url"), none.alias("domain"), none.alias("author"), F.lit("2024-01-01T00:00:00.000Z").alias("created_at"),
    )
    job = F.struct(F.concat(F.lit("t"), "page_id").alias("trace_id"), story.alias("story"), F.lit(0).alias("attempt"), F.lit(1).alias("schema_version"))
    jobs = pages.select(F.to_json(job, {"ignoreNullFields": "false"}).alias("value"))
    first = stages.scrape_stage(jobs, bodies, F.lit("en"), F.lit(NOW_MS))
    second = stages.scrape_stage(first["retry"].select("value"), bodies, F.lit("en"), F.lit(NOW_MS))
    trace = F.get_json_object("value", "$.trace_id")
    out = None
    for passes, step in enumerate((first, second)):
        made = step["summarize_job"].select(trace.alias("trace_id"), F.lit("article").alias("fate"))
        ended = step["dead"].select(trace.alias("trace_id"), F.lit("dead").alias("fate"))
        part = made.unionByName(ended).withColumn("passes", F.lit(passes))
        out = part if out is None else out.unionByName(part)
    return out
