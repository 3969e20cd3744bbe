"""Candidate, job, routing, state and metrics queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import buckets, ingest, metrics
from storyloom.plans.registry import query
from storyloom.session import shared_dir
from storyloom.sources.entities import ts

CAPS = {"signup": 20, "error": 50, "click": 50, "view": 100, "purchase": 100}
ONE_SHOT = {"view": 200, "click": 200}
RUN_AT = "2024-01-16 12:00:00"
CUTOFF = "CAST(epoch(TIMESTAMP '2024-01-16 12:00:00') AS BIGINT) - 129600"
GOOD = f"""(type = 'story' AND NOT dead AND NOT deleted AND time >= {CUTOFF}
            AND (coalesce(score, 0) >= 50 OR coalesce(descendants, 0) >= 20))"""


def _caps(caps):
    return f"(VALUES {', '.join(f'({n!r}, {c})' for n, c in caps.items())}) c(list_name, cap)"


def _capped(caps):
    return f"""SELECT l.list_name, pos, item_id, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY list_name ORDER BY pos) AS INT) AS rank FROM fx_list) l
        JOIN {_caps(caps)} ON l.list_name = c.list_name AND rank <= cap"""


@query("list_cap", _capped(CAPS))
def list_cap(e):
    return ingest.capped_lists(e.ranked_list(), CAPS)


@query("candidates_distinct", f"SELECT DISTINCT item_id AS id FROM ({_capped(CAPS)})")
def candidates_distinct(e):
    return ingest.candidates(e.ranked_list(), CAPS)


@query("oneshot_candidates", f"SELECT DISTINCT item_id AS id FROM ({_capped(ONE_SHOT)})")
def oneshot_candidates(e):
    return ingest.candidates(e.ranked_list(), ONE_SHOT)


@query("updates_tail", "SELECT event_id AS pos, user_id AS item_id FROM events ORDER BY event_id DESC LIMIT 200")
def updates_tail(e):
    return ingest.updates_tail(e.ranked_list().select("pos", "item_id"))


@query("unseen_anti", f"""
    SELECT DISTINCT item_id AS id FROM ({_capped(CAPS)}) WHERE item_id NOT IN (SELECT id FROM fx_seen)""")
def unseen_anti(e):
    return ingest.unseen(ingest.candidates(e.ranked_list(), CAPS), e.seen())


@query("item_to_story", """
    SELECT 'hn' AS source, CAST(id AS INT) AS hn_id, title, url, poster AS author,
           strftime(make_timestamp(time * 1000000), '%Y-%m-%d %H:%M:%S.%f') AS created_at,
           nullif(score, 0) AS points, nullif(descendants, 0) AS comments_count, text, seq
    FROM fx_item WHERE type = 'story'""")
def item_to_story(e):
    return ingest.items_to_stories(ingest.parse_items(e.item_json()))


@query("submission_to_story", """
    SELECT source, hn_id, title, url, domain, author, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
           points, comments_count, text, seq FROM fx_submission""")
def submission_to_story(e):
    return ingest.submissions_to_stories(e.submission_json(), ts("2024-02-01 00:00:00"))


@query("quality_filter", f"SELECT seq, id, score, descendants FROM fx_item WHERE {GOOD}")
def quality_filter(e):
    return ingest.good_items(e.item(), ts(RUN_AT)).select("seq", "id", "score", "descendants")


@query("run_funnel", f"""
    WITH now AS (SELECT id, arg_max(struct_pack(g := {GOOD}), seq).g AS good FROM fx_item GROUP BY id),
    cand AS (SELECT DISTINCT item_id AS id FROM ({_capped(CAPS)})),
    a AS (SELECT c.id, s.id IS NULL AS new, n.id IS NOT NULL AS fetched, coalesce(n.good, false) AS good
          FROM cand c LEFT JOIN fx_seen s USING (id) LEFT JOIN now n USING (id)),
    up AS (SELECT user_id AS id FROM events ORDER BY event_id DESC LIMIT 200),
    b AS (SELECT u.id, s.id IS NULL AND k.id IS NULL AS fresh, n.id IS NOT NULL AS fetched, coalesce(n.good, false) AS good
          FROM up u LEFT JOIN fx_seen s USING (id) LEFT JOIN now n USING (id)
          LEFT JOIN (SELECT id FROM a WHERE new AND good) k USING (id))
    SELECT count(*) AS candidates, count(*) FILTER (WHERE new) AS unseen, count(*) FILTER (WHERE new AND fetched) AS fetched,
           count(*) FILTER (WHERE new AND good) AS keepers, count(*) FILTER (WHERE new AND good) AS processed,
           (SELECT count(*) FROM b) AS updates_considered, (SELECT count(*) FROM b WHERE fresh) AS updates_unseen,
           (SELECT count(*) FROM b WHERE fresh AND good) AS updates_processed,
           count(*) FILTER (WHERE new AND NOT fetched) + (SELECT count(*) FROM b WHERE fresh AND NOT fetched) AS fetch_errors,
           (SELECT count(*) FROM (VALUES {", ".join(f"('{c}')" for c in CAPS)}) v(n) WHERE n NOT IN (SELECT event_type FROM events)) AS list_errors,
           (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM events)::BIGINT AS update_errors,
           (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM events)::BIGINT AS tick_errors FROM a""")
def run_funnel(e):
    lists = e.ranked_list()
    return ingest.funnel(lists, CAPS, lists.select("pos", "item_id"), e.item(), e.seen(), ts(RUN_AT))


@query("seen_dedupe", f"""
    WITH RECURSIVE runs AS (
        SELECT DISTINCT id, CAST(make_timestamp(time * 1000000) AS DATE) AS run FROM fx_item
        WHERE {GOOD.replace(CUTOFF, '0')}),
    kept AS (SELECT id, min(run) AS run FROM runs GROUP BY id
             UNION ALL
             SELECT k.id, (SELECT min(r.run) FROM runs r WHERE r.id = k.id AND r.run >= k.run + 7) FROM kept k
             WHERE EXISTS (SELECT 1 FROM runs r WHERE r.id = k.id AND r.run >= k.run + 7))
    SELECT id, strftime(run, '%Y-%m-%d') AS run FROM kept""")
def seen_dedupe(e):
    good = e.item().where(ingest.is_good(F.lit(0)))
    out = ingest.kept_runs(good, F.to_date(F.timestamp_seconds("time")))
    return out.select("id", F.date_format("run", "yyyy-MM-dd").alias("run"))


IDEMPOTENT = """
    SELECT e.event_id, e.user_id AS story_id FROM events e WHERE NOT EXISTS (
        SELECT 1 FROM fx_done d WHERE d.story_id = e.user_id AND d.model = 'm1'
        AND d.done_at > TIMESTAMP '2024-02-01' - INTERVAL 7 DAY AND d.done_at <= TIMESTAMP '2024-02-01')"""


@query("idempotent_filter", IDEMPOTENT)
def idempotent_filter(e):
    jobs = e.events().select("event_id", F.col("user_id").alias("story_id"), F.lit("m1").alias("model"))
    return ingest.not_done(jobs, e.done(), ["story_id", "model"], ts("2024-02-01")).drop("model")


@query("idempotent_marks", IDEMPOTENT)
def idempotent_marks(e):
    """The same filter against a stored table of marks, which is neither shuffled nor read beyond its retention period."""
    table = f"marks_{uuid.uuid4().hex}"
    buckets.create_marks(e.spark, table, {"story_id": "bigint", "model": "string"}, 4, f"{shared_dir(e.spark)}/{table}")
    buckets.add_marks(table, e.done())
    jobs = e.events().select("event_id", F.col("user_id").alias("story_id"), F.lit("m1").alias("model"))
    return buckets.without_marks(jobs, table, ["story_id", "model"], ts("2024-02-01")).drop("model")


@query("publish_once", """
    WITH j AS (SELECT event_id AS seq, user_id, CASE WHEN k % 10 <> 0 THEN event_type || user_id END AS job_key FROM fx_events)
    SELECT job_key, seq, user_id FROM j WHERE job_key IS NULL
    UNION ALL SELECT job_key, min(seq), arg_min(user_id, seq) FROM j WHERE job_key IS NOT NULL GROUP BY job_key""")
def publish_once(e):
    jobs = e.events().select(
        F.col("event_id").alias("seq"), "user_id",
        F.when(F.col("k") % 10 != 0, F.concat("event_type", "user_id")).alias("job_key"),
    )
    return ingest.publish_once(jobs, ["user_id"])


@query("job_fanout", """
    SELECT seq AS story_id, job_type, CASE WHEN job_type = 'SCRAPE' THEN 'scrape' ELSE 'queue' END AS route,
           CASE WHEN job_type = 'SCRAPE' THEN 0 ELSE 1 END AS attempt,
           CASE WHEN job_type = 'SCRAPE' THEN url END AS url, CASE WHEN job_type = 'EMBED' THEN 'default' END AS model_key
    FROM fx_item, LATERAL (SELECT unnest(CASE WHEN url <> '' THEN ['SCRAPE'] WHEN text <> '' THEN ['SUMMARIZE', 'EMBED', 'TAG'] ELSE [] END) AS job_type) t
    WHERE type = 'story'""")
def job_fanout(e):
    stories = ingest.items_to_stories(e.item()).withColumn("id", F.col("seq"))
    out = ingest.jobs_of(stories)
    return out.select(
        "story_id", "job_type", "route", "attempt",
        F.get_json_object("value", "$.story.url").alias("url"), F.get_json_object("value", "$.model_key").alias("model_key"),
    )


@query("text_jobs", """
    SELECT seq AS story_id, t.job_type,
           CASE WHEN t.job_type = 'EMBED'
                THEN '{"job_key":null,"story_id":"' || seq || '","article_id":"a-' || h || '","model_key":"default","attempt":1}'
                ELSE '{"job_key":null,"story_id":"' || seq || '","article_id":"a-' || h || '","attempt":1}' END AS value
    FROM (SELECT *, sha1(regexp_replace(trim(text, E' \\t\\n\\r'), '\\s+', ' ', 'g')) AS h FROM fx_item
          WHERE type = 'story' AND coalesce(url, '') = '' AND text <> ''),
         LATERAL (SELECT unnest(['SUMMARIZE', 'EMBED', 'TAG']) AS job_type) t""")
def text_jobs(e):
    out = ingest.jobs_of(ingest.items_to_stories(e.item()).withColumn("id", F.col("seq")))
    return out.where("route = 'queue'").select("story_id", "job_type", "value")


JOB_REASON = """CASE WHEN broken THEN 'BAD_JSON' WHEN story_id IS NULL THEN 'BAD_PAYLOAD' WHEN url IS NULL THEN 'NO_URL' END"""


@query("job_decode", f"SELECT page_id, trace_id, story_id, url, attempt, schema_version, {JOB_REASON} AS reason FROM fx_job")
def job_decode(e):
    out = ingest.decode_jobs(e.job_raw())
    ok = F.col("reason").isNull() | (F.col("reason") != "BAD_JSON")
    return out.select(
        "page_id",
        *[F.when(ok, F.col(f"job.{c}")).alias(a) for c, a in (
            ("trace_id", "trace_id"), ("story.id", "story_id"), ("story.url", "url"),
            ("attempt", "attempt"), ("schema_version", "schema_version"))],
        "reason",
    )


NOW_MS = 1706745600000
DELAY = """CAST(floor(pow(2.0, attempt + 1) * 1000 * (1 + CAST(('0x' || substring(sha1(trace_id), 1, 8)) AS BIGINT) / 4294967296.0 * 0.25)) AS BIGINT)"""


def _failed_jobs(e):
    decoded = ingest.decode_jobs(e.job_raw()).where("reason IS NULL")
    state = ingest.scrape_retry(F.col("job.attempt"), F.col("job.trace_id"), F.lit(NOW_MS))
    return decoded.select("page_id", F.col("job.trace_id").alias("trace_id"), state.alias("s")).select("page_id", "trace_id", "s.*")


RETRY = f"""
    SELECT page_id, trace_id, CASE WHEN attempt + 1 < 2 THEN 'retry' ELSE 'dead' END AS route,
           CASE WHEN attempt + 1 < 2 THEN attempt + 1 ELSE attempt END AS attempt,
           CASE WHEN attempt + 1 < 2 THEN {NOW_MS} + {DELAY} END AS visible_at
    FROM fx_job WHERE {JOB_REASON} IS NULL"""


@query("retry_route", RETRY)
def retry_route(e):
    return _failed_jobs(e)


@query("retry_visible", f"SELECT page_id, visible_at FROM ({RETRY}) WHERE route = 'retry' AND visible_at <= {NOW_MS} + 2200")
def retry_visible(e):
    return ingest.visible(_failed_jobs(e).where("route = 'retry'"), F.lit(NOW_MS + 2200)).select("page_id", "visible_at")


ERROR = "CASE k % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'json_parse_failed' WHEN 2 THEN 'llm_failed' END"
SUM_ROUTE = f"""
    SELECT event_id, CASE WHEN NOT valid THEN 'dead' WHEN err IS NULL THEN 'done' WHEN a + 1 < 3 THEN 'retry' ELSE 'dead' END AS route,
           CAST(CASE WHEN valid AND err IS NOT NULL AND a + 1 < 3 THEN a + 1 ELSE a END AS INT) AS attempt,
           CASE WHEN NOT valid THEN 'SCHEMA_MISMATCH' WHEN err = 'timeout' THEN 'LLM_TIMEOUT' WHEN err LIKE '%json_parse%' THEN 'JSON_PARSE'
                WHEN err IS NOT NULL THEN 'UNKNOWN' END AS reason
    FROM (SELECT event_id, event_id % 4 AS a, {ERROR} AS err, event_type <> 'error' AS valid FROM fx_events)"""


def _summarize_routes(e):
    state = ingest.summarize_retry(
        (F.col("event_id") % 4).cast("int"),
        F.when(F.col("k") % 5 == 0, "timeout").when(F.col("k") % 5 == 1, "json_parse_failed").when(F.col("k") % 5 == 2, "llm_failed"),
        F.col("event_type") != "error",
    )
    return e.events().select("event_id", state.alias("s")).select("event_id", "s.*")


@query("summarizer_route", SUM_ROUTE)
def summarizer_route(e):
    return _summarize_routes(e)


@query("dlq_by_reason", f"SELECT reason, count(*) AS n FROM ({SUM_ROUTE}) WHERE route = 'dead' AND reason IS NOT NULL GROUP BY reason")
def dlq_by_reason(e):
    return ingest.dead_by_reason(_summarize_routes(e).where("route = 'dead' and reason is not null"))


STATUS = """CASE WHEN status >= 500 OR status IN (401,403,406,408,409,412,429,451) THEN 'retryable'
                 WHEN status >= 400 THEN 'permanent' ELSE 'ok' END"""


@query("status_class", f"SELECT page_id, CAST(status AS INT) AS status, {STATUS} AS class FROM fx_fetch_log")
def status_class(e):
    return e.fetch_log().select("page_id", "status", ingest.status_class(F.col("status")).alias("class"))


@query("mime_gate", """
    SELECT page_id, CASE WHEN content_type ILIKE '%html%' OR lower(url) LIKE '%.html' THEN 'ok' ELSE 'UNSUPPORTED_MIME' END AS route
    FROM fx_fetch_log""")
def mime_gate(e):
    ok = ingest.is_html(F.col("content_type"), F.col("url"))
    return e.fetch_log().select("page_id", F.when(ok, "ok").otherwise("UNSUPPORTED_MIME").alias("route"))


@query("paywall_flag", """
    SELECT page_id, len(list_filter(string_split_regex(html, '\\s+'), lambda w: w <> '')) < 1500
                    AND (lower(html) LIKE '%subscribe%' OR lower(html) LIKE '%paywall%') AS big_page,
           len(list_filter(string_split_regex(html, '\\s+'), lambda w: w <> '')) < 100
                    AND (lower(html) LIKE '%subscribe%' OR lower(html) LIKE '%paywall%') AS paywalled
    FROM fx_fetch_log""")
def paywall_flag(e):
    words = T.word_count(F.col("html"))
    # the second flag scales the word count down so that both outcomes occur in the data
    return e.fetch_log().select(
        "page_id",
        ingest.paywalled(words / 15, F.col("html")).alias("big_page"),
        ingest.paywalled(words, F.col("html")).alias("paywalled"),
    )


@query("embedding_backlog", """
    SELECT id AS article_id, 'default' AS model_key, 1 AS attempt FROM fx_story
    WHERE id = article_id AND id NOT IN (SELECT article_id FROM fx_embedding)""")
def embedding_backlog(e):
    return ingest.embedding_backlog(e.article_text(), e.embedding())


# -- metrics -------------------------------------------------------------------

DAILY = """SELECT strftime(ran_at, '%Y-%m-%d') AS day, kind, name, round(sum(value), 4) AS value FROM fx_metrics GROUP BY 1, 2, 3"""


def _daily(e):
    out = metrics.daily(e.metrics())
    return out.withColumn("value", F.round("value", 4))


@query("metrics_daily", DAILY)
def metrics_daily(e):
    return _daily(e).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("metrics_last_run", """
    SELECT run_id, kind, name, value, strftime(ran_at, '%Y-%m-%d %H:%M:%S.%f') AS ran_at FROM fx_metrics
    WHERE run_id = (SELECT arg_max(run_id, ran_at) FROM fx_metrics)""")
def metrics_last_run(e):
    return metrics.last_run(e.metrics()).select("run_id", "kind", "name", "value", F.col("at").alias("ran_at"))


@query("metrics_retained", f"SELECT * FROM ({DAILY}) WHERE day >= '2024-01-20'")
def metrics_retained(e):
    kept = metrics.retained(_daily(e), ts("2024-01-28"))
    return kept.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("redact_json", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
           '[REDACTED]' AS token, '[REDACTED]' AS password, '[REDACTED]' AS secret, CAST(k AS VARCHAR) AS n, event_type
    FROM fx_events""")
def redact_json(e):
    out = e.log().select("event_id", metrics.redact_json("row").alias("row"))
    paths = {
        "level": "$.level", "token": "$.Token", "password": "$.ctx.password", "secret": "$.ctx.items[0].secret",
        "n": "$.ctx.items[0].n", "event_type": "$.ctx.event_type",
    }
    return out.select("event_id", *[F.get_json_object("row", p).alias(c) for c, p in paths.items()])


@query("mask_url", """
    SELECT event_id, 'redis://' || CASE k % 3 WHEN 0 THEN 'user' || user_id || ':***@' WHEN 1 THEN '***@' ELSE '' END
           || 'cache.example:6379/0' AS url FROM fx_events""")
def mask_url(e):
    return e.log().select("event_id", T.mask_url(F.col("url")).alias("url"))
