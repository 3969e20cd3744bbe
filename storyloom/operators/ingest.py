"""Candidate collection, quality filter, job envelopes and job routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom import schemas
from storyloom.functions import text as T
from storyloom.functions import urls as U
from storyloom.operators.skew import lookup

# The ranked lists, how much of each is considered, and the thresholds.
LIST_CAPS = {
    "topstories": 500, "beststories": 500, "newstories": 500,
    "askstories": 200, "showstories": 200, "jobstories": 200,
}
ONE_SHOT_CAPS = {"topstories": 200, "newstories": 200}
UPDATES_TAIL = 200
WINDOW_SECONDS = 36 * 3600
MIN_SCORE = 50
MIN_COMMENTS = 20
SEEN_DAYS = 7
SCRAPE_MAX_ATTEMPTS = 2
SUMMARIZE_MAX_ATTEMPTS = 3
RETRYABLE_STATUS = [401, 403, 406, 408, 409, 412, 429, 451]


# -- candidates ----------------------------------------------------------------


def capped_lists(lists: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The first ``cap`` rows of each list in list order: ``list_name, pos, item_id, rank``.

    The literal outer bound lets each task keep only that many rows per list before the
    shuffle, so one huge list stays small.
    """
    ranked = lists.where(F.col("list_name").isin(list(caps))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("list_name").orderBy("pos"))
    )
    cap = F.lit(None).cast("int")
    for name, limit in caps.items():
        cap = F.when(F.col("list_name") == name, F.lit(limit)).otherwise(cap)
    return ranked.where(F.col("rank") <= max(caps.values())).where(F.col("rank") <= cap)


def candidates(lists: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Distinct ids over the capped lists."""
    return capped_lists(lists, caps).select(F.col("item_id").alias("id")).distinct()


def updates_tail(updates: DataFrame, n: int = UPDATES_TAIL) -> DataFrame:
    """The last ``n`` rows of the update feed (``pos, item_id``), a plain top-n."""
    return updates.orderBy(F.col("pos").desc()).limit(n)


def updates_tail_array(ids: Column, n: int = UPDATES_TAIL) -> Column:
    """The same on a landed array; shorter arrays are taken whole."""
    return F.when(F.size(ids) > n, F.slice(ids, -n, n)).otherwise(ids)


def unseen(ids: DataFrame, seen: DataFrame) -> DataFrame:
    return ids.join(seen.select("id"), "id", "left_anti")


def parse_items(landed: DataFrame) -> DataFrame:
    """Landed JSON items by their declared schema; ``seq`` is kept."""
    return landed.select("seq", F.from_json("value", schemas.ITEM).alias("i")).select("seq", "i.*")


def current_items(items: DataFrame) -> DataFrame:
    """The newest landed state of each item."""
    rest = [c for c in items.columns if c != "id"]
    best = F.max_by(F.struct(*rest), "seq").alias("best")
    return items.groupBy("id").agg(best).select("id", "best.*")


def is_good(cutoff: Column) -> Column:
    """The quality rule; missing counts are zero."""
    flags = ~F.coalesce("dead", F.lit(False)) & ~F.coalesce("deleted", F.lit(False))
    liked = (F.coalesce("score", F.lit(0)) >= MIN_SCORE) | (F.coalesce("descendants", F.lit(0)) >= MIN_COMMENTS)
    recent = F.coalesce("time", F.lit(0)) >= cutoff
    return F.coalesce((F.col("type") == "story") & flags & recent & liked, F.lit(False))


def cutoff(as_of: Column) -> Column:
    return F.unix_seconds(as_of) - F.lit(WINDOW_SECONDS)


def good_items(items: DataFrame, as_of: Column) -> DataFrame:
    return items.where(is_good(cutoff(as_of)))


def items_to_stories(items: DataFrame) -> DataFrame:
    """Story rows of story-type items; zero counts are unknown counts."""
    return items.where("type = 'story'").select(
        F.lit("hn").alias("source"),
        F.col("id").cast("int").alias("hn_id"),
        "title",
        "url",
        F.col("by").alias("author"),
        F.timestamp_seconds("time").alias("created_at"),
        F.nullif("score", F.lit(0)).alias("points"),
        F.nullif("descendants", F.lit(0)).alias("comments_count"),
        "text",
        "seq",
    )


def submissions_to_stories(landed: DataFrame, now: Column) -> DataFrame:
    """Story rows of posted bodies; defaults fill what the body leaves out."""
    body = landed.select("seq", F.from_json("value", schemas.SUBMISSION).alias("b")).select("seq", "b.*")
    has_hn = F.coalesce(F.col("hn_id") != 0, F.lit(False))
    named = F.nullif("source", F.lit(""))
    return body.select(
        F.coalesce(named, F.when(has_hn, "hn").otherwise("blog")).alias("source"),
        "hn_id",
        "title",
        "url",
        U.host_domain(F.col("url")).alias("domain"),
        "author",
        F.coalesce(F.try_to_timestamp("created_at"), now).alias("created_at"),
        "points",
        "comments_count",
        "text",
        "seq",
    )


def funnel(lists: DataFrame, caps: dict[str, int], updates: DataFrame, items: DataFrame, seen: DataFrame, as_of: Column) -> DataFrame:
    """One row of run counters for a polling run.

    An error is something that was asked for and did not land: an item, a whole list, the
    tail of updates, or, for the run itself, all of them.
    """
    now_items = current_items(items)
    flagged = now_items.select("id", is_good(cutoff(as_of)).alias("good"), F.lit(True).alias("fetched"))
    known = seen.select("id", F.lit(True).alias("known"))
    first = candidates(lists, caps).join(known, "id", "left").join(flagged, "id", "left")
    new = F.col("known").isNull()
    keeps = new & F.coalesce("good", F.lit(False))
    counts = first.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(new).alias("unseen"),
        F.count_if(new & F.col("fetched")).alias("fetched"),
        F.count_if(keeps).alias("keepers"),
        F.count_if(new & F.col("fetched").isNull()).alias("_lost"),
    )
    marked = first.where(keeps).select("id", F.lit(True).alias("marked"))
    tail = updates_tail(updates).select(F.col("item_id").alias("id"))
    second = tail.join(known, "id", "left").join(marked, "id", "left").join(flagged, "id", "left")
    fresh = new & F.col("marked").isNull()
    more = second.agg(
        F.count(F.lit(1)).alias("updates_considered"),
        F.count_if(fresh).alias("updates_unseen"),
        F.count_if(fresh & F.coalesce("good", F.lit(False))).alias("updates_processed"),
        F.count_if(fresh & F.col("fetched").isNull()).alias("_lost_updates"),
    )
    landed = lists.where(F.col("list_name").isin(list(caps))).agg(F.count_distinct("list_name").alias("lists"))
    scalars = [more.select(c).scalar().alias(c) for c in more.columns] + [landed.scalar().alias("_lists")]
    none = F.col("updates_considered") == 0
    return counts.select("*", F.col("keepers").alias("processed"), *scalars).select(
        "candidates", "unseen", "fetched", "keepers", "processed", "updates_considered", "updates_unseen", "updates_processed",
        (F.col("_lost") + F.col("_lost_updates")).alias("fetch_errors"), (F.lit(len(caps)) - F.col("_lists")).alias("list_errors"),
        none.cast("long").alias("update_errors"), (none & (F.col("_lists") == 0)).cast("long").alias("tick_errors"),
    )


# -- state over runs -----------------------------------------------------------


def kept_runs(items: DataFrame, run: Column, days: int = SEEN_DAYS) -> DataFrame:
    """``id, run`` at which an item is processed, given the seen set with its retention.

    Only processed items are marked, so an id is due again once ``days`` have passed
    since it was last processed. A run considers an id once, so rows are first reduced to
    (id, run); what is gathered per id is bounded by the number of runs.
    """
    per_run = items.select("id", run.alias("run")).distinct()
    runs = F.sort_array(F.collect_list("run"))
    none = F.array().cast("array<date>")
    kept = F.aggregate(
        "runs",
        none,
        lambda acc, r: F.when(
            (F.size(acc) == 0) | (F.date_diff(r, F.element_at(acc, -1)) >= days), F.concat(acc, F.array(r))
        ).otherwise(acc),
    )
    return per_run.groupBy("id").agg(runs.alias("runs")).select("id", F.explode(kept).alias("run"))


def not_done(jobs: DataFrame, done: DataFrame, keys: list[str], as_of: Column, days: int = SEEN_DAYS, force: bool = False) -> DataFrame:
    """Jobs without a live marker. Markers are set after success, so retries get through."""
    if force:
        return jobs
    live = done.where((F.col("done_at") > as_of - F.make_dt_interval(F.lit(days))) & (F.col("done_at") <= as_of))
    return jobs.join(live.select(*keys).distinct(), keys, "left_anti")


def publish_once(jobs: DataFrame, columns: list[str]) -> DataFrame:
    """The first job of each key; jobs without a key are always published."""
    first = F.min_by(F.struct("seq", *columns), "seq").alias("first")
    keyed = jobs.where("job_key is not null").groupBy("job_key").agg(first)
    return keyed.select("job_key", "first.*").unionByName(
        jobs.where("job_key is null").select("job_key", "seq", *columns)
    )


# -- job envelopes -------------------------------------------------------------


def trace_id(story_id: Column, at: Column) -> Column:
    return F.concat(F.lit("ingest-"), F.substring(F.sha2(F.concat_ws("|", story_id.cast("string"), at.cast("string")), 256), 1, 16))


def text_article_id(text: Column) -> Column:
    """Id of the article that a story's own text becomes: the same text is the same article."""
    return F.concat(F.lit("a-"), T.sha1_hash(text))


def jobs_of(stories: DataFrame) -> DataFrame:
    """Jobs each new story asks for: one scrape job with a URL; summarize, embed and tag
    jobs with text only, which name the article of the text; none with neither."""
    def job(kind: str, route: str) -> Column:
        return F.struct(F.lit(kind).alias("job_type"), F.lit(route).alias("route"))

    has_url = F.coalesce(F.length("url") > 0, F.lit(False))
    has_text = F.coalesce(F.length("text") > 0, F.lit(False))
    fan = F.when(has_url, F.array(job("SCRAPE", "scrape"))).when(
        has_text, F.array(job("SUMMARIZE", "queue"), job("EMBED", "queue"), job("TAG", "queue"))
    )
    story = F.struct(
        F.col("id").cast("string").alias("id"), "hn_id", "source", "title", "url", F.lit(None).cast("string").alias("domain"),
        "author", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
    )
    out = stories.withColumn("job", F.explode(fan))
    scrape = F.to_json(
        F.struct(
            F.col("trace_id"), story.alias("story"), F.lit(0).alias("attempt"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version")
        ),
        {"ignoreNullFields": "false"},
    )
    common = [F.lit(None).cast("string").alias("job_key"), F.col("id").cast("string").alias("story_id"), text_article_id(F.col("text")).alias("article_id")]
    plain = F.to_json(F.struct(*common, F.lit(1).alias("attempt")), {"ignoreNullFields": "false"})
    embed = F.to_json(F.struct(*common, F.lit("default").alias("model_key"), F.lit(1).alias("attempt")), {"ignoreNullFields": "false"})
    other = F.when(F.col("job.job_type") == "EMBED", embed).otherwise(plain)
    return out.withColumn("trace_id", trace_id(F.col("id"), F.col("created_at"))).select(
        F.col("id").alias("story_id"),
        "job.job_type",
        "job.route",
        "trace_id",
        F.when(F.col("job.route") == "scrape", 0).otherwise(1).alias("attempt"),
        F.when(F.col("job.route") == "scrape", scrape).otherwise(other).alias("value"),
    )


def decode_jobs(landed: DataFrame, value: str = "value") -> DataFrame:
    """Scrape jobs from text. Text that is no JSON keeps its row with reason BAD_JSON,
    jobs without story id or URL get BAD_PAYLOAD or NO_URL; good ones have no reason."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = landed.withColumn("job", F.from_json(value, schemas.SCRAPE_JOB, options))
    reason = (
        F.when(F.col("job._corrupt").isNotNull() | F.col("job").isNull(), "BAD_JSON")
        .when(F.coalesce(F.length("job.story.id"), F.lit(0)) == 0, "BAD_PAYLOAD")
        .when(F.coalesce(F.length("job.story.url"), F.lit(0)) == 0, "NO_URL")
    )
    return parsed.withColumn("reason", reason)


# -- fetch outcome and routing -------------------------------------------------


def status_class(status: Column) -> Column:
    return (
        F.when((status >= 500) | status.isin(RETRYABLE_STATUS), "retryable").when(status >= 400, "permanent").otherwise("ok")
    )


def is_html(content_type: Column, url: Column) -> Column:
    html_type = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html"))
    return html_type | F.endswith(F.lower(F.coalesce(url, F.lit(""))), F.lit(".html"))


def paywalled(words: Column, html: Column) -> Column:
    page = F.lower(html)
    return (words < 100) & (F.contains(page, F.lit("subscribe")) | F.contains(page, F.lit("paywall")))


def jitter(key: Column) -> Column:
    """A repeatable number in [0, 1) per key, in place of a random one."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def scrape_retry(attempt: Column, key: Column, now_ms: Column) -> Column:
    """``route, attempt, visible_at`` of a failed scrape job: exponential delay with up to
    a quarter of jitter, dead letter after the last attempt."""
    following = F.coalesce(attempt, F.lit(0)) + 1
    again = following < SCRAPE_MAX_ATTEMPTS
    delay = (F.pow(F.lit(2.0), following) * 1000 * (F.lit(1.0) + jitter(key) * 0.25)).cast("long")
    return F.struct(
        F.when(again, "retry").otherwise("dead").alias("route"),
        F.when(again, following).otherwise(attempt).cast("int").alias("attempt"),
        F.when(again, now_ms + delay).alias("visible_at"),
    )


def summarize_retry(attempt: Column, error: Column, valid: Column) -> Column:
    """``route, attempt, reason`` of a summarize job after its model call."""
    following = F.coalesce(attempt, F.lit(0)) + 1
    failed = error.isNotNull()
    reason = (
        F.when(~valid, "SCHEMA_MISMATCH")
        .when(error == "timeout", "LLM_TIMEOUT")
        .when(F.contains(error, F.lit("json_parse")), "JSON_PARSE")
        .when(failed, "UNKNOWN")
    )
    again = following < SUMMARIZE_MAX_ATTEMPTS
    route = F.when(~valid, "dead").when(~failed, "done").when(again, "retry").otherwise("dead")
    return F.struct(
        route.alias("route"),
        F.when(valid & failed & again, following).otherwise(attempt).cast("int").alias("attempt"),
        reason.alias("reason"),
    )


def visible(jobs: DataFrame, now_ms: Column) -> DataFrame:
    """Retry jobs whose waiting time is over."""
    return jobs.where(F.col("visible_at").isNull() | (F.col("visible_at") <= now_ms))


def dead_by_reason(dead: DataFrame) -> DataFrame:
    return dead.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def embedding_backlog(articles: DataFrame, embeddings: DataFrame, model_key: str = "default") -> DataFrame:
    """Embed requests for articles without a vector of the model."""
    have = embeddings.where(F.col("model_key") == model_key).select(F.col("article_id").alias("id"))
    missing = articles.select("id").join(have, "id", "left_anti")
    return missing.select(F.col("id").alias("article_id"), F.lit(model_key).alias("model_key"), F.lit(1).alias("attempt"))
