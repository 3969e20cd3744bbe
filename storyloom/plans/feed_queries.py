"""Feed, detail, vocabulary and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import feed, merge
from storyloom.operators.feed import FeedQuery, Store
from storyloom.plans.registry import query

STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {0}"
BASE = (
    "s.id, s.source, s.hn_id, s.title, s.url, s.domain, s.author, s.points, s.comments_count, "
    "strftime(s.created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, "
    "strftime(s.fetched_at, '%Y-%m-%d %H:%M:%S.%f') AS fetched_at"
)
TAGS = """
    tags_of AS (SELECT st.story_id, string_agg(concat_ws(':', t.slug, t.name, t.kind, 'tag:' || t.slug), '|' ORDER BY t.slug) AS tags
                FROM fx_story_tag st JOIN fx_tag t USING (slug) GROUP BY 1)"""
TOPICS = """
    topics_of AS (SELECT st.story_id, string_agg(concat_ws(':', t.slug, t.name, 'topic:' || t.slug), '|' ORDER BY t.slug) AS topics
                  FROM fx_story_topic st JOIN fx_topic t USING (slug) GROUP BY 1)"""
FIELDS = """
    coalesce(m.summary_140, substring(m.summary, 1, 160)) AS summary_snippet,
    array_to_string(m.quicktake, '|') AS summary_quicktake,
    CAST(m.n AS INT) AS reading_time_min, CAST(m.n * 10 AS INT) AS impact_score,
    CAST(CAST(m.n * 0.1 AS DECIMAL(3,1)) AS DOUBLE) AS confidence,
    CASE WHEN m.n IS NOT NULL THEN m.n = 1 END AS paywall,
    CASE WHEN m.has_ui THEN 'html' END AS link_format,
    CASE WHEN m.n IS NOT NULL THEN false END AS is_pdf, m.class_type"""
LATEST = """
    latest AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS rn
        FROM fx_summary) WHERE rn = 1)"""
ORDERS = {
    "hot": "coalesce(r.hot_score, 0) DESC, s.created_at DESC, s.id",
    "newest": "s.created_at DESC, s.id",
    "points": "s.points DESC NULLS LAST, s.created_at DESC, s.id",
    "comments": "s.comments_count DESC NULLS LAST, s.created_at DESC, s.id",
}


def feed_sql(where: str = "true", sort: str = "hot", limit: int = 30, offset: int = 0) -> str:
    return f"""
        WITH {TAGS}, {TOPICS}, {LATEST},
        page AS (SELECT s.* FROM fx_story s LEFT JOIN fx_rank_signals r ON r.story_id = s.id
                 WHERE EXISTS (SELECT 1 FROM fx_summary x WHERE x.article_id = s.article_id) AND ({where})
                 ORDER BY {ORDERS[sort]} LIMIT {limit} OFFSET {offset})
        SELECT {BASE}, coalesce(g.tags, '') AS tags, coalesce(h.topics, '') AS topics, {FIELDS}
        FROM page s LEFT JOIN tags_of g ON g.story_id = s.id LEFT JOIN topics_of h ON h.story_id = s.id
        LEFT JOIN latest m ON m.article_id = s.article_id"""


HAS_TERMS = """EXISTS (SELECT 1 FROM fx_story a WHERE a.id = s.article_id AND list_has_all(
    regexp_extract_all(lower(strip_accents(replace(replace(a.text, 'ß', 'ss'), 'œ', 'oe'))), '[\\p{L}\\p{N}]+'), %s))"""
TAGGED = "EXISTS (SELECT 1 FROM fx_story_tag t WHERE t.story_id = s.id AND t.slug IN (%s))"
TOPICAL = "EXISTS (SELECT 1 FROM fx_story_topic t WHERE t.story_id = s.id AND t.slug IN (%s))"

_FEEDS = {
    "feed_hot": (FeedQuery(), {}),
    "feed_newest": (FeedQuery(sort="newest"), {"sort": "newest"}),
    "feed_points": (FeedQuery(sort="points"), {"sort": "points"}),
    "feed_comments": (FeedQuery(sort="comments", limit=50), {"sort": "comments", "limit": 50}),
    "feed_page": (FeedQuery(sort="newest", limit=10, offset=20), {"sort": "newest", "limit": 10, "offset": 20}),
    "feed_domain": (
        FeedQuery(domain="blog.ththan.example.net", limit=100),
        {"where": "s.domain = 'blog.ththan.example.net'", "limit": 100},
    ),
    "feed_since": (
        FeedQuery(since="2024-01-01T01:00:00Z", limit=100),
        {"where": "s.created_at >= TIMESTAMP '2024-01-01 01:00:00'", "limit": 100},
    ),
    "feed_tags": (FeedQuery(tags=["src1", "toxic-1"], limit=100), {"where": TAGGED % "'src1', 'toxic-1'", "limit": 100}),
    "feed_topics": (FeedQuery(topics=["de", "fr"], limit=100), {"where": TOPICAL % "'de', 'fr'", "limit": 100}),
    "feed_text": (FeedQuery(q="the of", limit=100), {"where": HAS_TERMS % "['the', 'of']", "limit": 100}),
    "feed_all_filters": (
        FeedQuery(q="the", tags=["quality-1", "src1"], topics=["en"], since="2024-01-01", sort="points", limit=100),
        {
            "where": " AND ".join(
                [HAS_TERMS % "['the']", TAGGED % "'quality-1', 'src1'", TOPICAL % "'en'", "s.created_at >= TIMESTAMP '2024-01-01'"]
            ),
            "sort": "points",
            "limit": 100,
        },
    ),
}

for _key, (_query, _sql) in _FEEDS.items():
    query(_key, feed_sql(**_sql))(lambda e, q=_query: feed.feed(Store.of(e), q).items)


def _deep(e, sort: str, limit: int, pages: int):
    """The last of several pages, each found by the cursor of the one before."""
    page = feed.feed(Store.of(e), FeedQuery(sort=sort, limit=limit))
    for _ in range(pages - 1):
        if page.cursor is None:
            return page.items.where(F.lit(False))
        page = feed.feed(Store.of(e), FeedQuery(sort=sort, limit=limit, after=page.cursor))
    return page.items


for _sort, _limit, _pages in (("hot", 7, 3), ("newest", 9, 4), ("points", 8, 5), ("comments", 5, 3)):
    query(f"feed_seek_{_sort}", feed_sql(sort=_sort, limit=_limit, offset=_limit * (_pages - 1)))(
        lambda e, s=_sort, n=_limit, p=_pages: _deep(e, s, n, p)
    )


@query("feed_has_summary", f"""
    SELECT s.id, s.article_id, s.hot_score FROM (
        SELECT s.*, r.hot_score FROM fx_story s LEFT JOIN fx_rank_signals r ON r.story_id = s.id) s
    WHERE EXISTS (SELECT 1 FROM fx_summary x WHERE x.article_id = s.article_id)""")
def feed_has_summary(e):
    return feed.filtered(Store.of(e), FeedQuery()).select("id", "article_id", "hot_score")


@query("feed_enriched", f"""
    WITH {TAGS}, {TOPICS}, {LATEST}
    SELECT s.id, coalesce(g.tags, '') AS tags, coalesce(h.topics, '') AS topics, {FIELDS}
    FROM fx_story s LEFT JOIN tags_of g ON g.story_id = s.id LEFT JOIN topics_of h ON h.story_id = s.id
    LEFT JOIN latest m ON m.article_id = s.article_id""")
def feed_enriched(e):
    out = feed.enriched(Store.of(e), e.stories())
    return out.select(
        "id", "tags", "topics", "summary_snippet", "summary_quicktake", "reading_time_min", "impact_score",
        "confidence", "paywall", "link_format", "is_pdf", "class_type",
    )


@query("story_list", f"""
    SELECT {BASE}, s.article_id, r.hot_score FROM fx_story s LEFT JOIN fx_rank_signals r ON r.story_id = s.id""")
def story_list(e):
    return feed.story_list(Store.of(e)).select(*feed.STORY_COLUMNS, "article_id", "hot_score")


@query("story_tags", f"WITH {TAGS} SELECT * FROM tags_of")
def story_tags(e):
    return feed.story_tags(Store.of(e))


@query("story_topics", f"WITH {TOPICS} SELECT * FROM topics_of")
def story_topics(e):
    return feed.story_topics(Store.of(e))


@query("latest_summary", f"WITH {LATEST} SELECT m.article_id, m.id AS summary_id, {FIELDS} FROM latest m")
def latest_summary(e):
    return feed.latest_summary(e.summary()).drop("summarized")


@query("summary_ui_fields", f"SELECT m.id, {FIELDS} FROM fx_summary m")
def summary_ui_fields(e):
    return feed.summary_fields(e.summary()).drop("article_id", "created_at")


@query("summary_snippet", "SELECT id, coalesce(summary_140, substring(summary, 1, 160)) AS summary_snippet FROM fx_summary")
def summary_snippet(e):
    return feed.summary_fields(e.summary()).select("id", "summary_snippet")


@query("story_base_json", f"""
    WITH {TAGS}
    SELECT s.id, s.title, s.url, s.points, strftime(s.created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at,
           len(string_split(g.tags, '|')) AS n_tags
    FROM fx_story s LEFT JOIN tags_of g ON g.story_id = s.id""")
def story_base_json(e):
    store = Store.of(e)
    shaped = feed.story_base_json(feed.with_vocab(e.stories(), feed.story_tags(store), feed.story_topics(store)))
    doc = F.from_json("value", "title string, url string, points int, created_at string, tags array<struct<slug:string>>")
    return shaped.select("id", doc.alias("d")).select(
        "id", "d.title", "d.url", "d.points", "d.created_at", F.size("d.tags").cast("long").alias("n_tags")
    )


@query("story_detail", f"""
    WITH {TAGS}, {TOPICS},
    told AS (SELECT article_id, count(*) AS n, string_agg(id || ':' || strftime(created_at, '%H:%M') || ':' || summary, '|' ORDER BY created_at DESC, id DESC) AS summaries
             FROM fx_summary GROUP BY 1)
    SELECT {BASE}, coalesce(g.tags, '') AS tags, coalesce(h.topics, '') AS topics,
           a.word_count, a.content_hash, a.text, '<article>' || a.text || '</article>' AS html,
           coalesce(m.n, 0)::INT AS n_summaries, coalesce(m.summaries, '') AS summaries, r.hot_score, r.click_count
    FROM fx_story s LEFT JOIN tags_of g ON g.story_id = s.id LEFT JOIN topics_of h ON h.story_id = s.id
    LEFT JOIN fx_article a ON a.id = s.article_id LEFT JOIN told m ON m.article_id = s.article_id
    LEFT JOIN fx_rank_signals r ON r.story_id = s.id""")
def story_detail(e):
    html = F.concat(F.lit("<article>"), "text", F.lit("</article>"))
    out = feed.story_detail(Store.of(e), e.article().withColumn("html", html))
    told = F.transform("summaries", lambda x: F.concat_ws(":", x["id"], F.date_format(x["created_at"], "HH:mm"), x["summary"]))
    return out.select(
        *feed.STORY_COLUMNS, "tags", "topics", "article.word_count", "article.content_hash", "article.text", "article.html",
        F.size("summaries").alias("n_summaries"), F.array_join(told, "|").alias("summaries"), "rank_signals.hot_score", "rank_signals.click_count",
    )


@query("article_summaries", """
    SELECT m.article_id, m.id, m.model, m.lang, m.summary,
           strftime(m.created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
           strftime(m.summarized_at, '%Y-%m-%d %H:%M:%S.%f') AS summarized_at
    FROM fx_summary m WHERE m.article_id IN (SELECT article_id FROM fx_story)""")
def article_summaries(e):
    return feed.article_summaries(Store.of(e))


@query("feed_page_json", f"""
    WITH {TAGS},
    page AS (SELECT s.*, row_number() OVER (ORDER BY {ORDERS["points"]}) AS place FROM fx_story s LEFT JOIN fx_rank_signals r ON r.story_id = s.id
             WHERE EXISTS (SELECT 1 FROM fx_summary x WHERE x.article_id = s.article_id) ORDER BY place LIMIT 20)
    SELECT place::INT AS place, s.id, s.title, s.points, strftime(s.created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at,
           len(string_split(g.tags, '|'))::INT AS n_tags, CASE WHEN count(*) OVER () = 20 THEN 20 END AS next_offset
    FROM page s LEFT JOIN tags_of g ON g.story_id = s.id""")
def feed_page_json(e):
    """A page as one JSON document, read back."""
    doc = feed.feed_page_json(feed.feed(Store.of(e), FeedQuery(sort="points", limit=20)))
    item = "struct<id:long,title:string,points:int,created_at:string,tags:array<struct<slug:string>>>"
    back = doc.select(F.from_json("value", f"items array<{item}>, next_offset int").alias("d")).select("d.next_offset", F.posexplode("d.items").alias("place", "i"))
    return back.select((F.col("place") + 1).alias("place"), "i.id", "i.title", "i.points", "i.created_at", F.size("i.tags").alias("n_tags"), "next_offset")


@query("vocab_tags", "SELECT 'tag:' || slug AS id, slug, name, kind FROM fx_tag")
def vocab_tags(e):
    return feed.vocab_tags(e.tag())


@query("vocab_topics", "SELECT 'topic:' || slug AS id, slug, name FROM fx_topic")
def vocab_topics(e):
    return feed.vocab_topics(e.topic())


@query("hot_score", """
    SELECT id, round((ln(points + 1) * 0.7 + ln(comments_count + 1) * 0.3)
        * exp(-((epoch_us(TIMESTAMP '2024-01-08') - epoch_us(created_at)) / 3600000000.0) / 60.0), 6) AS hot_score
    FROM fx_story""")
def hot_score(e):
    from storyloom.functions import text as T
    from storyloom.sources.entities import AS_OF, ts

    score = T.hot_score(F.col("points"), F.col("comments_count"), T.age_hours(ts(AS_OF), F.col("created_at")))
    return e.stories().select("id", F.round(score, 6).alias("hot_score"))
