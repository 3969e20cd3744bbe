"""The story feed: filters, sort orders, paging and the enriched page; story detail."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators import search, search_index
from storyloom.operators.skew import lookup, newest

STORY_COLUMNS = [
    "id", "source", "hn_id", "title", "url", "domain", "author",
    "points", "comments_count", "created_at", "fetched_at",
]
SORTS = ("hot", "newest", "points", "comments")
MAX_PAGE = 100
DEFAULT_PAGE = 30


class Store:
    """The tables a feed or search reads, each built when first asked for.

    Pass DataFrames, or functions returning one. ``heavy_articles`` is the array of
    articles very many stories share, when it is known without looking.
    """

    def __init__(self, **tables):
        self._tables = tables

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        value = self._tables.get(name)
        value = value() if callable(value) and not isinstance(value, (DataFrame, Column)) else value
        setattr(self, name, value)
        return value

    @classmethod
    def of(cls, entities) -> "Store":
        e = entities
        return cls(
            story=e.stories, rank_signals=e.rank_signals, summary=e.summary, tag=e.tag, story_tag=e.story_tag,
            topic=e.topic, story_topic=e.story_topic, article=e.article_text, heavy_articles=e.heavy_articles,
            index=e.search_index,
        )


@dataclass
class FeedQuery:
    """Feed parameters; absent ones add no predicate."""

    q: str = ""
    tags: list[str] = field(default_factory=list)
    topics: list[str] = field(default_factory=list)
    domain: str | None = None
    sort: str = "hot"
    since: str | None = None
    limit: int = DEFAULT_PAGE
    offset: int = 0
    after: dict | None = None  # the cursor of a page; its rows come behind it, whatever the offset

    def __post_init__(self):
        self.q = (self.q or "").strip()
        self.sort = self.sort if self.sort in SORTS else "hot"
        self.limit = max(1, min(MAX_PAGE, int(self.limit)))
        self.offset = max(0, int(self.offset))


@dataclass
class FeedPage:
    items: DataFrame
    next_offset: int | None
    cursor: dict | None = None
    order: list[Column] = field(default_factory=list)


def story_list(store: Store) -> DataFrame:
    """Stories with their hot score, null where no signal was recorded."""
    scores = store.rank_signals.select(F.col("story_id").alias("id"), "hot_score")
    return store.story.join(scores, "id", "left")


def with_any_slug(stories: DataFrame, bridge: DataFrame, vocab: DataFrame, ref: str, slugs: list[str]) -> DataFrame:
    """Stories linked to at least one of the slugs."""
    wanted = vocab.where(F.col("slug").isin(slugs)).select(F.col("id").alias(ref))
    linked = bridge.join(wanted, ref, "left_semi").select(F.col("story_id").alias("id"))
    return stories.join(linked, "id", "left_semi")


def with_summary(store: Store, stories: DataFrame) -> DataFrame:
    have = store.summary.select("article_id").distinct()
    return lookup(stories, have, "article_id", "left_semi", heavy=store.heavy_articles)


def matching_text(store: Store, stories: DataFrame, q: str) -> DataFrame:
    """Stories whose article holds every term of ``q``; a query without terms matches none."""
    if store.index is not None:
        asked = stories.sparkSession.createDataFrame([(0, q)], "query_id int, q string")
        hits = search_index.matching(store.index, asked).select(F.col("id").alias("article_id"))
    else:
        hits = search.articles_with_all(store.article, q).select(F.col("id").alias("article_id"))
    return lookup(stories, hits, "article_id", "left_semi", heavy=store.heavy_articles)


def filtered(store: Store, query: FeedQuery, base: DataFrame | None = None) -> DataFrame:
    """All filters of a feed query, cheap column predicates first."""
    out = story_list(store) if base is None else base
    if query.domain:
        out = out.where(F.col("domain") == query.domain)
    if query.since:
        since = F.try_to_timestamp(F.lit(query.since))
        out = out.where(since.isNull() | (F.col("created_at") >= since))
    if query.tags:
        out = with_any_slug(out, store.story_tag, store.tag, "tag_id", query.tags)
    if query.topics:
        out = with_any_slug(out, store.story_topic, store.topic, "topic_id", query.topics)
    if query.q:
        out = matching_text(store, out, query.q)
    if query.after is not None:
        out = out.where(behind(query.sort, query.after))
    return with_summary(store, out)


def ordering(sort: str) -> list[Column]:
    newest_first = [F.col("created_at").desc(), F.col("id")]
    if sort == "newest":
        return newest_first
    if sort == "points":
        return [F.col("points").desc_nulls_last(), *newest_first]
    if sort == "comments":
        return [F.col("comments_count").desc_nulls_last(), *newest_first]
    return [F.coalesce("hot_score", F.lit(0.0)).desc(), *newest_first]


def behind(sort: str, cursor: dict) -> Column:
    """Rows that come after the cursor in the sort order, as predicates on plain columns that reach the scan.

    ``cursor``: the last row's ``id``, ``created_at`` and, where the order has one, its leading value.
    """
    at = F.lit(cursor["created_at"])
    later = (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > F.lit(cursor["id"])))
    if sort == "newest":
        # a plain bound in front, which a scan can use to leave row groups out
        return (F.col("created_at") <= at) & later
    if sort in ("points", "comments"):
        lead = F.col("points" if sort == "points" else "comments_count")
        if cursor["lead"] is None:
            return lead.isNull() & later
        return lead.isNull() | (lead < cursor["lead"]) | ((lead == cursor["lead"]) & later)
    lead = F.coalesce("hot_score", F.lit(0.0))
    return (lead < cursor["lead"]) | ((lead == cursor["lead"]) & later)


def cursor_of(sort: str, row) -> dict:
    """The cursor that stands behind ``row``."""
    lead = {"points": row["points"], "comments": row["comments_count"], "hot": row["hot_score"] or 0.0}
    return {"id": row["id"], "created_at": row["created_at"], "lead": lead.get(sort)}


def page_of(ranked: DataFrame, sort: str, limit: int, offset: int) -> DataFrame:
    return ranked.orderBy(*ordering(sort)).offset(offset).limit(limit)


def story_tags(store: Store, story_tag: DataFrame | None = None) -> DataFrame:
    """``story_id, tags``: tags of a story ordered by slug.

    A story has at most one link per tag, so an array is bounded by the vocabulary. A
    popular tag is skewed only on the link side of the join; Spark broadcasts the
    vocabulary while it is small and splits the skewed partitions once it is not.
    """
    links = store.story_tag if story_tag is None else story_tag
    vocab = store.tag.select(F.col("id").alias("tag_id"), "slug", "name", "kind")
    named = links.join(vocab, "tag_id")
    entries = F.sort_array(F.collect_list(F.struct("slug", "name", "kind", F.col("tag_id").alias("id"))))
    return named.groupBy("story_id").agg(entries.alias("tags"))


def story_topics(store: Store, story_topic: DataFrame | None = None) -> DataFrame:
    links = store.story_topic if story_topic is None else story_topic
    vocab = store.topic.select(F.col("id").alias("topic_id"), "slug", "name")
    named = links.join(vocab, "topic_id")
    entries = F.sort_array(F.collect_list(F.struct("slug", "name", F.col("topic_id").alias("id"))))
    return named.groupBy("story_id").agg(entries.alias("topics"))


def with_vocab(stories: DataFrame, tags: DataFrame, topics: DataFrame) -> DataFrame:
    """Attach tags and topics, an empty array where a story has none."""
    no_tags = F.array().cast(tags.schema["tags"].dataType)
    no_topics = F.array().cast(topics.schema["topics"].dataType)
    out = stories.join(tags.withColumnRenamed("story_id", "id"), "id", "left")
    out = out.join(topics.withColumnRenamed("story_id", "id"), "id", "left")
    return out.withColumns({"tags": F.coalesce("tags", no_tags), "topics": F.coalesce("topics", no_topics)})


def summary_fields(summary: DataFrame) -> DataFrame:
    """Typed fields of the summary's JSON documents, empty strings read as null."""
    def ui(path: str) -> Column:
        return F.get_json_object("ui_json", path)

    def typed(path: str, kind: str) -> Column:
        return F.nullif(ui(path), F.lit("")).try_cast(kind)

    return summary.select(
        "article_id",
        "id",
        "created_at",
        F.coalesce(ui("$.summary_140"), F.substring("summary", 1, 160)).alias("summary_snippet"),
        F.from_json(ui("$.quicktake"), "array<string>").alias("summary_quicktake"),
        typed("$.reading_time_min", "int").alias("reading_time_min"),
        typed("$.impact_score", "int").alias("impact_score"),
        typed("$.confidence", "double").alias("confidence"),
        typed("$.link_props.paywall", "boolean").alias("paywall"),
        ui("$.link_props.format").alias("link_format"),
        typed("$.link_props.is_pdf", "boolean").alias("is_pdf"),
        F.get_json_object("classification_json", "$.type").alias("class_type"),
    )


def latest_summary(summary: DataFrame) -> DataFrame:
    """The newest summary per article; only the winner's JSON is taken apart."""
    keep = ["id", "created_at", "summary", "ui_json", "classification_json"]
    best = newest(summary, "article_id", [F.col("created_at"), F.col("id")], keep)
    return summary_fields(best).withColumnRenamed("id", "summary_id").withColumnRenamed("created_at", "summarized")


def feed(store: Store, query: FeedQuery) -> FeedPage:
    """One page of the feed.

    The page holds at most MAX_PAGE rows, so its rows come to the driver once; the
    wide tables are then filtered by those literal ids, which reaches their scans.
    """
    ranked = filtered(store, query)
    # behind a cursor every page is the first one: no rows are sorted to be skipped
    top = page_of(ranked, query.sort, query.limit, query.offset if query.after is None else 0)
    rows = top.collect()
    spark = store.story.sparkSession
    page = spark.createDataFrame(rows, top.schema)
    ids = [r["id"] for r in rows]
    articles = [r["article_id"] for r in rows if r["article_id"] is not None]
    tags = story_tags(store, store.story_tag.where(F.col("story_id").isin(ids)))
    topics = story_topics(store, store.story_topic.where(F.col("story_id").isin(ids)))
    best = latest_summary(store.summary.where(F.col("article_id").isin(articles)))
    items = with_vocab(page, tags, topics).join(best, "article_id", "left")
    full = len(rows) == query.limit
    return FeedPage(
        items.select(
            *STORY_COLUMNS, "tags", "topics", "summary_snippet", "summary_quicktake", "reading_time_min",
            "impact_score", "confidence", "paywall", "link_format", "is_pdf", "class_type",
        ),
        query.offset + len(rows) if full else None,
        cursor_of(query.sort, rows[-1]) if full else None,
        [F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("id"))] if ids else [F.col("id")],
    )


def enriched(store: Store, stories: DataFrame) -> DataFrame:
    """Every story with tags, topics and its newest summary: the feed without a page."""
    out = with_vocab(stories, story_tags(store), story_topics(store))
    return lookup(out, latest_summary(store.summary), "article_id", heavy=store.heavy_articles)


def story_detail(store: Store, articles: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Story with its article, all its article's summaries, newest first, and its signals; unknown ids give no row.

    Summaries are gathered once per article that is asked for and only then spread to its stories.
    """
    stories = store.story if ids is None else store.story.join(ids.select("id").distinct(), "id", "left_semi")
    signals = store.rank_signals.select(
        F.col("story_id").alias("id"), "hot_score", "decay_ts", "click_count", "dwell_ms_avg"
    )
    article = articles.select(
        F.col("id").alias("article_id"),
        F.struct(F.col("id"), "language", "html", "text", "word_count", "content_hash").alias("article"),
    )
    one = F.struct("id", "model", "lang", "summary", "created_at", "classification_json", "ui_json", "summarized_at")
    wanted = store.summary
    if ids is not None:
        wanted = wanted.join(stories.select("article_id").distinct(), "article_id", "left_semi")
    # sorted by (time, id) first, so the newest stands last
    listed = F.reverse(F.sort_array(F.collect_list(F.struct("created_at", "id", one.alias("s")))))
    summaries = wanted.groupBy("article_id").agg(F.transform(listed, lambda x: x["s"]).alias("summaries"))
    out = with_vocab(stories, story_tags(store), story_topics(store)).join(signals, "id", "left")
    out = lookup(out, article, "article_id", heavy=store.heavy_articles)
    out = lookup(out, summaries, "article_id", heavy=store.heavy_articles)
    parts = ["hot_score", "decay_ts", "click_count", "dwell_ms_avg"]
    known = F.coalesce(*[F.col(c).cast("string") for c in parts]).isNotNull()
    record = F.struct(F.coalesce("hot_score", F.lit(0.0)).alias("hot_score"), *parts[1:])
    return out.select(
        *STORY_COLUMNS,
        "tags",
        "topics",
        "article",
        F.coalesce("summaries", F.array().cast(summaries.schema["summaries"].dataType)).alias("summaries"),
        F.when(known, record).alias("rank_signals"),
    )


def article_summaries(store: Store, ids: DataFrame | None = None) -> DataFrame:
    """All summaries of the requested stories' articles as rows, to be read newest first.

    Rows keyed by article rather than arrays per story: an article may carry any number
    of summaries and be shared by any number of stories, and neither multiplies the other.
    """
    stories = store.story if ids is None else store.story.join(ids.select("id").distinct(), "id", "left_semi")
    wanted = stories.select("article_id").where("article_id is not null").distinct()
    return lookup(store.summary, wanted, "article_id", "left_semi").select(
        "article_id", "id", "model", "lang", "summary", "created_at", "summarized_at"
    )


def story_base_json(stories: DataFrame) -> DataFrame:
    """The JSON shape of a story in lists, ISO timestamps included."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    fields = [
        F.date_format(c, iso).alias(c) if c in ("created_at", "fetched_at") else F.col(c)
        for c in [*STORY_COLUMNS, "tags", "topics"]
    ]
    return stories.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def feed_page_json(page: FeedPage) -> DataFrame:
    """One row: the page as the JSON a client gets, its items in order (at most MAX_PAGE) and the next offset."""
    extra = [c for c in page.items.columns if c not in STORY_COLUMNS and c not in ("tags", "topics")]
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    base = [F.date_format(c, iso).alias(c) if c in ("created_at", "fetched_at") else F.col(c) for c in [*STORY_COLUMNS, "tags", "topics"]]
    # what an item has no value for is left out
    items = page.items.withColumn("_item", F.struct(*base, *extra))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_item"))), lambda x: x["_item"])
    placed = items.withColumn("_place", F.row_number().over(Window.orderBy(*page.order)))
    body = F.struct(listed.alias("items"), F.lit(page.next_offset).cast("int").alias("next_offset"))
    return placed.agg(F.to_json(body, {"ignoreNullFields": "true"}).alias("value"))


def search_hits_json(hits: DataFrame) -> DataFrame:
    """``rank, value``: each hit of a search as the JSON a client gets."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    base = [F.date_format(c, iso).alias(c) if c in ("created_at", "fetched_at") else F.col(c) for c in [*STORY_COLUMNS, "tags", "topics"]]
    return hits.select("rank", F.to_json(F.struct(F.struct(*base).alias("story"), "score", "match")).alias("value"))


def vocab_tags(tag: DataFrame) -> DataFrame:
    return tag.select("id", "slug", "name", "kind").orderBy("slug")


def vocab_topics(topic: DataFrame) -> DataFrame:
    return topic.select("id", "slug", "name").orderBy("slug")
