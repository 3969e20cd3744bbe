"""Table maintenance: upserts, vocabulary merges, cascades, integrity."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storyloom import schemas
from storyloom.functions import text as T
from storyloom.operators import buckets, ingest, merge, results
from storyloom.plans.registry import query
from storyloom.plans.text_queries import CLEAN, LABELS, accepted
from storyloom.session import shared_dir, spread
from storyloom.sources.entities import ts

NOW = "2024-02-01 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
SHA1 = "sha1(regexp_replace(trim({0}, E' \\t\\n\\r'), '\\s+', ' ', 'g'))"


STORY_UPSERT = f"""
    WITH inc AS (
        SELECT hn_id, arg_min(source, seq) AS source, arg_max(struct_pack(title := title, url := url, domain := domain, author := author), seq) AS last,
               arg_max(points, seq) FILTER (WHERE points IS NOT NULL) AS points,
               arg_max(comments_count, seq) FILTER (WHERE comments_count IS NOT NULL) AS comments_count, min(created_at) AS created_at
        FROM fx_submission WHERE hn_id IS NOT NULL GROUP BY hn_id),
    merged AS (
        SELECT coalesce(CAST(t.id AS VARCHAR), sha256('hn:' || n.hn_id)) AS id, coalesce(t.source, n.source) AS source,
               coalesce(t.hn_id, n.hn_id) AS hn_id,
               CASE WHEN n.hn_id IS NOT NULL THEN n.last.title ELSE t.title END AS title,
               CASE WHEN n.hn_id IS NOT NULL THEN n.last.url ELSE t.url END AS url,
               CASE WHEN n.hn_id IS NOT NULL THEN n.last.domain ELSE t.domain END AS domain,
               CASE WHEN n.hn_id IS NOT NULL THEN n.last.author ELSE t.author END AS author,
               coalesce(n.points, t.points) AS points, coalesce(n.comments_count, t.comments_count) AS comments_count,
               least(t.created_at, n.created_at) AS created_at,
               CASE WHEN n.hn_id IS NOT NULL THEN {NOW_SQL} ELSE t.fetched_at END AS fetched_at, CAST(t.article_id AS VARCHAR) AS article_id
        FROM (SELECT * FROM fx_story WHERE hn_id IS NOT NULL) t FULL JOIN inc n USING (hn_id)
        UNION ALL
        SELECT CAST(id AS VARCHAR), source, NULL, title, url, domain, author, points, comments_count, created_at, fetched_at, CAST(article_id AS VARCHAR)
        FROM fx_story WHERE hn_id IS NULL
        UNION ALL
        SELECT sha256('seq:' || seq), source, NULL, title, url, domain, author, points, comments_count, created_at, {NOW_SQL}, NULL
        FROM fx_submission WHERE hn_id IS NULL)
    SELECT * REPLACE (strftime(created_at, {STAMP}) AS created_at, strftime(fetched_at, {STAMP}) AS fetched_at) FROM merged"""


@query("story_upsert", STORY_UPSERT)
def story_upsert(e):
    target = e.stories().withColumns({"id": F.col("id").cast("string"), "article_id": F.col("article_id").cast("string")})
    incoming = ingest.submissions_to_stories(e.submission_json(), ts(NOW))
    return merge.story_upsert(target, incoming, ts(NOW))


@query("story_upsert_buckets", STORY_UPSERT)
def story_upsert_buckets(e):
    """The upsert into a stored table: only the buckets of arriving stories are rewritten."""
    path = f"{shared_dir(e.spark)}/stories-{uuid.uuid4().hex}"
    key = F.coalesce(F.col("hn_id").cast("string"), F.col("id"))
    arriving = F.coalesce(F.col("hn_id").cast("string"), F.sha2(F.concat(F.lit("seq:"), F.col("seq").cast("string")), 256))
    buckets.create(e.stories().withColumns({"id": F.col("id").cast("string"), "article_id": F.col("article_id").cast("string")}), path, key, 8)
    incoming = ingest.submissions_to_stories(e.submission_json(), ts(NOW))
    buckets.merge_into(path, incoming, key, arriving, lambda t, n: merge.story_upsert(t, n, ts(NOW)), 8)
    return buckets.read(e.spark, path)


@query("article_dedupe", f"""
    SELECT content_hash, min(doc_id) AS id, arg_min(lang, doc_id) AS language, arg_min(words, doc_id) AS word_count FROM (
        SELECT doc_id, lang, {SHA1.format('text')} AS content_hash, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words
        FROM documents) GROUP BY content_hash""")
def article_dedupe(e):
    rows = e.t.documents.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.col("lang").alias("language"),
        T.sha1_hash(F.col("text")).alias("content_hash"), T.word_count(F.col("text")).cast("long").alias("word_count"),
    )
    return merge.article_dedupe(rows)


def _article_target(e):
    """Articles already known: the first copies of the documents, hashed the plain way."""
    return e.article_text().select(
        F.col("id").cast("string").alias("id"), F.lit("en").alias("language"), "text",
        T.word_count(F.col("text")).alias("word_count"), T.sha1_hash(F.col("text")).alias("content_hash"),
    )


def _article_incoming(e):
    """Texts that arrive: every document again, then the text-only items."""
    docs = e.t.documents.select(
        F.concat(F.lit("d"), "doc_id").alias("story_id"), F.col("lang").alias("language"), "text", F.col("doc_id").alias("seq")
    )
    items = e.item().where("text is not null").select(
        F.concat(F.lit("i"), "seq").alias("story_id"), F.lit("en").alias("language"), "text", (F.col("seq") + 1_000_000_000).alias("seq")
    )
    both = spread(docs.unionByName(items), "seq")
    return both.withColumns({"word_count": T.word_count(F.col("text")), "content_hash": T.sha1_hash(F.col("text"))})


INCOMING = f"""inc AS (
    SELECT *, {SHA1.format('text')} AS content_hash FROM (
        SELECT 'd' || doc_id AS story_id, lang AS language, text, doc_id AS seq FROM documents
        UNION ALL SELECT 'i' || seq, 'en', text, seq + 1000000000 FROM fx_item WHERE text IS NOT NULL)),
    known AS (SELECT CAST(min(doc_id) AS VARCHAR) AS id, content_hash FROM (
        SELECT doc_id, {SHA1.format('text')} AS content_hash FROM documents) GROUP BY content_hash)"""


@query("article_upsert_text", f"""
    WITH {INCOMING}
    SELECT coalesce(k.id, 'a-' || i.content_hash) AS id, arg_max(i.language, i.seq) AS language, i.content_hash
    FROM inc i LEFT JOIN known k USING (content_hash) GROUP BY k.id, i.content_hash""")
def article_upsert_text(e):
    articles, _ = merge.article_upsert(_article_target(e), _article_incoming(e), set_language=True)
    return articles.select("id", "language", "content_hash")


@query("article_upsert", f"""
    WITH {INCOMING}
    SELECT coalesce(k.id, 'a-' || i.content_hash) AS id, CASE WHEN k.id IS NOT NULL THEN 'en' ELSE arg_min(i.language, i.seq) END AS language,
           arg_min(i.text, i.seq) AS text, i.content_hash
    FROM inc i LEFT JOIN known k USING (content_hash) GROUP BY k.id, i.content_hash""")
def article_upsert(e):
    articles, _ = merge.article_upsert(_article_target(e), _article_incoming(e), set_language=False)
    return articles.select("id", "language", "text", "content_hash")


@query("story_link", f"""
    WITH {INCOMING},
    links AS (SELECT i.story_id, coalesce(k.id, 'a-' || i.content_hash) AS article_id, 'd' AS x FROM inc i LEFT JOIN known k USING (content_hash))
    SELECT s.id, l.article_id, coalesce(s.domain, 'text.example') AS domain, s.author
    FROM fx_story s JOIN links l ON l.story_id = 'd' || s.id""")
def story_link(e):
    _, links = merge.article_upsert(_article_target(e), _article_incoming(e), set_language=False)
    found = links.where(F.startswith("story_id", F.lit("d"))).select(
        F.substring("story_id", 2, 20).cast("long").alias("story_id"), "article_id",
        F.lit("text.example").alias("domain"), F.lit("nobody").alias("author"), "seq",
    )
    target = e.stories().withColumn("article_id", F.lit(None).cast("string"))
    return merge.story_link(target, found).select("id", "article_id", "domain", "author")


@query("story_article_detach", """
    SELECT id, CASE WHEN rn = 1 THEN article_id END AS article_id FROM (
        SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY fetched_at DESC NULLS LAST, created_at DESC, CAST(id AS VARCHAR) DESC) AS rn FROM fx_story)""")
def story_article_detach(e):
    return merge.detach_older_stories(e.stories()).select("id", "article_id")


@query("summary_dedupe", f"""
    SELECT id, article_id, summary, strftime(created_at, {STAMP}) AS created_at FROM (
        SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS rn FROM fx_summary) WHERE rn = 1""")
def summary_dedupe(e):
    return merge.one_summary_per_article(e.summary()).select("id", "article_id", "summary", "created_at")


@query("latest_k_summaries", """
    SELECT id, article_id, CAST(rn AS INT) AS nth FROM (
        SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS rn FROM fx_summary) WHERE rn <= 2""")
def latest_k_summaries(e):
    return merge.latest_k_summaries(e.summary(), 2).select("id", "article_id", "nth")


@query("summary_upsert", f"""
    WITH {CLEAN},
    inc AS (SELECT article_id, arg_max(struct_pack(model := model, lang := lang, summary := summary, kind := type, category := primary_category,
                   tags := array_to_string(tags, '|'), topics := array_to_string(topics, '|'), audience := array_to_string(audience, '|'),
                   impact := impact_score, confidence := round(confidence, 6), summary_140 := summary_140, quicktake := array_to_string(quicktake, '|'),
                   minutes := reading_time_min, props := link_props), seq) AS last,
                   arg_max(summarized_at, seq) FILTER (WHERE summarized_at IS NOT NULL) AS summarized_at
            FROM clean WHERE errors = '' GROUP BY article_id),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS rn FROM fx_summary) WHERE rn = 1)
    SELECT coalesce(t.article_id, n.article_id) AS article_id, coalesce(n.last.model, t.model) AS model, coalesce(n.last.lang, t.lang) AS lang,
           coalesce(n.last.summary, t.summary) AS summary, coalesce(n.last.kind, t.class_type) AS type, n.last.category AS primary_category,
           n.last.tags AS tags, n.last.topics AS topics, n.last.audience AS audience,
           CASE WHEN n.article_id IS NOT NULL THEN CAST(n.last.impact AS VARCHAR) ELSE CAST(t.n * 10 AS VARCHAR) END AS impact_score,
           CASE WHEN n.article_id IS NOT NULL THEN n.last.confidence ELSE round(t.n * 0.1, 6) END AS confidence,
           CASE WHEN n.article_id IS NOT NULL THEN n.last.summary_140 ELSE t.summary_140 END AS summary_140,
           CASE WHEN n.article_id IS NOT NULL THEN n.last.quicktake ELSE array_to_string(t.quicktake, '|') END AS quicktake,
           CASE WHEN n.article_id IS NOT NULL THEN CAST(n.last.minutes AS VARCHAR) ELSE CAST(t.n AS VARCHAR) END AS reading_time_min,
           n.last.props AS link_props,
           strftime(coalesce(t.created_at, {NOW_SQL}), {STAMP}) AS created_at,
           strftime(coalesce(n.summarized_at, t.summarized_at), {STAMP}) AS summarized_at
    FROM t FULL JOIN inc n ON t.article_id = n.article_id""")
def summary_upsert(e):
    """Every field that a stored summary has; link properties only of the summaries that arrived."""
    target = merge.one_summary_per_article(e.summary())
    out = merge.summary_upsert(target, results.result_summaries(accepted(e)), ts(NOW))
    said = lambda c, path: F.nullif(F.get_json_object(c, path), F.lit(""))
    ui = lambda name: said("ui_json", f"$.{name}")
    listed = lambda c: F.from_json(c, "array<string>")
    arrived = ui("audience").isNotNull()
    return out.select(
        "article_id", "model", "lang", "summary", said("classification_json", "$.type").alias("type"),
        said("classification_json", "$.primary_category").alias("primary_category"),
        *[listed(said("classification_json", f"$.{c}")).alias(c) for c in ("tags", "topics")], listed(ui("audience")).alias("audience"),
        ui("impact_score").alias("impact_score"), F.round(ui("confidence").try_cast("double"), 6).alias("confidence"), ui("summary_140").alias("summary_140"),
        listed(ui("quicktake")).alias("quicktake"), ui("reading_time_min").alias("reading_time_min"), F.when(arrived, ui("link_props")).alias("link_props"),
        "created_at", "summarized_at",
    )


@query("tag_upsert", f"""
    WITH {CLEAN}, {LABELS}
    SELECT 'tag:' || slug AS id, slug, name, kind FROM fx_tag
    UNION ALL SELECT 'tag:' || slug, slug, arg_min(name, n), 'tech' FROM labels_of
    WHERE kind = 'tag' AND slug NOT IN (SELECT slug FROM fx_tag) GROUP BY slug""")
def tag_upsert(e):
    arriving = results.result_labels(accepted(e), "tags").withColumn("kind", F.lit("tech"))
    return merge.vocab_upsert(e.tag(), arriving, "tag:")


@query("topic_upsert", f"""
    WITH {CLEAN}, {LABELS}
    SELECT 'topic:' || slug AS id, slug, name FROM fx_topic
    UNION ALL SELECT 'topic:' || slug, slug, arg_min(name, n) FROM labels_of
    WHERE kind = 'topic' AND slug NOT IN (SELECT slug FROM fx_topic) GROUP BY slug""")
def topic_upsert(e):
    return merge.vocab_upsert(e.topic(), results.result_labels(accepted(e), "topics"), "topic:")


@query("bridge_upsert", f"""
    WITH {CLEAN}, {LABELS}
    SELECT story_id, 'tag:' || slug AS tag_id FROM fx_story_tag
    UNION SELECT story_id, 'tag:' || slug FROM labels_of WHERE kind = 'tag'""")
def bridge_upsert(e):
    arriving = results.result_labels(accepted(e), "tags").select("story_id", F.concat(F.lit("tag:"), "slug").alias("tag_id"))
    return merge.bridge_upsert(e.story_tag(), arriving)


@query("vocab_seed", f"""
    SELECT 'tag:' || slug AS id, slug, name, kind FROM fx_tag
    UNION ALL SELECT * FROM (VALUES {", ".join(f"('tag:{s}', '{s}', '{n}', '{k}')" for s, n, k in schemas.SEED_TAGS)}) v(id, slug, name, kind)
    WHERE slug NOT IN (SELECT slug FROM fx_tag)""")
def vocab_seed(e):
    rows = e.spark.createDataFrame([(f"tag:{s}", s, n, k) for s, n, k in schemas.SEED_TAGS], "id string, slug string, name string, kind string")
    return merge.seed(e.tag(), rows, "slug")


def tables(e) -> dict:
    return {
        "story": e.stories(), "article": e.article(), "summary": e.summary(), "embedding": e.embedding(), "tag": e.tag(),
        "topic": e.topic(), "story_tag": e.story_tag(), "story_topic": e.story_topic(), "rank_signals": e.rank_signals(),
    }


@query("delete_cascade", """
    WITH gs AS (SELECT id FROM fx_story WHERE source = 'devto'), ga AS (SELECT id FROM fx_article WHERE language = 'es')
    SELECT 'article' AS relation, CAST(id AS VARCHAR) AS key, NULL AS ref FROM fx_article WHERE language <> 'es'
    UNION ALL SELECT 'story', CAST(id AS VARCHAR), CASE WHEN article_id NOT IN (SELECT id FROM ga) THEN CAST(article_id AS VARCHAR) END
        FROM fx_story WHERE source <> 'devto'
    UNION ALL SELECT 'summary', id, CAST(article_id AS VARCHAR) FROM fx_summary WHERE article_id NOT IN (SELECT id FROM ga)
    UNION ALL SELECT 'embedding', CAST(article_id AS VARCHAR), CAST(article_id AS VARCHAR) FROM fx_embedding WHERE article_id NOT IN (SELECT id FROM ga)
    UNION ALL SELECT 'story_tag', 'tag:' || slug, CAST(story_id AS VARCHAR) FROM fx_story_tag WHERE story_id NOT IN (SELECT id FROM gs)
    UNION ALL SELECT 'story_topic', 'topic:' || slug, CAST(story_id AS VARCHAR) FROM fx_story_topic WHERE story_id NOT IN (SELECT id FROM gs)
    UNION ALL SELECT 'rank_signals', CAST(story_id AS VARCHAR), CAST(story_id AS VARCHAR) FROM fx_rank_signals WHERE story_id NOT IN (SELECT id FROM gs)""")
def delete_cascade(e):
    left = merge.delete_cascade(tables(e), e.stories().where("source = 'devto'"), e.article().where("language = 'es'"))
    shown = {
        "article": ("id", None), "story": ("id", "article_id"), "summary": ("id", "article_id"), "embedding": ("article_id", "article_id"),
        "story_tag": ("tag_id", "story_id"), "story_topic": ("topic_id", "story_id"), "rank_signals": ("story_id", "story_id"),
    }
    out = None
    for name, (key, ref) in shown.items():
        part = left[name].select(
            F.lit(name).alias("relation"), F.col(key).cast("string").alias("key"),
            (F.col(ref) if ref else F.lit(None)).cast("string").alias("ref"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("integrity_report", """
    SELECT 'story.article_id' AS rule, CAST(article_id AS VARCHAR) AS key, count(*) AS n FROM fx_story GROUP BY article_id HAVING count(*) > 1
    UNION ALL SELECT 'article.content_hash', content_hash, count(*) FROM fx_article GROUP BY content_hash HAVING count(*) > 1
    UNION ALL SELECT 'summary.article_id', CAST(article_id AS VARCHAR), count(*) FROM fx_summary GROUP BY article_id HAVING count(*) > 1
    UNION ALL SELECT 'summary.article', CAST(article_id AS VARCHAR), count(*) FROM fx_summary
        WHERE article_id NOT IN (SELECT id FROM fx_article) GROUP BY article_id
    UNION ALL SELECT 'embedding.article', CAST(article_id AS VARCHAR), count(*) FROM fx_embedding
        WHERE article_id NOT IN (SELECT id FROM fx_article) GROUP BY article_id""")
def integrity_report(e):
    return merge.integrity_report(tables(e))
