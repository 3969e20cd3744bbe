"""Declared schemas of the entities and messages. Nothing is inferred."""

from __future__ import annotations

STORY = (
    "id string, source string, hn_id int, title string, url string, domain string, "
    "author string, points int, comments_count int, created_at timestamp, "
    "fetched_at timestamp, article_id string"
)
ARTICLE = "id string, language string, html string, text string, word_count int, content_hash string"
CLASSIFICATION = "struct<primary_category string, type string, tags array<string>, topics array<string>>"
LINK_PROPS = "struct<paywall string, format string, is_pdf string>"

# A source item as landed: epoch seconds, zero counts and boolean flags kept as sent.
ITEM = (
    "id long, type string, title string, url string, `by` string, time long, score int, "
    "descendants int, text string, dead boolean, deleted boolean"
)
JOB_STORY = (
    "struct<id string, hn_id int, source string, title string, url string, domain string, "
    "author string, created_at string>"
)
SCRAPE_JOB = (
    f"trace_id string, story {JOB_STORY}, attempt int, schema_version int, "
    "visible_at long, _corrupt string"
)
SUBMISSION = (
    "source string, hn_id int, title string, url string, author string, created_at string, "
    "points int, comments_count int, text string"
)
RESULT = (
    "trace_id string, story_id string, article_id string, model string, lang string, "
    f"summary string, classification {CLASSIFICATION}, "
    "ui struct<summary_140 string, quicktake array<string>, audience array<string>, "
    "impact_score int, confidence double, reading_time_min int, "
    "link_props variant>, timestamps map<string,string>, schema_version int"
)

# Fixed values of the data model.
SOURCES = ["hn", "blog", "lobsters", "devto"]
TAG_KINDS = ["topic", "tech", "meta"]
CLASS_TYPES = ["news", "article", "discussion", "research", "other"]
SCHEMA_VERSION = 1
SEED_MODELS = [("default", 1536, "openai")]
SEED_TAGS = [("ai", "AI", "tech"), ("security", "Security", "tech"), ("show", "Show HN", "meta")]
SEED_TOPICS = [("startups", "Startups"), ("programming", "Programming")]
