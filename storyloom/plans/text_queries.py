"""Scalar functions, validation and cleaning over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions import urls as U
from storyloom.operators import results
from storyloom.plans.registry import query

WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"


@query("host_domain", f"SELECT page_id, regexp_replace({HOST}, '^www\\.', '') AS domain FROM pages")
def host_domain(e):
    return e.t.pages.select("page_id", U.host_domain(F.col("url")).alias("domain"))


@query("canonical_url", f"""
    SELECT page_id, regexp_extract(url, '^[^?#]*') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url
    FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
        lambda p: regexp_matches(p, '=.') AND split_part(lower(p), '=', 1) NOT IN
          ({", ".join(repr(t) for t in U.TRACKING)})) AS kept FROM pages)""")
def canonical_url(e):
    return e.t.pages.select("page_id", U.canonical_url(F.col("url")).alias("url"))


@query("registered_domain", f"""
    SELECT DISTINCT {HOST} AS host, regexp_extract({HOST}, '([^.]+\\.(com|org|net|io|dev|co\\.uk|uk))$', 1) AS registered_domain FROM pages""")
def registered_domain(e):
    return U.registered_domains(e.t.pages, e.suffixes())


@query("word_count", f"SELECT doc_id, len({WORDS.format('text')}) AS words FROM documents")
def word_count(e):
    return e.t.documents.select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


@query("reading_time", f"""
    SELECT doc_id, CAST(greatest(1, least(60, ceil(len({WORDS.format('text')}) / 200.0))) AS INT) AS minutes FROM documents""")
def reading_time(e):
    return e.t.documents.select("doc_id", T.reading_time(T.word_count(F.col("text"))).alias("minutes"))


@query("content_hash_sha1", """
    SELECT doc_id, sha1(regexp_replace(trim(text, E' \\t\\n\\r'), '\\s+', ' ', 'g')) AS plain,
           sha1(regexp_replace(trim(text, E' \\t\\n\\r'), '\\s+', ' ', 'g') || chr(10) || 'https://e.example/' || doc_id) AS with_url
    FROM documents""")
def content_hash_sha1(e):
    link = F.concat(F.lit("https://e.example/"), "doc_id")
    return e.t.documents.select("doc_id", T.sha1_hash(F.col("text")).alias("plain"), T.sha1_hash(F.col("text"), link).alias("with_url"))


@query("content_hash_sha256", """
    SELECT doc_id, sha256(lang || chr(10) || source || chr(10) || substring(text, 1, 10000)) AS hash FROM documents""")
def content_hash_sha256(e):
    return e.t.documents.select("doc_id", T.sha256_hash(F.col("lang"), F.col("source"), F.col("text")).alias("hash"))


@query("unaccent", """
    SELECT doc_id, strip_accents(replace(replace(replace(replace(text, 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'ø', 'o')) AS text FROM documents""")
def unaccent(e):
    return e.t.documents.select("doc_id", T.unaccent(F.col("text")).alias("text"))


SLUG = """nullif(regexp_replace(regexp_replace(trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9\\s-]', '', 'g'), E' \\n\\t'),
    '[\\s-]+', '-', 'g'), '^-+|-+$', '', 'g'), '')"""


@query("slugify", f"SELECT doc_id, {SLUG.format('text')} AS slug FROM documents")
def slugify(e):
    return e.t.documents.select("doc_id", T.slugify(F.col("text")).alias("slug"))


PARTS = """parts AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
    SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)),
        lambda x: trim(x, E' \\n\\t')), lambda x: x <> '') AS ps FROM documents)),
    sums AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i {0}) AS used,
             row_number() OVER (PARTITION BY doc_id ORDER BY i {0}) AS nth FROM parts)"""
CUT = """
    WITH {parts} SELECT d.doc_id, coalesce(x.cut, '') AS cut FROM documents d LEFT JOIN (
        SELECT doc_id, substring(string_agg(p, chr(10) || chr(10) ORDER BY i), 1, {n}) AS cut
        FROM sums WHERE nth = 1 OR used <= {n} GROUP BY doc_id) x USING (doc_id)"""


@query("text_head", CUT.format(parts=PARTS.format("ASC"), n=900))
def text_head(e):
    return e.paragraph_text().select("doc_id", T.text_head(F.col("text")).alias("cut"))


@query("text_tail", CUT.format(parts=PARTS.format("DESC"), n=600))
def text_tail(e):
    return e.paragraph_text().select("doc_id", T.text_tail(F.col("text")).alias("cut"))


@query("candidate_tags", f"""
    WITH t AS (SELECT id, list_concat(
        list_transform(list_filter({WORDS.format("replace(title, '/', ' ')")}, lambda w: regexp_matches(w, '^\\p{{Lu}}')),
                       lambda w: trim(w, '.,:;!?')),
        [author, 'Topic'],
        list_transform(list_filter(string_split(coalesce(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/'),
            lambda s: regexp_matches(s, '^\\p{{L}}+$') AND length(s) <= 20),
            lambda s: upper(substring(s, 1, 1)) || lower(substring(s, 2)))) AS all_tags FROM fx_story)
    SELECT id, array_to_string(list_filter(all_tags, lambda x, i: list_position(list_transform(all_tags, lambda y: lower(y)), lower(x)) = i)[1:6], '|') AS tags
    FROM t""")
def candidate_tags(e):
    heads = F.array(F.concat("author", F.lit(" desk")), F.lit(""), F.lit("Topic of the day"))
    path = F.coalesce(U.url_path(F.col("url")), F.lit("/"))
    return e.stories().select("id", T.candidate_tags(F.col("title"), heads, path).alias("tags"))


# -- summarize jobs and results ------------------------------------------------


@query("job_validate", """
    SELECT doc_id, array_to_string(list_filter([
        CASE WHEN doc_id % 6 = 0 THEN 'story.url' END,
        CASE WHEN doc_id % 9 = 0 THEN 'story.hn_id' END,
        CASE WHEN doc_id % 7 = 0 THEN 'article.language' END,
        CASE WHEN doc_id % 10 = 0 THEN 'article.word_count' END,
        CASE WHEN doc_id % 9 = 0 THEN 'hints' END,
        CASE WHEN doc_id % 9 = 0 THEN 'metrics' END,
        CASE WHEN doc_id % 11 = 0 THEN 'schema_version' END], lambda x: x IS NOT NULL), '|') AS errors,
        CASE WHEN doc_id % 6 = 0 OR doc_id % 9 = 0 OR doc_id % 7 = 0 OR doc_id % 10 = 0 OR doc_id % 11 = 0 THEN 'SCHEMA_MISMATCH' END AS reason
    FROM documents""")
def job_validate(e):
    return results.validate_jobs(e.summarize_jobs()).select("doc_id", "errors", "reason")


CLEAN = """clean AS (
    SELECT trace_id, story_id, article_id, turn, seq, model, lang, substring(trim(summary, E' \\n\\t'), 1, 800) AS summary, primary_category,
        list_filter(list_transform(coalesce(tags, [])[1:6], lambda t: trim(t)), lambda t: length(t) BETWEEN 2 AND 40) AS tags,
        list_filter(list_transform(coalesce(topics, [])[1:6], lambda t: trim(t)), lambda t: length(t) BETWEEN 2 AND 40) AS topics,
        list_filter(audience, lambda a: a <> 'Everyone') AS audience, coalesce(type, 'news') AS type,
        CASE WHEN impact_score IS NOT NULL THEN greatest(0, least(100, impact_score)) END AS impact_score,
        CASE WHEN confidence IS NOT NULL THEN greatest(0.0, least(1.0, confidence)) END AS confidence,
        summary_140, quicktake, reading_time_min, link_props, summarized_at,
        array_to_string(list_filter([CASE WHEN trace_id IS NULL THEN 'trace_id' END, CASE WHEN article_id IS NULL THEN 'article_id' END,
            CASE WHEN model IS NULL THEN 'model' END, CASE WHEN lang IS NULL OR length(lang) < 2 THEN 'lang' END,
            CASE WHEN trim(summary, E' \\n\\t') = '' THEN 'summary' END, CASE WHEN NOT has_classification THEN 'classification' END,
            CASE WHEN type = 'rumor' THEN 'classification.type' END, CASE WHEN NOT has_ui THEN 'ui' END,
            CASE WHEN NOT has_timestamps THEN 'timestamps' END, CASE WHEN schema_version <> 1 THEN 'schema_version' END],
            lambda x: x IS NOT NULL), '|') AS errors
    FROM fx_result)"""


@query("result_clean", f"""
    WITH {CLEAN} SELECT seq, trace_id, errors, summary, primary_category, array_to_string(tags, '|') AS tags, array_to_string(topics, '|') AS topics,
        array_to_string(audience, '|') AS audience, type, impact_score, round(confidence, 6) AS confidence, summary_140,
        array_to_string(quicktake, '|') AS quicktake, reading_time_min, link_props FROM clean""")
def result_clean(e):
    return results.clean_results(results.decode_results(e.result_json())).select(
        "seq", "trace_id", "errors", "summary", "primary_category", "tags", "topics", "audience", "type", "impact_score",
        F.round("confidence", 6).alias("confidence"), "summary_140", "quicktake", "reading_time_min", F.to_json("link_props").alias("link_props"),
    )


@query("audience_filter", "SELECT seq, array_to_string(list_filter(audience, lambda a: a <> 'Everyone'), '|') AS audience FROM (SELECT conv_id * 100 + turn AS seq, ['Kernel Devs', 'Everyone', 'Data Scientists', 'Kernel Devs'] AS audience FROM conversations WHERE role = 'assistant')")
def audience_filter(e):
    return e.result().select("seq", results.known_audience(F.col("audience")).alias("audience"))


@query("result_gate", "SELECT seq, CASE WHEN article_id IS NULL OR summary = '' OR model IS NULL THEN 'missing_fields' END AS skip FROM fx_result")
def result_gate(e):
    return results.gate_results(e.result()).select("seq", "skip")


LABELS = f"""labels_of AS (
    SELECT story_id, seq, kind, name, {SLUG.format('name')} AS slug, seq * 100 + i - 1 AS n FROM (
        SELECT story_id, seq, 'tag' AS kind, unnest(tags[1:10]) AS name, generate_subscripts(tags[1:10], 1) AS i FROM clean WHERE errors = ''
        UNION ALL
        SELECT story_id, seq, 'topic', unnest(topics[1:10]), generate_subscripts(topics[1:10], 1) FROM clean WHERE errors = '')
    WHERE {SLUG.format('name')} IS NOT NULL)"""


def accepted(e):
    """Cleaned results without errors that also pass the presence gate."""
    clean = results.clean_results(results.decode_results(e.result_json())).where(F.size("errors") == 0)
    ids = {c: F.col(c).cast("long") for c in ("story_id", "article_id")}  # the fixtures' ids are numbers
    return results.gate_results(clean).where("skip is null").withColumns(ids)


@query("result_to_vocab", f"WITH {CLEAN}, {LABELS} SELECT story_id, kind, name, slug, n AS seq FROM labels_of")
def result_to_vocab(e):
    good = accepted(e)
    tags = results.result_labels(good, "tags").withColumn("kind", F.lit("tag"))
    topics = results.result_labels(good, "topics").withColumn("kind", F.lit("topic"))
    return tags.unionByName(topics)
