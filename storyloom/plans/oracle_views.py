"""DuckDB text of the entity views, used to check the Spark results."""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-01-08 00:00:00'"

VIEWS = {
    "fx_events": """
        SELECT event_id, user_id, event_type, value, ts, props,
               CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""",
    "fx_sig": """
        SELECT user_id,
               CAST(count(*) FILTER (WHERE event_type IN ('view','click')) AS INT) AS points,
               CAST(count(*) FILTER (WHERE event_type IN ('signup','purchase')) AS INT) AS comments_count,
               min(ts) AS t0, max(ts) AS t1
        FROM events GROUP BY user_id""",
    "fx_story": """
        SELECT d.id, ['hn','blog','lobsters','devto'][d.id % 4 + 1] AS source,
               CASE WHEN d.id % 4 = 0 THEN CAST(d.id AS INT) END AS hn_id,
               d.title, p.url,
               regexp_replace(lower(regexp_extract(p.url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS domain,
               d.author, s.points, s.comments_count,
               coalesce(s.t0, TIMESTAMP '2024-01-01' + d.id * INTERVAL 1 MINUTE) AS created_at,
               coalesce(s.t1, s.t0, TIMESTAMP '2024-01-01' + d.id * INTERVAL 1 MINUTE) AS fetched_at,
               d.article_id, d.lang, d.text
        FROM (SELECT doc_id AS id, substring(text, 1, 80) AS title, source AS author, lang, text,
                     min(doc_id) OVER (PARTITION BY text) AS article_id,
                     CASE WHEN doc_id % 10 <> 9 THEN doc_id % (SELECT count(*) FROM pages) END AS page_id
              FROM documents) d
        LEFT JOIN pages p ON p.page_id = d.page_id
        LEFT JOIN fx_sig s ON s.user_id = d.id""",
    "fx_article": """
        SELECT id, lang AS language, text,
               CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS INT) AS word_count,
               sha256(lang || chr(10) || coalesce(domain, '') || chr(10) || substring(text, 1, 10000)) AS content_hash
        FROM fx_story WHERE id = article_id""",
    "fx_summary": """
        SELECT conv_id || '-' || turn AS id, conv_id AS article_id, 'm1' AS model, 'en' AS lang,
               text AS summary, TIMESTAMP '2024-02-01' + turn * INTERVAL 1 HOUR AS created_at,
               CASE WHEN conv_id % 2 = 0 THEN CASE WHEN turn = 1 THEN 'news' ELSE 'article' END END AS class_type,
               CASE WHEN conv_id % 2 = 0 AND turn <> 5 THEN substring(text, 1, 20) END AS summary_140,
               CASE WHEN conv_id % 2 = 0 AND turn <> 3 THEN turn END AS n,
               CASE WHEN conv_id % 2 = 0 THEN list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:2] END AS quicktake,
               conv_id % 2 = 0 AS has_ui,
               CASE WHEN conv_id % 2 = 0 THEN TIMESTAMP '2024-02-01' + turn * INTERVAL 1 HOUR END AS summarized_at
        FROM conversations WHERE role = 'assistant'""",
    "fx_rank_signals": f"""
        SELECT user_id AS story_id,
               round((ln(points + 1) * 0.7 + ln(comments_count + 1) * 0.3)
                     * exp(-((epoch_us({AS_OF}) - epoch_us(t0)) / 3600000000.0) / 60.0), 12) AS hot_score,
               {AS_OF} AS decay_ts, points AS click_count
        FROM fx_sig WHERE user_id IN (SELECT doc_id FROM documents)""",
    "fx_story_tag": """
        SELECT doc_id AS story_id, source AS slug FROM documents
        UNION SELECT doc_id, 'quality-' || quality FROM labels
        UNION SELECT doc_id, 'toxic-' || toxic FROM labels""",
    "fx_tag": """
        SELECT DISTINCT slug, upper(slug) AS name,
               CASE WHEN regexp_matches(slug, '^(quality|toxic)-') THEN 'meta' ELSE 'tech' END AS kind
        FROM fx_story_tag""",
    "fx_story_topic": "SELECT doc_id AS story_id, lang AS slug FROM documents",
    "fx_topic": "SELECT DISTINCT lang AS slug, upper(lang) AS name FROM documents",
    "fx_embedding": """
        SELECT vec_id AS article_id, 'default' AS model_key,
               CASE WHEN vec_id % 97 = 0 THEN embedding[1:63] ELSE embedding END AS vector FROM embeddings""",
    "fx_item": """
        SELECT e.user_id AS id, e.event_id AS seq,
               CASE WHEN event_type = 'signup' THEN 'job' ELSE 'story' END AS type,
               'Item ' || e.user_id || ' ' || event_type AS title, p.url, 'u' || e.user_id AS poster,
               CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS time,
               CAST(floor(value / 4) AS INT) AS score, k % 40 AS descendants,
               CASE WHEN p.url IS NULL THEN event_type || ' ' || props END AS text,
               event_type = 'error' AND k < 50 AS dead, k = 0 AS deleted, ts
        FROM fx_events e LEFT JOIN pages p
          ON p.page_id = CASE WHEN e.user_id % 10 <> 9 THEN e.user_id % (SELECT count(*) FROM pages) END""",
    "fx_list": "SELECT event_type AS list_name, event_id AS pos, user_id AS item_id FROM events",
    "fx_seen": """
        SELECT user_id AS id, min(ts) AS seen_at FROM events GROUP BY user_id
        HAVING min(ts) < TIMESTAMP '2024-01-01 03:00:00'""",
    "fx_done": """
        SELECT user_id AS story_id, 'm1' AS model, max(ts) AS done_at FROM events
        WHERE event_type = 'purchase' GROUP BY user_id""",
    "fx_submission": """
        SELECT seq, CASE WHEN seq % 4 = 0 THEN 'lobsters' WHEN seq % 7 <> 0 AND id <> 0 THEN 'hn' ELSE 'blog' END AS source,
               CASE WHEN seq % 7 <> 0 THEN CAST(id AS INT) END AS hn_id, title, url,
               regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS domain,
               CASE WHEN seq % 3 <> 0 THEN poster END AS author,
               CASE WHEN seq % 11 <> 0 THEN make_timestamp(time * 1000000) ELSE TIMESTAMP '2024-02-01' END AS created_at,
               CASE WHEN seq % 5 <> 0 THEN score END AS points,
               CASE WHEN seq % 2 <> 0 THEN descendants END AS comments_count, text
        FROM fx_item""",
    "fx_job": """
        SELECT page_id, page_id % 19 = 0 AS broken,
               CASE WHEN page_id % 19 <> 0 THEN 't-' || page_id END AS trace_id,
               CASE WHEN page_id % 19 <> 0 AND page_id % 13 <> 0 THEN CAST(page_id AS VARCHAR) END AS story_id,
               CASE WHEN page_id % 19 <> 0 AND page_id % 17 <> 0 THEN url END AS url,
               CASE WHEN page_id % 19 <> 0 THEN CAST(page_id % 4 AS INT) END AS attempt,
               CASE WHEN page_id % 19 <> 0 THEN CASE WHEN page_id % 11 = 0 THEN 2 ELSE 1 END END AS schema_version
        FROM pages""",
    "fx_fetch_log": """
        SELECT page_id, url, [200,200,301,403,404,429,500,503][page_id % 8 + 1] AS status,
               CASE WHEN page_id % 9 = 0 THEN 'application/pdf' ELSE 'text/HTML; charset=utf-8' END AS content_type,
               CASE WHEN page_id % 21 = 0 THEN '<html><script>var a = ''<p>x</p>''</script><body> </body></html>'
                    WHEN page_id % 5 = 0 THEN html || ' subscribe' ELSE html END AS html
        FROM pages""",
    "fx_result": """
        SELECT conv_id AS story_id, CASE WHEN conv_id % 23 <> 0 THEN conv_id END AS article_id, turn,
               conv_id * 100 + turn AS seq,
               CASE WHEN conv_id % 29 <> 0 THEN 'm1' END AS model,
               CASE WHEN conv_id % 31 <> 0 THEN CASE WHEN conv_id % 37 = 0 THEN 'e' ELSE 'en' END END AS lang,
               CASE WHEN turn = 7 THEN '  ' ELSE '  ' || text END AS summary,
               CASE WHEN conv_id % 47 <> 0 THEN list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:12] END AS tags,
               CASE WHEN conv_id % 47 <> 0 THEN ['en', 'Source ' || (conv_id % 20), '', 'x'] END AS topics,
               CASE WHEN conv_id % 47 <> 0 THEN CASE WHEN conv_id % 20 = 0 THEN 'rumor' WHEN conv_id % 3 = 0 THEN 'research' END END AS type,
               CASE WHEN conv_id % 47 <> 0 AND turn = 1 THEN 'tech' END AS primary_category,
               CASE WHEN conv_id % 53 <> 0 AND turn <> 3 THEN CAST(turn * 40 - 60 AS INT) END AS impact_score,
               CASE WHEN conv_id % 53 <> 0 AND turn <> 3 THEN CAST(round(turn * 0.4 - 0.3, 6) AS DOUBLE) END AS confidence,
               CASE WHEN conv_id % 53 <> 0 THEN ['Kernel Devs', 'Everyone', 'Data Scientists', 'Kernel Devs'] END AS audience,
               CASE WHEN conv_id % 53 <> 0 AND turn <> 5 THEN substring(text, 1, 20) END AS summary_140,
               CASE WHEN conv_id % 53 <> 0 THEN list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:2] END AS quicktake,
               CASE WHEN conv_id % 53 <> 0 THEN CAST(turn AS INT) END AS reading_time_min,
               CASE WHEN conv_id % 53 <> 0 AND turn <> 3 THEN '{"format":"html","is_pdf":false,"paywall":' || CASE WHEN turn = 1 THEN 'true' ELSE 'false' END || '}' END AS link_props,
               CASE WHEN conv_id % 43 <> 0 THEN 't-' || (conv_id * 100 + turn) END AS trace_id,
               conv_id % 47 <> 0 AS has_classification, conv_id % 53 <> 0 AS has_ui, conv_id % 59 <> 0 AS has_timestamps,
               CASE WHEN conv_id % 41 = 0 THEN 2 ELSE 1 END AS schema_version,
               CASE WHEN conv_id % 59 <> 0 AND conv_id % 3 <> 0 THEN TIMESTAMP '2024-02-01' + turn * INTERVAL 1 HOUR END AS summarized_at
        FROM conversations WHERE role = 'assistant'""",
    "fx_metrics": """
        SELECT run_id, ran_at, name, kind, value FROM (
            SELECT event_id // 50 AS run_id, event_type AS name, max(ts) AS ran_at,
                   CAST(count(*) AS DOUBLE) AS n, round(sum(value), 4) AS ms
            FROM events GROUP BY 1, 2) r,
            LATERAL (SELECT 'counter' AS kind, n AS value UNION ALL SELECT 'timing', ms) m""",
}


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it names, each after the ones it needs."""
    body = body.strip()
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
