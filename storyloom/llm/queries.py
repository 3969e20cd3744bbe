"""One registered query per corpus operator, and the DuckDB texts of those SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.llm import ann, centroids, decontaminate, filter_audit, html_extract, line_dedup, mixing, simhash, suffix_dedup, toxicity, trie_dedup, url_filter, warc
from storyloom.llm.common import scratch, table

QUERIES = {}
ORACLES = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _line_sql(bound: int) -> str:
    """Near lines through pieces at every shift, verified by edit distance; DuckDB counts edits of bytes, so letters beyond ASCII are replaced by single bytes."""
    control = " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 32)])
    return f"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, i AS line_no, ls[i + 1] AS line, doc_id * 1000000 + i AS ord
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM parts)
  WHERE length(ls[i + 1]) >= 20 OR regexp_matches(ls[i + 1], '[^ \\t\\n\\x0B\\f\\r]')
), d AS (
  SELECT line, min(ord) AS first, length(line) AS n FROM l GROUP BY line
), own AS (
  SELECT line, first, n, p, substr(line, n * p // (e + 1) + 1, n * (p + 1) // (e + 1) - n * p // (e + 1)) AS piece FROM (
    SELECT *, unnest(range(0, e + 1)) AS p FROM (SELECT *, least({bound}, greatest(1, n // 20)) AS e FROM d WHERE n >= 20))
), other AS (
  SELECT line, first, m, p, substr(line, m * p // (e + 1) + s + 1, m * (p + 1) // (e + 1) - m * p // (e + 1)) AS piece FROM (
    SELECT *, unnest(range(-{bound}, {bound + 1})) AS s FROM (
      SELECT *, unnest(range(0, e + 1)) AS p FROM (
        SELECT *, least({bound}, greatest(1, m // 20)) AS e FROM (
          SELECT line, first, n + k AS m, k FROM (SELECT *, unnest(range(0, {bound + 1})) AS k FROM d WHERE n >= 20)) WHERE k <= e)))
  WHERE m * p // (e + 1) + s >= 0
), pairs AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.first AS af, b.first AS bf, least({bound}, greatest(1, a.n // 20)) AS e
  FROM own a JOIN other b ON a.n = b.m AND a.p = b.p AND a.piece = b.piece AND a.line <> b.line
), letters AS (
  SELECT *, array_to_string(list_distinct(regexp_extract_all(a || b, '[^\\x00-\\x7F]')), '') AS cs FROM pairs
), near AS (
  SELECT DISTINCT CASE WHEN af < bf THEN b ELSE a END AS line FROM letters
  WHERE levenshtein(translate(a, cs, substr({control}, 1, length(cs))), translate(b, cs, substr({control}, 1, length(cs)))) <= e
), gone AS (
  SELECT doc_id, line_no FROM l JOIN d ON l.line = d.line WHERE ord > first OR l.line IN (SELECT line FROM near)
), g AS (
  SELECT doc_id, count(*) AS n, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS dropped FROM gone GROUP BY doc_id
)
SELECT p.doc_id, len(p.ls)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_dropped, coalesce(g.dropped, '') AS dropped
FROM parts p LEFT JOIN g ON p.doc_id = g.doc_id
"""


ORACLES["op4_line_dedup"] = _line_sql(1)
ORACLES["op4_line_dedup_wide"] = _line_sql(line_dedup.EDIT_BOUND)

ORACLES["op9_url_filters"] = """
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict,
  CASE WHEN regexp_matches(p.host, '(^|[.-])(ads|adult|bets|betting|casino|porn|spam|xxx)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best b ON p.page_id = b.page_id
"""

ORACLES["op10_warc"] = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), w AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
c AS (
  SELECT page_id, payload_bytes, first, k, ('0x' || substr(h, (1 + 10 * (k // 8))::BIGINT, 10))::UBIGINT AS forty
  FROM (SELECT *, unnest(range(0, 32)) AS k FROM w)
), b AS (
  SELECT page_id, payload_bytes, first,
    string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((forty >> (35 - 5 * (k % 8))::UBIGINT) & 31)::BIGINT + 1, 1), '' ORDER BY k) AS payload_digest
  FROM c GROUP BY ALL
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


ORACLES["op11_trie_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""


def _centroid_sql(rounds: int = 5) -> str:
    """Rounds of assignment and update as a chain of tables."""
    nearest = """a{r} AS MATERIALIZED (SELECT vec_id, row, v, min(struct_pack(d := d, c := c)) AS best FROM (
        SELECT vec_id, row, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d FROM v, c{r}) GROUP BY ALL)"""
    update = """c{n} AS MATERIALIZED (SELECT o.c, coalesce(u.m, o.m) AS m FROM c{r} o LEFT JOIN (
        SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
            SELECT best.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM (SELECT *, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY 1, 2)
        GROUP BY c) u ON o.c = u.c)"""
    chain = ",\n".join([nearest.format(r=r) + ",\n" + update.format(r=r, n=r + 1) for r in range(rounds)] + [nearest.format(r=rounds)])
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (
    SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM v ORDER BY h, v LIMIT 40)
), {chain}
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.c = c{rounds}.c
"""


ORACLES["op12_centroids"] = _centroid_sql()

ORACLES["op13_filter_audit"] = """
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
    coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS later FROM t
), m AS (
  SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * capitals > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * later::INT AS mask FROM w
), says AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN says USING (doc_id) GROUP BY 1, 2
), letters(name, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), places AS (
  SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS front
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)
), counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (front | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & front = 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & front <> 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & front = 0 AND mask & own <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & front = 0 AND mask & own <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, places GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""


@_query
def op1_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


@_query
def op2_decontamination(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query
def op3_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@_query
def op4_line_dedup(spark, folder):
    docs = table(spark, folder, "documents")
    return line_dedup.summary(docs, line_dedup.dropped_lines(docs, bound=1))


@_query
def op4_line_dedup_wide(spark, folder):
    docs = table(spark, folder, "documents")
    return line_dedup.summary(docs, line_dedup.dropped_lines(docs, bound=line_dedup.EDIT_BOUND))


@_query
def op5_learned_partitions(spark, folder):
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op6_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@_query
def op8_html_extraction(spark, folder):
    return html_extract.extract(table(spark, folder, "pages"))


@_query
def op9_url_filters(spark, folder):
    return url_filter.judge_urls(table(spark, folder, "pages"))


@_query
def op10_warc(spark, folder):
    return warc.round_trip(table(spark, folder, "pages"), scratch(spark, "warc"))


@_query
def op7_suffix_dedup(spark, folder):
    return suffix_dedup.deduplicate(table(spark, folder, "documents"))


@_query
def op11_trie_dedup(spark, folder):
    return trie_dedup.duplicates(table(spark, folder, "documents"))


@_query
def op12_centroids(spark, folder):
    return centroids.cluster(table(spark, folder, "embeddings"))


@_query
def op13_filter_audit(spark, folder):
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
