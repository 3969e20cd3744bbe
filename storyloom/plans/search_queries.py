"""Full-text, fuzzy and index queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storyloom.operators import feed, search, search_index, similarity
from storyloom.operators.feed import Store
from storyloom.plans.registry import query
from storyloom.session import shared_dir

# Requests of the search endpoint: id and text.
REQUESTS = [(1, "in"), (2, "the of"), (3, "in and to"), (4, "für"), (5, "éeau"), (6, "zzzyx"), (7, ""), (8, "The the")]


def _fold(c: str) -> str:
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE"), ("ø", "o"), ("Ø", "O")):
        c = f"replace({c}, '{a}', '{b}')"
    return f"strip_accents({c})"


TOKENS = f"regexp_extract_all(lower({_fold('text')}), '[\\p{{L}}\\p{{N}}]+')"
OCC = f"""occ AS (SELECT a.id, u.pos, u.term FROM (SELECT id, {TOKENS} AS w FROM fx_story WHERE id = article_id) a,
    LATERAL (SELECT generate_subscripts(a.w, 1) AS pos, unnest(a.w) AS term) u)"""
TERMS = (
    "terms AS (SELECT query_id, len(ts) AS n, unnest(ts) AS term FROM (SELECT query_id, list_distinct("
    + f"regexp_extract_all(lower({_fold('q')}), '[\\p{{L}}\\p{{N}}]+')) AS ts FROM (VALUES "
    + ", ".join(f"({i}, '{q}')" for i, q in REQUESTS)
    + ") v(query_id, q)))"
)
# Minimal covers by running maxima: per matched word the latest index of every term; the
# oldest of them begins the cover, which counts when that beginning moved.
RANK = """
    hit AS (SELECT t.query_id, t.n, o.id, o.pos, o.term,
                   row_number() OVER (PARTITION BY t.query_id, o.id ORDER BY o.pos) AS nth
            FROM occ o JOIN terms t USING (term)),
    full_hit AS (SELECT h.* FROM hit h JOIN (SELECT query_id, id FROM hit GROUP BY query_id, id, n HAVING count(DISTINCT term) = n) f
                 USING (query_id, id)),
    run AS (SELECT h.query_id, h.id, h.n, h.pos, h.nth, t.term,
                   max(CASE WHEN h.term = t.term THEN h.pos END) OVER w AS p,
                   max(CASE WHEN h.term = t.term THEN h.nth END) OVER w AS a
            FROM full_hit h JOIN terms t USING (query_id)
            WINDOW w AS (PARTITION BY h.query_id, h.id, t.term ORDER BY h.nth)),
    ends AS (SELECT query_id, id, pos, nth, min(p) AS p0, min(a) AS a0 FROM run
             GROUP BY query_id, id, pos, nth, n HAVING count(p) = n),
    cover AS (SELECT *, lag(p0) OVER (PARTITION BY query_id, id ORDER BY nth) AS before FROM ends),
    score AS (SELECT query_id, id AS article_id, sum(0.1 / (1 + (pos - p0) - (nth - a0))) AS score
              FROM cover WHERE before IS NULL OR p0 > before GROUP BY 1, 2)"""
TOP = """
    SELECT query_id, CAST(rank AS INT) AS rank, id, round(score, 6) AS score FROM (
        SELECT c.query_id, s.id, c.score, row_number() OVER (
            PARTITION BY c.query_id ORDER BY round(c.score, 9) DESC, s.created_at DESC, s.id) AS rank
        FROM score c JOIN fx_story s USING (article_id)) WHERE rank <= {k}"""


def requests(e, wanted=None):
    rows = [r for r in REQUESTS if wanted is None or r[0] in wanted]
    return e.spark.createDataFrame(rows, "query_id int, q string")


@query("postings", f"WITH {OCC} SELECT term, id, string_agg(pos, ',' ORDER BY pos) AS positions FROM occ GROUP BY 1, 2")
def postings(e):
    index = e.search_index().postings()
    return index.select("term", "id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("postings_refresh", f"""
    WITH {OCC} SELECT term, count(*) AS articles, CAST(sum(n) AS BIGINT) AS occurrences FROM (
        SELECT term, id, count(*) AS n FROM occ GROUP BY 1, 2) GROUP BY term""")
def postings_refresh(e):
    article = e.article_text()
    changed = e.summary().select(F.col("article_id").alias("id"))
    # an index of its own: the refresh adds a segment to it
    index = search_index.build(article, f"{shared_dir(e.spark)}/postings-{uuid.uuid4().hex}")
    index = search_index.refresh(index, article, changed).postings()
    return index.groupBy("term").agg(
        F.count(F.lit(1)).alias("articles"), F.sum(F.size("positions")).alias("occurrences")
    )


@query("search_rank_single", f"""
    WITH {OCC} SELECT id, CAST(round(count(*) * 0.1, 6) AS DOUBLE) AS score FROM occ WHERE term = 'in' GROUP BY id""")
def search_rank_single(e):
    out = search_index.ranked(e.search_index(), requests(e, {1}))
    return out.select("id", F.round("score", 6).alias("score"))


@query("search_rank_cover", f"WITH {OCC}, {TERMS}, {RANK} SELECT query_id, article_id AS id, round(score, 6) AS score FROM score")
def search_rank_cover(e):
    out = search_index.ranked(e.search_index(), requests(e))
    return out.select("query_id", "id", F.round("score", 6).alias("score"))


@query("search_many", f"WITH {OCC}, {TERMS}, {RANK} {TOP.format(k=30)}")
def search_many(e):
    return search.search_many(Store.of(e), requests(e)).drop("match").withColumn("score", F.round("score", 6))


@query("search_lexical", f"""
    WITH {OCC}, {TERMS}, {RANK},
    top AS ({TOP.format(k=20)}),
    tags_of AS (SELECT story_id, string_agg(slug, '|' ORDER BY slug) AS tags FROM fx_story_tag GROUP BY 1)
    SELECT t.rank, t.score, t.id, s.title, s.url, g.tags, s.lang AS topics, 'lexical' AS match
    FROM top t JOIN fx_story s USING (id) LEFT JOIN tags_of g ON g.story_id = s.id WHERE t.query_id = 2""")
def search_lexical(e):
    out = search.search(Store.of(e), "the of", k=20)
    return out.select(
        "rank", F.round("score", 6).alias("score"), "id", "title", "url",
        F.transform("tags", lambda t: t["slug"]).alias("tags"),
        F.transform("topics", lambda t: t["slug"]).alias("topics"), "match",
    )


@query("search_hits_json", f"""
    WITH {OCC}, {TERMS}, {RANK}, top AS ({TOP.format(k=20)})
    SELECT t.rank, t.id, s.title, t.score, 'lexical' AS match, strftime(s.created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at
    FROM top t JOIN fx_story s USING (id) WHERE t.query_id = 2""")
def search_hits_json(e):
    """Hits as JSON documents, read back."""
    hits = feed.search_hits_json(search.search(Store.of(e), "the of", k=20))
    doc = F.from_json("value", "story struct<id:long,title:string,created_at:string>, score double, match string")
    return hits.select("rank", doc.alias("d")).select("rank", "d.story.id", "d.story.title", F.round("d.score", 6).alias("score"), "d.match", "d.story.created_at")


GRAMS = """list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'),
    lambda w: list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substring('  ' || w || ' ', CAST(i AS INT), 3)))))"""
NAMES = ["blog.thethan.example.net", "therin example", "spam-farm.org"]


@query("domain_fuzzy", f"""
    WITH d AS (SELECT DISTINCT domain, {GRAMS.format('domain')} AS g FROM fx_story WHERE domain IS NOT NULL),
    n AS (SELECT name, {GRAMS.format('name')} AS h FROM (VALUES {", ".join(f"('{x}')" for x in NAMES)}) v(name))
    SELECT domain, name, round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6) AS similarity
    FROM d, n WHERE len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) >= 0.3""")
def domain_fuzzy(e):
    out = search.fuzzy_domains(e.stories(), e.spark.createDataFrame([(n,) for n in NAMES], "name string"))
    return out.withColumn("similarity", F.round("similarity", 6))


PAIRS = """
    WITH d AS (SELECT DISTINCT {column} AS x, {grams} AS g FROM fx_story WHERE {column} IS NOT NULL)
    SELECT a.x AS a, b.x AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity
    FROM d a, d b WHERE a.x < b.x AND len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= {threshold}"""


@query("domain_pairs", PAIRS.format(column="domain", grams=GRAMS.format("domain"), threshold=0.5))
def domain_pairs(e):
    """All pairs of domains that resemble each other."""
    out = similarity.similar_pairs(e.stories().select(F.col("domain").alias("text")), threshold=0.5)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("title_pairs", PAIRS.format(column="title", grams=GRAMS.format("title"), threshold=0.6))
def title_pairs(e):
    """All pairs of titles that resemble each other."""
    out = similarity.similar_pairs(e.stories().select(F.col("title").alias("text")), threshold=0.6)
    return out.withColumn("similarity", F.round("similarity", 6))
