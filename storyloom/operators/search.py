"""Full-text search: positional postings, all-terms match, cover-density rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import similarity
from storyloom.session import spread


MAX_K = 100
TERM_WEIGHT = 0.1  # weight of an unlabelled term in the rank
MAX_QUERY_TERMS = 10_000


def occurrences(article: DataFrame) -> DataFrame:
    """``id, pos, term``: one row per token, positions from 1."""
    found = F.posexplode(T.tokens(T.unaccent(F.coalesce("text", F.lit("")))))
    rows = spread(article.select("id", "text"), "id")
    return rows.select("id", found.alias("pos", "term")).select("id", (F.col("pos") + 1).alias("pos"), "term")


def postings(article: DataFrame) -> DataFrame:
    """``term, id, positions``; an entry is bounded by the length of one article."""
    hits = occurrences(article)
    return hits.groupBy("term", "id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def query_terms(queries: DataFrame, strict: bool = False) -> DataFrame:
    """``query_id, term, n_terms``. ``strict`` leaves query accents in place, so an
    accented query never meets the unaccented index."""
    text = F.col("q") if strict else T.unaccent(F.col("q"))
    listed = queries.select("query_id", F.array_distinct(T.tokens(text)).alias("terms"))
    return listed.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def matched_occurrences(article: DataFrame, queries: DataFrame, strict: bool = False) -> DataFrame:
    """Occurrences of query terms only: ``query_id, n_terms, id, pos, term``.

    The distinct query terms are a scalar set when they are few; tokens outside it are
    dropped inside the scan's task, before any shuffle. Larger query tables skip the set
    and rely on the join, whose heavy terms AQE splits on the token side.
    """
    terms = query_terms(queries, strict)
    vocabulary = [r.term for r in terms.select("term").distinct().limit(MAX_QUERY_TERMS + 1).collect()]
    hits = occurrences(article)
    if len(vocabulary) <= MAX_QUERY_TERMS:
        hits = hits.where(F.col("term").isin(vocabulary))
    return hits.join(terms, "term")


def _cover_score(entries: Column, n_terms: Column) -> Column:
    """Sum over minimal covers of weight / (1 + noise words inside the cover).

    ``entries`` is an array of (pos, term) sorted by position. While sweeping, ``last``
    maps each term to its latest (pos, index); once all are known the cover ends here
    and begins at the oldest of them, and it is new only if that beginning moved.
    """
    last_type = "map<string,struct<pos:int,at:int>>"
    start = F.struct(
        F.map_from_arrays(F.array(), F.array()).cast(last_type).alias("last"),
        F.lit(0).alias("at"),
        F.lit(-1).alias("begun"),
        F.lit(0.0).alias("score"),
    )

    def step(acc: Column, e: Column) -> Column:
        here = F.struct(e["pos"].cast("int").alias("pos"), acc["at"].alias("at"))
        others = F.map_filter(acc["last"], lambda k, _: k != e["term"])
        last = F.map_concat(others, F.create_map(e["term"], here))
        oldest = F.array_min(F.map_values(last))
        fresh = (F.size(last) == n_terms) & (oldest["pos"] > acc["begun"])
        noise = (e["pos"] - oldest["pos"]) - (acc["at"] - oldest["at"])
        gain = F.lit(TERM_WEIGHT) / (F.lit(1.0) + noise)
        return F.struct(
            last.alias("last"),
            (acc["at"] + 1).alias("at"),
            F.when(fresh, oldest["pos"]).otherwise(acc["begun"]).alias("begun"),
            (acc["score"] + F.when(fresh, gain).otherwise(F.lit(0.0))).alias("score"),
        )

    return F.aggregate(entries, start, step)["score"]


def ranked_articles(article: DataFrame, queries: DataFrame, strict: bool = False) -> DataFrame:
    """``query_id, id, score`` of every article holding all terms of a query.

    Grouping is per (query, article), so a group is bounded by one article's length,
    however frequent a term is. One-term queries need a count, so their positions are
    not collected.
    """
    hits = matched_occurrences(article, queries, strict)
    several = F.col("n_terms") > 1
    per_article = hits.groupBy("query_id", "id", "n_terms").agg(
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_list(F.when(several, F.struct("pos", "term")))).alias("entries"),
    )
    held = F.size(F.array_distinct(F.transform("entries", lambda x: x["term"])))
    score = F.when(several, _cover_score(F.col("entries"), F.col("n_terms"))).otherwise(F.col("n") * F.lit(TERM_WEIGHT))
    return per_article.where(~several | (held == F.col("n_terms"))).select("query_id", "id", score.alias("score"))


def articles_with_all(article: DataFrame, q: str, strict: bool = False) -> DataFrame:
    """``id`` of the articles holding every term of one query text."""
    spark = article.sparkSession
    text = F.lit(q) if strict else T.unaccent(F.lit(q))
    terms = spark.range(1).select(F.array_distinct(T.tokens(text)).alias("t")).first().t
    if not terms:
        return article.select("id").where(F.lit(False))
    words = T.tokens(T.unaccent(F.coalesce("text", F.lit(""))))
    held = F.forall(F.array(*[F.lit(t) for t in terms]), lambda t: F.array_contains(F.col("_words"), t))
    rows = spread(article.select("id", "text"), "id")
    return rows.select("id", words.alias("_words")).where(held).select("id")


def top_stories(scores: DataFrame, stories: DataFrame, k: int) -> DataFrame:
    """The best ``k`` stories per query by score, newest first among equals.

    All stories of one article share its score, so only its newest k can be among the
    results, and only the k articles whose newest story ranks best can supply them.
    Both prunings are exact, and ``row_number() <= k`` runs inside each task before
    its shuffle: neither a text posted by a third of all stories nor a term found
    everywhere gathers in one task.
    """
    k = max(1, int(k))
    posted = stories.select("id", "article_id", "created_at").where("article_id is not null")
    latest = Window.partitionBy("article_id").orderBy(F.col("created_at").desc(), "id")
    recent = posted.withColumn("nth", F.row_number().over(latest)).where(F.col("nth") <= k)
    # sums of the same covers in another order may differ in their last bits
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("created_at").desc(), "id")
    newest_one = recent.where("nth = 1").drop("nth")
    per_article = scores.withColumnRenamed("id", "article_id")
    articles = (
        per_article.join(newest_one, "article_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "article_id", "score")
    )
    best = (
        articles.join(recent, "article_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
    return best.select("query_id", "rank", "id", "score")


def search_many(store, queries: DataFrame, k: int = 30, strict: bool = False) -> DataFrame:
    """Ranked hits of many queries at once: ``query_id, rank, id, score, match``.

    A store with an index is served by its postings; one without reads the articles.
    """
    from storyloom.operators import search_index

    if store.index is not None:
        return search_index.search_many(store.index, store.story, queries, k, strict)
    scores = ranked_articles(store.article, queries, strict)
    return top_stories(scores, store.story, k).withColumn("match", F.lit("lexical"))


def search(store, q: str, k: int = 30, strict: bool = False) -> DataFrame:
    """One query's hits with the stories widened only after the top k are known."""
    from storyloom.operators import feed

    spark = store.story.sparkSession
    queries = spark.createDataFrame([(0, (q or "").strip())], "query_id int, q string")
    top = search_many(store, queries, max(1, min(MAX_K, int(k))), strict).drop("query_id")
    rows = top.collect()  # at most MAX_K
    hits = spark.createDataFrame(rows, top.schema)
    ids = [r["id"] for r in rows]
    stories = store.story.where(F.col("id").isin(ids))
    tags = feed.story_tags(store, store.story_tag.where(F.col("story_id").isin(ids)))
    topics = feed.story_topics(store, store.story_topic.where(F.col("story_id").isin(ids)))
    return feed.with_vocab(stories, tags, topics).join(hits, "id")


# -- fuzzy names ---------------------------------------------------------------


def fuzzy_domains(stories: DataFrame, names: DataFrame, threshold: float = similarity.THRESHOLD) -> DataFrame:
    """``domain, name, similarity`` of the domains that resemble a name of ``names`` (column ``name``)."""
    pairs = similarity.similar_pairs(stories.select(F.col("domain").alias("text")), names.select(F.col("name").alias("text")), threshold)
    return pairs.select(F.col("a").alias("domain"), F.col("b").alias("name"), "similarity")


def fuzzy_titles(stories: DataFrame, names: DataFrame, threshold: float = similarity.THRESHOLD) -> DataFrame:
    """``id, title, name, similarity`` of the stories whose title resembles a name."""
    pairs = similarity.similar_pairs(stories.select(F.col("title").alias("text")), names.select(F.col("name").alias("text")), threshold)
    found = pairs.select(F.col("a").alias("title"), F.col("b").alias("name"), "similarity")
    return stories.select("id", "title").join(found, "title").select("id", "title", "name", "similarity")


# -- hybrid --------------------------------------------------------------------


def hybrid(lexical: DataFrame, semantic: DataFrame, k: int = 30, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists ``query_id, id, rank``.

    A hit found by both is labelled hybrid. Each list already holds at most k rows
    per query.
    """
    k = max(1, int(k))
    both = lexical.select("query_id", "id", "rank", F.lit("lexical").alias("kind")).unionByName(
        semantic.select("query_id", "id", "rank", F.lit("semantic").alias("kind"))
    )
    fused = both.groupBy("query_id", "id").agg(
        F.sum(F.lit(1.0) / (F.col("rank") + constant)).alias("score"),
        F.when(F.count(F.lit(1)) > 1, "hybrid").otherwise(F.min("kind")).alias("match"),
    )
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
