"""Upserts, vocabulary merges, cascades and integrity checks on plain Parquet tables.

Every function returns the new state of a table. Incoming rows are first collapsed to
one row per key with aggregates that combine on the map side, so a key that arrives in
a third of all rows costs one row per task; the merge itself then joins unique keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import schemas
from storyloom.functions import text as T
from storyloom.functions import urls as U
from storyloom.operators.skew import hot_from_counts, lookup, newest


def last_known(name: str, seq: str = "seq") -> Column:
    """The last non-null value in arrival order."""
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(seq))).alias(name)


def _latest(names: list[str], seq: str = "seq") -> Column:
    return F.max_by(F.struct(*names), seq).alias("_latest")


# -- stories -------------------------------------------------------------------


def story_upsert(target: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Upsert on hn_id. Titles, links and authors are overwritten, counts keep the last
    known value, the earliest creation time stays. Rows without hn_id never conflict.

    ``incoming``: source, hn_id, title, url, author, points, comments_count, created_at, seq.
    """
    fresh = incoming.withColumn("domain", U.host_domain(F.col("url")))
    new_id = lambda kind, key: F.sha2(F.concat(F.lit(kind), key.cast("string")), 256)
    columns = [c for c in target.columns]
    collapsed = (
        fresh.where("hn_id is not null")
        .groupBy("hn_id")
        .agg(
            _latest(["title", "url", "domain", "author"]),
            F.min_by("source", "seq").alias("source"),
            last_known("points"),
            last_known("comments_count"),
            F.min("created_at").alias("created_at"),
        )
        .select("hn_id", "source", "_latest.*", "points", "comments_count", "created_at", F.lit(1).alias("_in"))
    )
    t, n = target.where("hn_id is not null").alias("t"), collapsed.alias("n")
    hit = F.col("n._in").isNotNull()
    taken = {c: F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")) for c in ("title", "url", "domain", "author")}
    merged = {
        "id": F.coalesce("t.id", new_id("hn:", F.col("n.hn_id"))),
        "source": F.coalesce("t.source", "n.source"),
        "hn_id": F.coalesce("t.hn_id", "n.hn_id"),
        **taken,
        "points": F.coalesce("n.points", "t.points"),
        "comments_count": F.coalesce("n.comments_count", "t.comments_count"),
        "created_at": F.least("t.created_at", "n.created_at"),
        "fetched_at": F.when(hit, now).otherwise(F.col("t.fetched_at")),
        "article_id": F.col("t.article_id"),
    }
    keyed = t.join(n, F.col("t.hn_id") == F.col("n.hn_id"), "full").select(*[merged[c].alias(c) for c in columns])
    unkeyed = fresh.where("hn_id is null").withColumns(
        {"id": new_id("seq:", F.col("seq")), "fetched_at": now, "article_id": F.lit(None).cast("string")}
    )
    return (
        keyed.unionByName(target.where("hn_id is null")).unionByName(unkeyed.select(*columns))
    )


def story_link(target: DataFrame, links: DataFrame) -> DataFrame:
    """Point stories at their article; domain and author are only filled in.

    ``links``: story_id, article_id, domain, author, seq. Arrival order decides: the last
    article wins, the first known domain and author stay.
    """
    def first_known(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(f"_{name}")

    last = links.groupBy(F.col("story_id").alias("id")).agg(
        F.max_by("article_id", "seq").alias("_article"), first_known("domain"), first_known("author")
    )
    out = target.join(last, "id", "left")
    return out.withColumns(
        {
            "article_id": F.coalesce("_article", "article_id"),
            "domain": F.coalesce("domain", "_domain"),
            "author": F.coalesce("author", "_author"),
        }
    ).drop("_article", "_domain", "_author")


def detach_older_stories(stories: DataFrame) -> DataFrame:
    """Keep the article link only on the newest story of each article.

    The winners are found by aggregation and joined on the unique story id, so copies of
    one article never meet in one task. Nulls in fetched_at count as oldest.
    """
    order = F.struct(F.col("fetched_at").isNotNull(), "fetched_at", "created_at", F.col("id").cast("string"))
    winners = (
        stories.where("article_id is not null")
        .groupBy("article_id")
        .agg(F.max_by("id", order).alias("id"))
        .select("id", F.lit(True).alias("_keeps"))
    )
    return stories.join(winners, "id", "left").withColumn("article_id", F.when(F.col("_keeps"), F.col("article_id"))).drop("_keeps")


# -- articles ------------------------------------------------------------------


def article_dedupe(rows: DataFrame) -> DataFrame:
    """One article per content hash; the first writer's id and language stay."""
    first = F.min_by(F.struct("id", "language", "word_count"), "seq").alias("first")
    return rows.groupBy("content_hash").agg(first).select("content_hash", "first.*")


def _with_text(firsts: DataFrame, rows: DataFrame) -> DataFrame:
    """Bring the text of each chosen row back by its unique ``seq``."""
    return rows.select("seq", "text").join(firsts, "seq")


def article_upsert(target: DataFrame, incoming: DataFrame, set_language: bool) -> tuple[DataFrame, DataFrame]:
    """Insert articles by content hash; returns (articles, story links).

    ``incoming``: story_id, language, text, word_count, content_hash, seq. On conflict
    the text path overwrites the language (``set_language``), the page path does nothing.
    """
    per_hash = incoming.groupBy("content_hash").agg(
        F.min("seq").alias("seq"),
        F.max_by("language", "seq").alias("_last"),
        F.min_by("language", "seq").alias("_first"),
        F.min_by("word_count", "seq").alias("word_count"),
        F.count(F.lit(1)).alias("n"),
    )
    known = target.select("content_hash", F.col("id").alias("_id"))
    added = per_hash.join(known, "content_hash", "left_anti")
    inserted = _with_text(added, incoming).select(
        F.concat(F.lit("a-"), "content_hash").alias("id"),
        F.col("_last" if set_language else "_first").alias("language"),
        "text",
        "word_count",
        "content_hash",
    )
    kept = target
    if set_language:
        update = per_hash.select("content_hash", "_last")
        kept = target.join(update, "content_hash", "left").withColumn("language", F.coalesce("_last", "language")).drop("_last")
    articles = kept.select("id", "language", "text", "word_count", "content_hash").unionByName(inserted)
    ids = per_hash.select("content_hash").join(known, "content_hash", "left").select(
        "content_hash", F.coalesce("_id", F.concat(F.lit("a-"), "content_hash")).alias("article_id")
    )
    heavy = hot_from_counts(per_hash, "content_hash")
    links = lookup(
        incoming.select("story_id", "content_hash", "seq"), ids, "content_hash", "inner", spread="seq", heavy=heavy
    )
    return articles, links.select("story_id", "article_id", "seq")


# -- summaries -----------------------------------------------------------------


def one_summary_per_article(summary: DataFrame) -> DataFrame:
    """The newest summary per article."""
    keep = [c for c in summary.columns if c != "article_id"]
    return newest(summary, "article_id", [F.col("created_at"), F.col("id")], keep).select(*summary.columns)


def latest_k_summaries(summary: DataFrame, k: int) -> DataFrame:
    """The newest ``k`` summaries per article, pruned per task before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("article_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return summary.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def summary_upsert(target: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Upsert on article_id: model, language and text are overwritten; the JSON documents
    and the summarised time keep the last known value; creation time stays.

    ``incoming``: article_id, model, lang, summary, classification_json, ui_json,
    summarized_at, seq.
    """
    documents = ["classification_json", "ui_json", "summarized_at"]
    collapsed = (
        incoming.groupBy("article_id")
        .agg(_latest(["model", "lang", "summary"]), *[last_known(c) for c in documents])
        .select("article_id", "_latest.*", *documents)
    )
    t, n = target.alias("t"), collapsed.alias("n")
    hit = F.col("n.model").isNotNull()
    return t.join(n, F.col("t.article_id") == F.col("n.article_id"), "full").select(
        F.coalesce("t.id", F.sha2(F.col("n.article_id").cast("string"), 256)).alias("id"),
        F.coalesce("t.article_id", "n.article_id").alias("article_id"),
        *[F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in ("model", "lang", "summary")],
        F.coalesce("t.created_at", now).alias("created_at"),
        *[F.coalesce(f"n.{c}", f"t.{c}").alias(c) for c in documents],
    )


# -- vocabulary ----------------------------------------------------------------


def vocab_upsert(target: DataFrame, incoming: DataFrame, prefix: str) -> DataFrame:
    """Insert unseen slugs; an existing row keeps its name, the first arrival names a new one.

    ``incoming``: slug, name, seq and, for tags, kind.
    """
    extra = [c for c in target.columns if c not in ("id", "slug")]
    first = F.min_by(F.struct(*extra), "seq").alias("first")
    added = incoming.groupBy("slug").agg(first).join(target.select("slug"), "slug", "left_anti")
    return target.unionByName(
        added.select(F.concat(F.lit(prefix), "slug").alias("id"), "slug", "first.*").select(*target.columns)
    )


def bridge_upsert(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Set union of link pairs."""
    return target.unionByName(incoming.select(*target.columns)).distinct()


def seed(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Add the seed rows whose key is missing."""
    return target.unionByName(rows.join(target.select(key), key, "left_anti").select(*target.columns))


# -- deletes -------------------------------------------------------------------


def delete_cascade(tables: dict[str, DataFrame], stories: DataFrame, articles: DataFrame) -> dict[str, DataFrame]:
    """Remove stories and articles with everything that depends on them.

    Children of an article (summaries, embeddings) and of a story (links, signals) go;
    a surviving story whose article went loses the reference. Each table is read once. The
    deleted ids are unique, so only the table's side of a join can be skewed, and that is
    the side which the adaptive skew join splits.
    """
    gone_s = stories.select(F.col("id").alias("story_id")).distinct()
    gone_a = articles.select(F.col("id").alias("article_id")).distinct()
    out = {"article": tables["article"].join(gone_a.withColumnRenamed("article_id", "id"), "id", "left_anti")}
    for name in ("summary", "embedding"):
        out[name] = tables[name].join(gone_a, "article_id", "left_anti")
    for name in ("story_tag", "story_topic", "rank_signals"):
        out[name] = tables[name].join(gone_s, "story_id", "left_anti")
    left = tables["story"].join(gone_s.withColumnRenamed("story_id", "id"), "id", "left_anti")
    marked = left.join(gone_a.withColumn("_gone", F.lit(True)), "article_id", "left")
    out["story"] = marked.withColumn("article_id", F.when(F.col("_gone").isNull(), F.col("article_id"))).drop("_gone")
    return out


# -- integrity -----------------------------------------------------------------

_FACTS = ("broken", "keyed", "refers", "present")


def _fact(kind: str, rule: str, key: Column, when: Column) -> Column:
    flags = [F.lit(int(kind == f)).alias(f) for f in _FACTS]
    return F.when(when, F.struct(F.lit(rule).alias("rule"), key.cast("string").alias("key"), *flags))


def _allowed(rule: str, column: str, values: list[str]) -> Column:
    return _fact("broken", rule, F.col("id"), F.col(column).isNull() | ~F.col(column).isin(values))


def _required(rule: str, columns: list[str]) -> Column:
    return _fact("broken", rule, F.col("id"), F.greatest(*[F.col(c).isNull() for c in columns]) if len(columns) > 1 else F.col(columns[0]).isNull())


def _unique(rule: str, *columns: str) -> Column:
    return _fact("keyed", rule, F.concat_ws("/", *columns), F.least(*[F.col(c).isNotNull() for c in columns]) if len(columns) > 1 else F.col(columns[0]).isNotNull())


def _refers(rule: str, column: str) -> Column:
    return _fact("refers", rule, F.col(column), F.col(column).isNotNull())


def _present(rule: str) -> Column:
    return _fact("present", rule, F.col("id"), F.col("id").isNotNull())


def integrity_report(tables: dict[str, DataFrame]) -> DataFrame:
    """All constraint violations as ``rule, key, n``.

    Every table is read once; each of its rows states facts (a broken rule, a key that must
    be unique, a reference, a row that can be referred to). One aggregation by rule and key,
    combined on the map side, tells repeated keys and references without a row.
    """
    facts = {
        "story": [
            _allowed("story.source", "source", schemas.SOURCES), _required("story.not_null", ["title", "created_at", "fetched_at"]),
            _unique("story.hn_id", "hn_id"), _unique("story.article_id", "article_id"), _refers("story.article", "article_id"),
            _present("story_tag.story"), _present("story_topic.story"), _present("rank_signals.story"),
        ],
        "article": [
            _required("article.not_null", ["text", "content_hash"]), _unique("article.content_hash", "content_hash"),
            _present("story.article"), _present("summary.article"), _present("embedding.article"),
        ],
        "summary": [_unique("summary.article_id", "article_id"), _refers("summary.article", "article_id")],
        "embedding": [_unique("embedding.article_model", "article_id", "model_key"), _refers("embedding.article", "article_id")],
        "tag": [_allowed("tag.kind", "kind", schemas.TAG_KINDS), _unique("tag.slug", "slug"), _present("story_tag.tag")],
        "topic": [_unique("topic.slug", "slug"), _present("story_topic.topic")],
        "story_tag": [_refers("story_tag.story", "story_id"), _refers("story_tag.tag", "tag_id")],
        "story_topic": [_refers("story_topic.story", "story_id"), _refers("story_topic.topic", "topic_id")],
        "rank_signals": [_refers("rank_signals.story", "story_id")],
    }
    out = None
    for name, stated in facts.items():
        part = tables[name].select(F.explode(F.array_compact(F.array(*stated))).alias("f")).select("f.*")
        out = part if out is None else out.unionByName(part)
    sums = out.groupBy("rule", "key").agg(*[F.sum(f).alias(f) for f in _FACTS])
    lost = F.when(F.col("present") == 0, F.col("refers")).otherwise(0)
    n = F.when(F.col("keyed") > 1, F.col("keyed")).otherwise(F.col("broken") + lost)
    return sums.select("rule", "key", n.cast("long").alias("n")).where("n > 0")


# -- table writes --------------------------------------------------------------


def write_snapshot(df: DataFrame, root: str, name: str, version: int) -> str:
    """Write a new state beside the one being read and return its path.

    Readers switch by version, so a lost executor or a failed job never leaves a half
    table in place of the old one.
    """
    path = f"{root}/{name}/v{version:012d}"
    df.write.mode("overwrite").parquet(path)
    return path
