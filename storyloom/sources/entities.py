"""Entity tables shaped from the landed tables (see FIXTURES.md).

On a cluster these would be stored tables; here each method derives one from the
given Parquet so that every query reads the whole of its inputs.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom import schemas
from storyloom.functions import text as T
from storyloom.functions import urls as U
from storyloom.operators import search_index
from storyloom.operators.skew import hot_from_counts, lookup
from storyloom.session import shared_dir
from storyloom.sources.tables import Tables

#: Stored indexes by session and folder.
_INDEXES: dict[tuple[str, str], search_index.Index] = {}

AS_OF = "2024-01-08 00:00:00"
MODEL = "m1"
DOMAIN = "regexp_replace(lower(try_parse_url(url, 'HOST')), '^www\\\\.', '')"
EMPTY_PAGE = "<html><script>var a = '<p>x</p>'</script><body> </body></html>"


def ts(value: str):
    return F.lit(value).cast("timestamp")


def once(method):
    """Build a frame at most once per Entities object."""

    @functools.wraps(method)
    def wrapper(self):
        made = self.__dict__.setdefault("_made", {})
        if method.__name__ not in made:
            made[method.__name__] = method(self)
        return made[method.__name__]

    return wrapper


class Entities:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.t = Tables(spark, folder)

    # -- shared pieces ---------------------------------------------------------

    @once
    def events(self) -> DataFrame:
        return self.t.events.selectExpr(
            "event_id", "user_id", "event_type", "value", "props",
            "CAST(ts AS timestamp) AS ts",
            "CAST(get_json_object(props, '$.k') AS int) AS k",
        )

    def with_page(self, df: DataFrame, key: str, spread: str | None = None) -> DataFrame:
        """Give each row the URL of a page; every tenth key has none."""
        pages = self.t.pages
        count = pages.agg(F.count(F.lit(1))).scalar()
        slot = F.when(F.col(key) % 10 != 9, F.col(key) % count)
        keyed = df.withColumn("page_id", slot)
        urls = pages.select("page_id", "url")
        if spread is None:  # unique keys fall evenly on the pages
            return keyed.join(urls, "page_id", "left").drop("page_id")
        return lookup(keyed, urls, "page_id", spread=spread).drop("page_id")

    # -- story side ------------------------------------------------------------

    @once
    def sig(self) -> DataFrame:
        return self.events().groupBy("user_id").agg(
            F.expr("CAST(count_if(event_type IN ('view', 'click')) AS int) AS points"),
            F.expr("CAST(count_if(event_type IN ('signup', 'purchase')) AS int) AS comments_count"),
            F.expr("min(ts) AS t0"),
            F.expr("max(ts) AS t1"),
        )

    @once
    def _copies(self) -> DataFrame:
        """``copy, article_id, n``: copies of one text, their first id and their number."""
        docs = self.t.documents.select("doc_id", F.sha2("text", 256).alias("copy"))
        return docs.groupBy("copy").agg(F.min("doc_id").alias("article_id"), F.count(F.lit(1)).alias("n"))

    def heavy_articles(self):
        """Articles posted very often, from the counts the article ids need anyway."""
        return hot_from_counts(self._copies(), "article_id")

    def _posts(self, *extra: str) -> DataFrame:
        """Documents as stories, copies of one text sharing an article id."""
        docs = self.t.documents.withColumn("copy", F.sha2("text", 256))
        copies = self._copies()
        slim = docs.selectExpr(
            "doc_id AS id", "substring(text, 1, 80) AS title", "source AS author", "lang", "copy", *extra
        )
        heavy = hot_from_counts(copies, "copy")
        # copies are distinct, so a table of them is small in each task; posts are not sorted
        return lookup(slim, copies.select("copy", "article_id").hint("shuffle_hash"), "copy", heavy=heavy).drop("copy")

    def story(self, *extra: str) -> DataFrame:
        posts = self.with_page(self._posts(*extra), "id")
        joined = posts.join(self.sig().withColumnRenamed("user_id", "id"), "id", "left")
        dated = joined.selectExpr("*", "coalesce(t0, timestamp_seconds(1704067200 + id * 60)) AS created_at")
        return dated.selectExpr(
            "id",
            "element_at(array('hn', 'blog', 'lobsters', 'devto'), CAST(id % 4 + 1 AS int)) AS source",
            "CASE WHEN id % 4 = 0 THEN CAST(id AS int) END AS hn_id",
            "title",
            "url",
            f"{DOMAIN} AS domain",
            "author",
            "points",
            "comments_count",
            "created_at",
            "coalesce(t1, created_at) AS fetched_at",
            "article_id",
            "lang",
            *extra,
        )

    def stories(self) -> DataFrame:
        return self.story().drop("lang")

    def article(self) -> DataFrame:
        """The first copy of each text. What is known of it is narrow and hashed, so that texts pass one join and no sort."""
        firsts = self._copies().select(F.col("article_id").alias("id"), "copy")
        known = self.with_page(firsts, "id").selectExpr("id AS _id", "copy AS _copy", f"{DOMAIN} AS domain")
        docs = self.t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "text", F.sha2("text", 256).alias("copy"))
        first = docs.join(known.hint("shuffle_hash"), (F.col("id") == F.col("_id")) & (F.col("copy") == F.col("_copy")))
        return first.select(
            "id",
            "language",
            "text",
            T.word_count(F.col("text")).alias("word_count"),
            T.sha256_hash(F.col("language"), F.coalesce("domain", F.lit("")), F.col("text")).alias("content_hash"),
        )

    def article_text(self) -> DataFrame:
        """Only id and text of the articles: one pass, one shuffle of hashes."""
        firsts = self._copies().select(F.col("article_id").alias("id"))
        docs = self.t.documents.select(F.col("doc_id").alias("id"), "text")
        return docs.join(firsts, "id", "left_semi")

    def search_index(self) -> search_index.Index:
        """The stored index of the articles, built once per session and folder."""
        at = (self.spark.sparkContext.applicationId, self.t.folder)
        if at not in _INDEXES:
            _INDEXES[at] = search_index.build(self.article_text(), f"{shared_dir(self.spark)}/search-{uuid.uuid4().hex}")
        return _INDEXES[at]

    def summary(self) -> DataFrame:
        turns = self.t.conversations.where("role = 'assistant'").selectExpr(
            "*", "conv_id % 2 = 0 AS even", "turn = 3 AS blank", "timestamp_seconds(1706745600 + turn * 3600) AS at"
        )
        unless_blank = "CASE WHEN blank THEN '' ELSE CAST({0} AS string) END AS {1}"
        ui = f"""to_json(struct(
            CASE WHEN turn <> 5 THEN substring(text, 1, 20) END AS summary_140,
            {unless_blank.format('turn', 'reading_time_min')},
            {unless_blank.format('turn * 10', 'impact_score')},
            {unless_blank.format('CAST(turn * 0.1 AS decimal(3,1))', 'confidence')},
            slice(filter(split(text, '[ \\\\n]+'), w -> w <> ''), 1, 2) AS quicktake,
            struct({unless_blank.format("turn = 1", 'paywall')}, 'html' AS format,
                   {unless_blank.format("false", 'is_pdf')}) AS link_props))"""
        kind = "to_json(struct(CASE WHEN turn = 1 THEN 'news' ELSE 'article' END AS type))"
        return turns.selectExpr(
            "concat_ws('-', conv_id, turn) AS id",
            "conv_id AS article_id",
            f"'{MODEL}' AS model",
            "'en' AS lang",
            "text AS summary",
            "at AS created_at",
            f"CASE WHEN even THEN {kind} END AS classification_json",
            f"CASE WHEN even THEN {ui} END AS ui_json",
            "CASE WHEN even THEN at END AS summarized_at",
        )

    def rank_signals(self, as_of: str = AS_OF) -> DataFrame:
        """Hot score of every story with points. Only signal columns are read."""
        created = F.col("t0")
        ids = self.t.documents.select(F.col("doc_id").alias("story_id"))
        scored = self.sig().where("points is not null").select(
            F.col("user_id").alias("story_id"),
            F.round(
                T.hot_score(
                    F.col("points"), F.coalesce("comments_count", F.lit(0)), T.age_hours(ts(as_of), created)
                ),
                12,
            ).alias("hot_score"),
            ts(as_of).alias("decay_ts"),
            F.col("points").alias("click_count"),
            F.lit(None).cast("int").alias("dwell_ms_avg"),
        )
        return scored.join(ids, "story_id", "left_semi")

    # -- vocabulary ------------------------------------------------------------

    @once
    def _tag_pairs(self) -> DataFrame:
        by_source = self.t.documents.selectExpr("doc_id AS story_id", "source AS slug")
        labels = self.t.labels.selectExpr(
            "doc_id AS story_id", "explode(array(concat('quality-', quality), concat('toxic-', toxic))) AS slug"
        )
        return by_source.union(labels)

    def story_tag(self) -> DataFrame:
        return self._tag_pairs().selectExpr("story_id", "concat('tag:', slug) AS tag_id").distinct()

    def tag(self) -> DataFrame:
        return (
            self._tag_pairs()
            .select("slug")
            .distinct()
            .selectExpr(
                "concat('tag:', slug) AS id",
                "slug",
                "upper(slug) AS name",
                "CASE WHEN slug RLIKE '^(quality|toxic)-' THEN 'meta' ELSE 'tech' END AS kind",
            )
        )

    def story_topic(self) -> DataFrame:
        return self.t.documents.select(
            F.col("doc_id").alias("story_id"), F.concat(F.lit("topic:"), "lang").alias("topic_id")
        )

    def topic(self) -> DataFrame:
        slugs = self.t.documents.select(F.col("lang").alias("slug")).distinct()
        return slugs.select(F.concat(F.lit("topic:"), "slug").alias("id"), "slug", F.upper("slug").alias("name"))

    def embedding_model(self) -> DataFrame:
        return self.spark.createDataFrame([("default", 64, "local")], "key string, dimensions int, provider string")

    def embedding(self) -> DataFrame:
        vector = F.col("embedding").cast("array<double>")
        short = F.col("vec_id") % 97 == 0
        return self.t.embeddings.select(
            F.col("vec_id").alias("article_id"),
            F.when(F.col("vec_id").isNotNull(), "default").alias("model_key"),
            F.when(short, F.slice(vector, 1, 63)).otherwise(vector).alias("vector"),
        )

    def vectors(self) -> DataFrame:
        return self.t.embeddings.select(
            F.col("vec_id").alias("article_id"), F.col("embedding").cast("array<double>").alias("vector"), "label"
        )

    # -- ingest side -----------------------------------------------------------

    def item(self) -> DataFrame:
        ev = self.with_page(self.events(), "user_id", spread="event_id")
        return ev.select(
            F.col("user_id").alias("id"),
            F.col("event_id").alias("seq"),
            F.when(F.col("event_type") == "signup", "job").otherwise("story").alias("type"),
            F.concat_ws(" ", F.lit("Item"), "user_id", "event_type").alias("title"),
            "url",
            F.concat(F.lit("u"), "user_id").alias("by"),
            F.unix_seconds("ts").alias("time"),
            F.floor(F.col("value") / 4).cast("int").alias("score"),
            (F.col("k") % 40).alias("descendants"),
            F.when(F.col("url").isNull(), F.concat_ws(" ", "event_type", "props")).alias("text"),
            ((F.col("event_type") == "error") & (F.col("k") < 50)).alias("dead"),
            (F.col("k") == 0).alias("deleted"),
        )

    def item_json(self) -> DataFrame:
        """Items as landed: one JSON document per row."""
        fields = ["id", "type", "title", "url", "by", "time", "score", "descendants", "text", "dead", "deleted"]
        return self.item().select("seq", F.to_json(F.struct(*fields)).alias("value"))

    def ranked_list(self) -> DataFrame:
        return self.events().select(
            F.col("event_type").alias("list_name"), F.col("event_id").alias("pos"), F.col("user_id").alias("item_id")
        )

    def seen(self) -> DataFrame:
        """Ids already processed: those first met in the opening hours."""
        first = self.events().groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("seen_at"))
        return first.where(F.col("seen_at") < ts("2024-01-01 03:00:00"))

    def done(self) -> DataFrame:
        """Markers of finished stories: the last purchase of each id."""
        return (
            self.events()
            .where("event_type = 'purchase'")
            .groupBy(F.col("user_id").alias("story_id"))
            .agg(F.max("ts").alias("done_at"))
            .select("story_id", F.lit(MODEL).alias("model"), "done_at")
        )

    def submission_json(self) -> DataFrame:
        """Bodies posted to the ingest endpoint, with optional fields left out here and there."""
        seq = F.col("seq")

        def unless(mod: int, value):
            return F.when(seq % mod != 0, value)

        body = F.struct(
            F.when(seq % 4 == 0, "lobsters").alias("source"),
            unless(7, F.col("id")).alias("hn_id"),
            F.col("title"),
            F.col("url"),
            unless(3, F.col("by")).alias("author"),
            unless(11, F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at"),
            unless(5, F.col("score")).alias("points"),
            unless(2, F.col("descendants")).alias("comments_count"),
            F.col("text"),
        )
        return self.item().select("seq", F.to_json(body).alias("value"))

    # -- scrape side -----------------------------------------------------------

    def job_raw(self) -> DataFrame:
        """Scrape jobs as landed text: some broken, some with parts missing."""
        n = F.col("page_id")
        story = F.struct(
            F.when(n % 13 != 0, n.cast("string")).alias("id"),
            F.when(n % 2 == 0, n.cast("int")).alias("hn_id"),
            F.lit("hn").alias("source"),
            F.concat_ws(" ", F.lit("Page"), n).alias("title"),
            F.when(n % 17 != 0, F.col("url")).alias("url"),
            U.host_domain(F.col("url")).alias("domain"),
            F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        )
        job = F.to_json(
            F.struct(
                F.concat(F.lit("t-"), n).alias("trace_id"),
                story.alias("story"),
                (n % 4).cast("int").alias("attempt"),
                F.when(n % 11 == 0, 2).otherwise(1).alias("schema_version"),
            )
        )
        broken = F.substring(job, 1, 20)
        return self.t.pages.select("page_id", F.when(n % 19 == 0, broken).otherwise(job).alias("value"))

    def fetch_log(self) -> DataFrame:
        n = F.col("page_id")
        statuses = F.array(*[F.lit(s) for s in (200, 200, 301, 403, 404, 429, 500, 503)])
        return self.t.pages.select(
            "page_id",
            "url",
            F.element_at(statuses, (n % 8 + 1).cast("int")).alias("status"),
            F.when(n % 9 == 0, "application/pdf").otherwise("text/HTML; charset=utf-8").alias("content_type"),
            F.when(n % 21 == 0, EMPTY_PAGE)
            .when(n % 5 == 0, F.concat("html", F.lit(" subscribe")))
            .otherwise(F.col("html"))
            .alias("html"),
        )

    def paragraph_text(self) -> DataFrame:
        return self.t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))

    # -- summarize side --------------------------------------------------------

    def summarize_jobs(self) -> DataFrame:
        """Summarize jobs as JSON text with keys missing or null in turn."""
        n = F.col("doc_id")
        story = F.struct(
            n.cast("string").alias("id"),
            F.col("source"),
            F.substring("text", 1, 40).alias("title"),
            F.when(n % 6 != 0, F.concat(F.lit("https://e.example/"), n)).alias("url"),
            F.lit("e.example").alias("domain"),
            F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        )
        article = F.struct(
            n.cast("string").alias("id"),
            F.when(n % 7 == 0, "x").otherwise(F.col("lang")).alias("language"),
        )
        text = F.to_json(
            F.struct(
                F.concat(F.lit("s-"), n).alias("trace_id"),
                story.alias("story"),
                article.alias("article"),
                (n % 3).cast("int").alias("attempt"),
                F.when(n % 11 == 0, 2).otherwise(1).alias("schema_version"),
            )
        )
        # keys that must exist although null is allowed are spliced in as text
        text = F.when(n % 9 == 0, text).otherwise(F.replace(text, F.lit('"story":{'), F.lit('"hints":null,"metrics":null,"story":{"hn_id":null,')))
        text = F.when(n % 10 == 0, text).otherwise(F.replace(text, F.lit('"article":{'), F.lit('"article":{"word_count":null,')))
        return self.t.documents.select("doc_id", text.alias("value"))

    def result(self) -> DataFrame:
        """Summarizer output, one row per assistant turn, before cleaning."""
        turn, conv = F.col("turn"), F.col("conv_id")
        words = T.words_py(F.col("text"))
        return self.t.conversations.where("role = 'assistant'").select(
            conv.alias("story_id"),
            F.when(conv % 23 != 0, conv).alias("article_id"),
            turn.alias("turn"),
            (conv * 100 + turn).alias("seq"),
            F.when(conv % 29 != 0, F.lit(MODEL)).alias("model"),
            F.when(conv % 31 != 0, F.when(conv % 37 == 0, "e").otherwise("en")).alias("lang"),
            F.when(turn == 7, "  ").otherwise(F.concat(F.lit("  "), "text")).alias("summary"),
            F.slice(words, 1, 12).alias("tags"),
            F.array(F.lit("en"), F.concat(F.lit("Source "), conv % 20), F.lit(""), F.lit("x")).alias("topics"),
            F.when(conv % 20 == 0, "rumor").when(conv % 3 == 0, "research").alias("type"),
            F.when(turn != 3, turn * 40 - 60).cast("int").alias("impact_score"),
            F.when(turn != 3, F.round(turn * 0.4 - 0.3, 6)).alias("confidence"),
            F.array(F.lit("Kernel Devs"), F.lit("Everyone"), F.lit("Data Scientists"), F.lit("Kernel Devs")).alias("audience"),
            F.when(conv % 41 == 0, 2).otherwise(1).alias("schema_version"),
            F.when(conv % 3 != 0, F.timestamp_seconds(F.lit(1706745600) + turn * 3600)).alias("summarized_at"),
        )

    def result_json(self) -> DataFrame:
        """Result messages as landed; some lack parts that a message must have."""
        turn, conv = F.col("turn"), F.col("story_id")
        words = T.words_py(F.col("text"))
        turns = self.result().join(self.t.conversations.select(F.col("conv_id").alias("story_id"), "turn", "text"), ["story_id", "turn"])
        classification = F.struct(F.when(turn == 1, "tech").alias("primary_category"), "type", "tags", "topics")
        props = F.struct((turn == 1).alias("paywall"), F.lit("html").alias("format"), F.lit(False).alias("is_pdf"))
        ui = F.struct(
            F.when(turn != 5, F.substring("text", 1, 20)).alias("summary_140"), F.slice(words, 1, 2).alias("quicktake"), "audience", "impact_score",
            "confidence", turn.cast("int").alias("reading_time_min"), F.when(turn != 3, props).alias("link_props"),
        )
        stamps = F.map_filter(F.create_map(F.lit("summarized_at"), F.date_format("summarized_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), lambda _, v: v.isNotNull())
        message = F.struct(
            F.when(conv % 43 != 0, F.concat(F.lit("t-"), "seq")).alias("trace_id"), conv.cast("string").alias("story_id"),
            F.col("article_id").cast("string").alias("article_id"), "model", "lang", "summary",
            F.when(conv % 47 != 0, classification).alias("classification"), F.when(conv % 53 != 0, ui).alias("ui"),
            F.when(conv % 59 != 0, stamps).alias("timestamps"), "schema_version",
        )
        return turns.select("seq", "turn", F.to_json(message).alias("value"))

    # -- logs and metrics ------------------------------------------------------

    def log(self) -> DataFrame:
        row = F.to_json(
            F.struct(
                F.col("event_id"),
                F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
                F.concat(F.lit("tok-"), "user_id").alias("Token"),
                F.struct(
                    F.concat(F.lit("pw-"), "k").alias("password"),
                    F.array(F.struct(F.lit("s").alias("secret"), F.col("k").alias("n"))).alias("items"),
                    F.col("event_type"),
                ).alias("ctx"),
            )
        )
        port = F.when(F.col("k") % 3 == 0, F.concat(F.lit("user"), "user_id", F.lit(":p"), "k", F.lit("@"))).when(
            F.col("k") % 3 == 1, F.concat(F.lit("key"), "k", F.lit("@"))
        ).otherwise("")
        return self.events().select(
            "event_id", row.alias("row"), F.concat(F.lit("redis://"), port, F.lit("cache.example:6379/0")).alias("url")
        )

    def metrics(self) -> DataFrame:
        """Long rows (run_id, at, kind, name, value): a counter and a timing per event."""
        ev = self.events()
        per_run = ev.groupBy(F.floor(F.col("event_id") / 50).alias("run_id"), F.col("event_type").alias("name")).agg(
            F.max("ts").alias("at"), F.count(F.lit(1)).cast("double").alias("n"), F.round(F.sum("value"), 4).alias("ms")
        )
        return per_run.select(
            "run_id",
            "at",
            "name",
            F.explode(
                F.array(
                    F.struct(F.lit("counter").alias("kind"), F.col("n").alias("value")),
                    F.struct(F.lit("timing").alias("kind"), F.col("ms").alias("value")),
                )
            ).alias("m"),
        ).select("run_id", "at", "name", "m.kind", "m.value")

    def suffixes(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(s,) for s in ("com", "org", "net", "uk", "co.uk", "io", "dev")], "suffix string"
        )
