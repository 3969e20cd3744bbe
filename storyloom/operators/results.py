"""Validation of summarize jobs and model results, and what a result adds to the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import schemas
from storyloom.functions import text as T

SUMMARY_CHARS = 800
LABELS = 6
STORED_LABELS = 10
# Spellings of known tags and the audiences a card may name.
TAG_SPELLING = {"btrfs": "Btrfs"}
AUDIENCES = [
    "Kernel Devs", "OSS Maintainers", "Data Scientists",
    "Frontend Engineers", "Backend Engineers", "Security Engineers",
]


# Fields of the two documents a result carries.
CLASSIFICATION = ["primary_category", "type", "tags", "topics"]
UI = ["summary_140", "quicktake", "audience", "impact_score", "confidence", "reading_time_min", "link_props"]


# -- jobs ----------------------------------------------------------------------


def _kind(doc: Column, path: str) -> Column:
    """JSON kind at a path: null when the key is absent, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))


class _Rules:
    """Rules over one JSON document; each gives the rule's name where it is broken, else null."""

    def __init__(self, value: str, doc: str | None = None):
        self.text, self.doc = F.col(value), F.try_parse_json(value) if doc is None else F.col(doc)

    def kind(self, path: str) -> Column:
        return _kind(self.doc, path)

    @staticmethod
    def bad(name: str, rule: Column) -> Column:
        return F.when(~F.coalesce(rule, F.lit(False)), F.lit(name))

    def string(self, path: str) -> Column:
        return self.bad(path[2:], self.kind(path) == "STRING")

    def given(self, path: str) -> Column:
        return F.trim(F.get_json_object(self.text, path))

    def number(self, path: str) -> Column:
        kind = self.kind(path)
        return kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | F.startswith(kind, F.lit("DECIMAL"))

    def integer(self, path: str) -> Column:
        """A whole number, also as text or with a zero fraction."""
        whole = self.given(path).rlike(r"^[+-]?[0-9]+(\.0*)?([eE]\+?[0-9]+)?$")
        return (self.kind(path) == "BOOLEAN") | ((self.number(path) | (self.kind(path) == "STRING")) & whole)

    def real(self, path: str) -> Column:
        return self.number(path) | ((self.kind(path) == "STRING") & self.given(path).try_cast("double").isNotNull())

    def flag(self, path: str) -> Column:
        words = F.lower(self.given(path)).isin("0", "1", "true", "false", "yes", "no", "on", "off", "t", "f", "y", "n")
        return (self.kind(path) == "BOOLEAN") | ((self.integer(path) | (self.kind(path) == "STRING")) & words)

    def strings(self, path: str) -> Column:
        items = F.from_json(F.get_json_object(self.text, path), "array<variant>")
        return F.startswith(self.kind(path), F.lit("ARRAY")) & F.forall(items, lambda v: F.schema_of_variant(v) == "STRING")

    def nullable(self, path: str, rule: Column) -> Column:
        """The key must be there; null is allowed."""
        return self.bad(path[2:], (self.kind(path) == "VOID") | rule)

    def optional(self, path: str, rule: Column, null: bool = True) -> Column:
        kind = self.kind(path)
        return self.bad(path[2:], kind.isNull() | ((kind == "VOID") & F.lit(null)) | rule)

    def record(self, path: str) -> Column:
        return F.startswith(self.kind(path), F.lit("OBJECT"))

    def version(self) -> Column:
        same = self.given("$.schema_version").try_cast("double") == schemas.SCHEMA_VERSION
        return self.optional("$.schema_version", self.integer("$.schema_version") & same, null=False)


def job_errors(value: str = "value") -> Column:
    """Names of the rules a summarize job breaks; an empty array means valid.

    Optional keys without a default must be present although null is allowed.
    """
    r = _Rules(value)
    bad, string, integer, real, flag, strings = r.bad, r.string, r.integer, r.real, r.flag, r.strings
    nullable, optional, record, doc, text = r.nullable, r.optional, r.record, r.doc, r.text
    has_hints, has_metrics = record("$.hints"), record("$.metrics")
    language = F.length(F.get_json_object(text, "$.article.language"))
    rules = [
        bad("json", doc.isNotNull()),
        string("$.trace_id"),
        *[string(f"$.story.{c}") for c in ("id", "source", "title", "url", "domain", "created_at")],
        nullable("$.story.hn_id", integer("$.story.hn_id")),
        string("$.article.id"),
        bad("article.language", (_kind(doc, "$.article.language") == "STRING") & language.between(2, 5)),
        nullable("$.article.word_count", integer("$.article.word_count")),
        *[optional(f"$.article.{c}", flag(f"$.article.{c}")) for c in ("is_pdf", "is_paywalled")],
        *[optional(f"$.article.{c}", _kind(doc, f"$.article.{c}") == "STRING") for c in ("text_head", "text_tail")],
        optional("$.article.headings", strings("$.article.headings")),
        bad("hints", (_kind(doc, "$.hints") == "VOID") | has_hints),
        F.when(has_hints, nullable("$.hints.source_reputation", real("$.hints.source_reputation"))),
        F.when(has_hints, optional("$.hints.candidate_tags", strings("$.hints.candidate_tags"))),
        bad("metrics", (_kind(doc, "$.metrics") == "VOID") | has_metrics),
        *[F.when(has_metrics, nullable(f"$.metrics.{c}", integer(f"$.metrics.{c}"))) for c in ("points", "comments")],
        F.when(has_metrics, nullable("$.metrics.captured_at", _kind(doc, "$.metrics.captured_at") == "STRING")),
        optional("$.attempt", integer("$.attempt"), null=False),
        r.version(),
    ]
    return F.array_compact(F.array(*rules))


def validate_jobs(jobs: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``errors`` and ``reason`` (SCHEMA_MISMATCH or null)."""
    checked = jobs.withColumn("errors", job_errors(value))
    return checked.withColumn("reason", F.when(F.size("errors") > 0, "SCHEMA_MISMATCH"))


# -- results -------------------------------------------------------------------


def clip_summary(c: Column, limit: int = SUMMARY_CHARS) -> Column:
    return F.substring(T.trim_py(F.coalesce(c, F.lit(""))), 1, limit)


def clean_labels(c: Column, spelling: dict[str, str] | None = None) -> Column:
    """The leading labels, trimmed, of fitting length; known ones respelled."""
    head = F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, LABELS)
    trimmed = F.transform(head, lambda t: T.trim_py(F.coalesce(t, F.lit(""))))
    fitting = F.filter(trimmed, lambda t: F.length(t).between(2, 40))
    if not spelling:
        return fitting

    def respelled(t: Column) -> Column:
        options = [F.when(F.lower(t) == known, F.lit(written)) for known, written in spelling.items()]
        return F.coalesce(*options, t)

    return F.transform(fitting, respelled)


def known_audience(c: Column) -> Column:
    """Only audiences of the controlled list; order and repeats stay."""
    return F.filter(c, lambda a: a.isin(AUDIENCES))


def clamp(c: Column, low, high) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def result_errors(value: str = "value", doc: str | None = None) -> Column:
    """Names of the rules a result message breaks; an empty array means valid. ``doc``: the column that holds the parsed message, if any."""
    r = _Rules(value, doc)
    lang = F.length(F.get_json_object(value, "$.lang"))
    kind = F.get_json_object(value, "$.classification.type")
    stamps = F.from_json(F.get_json_object(value, "$.timestamps"), "map<string,variant>")
    inside = lambda path, rule: F.when(r.record(path[: path.index(".", 2)]), rule)
    ui = {
        "summary_140": lambda p: r.kind(p) == "STRING", "quicktake": r.strings, "audience": r.strings, "impact_score": r.integer,
        "confidence": r.real, "reading_time_min": r.integer, "link_props": r.record,
    }
    rules = [
        r.bad("json", r.doc.isNotNull()),
        *[r.string(f"$.{c}") for c in ("trace_id", "story_id", "article_id", "model")],
        r.bad("lang", (r.kind("$.lang") == "STRING") & lang.between(2, 5)),
        r.bad("summary", (r.kind("$.summary") == "STRING") & (F.length(clip_summary(F.get_json_object(value, "$.summary"))) > 0)),
        r.bad("classification", r.record("$.classification")),
        inside("$.classification.type", r.optional("$.classification.type", kind.isin(schemas.CLASS_TYPES))),
        inside("$.classification.primary_category", r.optional("$.classification.primary_category", r.kind("$.classification.primary_category") == "STRING")),
        *[inside(f"$.classification.{c}", r.optional(f"$.classification.{c}", r.strings(f"$.classification.{c}"), null=False)) for c in ("tags", "topics")],
        r.bad("ui", r.record("$.ui")),
        *[inside(f"$.ui.{c}", r.optional(f"$.ui.{c}", rule(f"$.ui.{c}"))) for c, rule in ui.items()],
        r.bad("timestamps", r.record("$.timestamps") & F.forall(F.map_values(stamps), lambda v: F.schema_of_variant(v) == "STRING")),
        r.version(),
    ]
    return F.array_compact(F.array(*rules))


def decode_results(messages: DataFrame, value: str = "value") -> DataFrame:
    """Result messages taken apart: ``errors``, the fields of ``schemas.RESULT``, and both documents' fields as columns."""
    m = F.from_json(value, schemas.RESULT)
    kept = [c for c in messages.columns if c != value]
    # parsed once as a column, not once for each rule
    parsed = messages.select(*kept, value, F.try_parse_json(value).alias("_doc"))
    rows = parsed.select(*kept, result_errors(value, "_doc").alias("errors"), m.alias("m"))
    plain = ["trace_id", "story_id", "article_id", "model", "lang", "summary", "schema_version"]
    stamp = F.to_timestamp(F.try_element_at("m.timestamps", F.lit("summarized_at")))
    return rows.select(*kept, "errors", *[F.col(f"m.{c}").alias(c) for c in plain], "m.classification.*", "m.ui.*", stamp.alias("summarized_at"))


def clean_results(decoded: DataFrame) -> DataFrame:
    """Decoded results with clean fields; both documents stay whole."""
    return decoded.withColumns(
        {
            "summary": clip_summary(F.col("summary")),
            "type": F.coalesce("type", F.lit("news")),
            "tags": clean_labels(F.col("tags"), TAG_SPELLING),
            "topics": clean_labels(F.col("topics")),
            "audience": known_audience(F.col("audience")),
            "impact_score": clamp(F.col("impact_score"), 0, 100),
            "confidence": clamp(F.col("confidence"), 0.0, 1.0),
        }
    )


def gate_results(results: DataFrame) -> DataFrame:
    """Adds ``skip``: missing_fields when article, summary or model is missing or empty."""
    def given(c: str) -> Column:
        return F.coalesce(F.length(F.col(c).cast("string")) > 0, F.lit(False))

    present = given("article_id") & given("summary") & given("model")
    return results.withColumn("skip", F.when(~present, "missing_fields"))


def result_summaries(results: DataFrame) -> DataFrame:
    """Summary rows of accepted results, ready for the upsert."""
    return results.select(
        "article_id",
        "model",
        F.coalesce(F.nullif("lang", F.lit("")), F.lit("en")).alias("lang"),
        "summary",
        F.to_json(F.struct(*CLASSIFICATION)).alias("classification_json"),
        F.to_json(F.struct(*UI)).alias("ui_json"),
        "summarized_at",
        "seq",
    )


def result_labels(results: DataFrame, column: str) -> DataFrame:
    """``story_id, slug, name, seq``: one row per usable label of an accepted result."""
    given = F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda t: F.length(t) > 0)
    exploded = results.select("story_id", "seq", F.posexplode(F.slice(given, 1, STORED_LABELS)).alias("nth", "name"))
    slugged = exploded.select(
        "story_id", T.slugify(F.col("name")).alias("slug"), "name", (F.col("seq") * 100 + F.col("nth")).alias("seq")
    )
    return slugged.where("slug is not null")
