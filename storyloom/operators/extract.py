"""Landed pages to text: decoding, extraction, routing, language, summarize jobs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from storyloom import schemas
from storyloom.functions import text as T
from storyloom.functions import urls as U
from storyloom.functions.html import read_page
from storyloom.operators import ingest
from storyloom.session import spread

PAGE = "text string, headings array<string>, author string, main string"
REPUTATION = 0.5


# -- decoding ------------------------------------------------------------------


_DECLARED = re.compile(rb"<(?:meta|\?xml)[^>]{0,400}?(?:charset|encoding)\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)
_HIGH_RUNS = re.compile(rb"[\x80-\xff]+")
# Letters by which a decoded text shows its script.
_KANA = re.compile("[\u3040-\u30ff]")
_HAN = re.compile("[\u4e00-\u9fff]")
_HANGUL = re.compile("[\uac00-\ud7af]")


def _decoded(body: bytes, charset: str) -> str | None:
    try:
        return body.decode(charset)
    except (LookupError, UnicodeDecodeError):
        return None


def _many_byte(body: bytes) -> str | None:
    """East Asian text: the first encoding whose strict reading is mostly letters of its script.

    Japanese needs kana, Korean needs Hangul; almost anything reads as Han, so it comes last.
    """
    for charset, script in (("shift_jis", _KANA), ("euc_jp", _KANA), ("euc_kr", _HANGUL), ("gb18030", _HAN), ("big5", _HAN)):
        text = _decoded(body, charset)
        if text is None:
            continue
        other = sum(ord(c) > 127 for c in text)
        fitting = len(script.findall(text)) + (len(_HAN.findall(text)) if script is _KANA and script.search(text) else 0)
        if other and fitting > 0.5 * other:
            return text
    return None


def guess_text(body: bytes, declared: str | None = None) -> str:
    """Text of a body that is no valid UTF-8.

    In this order: byte-order mark, the declared charset (of the header, then of the page
    itself), East Asian encodings that read as such, one-byte Cyrillic or Greek where most
    letters stand in runs beyond ASCII, one-byte Latin, UTF-8 without the bad bytes.
    """
    for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            return body.decode(name, errors="ignore")
    inside = _DECLARED.search(body[:4096])
    for charset in (declared, inside and inside[1].decode("ascii")):
        if charset and charset.lower().replace("_", "-") not in ("utf-8", "utf8") and (text := _decoded(body, charset)) is not None:
            return text
    runs = _HIGH_RUNS.findall(body)
    high = sum(map(len, runs))
    letters = high + sum(chr(b).isalpha() for b in body if b < 128)
    if high > 0.4 * letters and (text := _many_byte(body)) is not None:
        return text
    if high > 0.4 * letters and high >= 2.5 * len(runs):
        # a capital behind a small letter is a sign of the wrong table
        read = [t for c in ("windows-1251", "windows-1253") if (t := _decoded(body, c)) is not None]
        if read:
            return min(read, key=lambda t: sum(a.islower() and b.isupper() for a, b in zip(t, t[1:], strict=False)))
    if not any(b < 9 or 13 < b < 32 for b in body) and (text := _decoded(body, "cp1252")) is not None:
        return text
    return body.decode("utf-8", errors="ignore")


@F.pandas_udf(StringType())
def _guess(bodies: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for batch, declared in bodies:
        yield pd.Series([None if b is None else guess_text(bytes(b), c) for b, c in zip(batch, declared, strict=True)], dtype=object)


def declared_charset(content_type: Column) -> Column:
    """The charset that a Content-Type header names, or null."""
    found = F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_:.-]+)", 1)
    return F.when(found != "", found)


def decode_body(body: Column, content_type: Column | None = None) -> Column:
    """Text of a landed body. Valid UTF-8 stays in the JVM; only the rest, passed on as
    non-null, costs a trip to Python."""
    text = body.cast("string")
    valid = F.is_valid_utf8(text)
    plain = F.regexp_replace(text, "^\\uFEFF", "")
    named = F.lit(None).cast("string") if content_type is None else declared_charset(content_type)
    return F.when(valid, plain).otherwise(_guess(F.when(~valid, body), named))


# -- extraction ----------------------------------------------------------------


def read_pages(pages: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """``key, text, headings, author, main`` per page, with the columns to ``keep``; rows
    stay where they are, so there is no shuffle and no join back."""
    carried = [key, *[c for c in (keep or []) if c != key]]
    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [read_page(h) for h in batch["html"]]
            out = pd.DataFrame(parts, columns=["text", "headings", "author", "main"])
            yield pd.concat([batch[carried].reset_index(drop=True), out], axis=1)

    wanted = carried if "html" in carried else [*carried, "html"]
    return spread(pages.select(*wanted), key).mapInPandas(run, f"{schema}, {PAGE}")


def headings_by_pattern(html: Column) -> Column:
    """Heading texts by pattern alone, without leaving the JVM."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", "")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), 1)

    def plain(h: Column) -> Column:
        out = F.regexp_replace(h, "<[^>]*>", "")
        # these may stand without their semicolon
        for entity, char in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "'"), ("&amp;?", "&")):
            out = F.regexp_replace(out, entity, char)
        return T.trim_py(out)

    return F.slice(F.filter(F.transform(found, plain), lambda h: h != ""), 1, 5)


def extract_route(status: Column, content_type: Column, url: Column, text: Column) -> Column:
    """What becomes of a fetched page: its failure reason, or ok."""
    kind = ingest.status_class(status)
    return (
        F.when(kind == "retryable", "FETCH_RETRY")
        .when(kind == "permanent", "FETCH_NONRETRY")
        .when(~ingest.is_html(content_type, url), "UNSUPPORTED_MIME")
        .when(F.coalesce(F.length(text), F.lit(0)) == 0, "EMPTY_CONTENT")
        .otherwise("ok")
    )


def summarize_jobs(rows: DataFrame) -> DataFrame:
    """``story_id, value``: the nested summarize job of each extracted story.

    ``rows``: trace_id, id, hn_id, source, title, story_url, created_at, article_id,
    language, text, headings, is_paywalled, domain, url.
    """
    none = F.lit(None)
    story = F.struct(
        F.col("id").cast("string").alias("id"), "hn_id", "source", "title", F.col("story_url").alias("url"), "domain",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
    )
    heads = F.slice(F.coalesce("headings", F.array().cast("array<string>")), 1, 5)
    article = F.struct(
        F.col("article_id").cast("string").alias("id"), "language", T.word_count(F.col("text")).alias("word_count"),
        F.lit(False).alias("is_pdf"), "is_paywalled", T.text_head(F.col("text")).alias("text_head"),
        heads.alias("headings"), T.text_tail(F.col("text")).alias("text_tail"),
    )
    path = U.url_path(F.coalesce("url", F.lit("")))
    hints = F.struct(
        T.candidate_tags(F.col("title"), heads, path).alias("candidate_tags"), F.lit(REPUTATION).alias("source_reputation")
    )
    job = F.struct(
        "trace_id", story.alias("story"), article.alias("article"), hints.alias("hints"), none.cast("string").alias("metrics"),
        F.lit(0).alias("attempt"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
    )
    return rows.select(F.col("id").alias("story_id"), F.to_json(job, {"ignoreNullFields": "false"}).alias("value"))


# -- language ------------------------------------------------------------------

BUCKETS = 32_768
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    """Naive Bayes over hashed letter trigrams (after Lui and Baldwin's langid.py).

    ``weights`` is BUCKETS x languages, 256 KiB for each language of the samples and no more
    for more rows, so it may travel to every task.
    """

    languages: list[str]
    weights: np.ndarray


def trigram_buckets(text: str | None) -> np.ndarray:
    """Bucket per letter trigram of the lower-cased text, words parted by one blank."""
    low = (text or "").lower()
    low = low.translate({ord(c): " " for c in set(low) if not c.isalpha()})
    codes = np.frombuffer(f" {' '.join(low.split())} ".encode("utf-32-le"), dtype="uint32").astype("int64")
    if len(codes) < 3 or not low.strip():
        return np.empty(0, dtype="int64")
    return (codes[:-2] * 7919 + codes[1:-1] * 104729 + codes[2:] * 1299709) % BUCKETS


def train_languages(samples: DataFrame) -> LanguageModel:
    """Model from ``text, lang`` rows. Each task counts its own rows first, so it sends
    at most BUCKETS numbers per language however many rows it read."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                total = seen.setdefault(lang, np.zeros(BUCKETS, dtype="int64"))
                total += np.bincount(trigram_buckets(text), minlength=BUCKETS)
        for lang, total in seen.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": total[used]})

    rows = spread(samples.select("text", "lang").where("lang is not null"), "text")
    counts = rows.mapInPandas(count, "lang string, bucket long, n long")
    merged = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = merged.toPandas()  # at most BUCKETS rows per language
    languages = sorted(table["lang"].unique())
    n = np.zeros((BUCKETS, len(languages)))
    n[table["bucket"].to_numpy(), [languages.index(x) for x in table["lang"]]] = table["n"].to_numpy()
    return LanguageModel(languages, np.log(n + 1.0) - np.log(n.sum(axis=0) + BUCKETS))


def detect_language(texts: DataFrame, key: str, model: LanguageModel, allowed: list[str] | None = None) -> DataFrame:
    """``key, language`` of ``key, text`` rows; und when empty or not allowed.

    A map over the rows with the fixed-size model: no shuffle at all.
    """
    kind = texts.schema[key].dataType.simpleString()
    weights = texts.sparkSession.sparkContext.broadcast(model.weights)
    names = np.array(model.languages)

    def one(text: str | None) -> str:
        buckets = trigram_buckets(text)
        if not len(buckets):
            return UNDETERMINED
        scores = np.round(weights.value[buckets].sum(axis=0), 4)
        lang = names[np.flatnonzero(scores == scores.max())[-1]]
        return lang if not allowed or lang in allowed else UNDETERMINED

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "language": batch["text"].map(one)})

    return spread(texts.select(key, "text"), key).mapInPandas(run, f"{key} {kind}, language string")
