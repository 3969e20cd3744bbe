"""Golden rows of the scalar functions, worked out by hand from their definitions."""

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions import urls as U
from storyloom.operators import ingest, metrics, results, similarity


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(
    "raw, slug",
    [
        ("C++", "c"), ("C#", "c"), ("Node.js", "nodejs"), ("snake_case", "snakecase"), ("Crème Brûlée", "creme-brulee"),
        ("日本", None), ("  --x--  ", "x"), ("", None), (None, None), ("a b", "a-b"), ("ﬁne ½", "fine-12"), ("x²", "x2"),
        ("Straße", "strae"), ("ＡＢＣ", "abc"),
    ],
)
def test_slugify(spark, raw, slug):
    assert one(spark, raw, T.slugify) == slug
    if slug:
        assert one(spark, slug, T.slugify) == slug


@pytest.mark.parametrize(
    "raw, plain",
    [("Crème", "Creme"), ("Straße", "Strasse"), ("Œuvre", "OEuvre"), ("søt", "sot"), ("é", "e"), ("plain", "plain"), ("Ελλάς", "Ελλας")],
)
def test_unaccent(spark, raw, plain):
    assert one(spark, raw, T.unaccent) == plain


@pytest.mark.parametrize(
    "raw, words", [("a b", 2), ("  a b\n\nc ", 3), ("", 0), (None, 0), ("\x1c\x85", 0), ("one", 1)]
)
def test_word_count(spark, raw, words):
    assert one(spark, raw, T.word_count) == words


def test_sha1_hash(spark):
    import hashlib

    assert one(spark, " a   b\n", T.sha1_hash) == hashlib.sha1(b"a b").hexdigest()
    assert one(spark, "a", lambda c: T.sha1_hash(c, F.lit("u"))) == hashlib.sha1(b"a\nu").hexdigest()
    assert one(spark, "a", lambda c: T.sha1_hash(c, F.lit(""))) == hashlib.sha1(b"a").hexdigest()


def test_sha256_hash_stops_at_its_prefix(spark):
    long = "x" * 10_001
    a = one(spark, long, lambda c: T.sha256_hash(F.lit("en"), F.lit("d"), c))
    assert a == one(spark, long[:-1], lambda c: T.sha256_hash(F.lit("en"), F.lit("d"), c))


@pytest.mark.parametrize("words, minutes", [(0, 1), (200, 1), (201, 2), (100_000, 60)])
def test_reading_time(spark, words, minutes):
    assert one(spark, words, T.reading_time, "int") == minutes


def test_head_and_tail(spark):
    long = "a" * 1000
    assert one(spark, long, T.text_head) == "a" * 900
    assert one(spark, "x" * 500 + "\n\n" + "y" * 400 + "\n\nz", T.text_head) == ("x" * 500 + "\n\n" + "y" * 400)[:900]
    assert one(spark, "a\n\n \n\nb", T.text_head) == "a\n\nb"
    # a misfit stops the walk even when a later paragraph would fit
    assert one(spark, "a\n\n" + "b" * 900 + "\n\nc", T.text_head) == "a"
    assert one(spark, "h\n\n" + "p" * 300 + "\n\n" + "q" * 300, T.text_tail) == ("p" * 300 + "\n\n" + "q" * 300)[:600]
    assert one(spark, "", T.text_tail) == ""


def test_candidate_tags(spark):
    title = "Rust/Go: the Big, big Show!"
    out = spark.range(1).select(
        T.candidate_tags(F.lit(title), F.array(F.lit("Intro part"), F.lit("")), F.lit("/blog/v2/" + "a" * 21 + "/news")).alias("t")
    ).first().t
    assert out == ["Rust", "Go", "Big", "Show", "Intro", "Blog"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("https://e.com/a?UTM_Source=x&b=1#f", "https://e.com/a?b=1"),
        ("https://e.com/a?b=1&b=2", "https://e.com/a?b=1&b=2"),
        ("https://e.com/a?b=&c", "https://e.com/a"),
        ("https://e.com/a?q=a%20b%2Fc", "https://e.com/a?q=a+b%2Fc"),
        ("https://e.com/a", "https://e.com/a"),
        ("https://e.com/a?x=~*", "https://e.com/a?x=~%2A"),
    ],
)
def test_canonical_url(spark, raw, clean):
    assert one(spark, raw, U.canonical_url) == clean


@pytest.mark.parametrize(
    "raw, host", [("https://www.E.com/x", "e.com"), ("http://m.www.e.com", "m.www.e.com"), ("not a url", None), (None, None)]
)
def test_host_domain(spark, raw, host):
    assert one(spark, raw, U.host_domain) == host


def test_registered_domains(spark):
    urls = spark.createDataFrame([(f"https://{h}/x",) for h in ("a.b.co.uk", "co.uk", "x.y.com", "deep.host.zz", "10.0.0.1")], "url string")
    suffixes = spark.createDataFrame([("com",), ("uk",), ("co.uk",)], "suffix string")
    got = {r.host: r.registered_domain for r in U.registered_domains(urls, suffixes).collect()}
    assert got == {"a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "x.y.com": "y.com", "deep.host.zz": "zz", "10.0.0.1": "10.0.0.1"}


@pytest.mark.parametrize(
    "raw, masked",
    [
        ("redis://u:secret@h:1/0", "redis://u:***@h:1/0"), ("redis://token@h", "redis://***@h"), ("redis://h:1", "redis://h:1"),
        ("redis://:p@h", "redis://:***@h"),
    ],
)
def test_mask_url(spark, raw, masked):
    assert one(spark, raw, T.mask_url) == masked


def test_hot_score(spark):
    got = spark.range(1).select(T.hot_score(F.lit(9), F.lit(4), F.lit(0.0)).alias("s"), T.hot_score(F.lit(None), F.lit(1), F.lit(1.0)).alias("n")).first()
    assert round(got.s, 6) == round(2.302585 * 0.7 + 1.609438 * 0.3, 6)
    assert got.n is None


def test_scrub():
    assert metrics.scrub({"API_KEY": 1, "a": [{"Token": "x", "b": 2}]}) == {"API_KEY": "[REDACTED]", "a": [{"Token": "[REDACTED]", "b": 2}]}


def test_labels(spark):
    raw = ["btrfs", " ok ", "x", None, "y" * 41, "fine", "seventh"]
    got = one(spark, raw, lambda c: results.clean_labels(c, results.TAG_SPELLING), "array<string>")
    assert got == ["Btrfs", "ok", "fine"]


def test_clamp_keeps_null(spark):
    assert one(spark, None, lambda c: results.clamp(c, 0, 100), "int") is None
    assert one(spark, 140, lambda c: results.clamp(c, 0, 100), "int") == 100


def test_updates_tail_array(spark):
    assert one(spark, list(range(5)), lambda c: ingest.updates_tail_array(c, 3), "array<int>") == [2, 3, 4]
    assert one(spark, [1], lambda c: ingest.updates_tail_array(c, 3), "array<int>") == [1]


def test_trigrams(spark):
    assert sorted(one(spark, "cat", similarity.trigrams)) == ["  c", " ca", "at ", "cat"]
    assert one(spark, "", similarity.trigrams) == []


@pytest.mark.parametrize(
    "status, kind", [(200, "ok"), (301, "ok"), (404, "permanent"), (403, "retryable"), (451, "retryable"), (500, "retryable"), (410, "permanent")]
)
def test_status_class(spark, status, kind):
    assert one(spark, status, ingest.status_class, "int") == kind


JOB = '{"trace_id":"t","story":{"id":"1","hn_id":null,"source":"hn","title":"T","url":"u","domain":"d","created_at":"c"},"article":{"id":"a","language":"en","word_count":null},"hints":null,"metrics":null}'


@pytest.mark.parametrize(
    "old, new, errors",
    [
        ("", "", []),
        ('"hints":null,', "", ["hints"]),
        ('"url":"u"', '"url":null', ["story.url"]),
        ('"en"', '"x"', ["article.language"]),
        ('"metrics":null', '"metrics":null,"schema_version":2', ["schema_version"]),
        ('"metrics":null', '"metrics":{"points":1,"comments":null}', ["metrics.captured_at"]),
        ('"hints":null', '"hints":{"candidate_tags":[],"source_reputation":0.5}', []),
        ('"hn_id":null,', "", ["story.hn_id"]),
    ],
)
def test_job_errors(spark, old, new, errors):
    text = JOB.replace(old, new) if old else JOB
    got = spark.createDataFrame([(text,)], "value string").select(results.job_errors("value").alias("e")).first().e
    assert got == errors


def test_broken_job(spark):
    got = spark.createDataFrame([("{oops",)], "value string").select(results.job_errors("value").alias("e")).first().e
    assert "json" in got


def test_slug_of_rare_characters_and_token_text(spark):
    assert one(spark, "½ ﬁn… ﬁ a -  b™ 𝔸 ½", T.slugify) == "12-fin-fi-a-b-12"
    assert one(spark, "　--  ", T.slugify) is None
    text = "  The ÉEAU, the-end x2 "
    assert one(spark, text, T.token_text).split(" ") == one(spark, text, T.tokens) == ["the", "éeau", "the", "end", "x2"]
    assert one(spark, "--", T.token_text) == ""
    # one pass over the text for each such character, not one search of the map for each character of the text
    plan = spark.range(1).select(T.slugify(F.lit("x").substr(F.lit(1), F.col("id").cast("int"))).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert "array_distinct" in plan
