"""Bodies that are no UTF-8."""

import pytest
from pyspark.sql import functions as F

from storyloom.operators.extract import decode_body, guess_text

RUSSIAN = "Привет, мир! Это обычный русский текст о погоде и дороге."
JAPANESE = "これは日本語の文章です。東京の天気はとても良いです。"
KOREAN = "안녕하세요. 오늘은 날씨가 아주 좋습니다."
CHINESE = "今天天气很好，我们去公园散步吧。这是一个普通的句子。"
GREEK = "Καλημέρα κόσμε, αυτό είναι ένα απλό κείμενο."
FRENCH = "L'été dernier, à Genève, les élèves étaient très fatigués."


@pytest.mark.parametrize(
    ("text", "charset"),
    [(RUSSIAN, "windows-1251"), (JAPANESE, "shift_jis"), (JAPANESE, "euc_jp"), (KOREAN, "euc_kr"), (CHINESE, "gb18030"), (GREEK, "windows-1253"), (FRENCH, "cp1252"), (RUSSIAN, "utf-16")],
)
def test_detected(text, charset):
    assert guess_text(text.encode(charset)).lstrip("﻿") == text


def test_declared(spark):
    page = '<html><head><meta http-equiv="Content-Type" content="text/html; charset=koi8-r"></head><p>Мир</p>'
    assert guess_text(page.encode("koi8-r")) == page
    assert guess_text("Да".encode("koi8-r"), "KOI8-R") == "Да"
    assert guess_text("né".encode("cp1252"), "no-such-charset") == "né"
    rows = [(page.encode("koi8-r"), None), ("Да".encode("koi8-r"), "text/html; charset=KOI8-R"), ("né".encode(), "text/html; charset=koi8-r"), (None, None)]
    df = spark.createDataFrame(rows, "body binary, kind string")
    got = [r.t for r in df.select(decode_body(F.col("body"), F.col("kind")).alias("t")).collect()]
    assert got == [page, "Да", "né", None]


def test_learned_charsets(spark):
    """A model of samples in several scripts reads other texts of them."""
    from storyloom.operators import charsets

    rows = [(i, t) for i, t in enumerate([RUSSIAN, GREEK, FRENCH] * 3)]
    names = ["cp1251", "koi8_r", "cp1253", "cp1252", "cp850", "utf-16-le", "utf-16-be"]
    texts = spark.createDataFrame(rows, "id long, text string")
    model = charsets.train_charsets(charsets.encoded(texts, names))
    assert set(model.names) == set(names)
    other = {"cp1251": "Завтра будет тёплый день, и мы пойдём гулять.", "koi8_r": "Завтра будет тёплый день, и мы пойдём гулять.",
             "cp1253": "Ο καιρός είναι πολύ καλός σήμερα, κόσμε.", "cp1252": "Les élèves étaient à l'école cet été.", "utf-16-be": "Été à Genève"}
    bodies = [(c, t, t.encode(c)) for c, t in other.items()] + [("utf-8", "né", "né".encode()), ("none", None, None), ("empty", "", b""), ("mark", "né", "né".encode("utf-16"))]
    df = spark.createDataFrame(bodies, "name string, want string, body binary")
    got = df.select("name", "want", charsets.decode_learned(F.col("body"), model).alias("text")).collect()
    assert {r.name: r.text for r in got} == {r.name: r.want for r in got}
