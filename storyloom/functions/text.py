"""Column functions over text: whitespace, accents, slugs, hashes, excerpts."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the two source languages count as white space, as classes.
ASCII_SPACE = "\\t\\n\\x0B\\f\\r "
JS_SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
PY_SPACE = "\\t\\n\\x0B\\f\\r \\x1C-\\x1F\\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_COMMON = "\t\n\x0b\f\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_JS_CHARS = _COMMON + "\ufeff"
_PY_CHARS = _COMMON + "\x1c\x1d\x1e\x1f\x85"

# Letters without a canonical decomposition that unaccenting still spells out.
SPELLED_OUT = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ø": "O", "ø": "o",
    "Đ": "D", "đ": "d", "Ł": "L", "ł": "l", "ı": "i",
}


def trim_js(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def trim_py(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{PY_SPACE}]+|[{PY_SPACE}]+$", "")


def words_py(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{PY_SPACE}]+"), lambda w: w != "")


def _collapsed(c: Column, chars: str) -> Column:
    """Runs of white space as one blank, none at the ends. Mapping every space character
    to the blank first leaves a literal pattern, several times faster than the class."""
    return F.regexp_replace(F.btrim(F.translate(c, chars, " " * len(chars))), " {2,}", " ")


def words_between_blanks(c: Column) -> Column:
    # one blank between words: count the blanks instead of building an array
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + (F.length(c) > 0).cast("int")


def word_count(c: Column) -> Column:
    """Number of blank-separated words; null text has none."""
    return words_between_blanks(_collapsed(F.coalesce(c, F.lit("")), _PY_CHARS))


def word_count_js(c: Column) -> Column:
    return words_between_blanks(_collapsed(F.coalesce(c, F.lit("")), _JS_CHARS))


@functools.cache
def _folding(form: str) -> tuple[str, str, dict[str, str]]:
    """Accent folding derived from the Unicode database.

    Returns the characters that fold to one character, their replacements, and the
    remaining ones with their longer spelling.
    """
    src, dst, longer = [], [], {}
    for point in range(0xA0, 0x10000):
        if 0xD800 <= point < 0xE000 or 0xAC00 <= point < 0xD7A4 or 0x0300 <= point < 0x0370:
            continue
        char = chr(point)
        plain = "".join(x for x in unicodedata.normalize(form, char) if not 0x300 <= ord(x) <= 0x36F)
        if plain == char or not plain:
            continue
        if len(plain) == 1:
            src.append(char)
            dst.append(plain)
        else:
            longer[char] = plain
    marks = "".join(chr(p) for p in range(0x300, 0x370))
    return "".join(src) + marks, "".join(dst), longer


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def unaccent(c: Column) -> Column:
    """Accents removed from letters; ligatures and stroked letters spelled out."""
    src, dst, _ = _folding("NFD")
    for char, plain in SPELLED_OUT.items():
        if len(plain) == 1:
            src, dst = char + src, plain + dst
    out = F.translate(c, src, dst)
    for char, plain in SPELLED_OUT.items():
        if len(plain) > 1:
            out = F.replace(out, F.lit(char), F.lit(plain))
    return F.when(_is_ascii(c), c).otherwise(out)


def _compat_fold(c: Column) -> Column:
    """Compatibility folding, white space to ASCII; the few characters that grow take the lookup branch."""
    src, dst, longer = _folding("NFKD")
    beyond = F.regexp_replace(c, r"[\x00-\x7F]+", "")  # a small part of most texts
    has_rare = F.length(F.translate(beyond, "".join(longer), "")) < F.length(beyond)
    table = F.str_to_map(
        F.lit("\x01".join(f"{k}\x02{v}" for k, v in longer.items())), F.lit("\x01"), F.lit("\x02")
    )
    # a map is searched key by key, so only once for each such character of a text
    rare = F.filter(F.array_distinct(F.split(beyond, "")), lambda x: (F.length(x) > 0) & (F.length(F.translate(x, "".join(longer), "")) == 0))
    spelled = F.aggregate(rare, c, lambda text, x: F.replace(text, x, F.try_element_at(table, x)))
    spaces = "".join(x for x in _JS_CHARS if x > "\x7f" and x not in src)  # the other ones fold to a blank
    src, dst = src[: len(dst)] + spaces + src[len(dst) :], dst + " " * len(spaces)
    folded = F.translate(F.when(has_rare, spelled).otherwise(c), src, dst)
    return F.when(_is_ascii(c), c).otherwise(folded)


def slugify(c: Column) -> Column:
    """Lower-case ascii slug, null when nothing is left."""
    kept = F.regexp_replace(_compat_fold(F.lower(c)), f"[^a-z0-9{ASCII_SPACE}-]+", "")
    # blanks at the ends become dashes and go with them
    dashed = F.btrim(F.regexp_replace(kept, f"[{ASCII_SPACE}-]+", "-"), F.lit("-"))
    return F.nullif(dashed, F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def token_text(c: Column) -> Column:
    """The words of ``tokens`` in order, one blank between two."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def folded_words(c: Column) -> Column:
    """The text with its words as ``token_text`` of the unaccented text has them; an ASCII text stays as it is,
    since there words are runs of letters and digits in either case, which tasks find without a pattern."""
    return F.when(_is_ascii(c), c).otherwise(token_text(unaccent(c)))


def sha1_hash(text: Column, canonical_url: Column | None = None) -> Column:
    """sha1 of the text with white space collapsed, plus the URL when one is given."""
    norm = _collapsed(F.coalesce(text, F.lit("")), _JS_CHARS)
    if canonical_url is not None:
        filled = F.length(canonical_url) > 0
        norm = F.when(filled, F.concat(norm, F.lit("\n"), canonical_url)).otherwise(norm)
    return F.sha1(norm)


def sha256_hash(language: Column, domain: Column, text: Column, max_chars: int = 10_000) -> Column:
    """sha256 of language, domain and the leading characters the hash is defined on."""
    return F.sha2(F.concat_ws("\n", language, domain, F.substring(text, 1, max_chars)), 256)


def reading_time(words: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(60), F.ceil(words / F.lit(200)))).cast("int")


def hot_score(points: Column, comments: Column, age_hours: Column) -> Column:
    weight = F.log(points + 1) * F.lit(0.7) + F.log(comments + 1) * F.lit(0.3)
    return weight * F.exp(-age_hours / F.lit(60.0))


def age_hours(as_of: Column, created_at: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(created_at)) / F.lit(3_600_000_000.0)


def paragraphs(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "\n\n"), trim_py)
    return F.filter(parts, lambda p: p != "")


def _leading(parts: Column, max_chars: int) -> Column:
    """The first paragraph, then every further one while the running length fits."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("taken"))

    def step(acc: Column, part: Column) -> Column:
        used = acc["used"] + F.length(part)
        fits = (acc["taken"] == 0) | (used <= max_chars)
        # the running length only grows, so nothing is taken after the first misfit
        return F.struct(used.alias("used"), (acc["taken"] + F.when(fits, 1).otherwise(0)).alias("taken"))

    return F.slice(parts, F.lit(1), F.aggregate(parts, start, step)["taken"])


def text_head(c: Column, max_chars: int = 900) -> Column:
    return F.substring(F.array_join(_leading(paragraphs(c), max_chars), "\n\n"), 1, max_chars)


def text_tail(c: Column, max_chars: int = 600) -> Column:
    last = F.reverse(_leading(F.reverse(paragraphs(c)), max_chars))
    return F.substring(F.array_join(last, "\n\n"), 1, max_chars)


def first_occurrences(c: Column) -> Column:
    """Array without later repeats, compared without case, order kept."""
    lowered = F.transform(c, F.lower)
    return F.filter(c, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def candidate_tags(title: Column, headings: Column, path: Column, limit: int = 6) -> Column:
    """Tags guessed from capitalised title words, headings and path segments."""
    title_words = F.filter(
        words_py(F.replace(F.coalesce(title, F.lit("")), F.lit("/"), F.lit(" "))),
        lambda w: w.rlike(r"^\p{Lu}"),
    )
    from_title = F.transform(title_words, lambda w: F.regexp_replace(w, r"^[.,:;!?]+|[.,:;!?]+$", ""))
    heads = F.filter(F.coalesce(headings, F.array().cast("array<string>")), lambda h: h != "")
    from_heads = F.transform(heads, lambda h: F.split(h, " ", 2)[0])
    segments = F.filter(
        F.split(path, "/"), lambda s: s.rlike(r"^\p{L}+$") & (F.length(s) <= 20)
    )
    from_path = F.transform(segments, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 20))))
    return F.slice(first_occurrences(F.concat(from_title, from_heads, from_path)), 1, limit)


def mask_url(c: Column) -> Column:
    """Hide the password, or a lone credential, in ``scheme://user:secret@host``."""
    with_secret = F.regexp_replace(c, "^(.*?//)([^@:]*):[^@]*@", "$1$2:***@")
    lone = F.regexp_replace(c, "^(.*?//)[^@:]*@", "$1***@")
    return F.when(c.rlike("^.*?//[^@:]*:[^@]*@"), with_secret).otherwise(lone)
