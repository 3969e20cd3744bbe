"""Near-duplicate lines by a deletion-neighbourhood join (DataFrame functions only).

Two lines are duplicates if at most ``d`` characters are inserted, deleted or replaced between
them; ``d`` is the bound of the longer line (see ``allowed``). Written below each other, such
lines fill ``k`` columns and agree in all but ``d`` of them, so lines emit what is left when
``d`` columns are deleted, with the places, as hashed keys, and equal keys meet. All lines of one
key are near to each other. Only the earliest of them matters: keys are reduced to their minimum.

Three steps keep this small without losing a pair. Of ``d + 1`` pieces one has no edit, and as
many edits before it as it has pieces before it, at most; lines that share no such piece with
another line emit nothing. Lines that meet are verified against the earliest of their key, and
keys of up to ``SMALL`` lines are verified in full. What is left undecided in larger keys
deletes halves as a whole, then halves of these; after each halving only keys that meet go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import by_doc, free, store, text_of

#: Edits between lines that are long enough for them, and characters of a line for each edit.
EDIT_BOUND = 3
CHARS_PER_EDIT = 20
#: Keys of so many lines are judged pair by pair.
SMALL = 8
#: Lines whose pieces are counted, and the count from which a piece is not dealt out: one in a thousand.
SAMPLE_LINES = 50_000
HOT_SAMPLE = 50
_UNITS = 1 << 30
#: In lines with fewer characters one edit is a large share; only equal ones are duplicates.
MIN_CHARS = 20


def lines_of(docs: DataFrame, min_equal: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, line_no, line)`` of the lines that take part: of ``min_equal`` characters, short ones not blank."""
    parts = docs.select("doc_id", F.posexplode(F.split(text_of(), "\n", -1)).alias("line_no", "line"))
    n = F.char_length("line")
    return parts.filter((n >= min_equal) & ((n >= min_chars) | F.col("line").rlike(r"\S")))


def _digest():
    return F.unhex(F.md5("line"))


def allowed(n, bound: int):
    """Edits allowed between two lines of which the longer one has ``n`` characters."""
    return F.least(F.lit(bound), F.greatest(F.lit(1), F.floor(n / CHARS_PER_EDIT))).cast("int")


def _frames(lines: DataFrame, bound: int) -> DataFrame:
    """A row for each length ``m`` the longer line of a pair may have, with its bound ``d``."""
    rows = lines.withColumn("n", F.char_length("line"))
    rows = rows.withColumn("m", F.explode(F.sequence(F.col("n"), F.col("n") + bound)))
    return rows.withColumn("d", allowed(F.col("m"), bound)).filter("m - n <= d")


def _cuts(bound: int) -> list[tuple[int, int, int, int]]:
    """``(more, d, p, s)``: against a line of ``more`` further characters that allows ``d`` edits, piece ``p`` is looked for ``s`` places on.

    The longer line is cut into d + 1 pieces. Some piece p has no edit, p edits before it and at
    most d - p behind it, so in the other line it stands shifted by s: -p <= s <= p and p - d <= s + more <= d - p.
    """
    return [
        (more, d, p, s) for d in range(1, bound + 1) for more in range(d + 1) for p in range(d + 1)
        for s in range(max(-p, p - d - more), min(p, d - p - more) + 1)
    ]


def _pieces(lines: DataFrame, bound: int, *columns) -> DataFrame:
    """``(*columns, piece)``: near lines have a piece in common. A line may emit a piece twice.

    The cuts are one literal that is exploded, so that keys are made in generated code, row by row.
    """
    fields = ("more", "d", "p", "s")
    cuts = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, cut, strict=True)]) for cut in _cuts(bound)])
    own = lines.select(F.col("line").alias("_line"), F.char_length("line").alias("_m"), *columns)
    rows = own.withColumn("_c", F.explode(cuts)).withColumn("_m", F.col("_m") + F.col("_c.more")).filter(allowed(F.col("_m"), bound) == F.col("_c.d"))
    key = F.expr("""xxhash64(_m, _c.p, substring(_line, cast(_m * _c.p div (_c.d + 1) + _c.s + 1 as int),
        cast(_m * (_c.p + 1) div (_c.d + 1) - _m * _c.p div (_c.d + 1) as int)))""")
    return rows.select(*own.columns[2:], key.alias("piece"))


def _candidates(lines: DataFrame, bound: int, n_lines: int) -> DataFrame:
    """``(h)`` of the lines that may share a piece with another line; lines: (doc_id, line_no, line).

    A piece that stands in a large share of a bounded sample of lines makes its lines candidates without
    looking further, so none is gathered anywhere. The others are dealt out once; their groups and the lines in
    them are read from the same shuffle.
    """
    pieces = _pieces(lines, bound, F.xxhash64("line").alias("h"))
    share = min(1.0, SAMPLE_LINES / max(1, n_lines))
    some = lines.filter(F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(_UNITS)) < int(share * _UNITS))
    hot = _pieces(some, bound).groupBy("piece").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_SAMPLE).select("piece")
    hot = F.broadcast(store(hot, "line-hot"))  # at most SAMPLE_LINES / HOT_SAMPLE times the pieces of a line
    dealt = pieces.join(hot, "piece", "left_anti").repartition("piece")
    meets = dealt.groupBy("piece").agg(F.min("h").alias("_a"), F.max("h").alias("_b")).filter("_a <> _b").select("piece")
    # each piece stands once in meets. An inner join stays above the shuffle, so both sides are the same one
    met = dealt.join(meets.hint("merge"), "piece").select("h")
    return met.unionByName(pieces.join(hot, "piece", "left_semi").select("h")).distinct()


def _whole(lines: DataFrame, bound: int) -> DataFrame:
    """``(id, first, key, parts)``: for each number of columns ``k``, all of them with all edits in one part."""
    rows = _frames(lines, bound).withColumn("k", F.explode(F.expr("sequence(m, cast((d + m + n) div 2 as int))")))
    part = F.struct(F.col("d").alias("e"), F.col("k").alias("w"), F.col("line").alias("s"))
    return rows.select("id", "first", F.xxhash64("m", "k").alias("key"), F.array(part).alias("parts"))


def _split(rows: DataFrame) -> DataFrame:
    """The first part of each row in two halves, with its edits dealt to them in every way.

    A part has ``w`` columns, ``e`` of them edits, and ``s``, which is shorter by the columns that
    are empty in this line. A half without edits goes into the key; one that is all edits is deleted.
    """
    rows = rows.withColumn("p", F.get("parts", F.lit(0))).withColumns({"u": F.expr("p.w div 2"), "g": F.expr("p.w - char_length(p.s)")})
    ways = F.expr("""flatten(transform(sequence(greatest(0, p.e - p.w + cast(u as int)), least(p.e, cast(u as int))), a ->
        transform(sequence(greatest(0, g - p.e + a), least(g, a)), b -> struct(a as a, b as b))))""")
    done = rows.filter(F.col("p").isNull()).select("id", "first", "key", "parts")
    rows = rows.filter(F.col("p").isNotNull()).withColumn("way", F.explode(ways))
    halves = F.expr("""array(struct(way.a as e, cast(u as int) as w, left(p.s, cast(u - way.b as int)) as s),
        struct(p.e - way.a as e, cast(p.w - u as int) as w, right(p.s, cast(p.w - u - g + way.b as int)) as s))""")
    rows = rows.withColumn("halves", halves)
    kept = F.expr("concat_ws('|', transform(halves, x -> if(x.e = 0, x.s, '')))")
    rest = F.concat(F.expr("slice(parts, 2, size(parts))"), F.filter("halves", lambda x: (x["e"] > 0) & (x["e"] < x["w"])))
    rows = rows.select("id", "first", F.xxhash64("key", "way.a", kept).alias("key"), rest.alias("parts"))
    return rows.unionByName(done)


def _judged(rows: DataFrame, key: str, lines: DataFrame, near: DataFrame | None, bound: int) -> tuple[DataFrame, DataFrame]:
    """The near lines known now, and the rows of larger keys that can still show more of them."""
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("first", "id")).alias("best")).filter("_n > 1")
    met = store(rows.join(groups, key), "line-keys-met")
    small = met.filter(F.col("_n").between(3, SMALL)).select(key, "first", "id")
    other = small.select(F.col(key).alias("_key"), F.col("first").alias("_first"), F.col("id").alias("of"))
    pairs = small.join(other, (F.col(key) == F.col("_key")) & (F.col("_first") < F.col("first"))).select("id", "of")
    pairs = pairs.unionByName(met.filter("best.first < first").select("id", F.col("best.id").alias("of"))).distinct()
    pairs = pairs if near is None else pairs.join(near, "id", "left_anti")
    texts = lines.select(F.col("id").alias("_id"), "line")
    pairs = pairs.join(texts, F.col("id") == F.col("_id")).select("id", "of", F.col("line").alias("a"))
    pairs = pairs.join(texts, F.col("of") == F.col("_id"))
    longer = F.greatest(F.char_length("a"), F.char_length("line"))
    new = pairs.filter((F.levenshtein("a", "line", bound) >= 0) & (F.levenshtein("a", "line", bound) <= allowed(longer, bound)))
    new = new.select("id").distinct()
    near = store(new if near is None else new.unionByName(near), "line-near")

    # what stands behind the last undecided line of its key can show nothing
    large = met.filter(F.col("_n") > SMALL)
    open_ = large.filter("best.first < first").join(near, "id", "left_anti")
    last = open_.groupBy(F.col(key).alias("_key")).agg(F.max("first").alias("_last"))
    left = large.join(last, (F.col(key) == F.col("_key")) & (F.col("first") <= F.col("_last")), "left_semi")
    return near, left.select(*rows.columns)


def _near(lines: DataFrame, bound: int) -> DataFrame:
    """Digests of the lines that an earlier line is near to. lines: (id, first, line), distinct."""
    near, left = _judged(_pieces(lines, bound, "id", "first").distinct(), "piece", lines, None, bound)
    rows = _whole(lines.join(left.select("id").distinct(), "id", "left_semi"), bound)
    while True:
        rows = store(rows, "line-deletions")
        if rows.isEmpty():
            return near
        near, rows = _judged(_split(rows), "key", lines, near, bound)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, bound: int = 1, min_equal: int = 1) -> DataFrame:
    """``(doc_id, line_no, id)`` of the lines to drop; ``id`` is the binary MD5 of the line.

    The order of lines is (doc_id, line number from 0). A line goes if an earlier line is
    equal, or if its first copy has an earlier line within ``bound`` edits, and within one edit
    for each CHARS_PER_EDIT characters of the longer line where that is less. Near lines have
    ``min_chars`` characters at least, equal ones ``min_equal``; short blank lines stay. Null and empty
    texts have no lines that take part; rows that repeat a doc_id and a text count once;
    an empty table gives an empty result.
    """
    lines = lines_of(docs, min_equal, min_chars)
    at = F.struct("doc_id", "line_no")
    keyed = store(lines.select("doc_id", "line_no", _digest().alias("id"), F.xxhash64("line").alias("h")), "line-keys")
    firsts = store(keyed.groupBy("id").agg(F.min(at).alias("first"), F.min("h").alias("h")), "line-firsts")

    some = _candidates(lines.filter(F.char_length("line") >= min_chars), bound, keyed.count())
    places = store(firsts.join(some, "h", "left_semi"), "line-candidates")
    # the texts of the candidates, each from its earliest place
    by_place = places.groupBy(F.col("first.doc_id").alias("_of")).agg(F.collect_set(F.struct("first", "id")).alias("_places"))
    # the places grow with the corpus: one plan at every size, none that hopes for a broadcast
    found = docs.select("doc_id", "text").join(by_place.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_of")))
    found = found.withColumn("_lines", F.split(text_of(), "\n", -1)).select("_lines", F.explode("_places").alias("p"))
    found = found.select("p.id", "p.first", F.get("_lines", F.col("p.first.line_no")).alias("line")).filter(_digest() == F.col("id"))
    near = _near(store(found.dropDuplicates(["id"]), "line-texts"), bound)

    # written, so that both sides of the next join are plain shuffles: a line that stands in a
    # large share of all documents is then split by the adaptive skew join
    judged = store(firsts.select("id", "first").join(near.withColumn("near", F.lit(True)), "id", "left"), "line-judged")
    gone = keyed.drop("h").join(judged, "id").filter((at > F.col("first")) | F.col("near"))
    return gone.select("doc_id", "line_no", "id")


def summary(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, dropped)`` per row of ``docs``; ``dropped`` lists line numbers."""
    per = gone.groupBy(F.col("doc_id").alias("_of")).agg(F.array_sort(F.collect_set("line_no")).alias("_gone"))
    own = docs.select("doc_id", F.size(F.split(text_of(), "\n", -1)).cast("long").alias("n_lines"))
    out = own.join(per, F.col("doc_id").eqNullSafe(F.col("_of")), "left")
    lost = F.coalesce(F.col("_gone"), F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(lost).cast("long").alias("n_dropped"), F.array_join(lost.cast("array<string>"), ",").alias("dropped"))


def apply_dropped(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the dropped lines and with the same columns.

    ``n_chars``, where there is one, follows the new text. A document that loses lines and
    keeps nothing but white space goes; documents without dropped lines stay as they are.
    """
    mark = F.concat_ws(":", F.col("line_no"), F.hex("id"))
    lost, new = free(docs, "_gone", "_new")
    d = by_doc(docs, gone.groupBy("doc_id").agg(F.collect_set(mark).alias(lost)), "left")
    name = lambda line, i: F.concat_ws(":", i, F.upper(F.md5(line)))
    kept = F.filter(F.split(text_of(), "\n", -1), lambda line, i: ~F.array_contains(F.col(lost), name(line, i)))
    d = d.withColumn(new, F.when(F.col(lost).isNotNull(), F.array_join(kept, "\n")))
    d = d.filter(F.col(lost).isNull() | F.col(new).rlike(r"\S"))
    fresh = {"text": F.coalesce(new, "text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.char_length(new).cast(docs.schema["n_chars"].dataType))
    return d.withColumns(fresh).select(*docs.columns)
