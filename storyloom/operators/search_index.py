"""Full-text search served by a stored index: tables of posting blocks, and top-k with score bounds.

The articles are dealt into slices of at most about SLICE_ROWS articles of like length; a block holds
the postings of one term in one slice, so no row of the index grows with the corpus. Blocks are
Parquet rows under ``segment=N/bucket=B``, buckets being hashes of terms. Read without
``entries``, the same files are the skip table: which slices hold a term, in how many articles,
and how often at most in one of them.

A query first finds the slices that hold all its terms, from the skip table alone. For the best k it
scores the slices with the highest bounds first; slices and articles whose bound
falls short of the k-th best score found are never scored. Bounds hold for every article, so the
result is that of the full ranking.

Changed articles are written as a further, small segment with the ids whose older entries are
void; ``merged`` folds all segments into one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import search
from storyloom.operators.search import TERM_WEIGHT  # a value: tasks have no module of this package
from storyloom.session import durable, spread

#: Articles per slice, slices that one writer takes of a bucket, and articles per bucket.
SLICE_ROWS = 1024
WRITER_SLICES = 64
#: Words of a slice, at most about; slices of long articles hold fewer of them. Words are taken to have so many bytes.
SLICE_WORDS = 1_000_000
WORD_BYTES = 6
BUCKET_ROWS = 50_000
#: Slices of each query that are scored first.
FIRST_SLICES = 2
#: Added to a bound: it is a product, the score a sum of the same terms.
SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """Where the segments of an index lie; ``segments`` are read, oldest first."""

    spark: SparkSession
    root: str
    buckets: int
    kind: str  # type of an article's id
    segments: tuple[int, ...]

    def _read(self, name: str, columns: str) -> DataFrame:
        paths = [f"{self.root}/{name}/segment={s}" for s in self.segments]
        return self.spark.read.schema(f"{columns}, segment int").option("basePath", f"{self.root}/{name}").parquet(*paths)

    def blocks(self, buckets: list[int] | None = None, words: list[str] | None = None) -> DataFrame:
        """``term, slice, n, most, entries, segment, bucket``; ``entries`` holds ``id, positions``. Only those of ``words``, if given."""
        rows = self._read("blocks", f"term string, slice long, n long, most int, entries array<struct<id:{self.kind},positions:array<int>>>, bucket int")
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows if words is None else rows.where(F.col("term").isin(words))

    def void(self) -> DataFrame:
        """``id, since``: entries of ``id`` in segments before ``since`` are void."""
        return self._read("void", f"id {self.kind}").groupBy("id").agg(F.max("segment").alias("since"))

    def bucket_of(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def current(self, hits: DataFrame) -> DataFrame:
        """``hits`` (with ``id`` and ``segment``) without void entries."""
        if len(self.segments) == 1:
            return hits
        void = self.void().select(F.col("id").alias("_void"), "since")
        return hits.join(void, (F.col("id") == F.col("_void")) & (F.col("segment") < F.col("since")), "left_anti")

    def postings(self) -> DataFrame:
        """``term, id, positions`` of all current entries."""
        rows = self.blocks().select("term", "segment", F.explode("entries").alias("e")).select("term", "segment", "e.id", "e.positions")
        return self.current(rows).drop("segment")


def _sliced(words: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``slice``: a class of lengths, cut by a hash of the id into slices of SLICE_ROWS articles, or fewer long ones."""
    words = words.withColumn("_class", F.floor(2 * F.log2(F.col("n") + F.lit(1))).cast("int"))
    sizes = {r["_class"]: r["count"] for r in words.groupBy("_class").count().collect()}  # two classes for each doubling
    cuts = {c: -(-n // max(1, min(SLICE_ROWS, int(SLICE_WORDS / 2 ** ((c + 1) / 2))))) for c, n in sizes.items()}
    of_class = F.create_map(*[F.lit(x) for pair in (cuts or {0: 1}).items() for x in pair])
    cut = F.pmod(F.xxhash64("id"), F.try_element_at(of_class, F.col("_class")))
    return words.withColumn("slice", F.col("_class").cast("long") * (1 << 40) + cut).drop("_class"), sum(cuts.values())


def _word_bytes() -> np.ndarray:
    """What each byte of a folded text becomes: letters and digits in lower case, 0 between words. Bytes beyond ASCII are letters there."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = [ord(chr(c).lower()) if chr(c).isalnum() else 0 for c in range(128)]
    return table


_WORD_BYTES = _word_bytes()


def _words_in(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and the number of the text that each is in."""
    text = text.cast(pa.string())
    if not pc.sum(pc.binary_length(text)).as_py():
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    _, ends, data = text.buffers()
    at = np.frombuffer(ends, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = _WORD_BYTES[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]
    at -= at[0]
    inside = data != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    texts = at[:-1][np.diff(at) > 0]
    starts[texts] = inside[texts]  # no word goes on in the next text
    starts = np.flatnonzero(starts)
    data = data[inside]
    ends = np.append(np.cumsum(inside)[starts] - 1, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return words, np.searchsorted(at, starts, side="right") - 1


def _blocks_of(ids: pa.Array, text: pa.Array, slice_: int) -> pa.RecordBatch:
    """The blocks of one slice: ``term, slice, n, most, entries``. Rows come by id; rows of one id are one article."""
    words, row = _words_in(text)
    n = np.bincount(row, minlength=len(ids))
    article = ids.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy()
    pos = (np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n) + 1).astype(np.int32)
    if len(article) and (np.diff(article) == 0).any():
        order = np.lexsort((pos, article[row], code))
    else:  # rows and positions are in order; numbers of two bytes sort fastest
        order = np.argsort(code.astype(np.uint16) if len(coded.dictionary) < 1 << 16 else code, kind="stable")
    code, row, pos = code[order], row[order], pos[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (np.diff(code) != 0) | (np.diff(article[row]) != 0)
    starts = np.flatnonzero(fresh)
    ends = np.append(starts, len(code)).astype(np.int32)
    entries = pa.StructArray.from_arrays([ids.take(pa.array(row[starts])), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos))], names=["id", "positions"])
    first = np.flatnonzero(np.append(True, np.diff(code[starts]) != 0)) if len(starts) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(np.diff(ends), first) if len(first) else np.zeros(0, np.int32)
    blocks = np.append(first, len(starts)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [coded.dictionary.take(pa.array(code[starts[first]])), pa.array(np.full(len(first), slice_, np.int64)), pa.array(np.diff(blocks).astype(np.int64)),
         pa.array(most.astype(np.int32)), pa.ListArray.from_arrays(pa.array(blocks), entries)],
        names=["term", "slice", "n", "most", "entries"],
    )


def _slice_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``slice, id, text`` by slice and id to blocks; one slice is held at a time."""
    held: list[pa.RecordBatch] = []

    def made() -> pa.RecordBatch:
        ids, text = (pa.concat_arrays([b.column(c) for b in held]) for c in (1, 2))
        return _blocks_of(ids, text, held[0].column(0)[0].as_py())

    for b in batches:
        slices = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1), len(slices)]
        for lo, hi in itertools.pairwise(cuts):
            if hi == lo:
                continue
            if held and held[0].column(0)[0].as_py() != slices[lo]:
                yield made()
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield made()


def _write(rows: DataFrame, path: str, buckets: int, slices: int) -> None:
    """rows: ``id, text, n, slice`` with folded texts. One shuffle, of the texts by slice: a task makes the blocks of its slices whole and writes them by bucket."""
    kind = rows.schema["id"].dataType.simpleString()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-slices // WRITER_SLICES))
    texts = rows.select("slice", "id", "text").repartition(tasks, "slice").sortWithinPartitions("slice", "id")
    blocks = texts.mapInArrow(_slice_blocks, f"term string, slice long, n long, most int, entries array<struct<id:{kind},positions:array<int>>>")
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    blocks.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(path)


def _words(article: DataFrame) -> DataFrame:
    """``id, text, n``: the texts folded but for what ``_words_in`` does in the tasks, and about how many words they have."""
    text = T.folded_words(F.coalesce("text", F.lit("")))
    rows = spread(article.select("id", "text"), "id").select("id", text.alias("text"))
    return rows.withColumn("n", F.ceil(F.octet_length("text") / F.lit(WORD_BYTES)))


def build(article: DataFrame, root: str, buckets: int | None = None) -> Index:
    """Index of ``article`` (``id``, ``text``; one row per id) under the folder ``root``."""
    spark = article.sparkSession
    words = durable(_words(article))
    rows, slices = _sliced(words)
    buckets = buckets or max(8, -(-slices * SLICE_ROWS // BUCKET_ROWS))
    _write(rows, f"{root}/blocks/segment=0", buckets, slices)
    rows.select("id").limit(0).write.parquet(f"{root}/void/segment=0")
    return Index(spark, root, buckets, article.schema["id"].dataType.simpleString(), (0,))


def refresh(index: Index, article: DataFrame, ids: DataFrame) -> Index:
    """The index after re-reading the articles ``ids``; ids that are no article any more leave it.

    Reads these articles and writes one segment of their postings; older segments are neither read nor written.
    """
    segment = max(index.segments) + 1
    changed = durable(ids.select("id").where("id is not null").distinct())
    words = durable(_words(article.join(changed, "id", "left_semi")))
    rows, slices = _sliced(words)
    _write(rows, f"{index.root}/blocks/segment={segment}", index.buckets, slices)
    changed.write.parquet(f"{index.root}/void/segment={segment}")
    return Index(index.spark, index.root, index.buckets, index.kind, (*index.segments, segment))


def merged(index: Index, root: str) -> Index:
    """All segments folded into one under ``root``, without reading a text; void entries go."""
    segment = max(index.segments)
    left = index.blocks().select("bucket", "term", "slice", "segment", F.explode("entries").alias("e"))
    left = index.current(left.select("bucket", "term", "slice", "segment", "e.id", "e.positions"))
    # a slice keeps its number within its segment; segments share none
    slice_ = F.col("slice") * len(index.segments) + F.array_position(F.array(*[F.lit(s) for s in index.segments]), F.col("segment")) - 1
    left = left.withColumn("slice", slice_).withColumn("split", F.pmod(F.xxhash64("slice"), F.lit(WRITER_SLICES)).cast("int"))
    key = ["bucket", "split", "slice", "term"]
    blocks = left.repartition("bucket", "split").groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("positions")).alias("most"), F.sort_array(F.collect_list(F.struct("id", "positions"))).alias("entries")
    )
    blocks.sortWithinPartitions("bucket", "term", "slice").drop("split").write.partitionBy("bucket").parquet(f"{root}/blocks/segment={segment}")
    index.void().select("id").limit(0).write.parquet(f"{root}/void/segment={segment}")
    return Index(index.spark, root, index.buckets, index.kind, (segment,))


# -- queries -------------------------------------------------------------------


def _bound(n_terms: Column, total: Column, least: Column) -> Column:
    """No article scores more, given how often its terms occur in all and the rarest of them.

    Covers begin at different occurrences, the last ones of all terms but one begin none; and every cover
    holds the rarest term, of which each occurrence lies in at most ``n_terms`` minimal covers. A cover without
    noise adds TERM_WEIGHT.
    """
    covers = F.least(total - n_terms + 1, n_terms * least)
    return F.when(n_terms > 1, covers).otherwise(total) * F.lit(TERM_WEIGHT) + SLACK


def _asked(index: Index, terms: DataFrame) -> tuple[list[int], list[str] | None]:
    """The buckets of the terms (at most index.buckets), and the terms themselves when they are few."""
    buckets = [r.b for r in terms.select(index.bucket_of(F.col("term")).alias("b")).distinct().collect()]
    words = [r.term for r in terms.select("term").distinct().limit(search.MAX_QUERY_TERMS + 1).collect()]
    return buckets, words if len(words) <= search.MAX_QUERY_TERMS else None


def live_slices(index: Index, terms: DataFrame, buckets: list[int], words: list[str] | None = None) -> DataFrame:
    """``query_id, n_terms, segment, slice, bound`` of the slices that hold every term, from the skip table."""
    heads = index.blocks(buckets, words).select("term", "segment", "slice", "most")
    found = heads.join(terms, "term").groupBy("query_id", "n_terms", "segment", "slice")
    found = found.agg(F.count(F.lit(1)).alias("_held"), F.sum("most").alias("_total"), F.min("most").alias("_least"))
    bound = _bound(F.col("n_terms"), F.col("_total"), F.col("_least"))
    return found.where("_held = n_terms").select("query_id", "n_terms", "segment", "slice", bound.alias("bound"))


def _blocks_asked(index: Index, terms: DataFrame, live: DataFrame, buckets: list[int], words: list[str] | None, *carried: str) -> DataFrame:
    """``query_id, n_terms, *carried, segment, slice, term, n, entries``: a block for each term of a query in a live slice."""
    wanted = live.select("query_id", "n_terms", *carried, "segment", "slice").join(terms.drop("n_terms"), "query_id")
    return index.blocks(buckets, words).select("term", "segment", "slice", "n", "entries").join(wanted, ["term", "segment", "slice"])


def matching(index: Index, queries: DataFrame, strict: bool = False) -> DataFrame:
    """``query_id, id`` of the articles that hold every term of a query; no position is looked at."""
    terms = durable(search.query_terms(queries, strict))
    buckets, words = _asked(index, terms)
    # at most n_terms blocks of one slice meet in a group
    grouped = _blocks_asked(index, terms, live_slices(index, terms, buckets, words), buckets, words).groupBy("query_id", "n_terms", "segment", "slice").agg(
        F.sort_array(F.collect_list(F.struct("n", "term", F.transform("entries", lambda e: e["id"]).alias("ids")))).alias("blocks")
    )
    rest = F.expr("slice(blocks, 2, size(blocks))")
    common = F.aggregate(rest, F.get("blocks", F.lit(0))["ids"], lambda acc, b: F.array_intersect(acc, b["ids"]))
    hits = grouped.select("query_id", "segment", F.explode(common).alias("id"))
    return index.current(hits).select("query_id", "id")


def _cover_scores(n_terms: int, article: np.ndarray, pos: np.ndarray, term: np.ndarray, n_articles: int) -> np.ndarray:
    """The rank of each article, as ``search._cover_score`` has it; one row per occurrence."""
    order = np.lexsort((term, pos, article))
    article, pos, term = article[order], pos[order], term[order]
    at = np.arange(len(pos))
    new = np.append(True, np.diff(article) != 0)
    begin = np.maximum.accumulate(np.where(new, at, 0))
    seen, oldest = np.zeros(len(pos), np.int64), at.copy()
    for t in np.unique(term):
        last = np.maximum.accumulate(np.where(term == t, at, -1))
        held = last >= begin
        seen += held
        oldest = np.where(held, np.minimum(oldest, last), oldest)
    full, start = seen == n_terms, pos[oldest]
    fresh = full.copy()
    fresh[1:] &= new[1:] | ~full[:-1] | (start[1:] > start[:-1])
    noise = (pos - start) - (at - oldest)
    with np.errstate(divide="raise"):
        gain = TERM_WEIGHT / (1.0 + noise[fresh])
    return np.bincount(article[fresh], weights=gain, minlength=n_articles)


def _score_slice(rows: pa.Table) -> pa.RecordBatch | None:
    """``query_id, n_terms, floor, segment, id, _total, _least, score`` of the articles that all blocks of a query in one slice hold."""
    n_terms, entries = rows.column("n_terms")[0].as_py(), rows.column("entries").combine_chunks()
    held = entries.flatten()
    coded = held.field(0).dictionary_encode()
    kinds = len(coded.dictionary)
    code = coded.indices.fill_null(kinds).to_numpy(zero_copy_only=False).astype(np.int64)
    term = np.repeat(np.arange(len(entries)), pc.list_value_length(entries).to_numpy(zero_copy_only=False))
    blocks = np.bincount(np.unique(code * len(entries) + term) // len(entries), minlength=kinds + 1)
    blocks[kinds] = 0  # a null id is no article
    kept = np.flatnonzero(blocks[code] == len(entries))
    if not len(kept):
        return None
    found, article = np.unique(code[kept], return_inverse=True)
    spots = held.field(1).take(pa.array(kept))
    n = pc.list_value_length(spots).to_numpy(zero_copy_only=False).astype(np.int64)
    total, least = np.zeros(len(found), np.int64), np.full(len(found), np.iinfo(np.int32).max, np.int64)
    np.add.at(total, article, n)
    np.minimum.at(least, article, n)
    if n_terms > 1:
        pos = spots.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        score = _cover_scores(n_terms, np.repeat(article, n), pos, np.repeat(term[kept], n), len(found))
    else:
        score = total * TERM_WEIGHT
    of_query = [pa.repeat(rows.column(c)[0], len(found)) for c in ("query_id", "n_terms", "floor", "segment")]
    out = [*of_query, coded.dictionary.take(pa.array(found)), pa.array(total), pa.array(least), pa.array(score)]
    return pa.RecordBatch.from_arrays(out, names=["query_id", "n_terms", "floor", "segment", "id", "_total", "_least", "score"])


def _score_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by query, slice and term to scored articles; the blocks of one query in one slice are held at a time."""
    key = ["query_id", "n_terms", "segment", "slice"]
    of, held = None, []
    for b in batches:
        turns = np.zeros(max(0, b.num_rows - 1), bool)
        for c in key:
            turns |= pc.not_equal(b.column(c).slice(1), b.column(c).slice(0, max(0, b.num_rows - 1))).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(turns) + 1), b.num_rows]
        for lo, hi in itertools.pairwise(cuts):
            if hi == lo:
                continue
            part = b.slice(lo, hi - lo)
            mine = [part.column(c)[0] for c in key]
            if held and mine != of:
                out = _score_slice(pa.Table.from_batches(held))
                held = []
                if out is not None:
                    yield out
            of = mine
            held.append(part)
    if held and (out := _score_slice(pa.Table.from_batches(held))) is not None:
        yield out


def _scored(index: Index, terms: DataFrame, live: DataFrame, buckets: list[int], words: list[str] | None) -> DataFrame:
    """``query_id, id, score`` of the articles in the ``live`` slices whose bound reaches ``floor``.

    The blocks of a query in one slice meet in a task, which intersects and scores them there.
    """
    blocks = _blocks_asked(index, terms, live, buckets, words, "floor").select("query_id", "n_terms", "floor", "segment", "slice", "term", "entries")
    blocks = blocks.repartition("query_id", "segment", "slice").sortWithinPartitions("query_id", "n_terms", "segment", "slice", "term")
    kind = blocks.schema["query_id"].dataType.simpleString()
    per = blocks.mapInArrow(_score_slices, f"query_id {kind}, n_terms int, floor double, segment int, id {index.kind}, _total long, _least long, score double")
    per = index.current(per).where(_bound(F.col("n_terms"), F.col("_total"), F.col("_least")) >= F.col("floor"))
    return per.select("query_id", "id", "score")


def ranked(index: Index, queries: DataFrame, strict: bool = False) -> DataFrame:
    """``query_id, id, score`` of every article holding all terms of a query."""
    terms = durable(search.query_terms(queries, strict))
    buckets, words = _asked(index, terms)
    live = live_slices(index, terms, buckets, words).withColumn("floor", F.lit(0.0))
    return _scored(index, terms, live, buckets, words)


def contenders(index: Index, queries: DataFrame, stories: DataFrame, k: int, strict: bool = False) -> DataFrame:
    """``query_id, id, score``: all articles that can be among the best ``k`` stories of a query, and few others.

    The FIRST_SLICES slices of the highest bound are scored first. The score of the k-th best story
    found there is a floor: what cannot reach it is skipped.
    """
    terms = durable(search.query_terms(queries, strict))
    buckets, words = _asked(index, terms)
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "segment", "slice")
    live = durable(live_slices(index, terms, buckets, words))
    head = live.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= FIRST_SLICES).drop("_place")
    first = durable(_scored(index, terms, head.withColumn("floor", F.lit(0.0)), buckets, words))
    floors = search.top_stories(first, stories, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = live.join(head.select("query_id", "segment", "slice"), ["query_id", "segment", "slice"], "left_anti")
    rest = rest.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).where(F.col("bound") >= F.col("floor"))
    return first.unionByName(_scored(index, terms, rest, buckets, words))


def search_many(index: Index, stories: DataFrame, queries: DataFrame, k: int = 30, strict: bool = False) -> DataFrame:
    """Ranked hits of many queries at once: ``query_id, rank, id, score, match``."""
    k = max(1, int(k))
    # read for the floors and again for the results
    stories = durable(stories.select("id", "article_id", "created_at").where("article_id is not null"))
    return search.top_stories(contenders(index, queries, stories, k, strict), stories, k).withColumn("match", F.lit("lexical"))
