"""Benchmark decontamination: BM25 over test items, searched by every training passage.

The test items form the index, the passages of the training texts are the queries. A
passage is ``2 * s`` words, one starting every ``s`` words, with ``s`` the length of the
longest item, so each copy of an item lies whole in some passage. Item impacts are BM25
weights divided by the item's score for itself: a passage with the whole item scores 1.

Block-max WAND, in arrays: (1) the lightest terms of an item that together stay below
``SPARE`` are put aside; the others are its essential terms. The lists of essential terms are
read for all passages of a text at once, and a passage goes on with an item only if what it
has there and all that was put aside reach the threshold together. (2) Items stand in blocks
of ``BLOCK``; of the blocks with such items those go on where the sum of the block maxima of
the passage's terms reaches the threshold. (3) Only there all postings are read and items
scored. All items at or above the threshold are retrieved and verified by word shingles of
question and answer.

The index is collected in shards of at most ``SHARD_POSTINGS`` postings, one pass over the
texts per shard, so what travels to the tasks has a fixed bound.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import by_doc

K1, B = 1.2, 0.75
THRESHOLD = 0.6
SPARE = 0.3
BLOCK = 32
SHARD_POSTINGS = 4_000_000
SHINGLE = 5
OVERLAP = 0.8
_WORDS = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The words of an item's question and answer.

    The answer is what follows the last question mark; without one it is the last sentence;
    an item of one sentence is cut in the middle. An empty side takes the other side's words.
    """
    text = (text or "").strip()
    head, mark, tail = text.rpartition("?")
    if not (mark and words_of(tail)):
        parts = _SENTENCE.split(text)
        head, tail = " ".join(parts[:-1]), parts[-1]
    q, a = words_of(head), words_of(tail)
    if not q:
        a, half = (q or a), len(a) // 2
        q, a = a[:half], a[half:]
    return (q or a), (a or q)


def shingles(words: list[str]) -> set[str]:
    n = min(SHINGLE, len(words))
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Index:
    """One shard: postings by term and block, with block maxima and verification data."""

    def __init__(self, items: list[tuple[int, str]], idf: dict[str, float], mean_length: float, threshold: float):
        self.threshold = threshold
        self.ids = [i for i, _ in items]
        self.parts = []
        self.longest = 1
        rows = []
        self.terms: dict[str, int] = {}
        self.aside = np.zeros(len(items))
        essential: list[tuple[int, int, float]] = []
        limit = min(SPARE, threshold) - 1e-9
        for n, (_, text) in enumerate(items):
            words = words_of(text)
            self.longest = max(self.longest, len(words))
            self.parts.append(tuple((min(SHINGLE, len(p)), shingles(p)) for p in question_and_answer(text)))
            tf: dict[str, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / mean_length)
            weight = {w: idf[w] * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            own = sum(weight.values())
            spare = 0.0
            for w, x in sorted(weight.items(), key=lambda p: (p[1], p[0])):
                t = self.terms.setdefault(w, len(self.terms))
                rows.append((t, n // BLOCK, n, x / own))
                spare += x / own
                if spare < limit:
                    self.aside[n] = spare
                else:
                    essential.append((t, n, x / own))
        rows.sort()
        essential.sort()
        v = len(self.terms)
        self.essential = np.zeros(v + 1, bool)  # the last stands for unknown words
        e_term, self.e_item, self.e_impact = (np.array(c) for c in zip(*essential, strict=True)) if essential else (np.zeros(0, np.int64),) * 3
        self.essential[e_term] = True
        self.e_entry = np.searchsorted(e_term, np.arange(v + 1))
        t, b, self.item, self.impact = (np.array(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
        first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (b[1:] != b[:-1])]) if rows else np.zeros(0, np.int64)
        self.start, self.size = first, np.diff(np.r_[first, len(rows)])
        self.block = b[first]
        self.most = np.maximum.reduceat(self.impact, first) if rows else np.zeros(0)
        self.entry = np.searchsorted(t[first], np.arange(v + 1))
        self.n_blocks = (len(items) + BLOCK - 1) // BLOCK

    @staticmethod
    def _expand(start, size):
        return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())

    def search(self, terms: np.ndarray, items: np.ndarray | None = None) -> list[tuple[int, float]]:
        """``(item position, score)`` at or above the threshold for distinct terms, among the blocks of ``items``."""
        e = self._expand(self.entry[terms], self.entry[terms + 1] - self.entry[terms])
        bound = np.bincount(self.block[e], self.most[e], self.n_blocks)
        if items is not None:
            asked = np.zeros(self.n_blocks, bool)
            asked[items // BLOCK] = True
            bound[~asked] = 0
        e = e[(bound >= self.threshold - 1e-9)[self.block[e]]]
        if not len(e):
            return []
        p = self._expand(self.start[e], self.size[e])
        found, at = np.unique(self.item[p], return_inverse=True)
        score = np.bincount(at, self.impact[p])
        good = score >= self.threshold - 1e-9
        return list(zip(found[good].tolist(), score[good].tolist(), strict=True))

    def candidates(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """Per passage of a text (word ids in order) the items that its essential terms leave possible."""
        hits = np.flatnonzero(self.essential[ids])
        if not len(hits):
            return {}
        own, v = hits // self.longest, len(self.terms) + 1
        key = own * v + ids[hits]
        # a word stands in the passage that starts with its stretch and in the one before
        key = np.unique(np.r_[key, key[own > 0] - v])
        passage, term = key // v, key % v
        n = self.e_entry[term + 1] - self.e_entry[term]
        at = self._expand(self.e_entry[term], n)
        both = np.repeat(passage, n) * len(self.ids) + self.e_item[at]
        both, where = np.unique(both, return_inverse=True)
        score = np.bincount(where, self.e_impact[at])
        both = both[score + self.aside[both % len(self.ids)] >= self.threshold - 1e-9]
        passage, item = both // len(self.ids), both % len(self.ids)
        if not len(both):
            return {}
        cut = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        return {int(passage[s]): item[s:e] for s, e in zip(cut, [*cut[1:], len(both)], strict=True)}

    def leaks(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """Verified items of a whole text: best score, overlap of question and of answer."""
        words = words_of(text)
        ids = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int32, len(words))
        out: dict[int, tuple[float, float, float]] = {}
        s = self.longest
        for k, items in self.candidates(ids).items():
            part = ids[k * s : (k + 2) * s]
            part = np.unique(part[part >= 0])
            grams: dict[int, set[str]] = {}
            for n, score in self.search(part, items):
                overlap = []
                for size, want in self.parts[n]:
                    if size not in grams:
                        w = words[k * s : (k + 2) * s]
                        grams[size] = {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)}
                    overlap.append(len(want & grams[size]) / len(want))
                if min(overlap) >= OVERLAP:
                    out[n] = max(out.get(n, (0.0, 0.0, 0.0)), (score, *overlap))
        return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap)`` for every verified pair.

    Words are runs of letters, digits and underscores in lower case. Null or empty items and
    texts match nothing. Repeated rows give one pair; repeated items give one pair per
    item_id. Extra columns on either side are not used. Without items, or without documents,
    the result is empty.
    """
    items = items.select("item_id", "text").filter(F.col("item_id").isNotNull()).dropDuplicates()
    spark = docs.sparkSession
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (items, "item_id")))
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    terms = items.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), F.lit(1))).alias("term"))
    n_items, n_words = items.count(), terms.count()
    if not n_words:
        return spark.createDataFrame([], schema)
    shards = -(-n_words // SHARD_POSTINGS)
    placed = items.withColumn("_shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    counts = terms.dropDuplicates().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    out = None
    for shard in range(shards):
        own = placed.filter(F.col("_shard") == shard).select("item_id", "text")
        used = terms.join(own.select("item_id"), "item_id", "left_semi").select("term").distinct()
        idf = {r.term: float(np.log(1 + (n_items - r.df + 0.5) / (r.df + 0.5))) for r in counts.join(used, "term").collect()}
        rows = sorted(((r.item_id, r.text) for r in own.collect()), key=lambda r: (r[0], r[1] or ""))
        rare = float(np.log(1 + n_items / 0.5))
        for _, text in rows:  # letters that two engines lower differently
            for w in words_of(text):
                idf.setdefault(w, rare)
        index = spark.sparkContext.broadcast(Index(rows, idf, n_words / n_items, threshold))

        def run(batches, index=index):
            held = index.value
            for b in batches:
                found = [(d, held.ids[n], *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, x in held.leaks(t).items()]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("doc_id", "item_id", "score", "question_overlap", "answer_overlap"), r, strict=True)) for r in found], schema=target
                )

        target = pa.schema([("doc_id", _arrow(kind)), ("item_id", _arrow(item_kind)), *((c, pa.float64()) for c in ("score", "question_overlap", "answer_overlap"))])
        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of ``docs`` with no verified pair; columns stay as they are."""
    return by_doc(docs, found.select("doc_id").distinct(), "left_anti")
