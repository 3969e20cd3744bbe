"""Interaction of five filters: a Gray-code walk over their subsets, per part of the corpus.

Documents become cells (part, mask of the filters they fail) with counts. The walk visits all
32 subsets by toggling one filter at a time. Every cell keeps the number of active filters that
it fails; when that number leaves or reaches zero the cell's counts leave or join the running
survivors. The 32 states answer every order of filters: what a step removes is the difference of
the states before and after it.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import SPACES, store, text_of

FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
CAPITALS_PERCENT = 10
SPECIAL = b"#$%&*|"
#: Bytes of a text that are split into words at once.
CHUNK = 1 << 20
COUNTS = ["n", "good", "toxic"]

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_LATER_BYTES = bytes(range(0x80, 0xC0))  # all but the first byte of a character
_SPACE = SPACES.encode()


def word_counts(text: bytes, chunk: int = CHUNK) -> tuple[int, int]:
    """The number of words and of distinct words; white space is the six ASCII characters."""
    n, seen, rest = 0, set(), b""
    for s in range(0, len(text), chunk):
        piece = rest + text[s : s + chunk]
        words = piece.split()  # of bytes: at the six ASCII characters
        rest = words.pop() if words and piece[-1] not in _SPACE else b""
        n += len(words)
        seen.update(words)
    if rest:
        n += 1
        seen.add(rest)
    return n, len(seen)


def own_failures(text: bytes) -> int:
    """The bits of the filters A to D that a text fails."""
    words, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _LATER_BYTES))
    return (
        (words < LEAST_WORDS)
        | (100 * distinct < DISTINCT_PERCENT * words) << 1
        | (100 * capitals > CAPITALS_PERCENT * points) << 2
        | (len(text) != len(text.translate(None, SPECIAL))) << 3
    )


def _judge(batches):
    for b in batches:
        texts = [t.as_py() for t in b.column(b.schema.get_field_index("_text"))]
        digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        mask = pa.array([own_failures(t) for t in texts], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("part")), digest, mask], names=["doc_id", "part", "digest", "mask"])


def failures(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, mask)`` for each row: the bits of all five filters it fails."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_of().cast("binary").alias("_text"))
    judged = store(rows.mapInArrow(_judge, f"doc_id {kind}, part string, digest binary, mask int"), "audit-judged")
    # only texts that stand under several ids can fail E; both sides are written, so that a text
    # of very many documents is split by the adaptive skew join
    firsts = judged.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    firsts = store(firsts.filter("_first < _last").select("digest", "_first"), "audit-repeated")
    joined = judged.join(firsts.hint("merge"), "digest", "left")
    later = F.coalesce(F.col("_first") < F.col("doc_id"), F.lit(False))
    return joined.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(later, 1 << 4).otherwise(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents per part and set of failed filters."""
    says = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_of"))
    says = says.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = failures(docs)
    rows = rows.join(says, F.col("doc_id") == F.col("_of"), "left")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def gray_walk(masks: list[int], counts: list[tuple], filters: int) -> list[tuple]:
    """What survives each subset of filters, by subset: the walk toggles one filter a step."""
    failing = [0] * len(masks)  # active filters that each cell fails
    alive = [sum(c) for c in zip(*counts, strict=True)] if counts else [0] * len(COUNTS)
    states, active = [()] * (1 << filters), 0
    states[0] = tuple(alive)
    for i in range(1, 1 << filters):
        bit = i & -i  # the Gray code's next subset differs in this filter
        active ^= bit
        step = 1 if active & bit else -1
        for cell, mask in enumerate(masks):
            if mask & bit:
                before = failing[cell]
                failing[cell] += step
                if not before or not failing[cell]:
                    alive = [a - step * c for a, c in zip(alive, counts[cell], strict=True)]
        states[active] = tuple(alive)
    return states


def steps(states: list[tuple], names: str) -> list[tuple]:
    """``(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` of all orders."""
    k = len(names)
    whole = (1 << k) - 1
    shapley = []
    for f in range(k):
        bit = 1 << f
        without = [s for s in range(1 << k) if not s & bit]
        # a subset stands in front of f in |s|! (k - 1 - |s|)! orders
        shapley.append(sum(factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) * (states[s][0] - states[s | bit][0]) for s in without))
    out = []
    for order in permutations(range(k)):
        before = 0
        for place, f in enumerate(order, 1):
            bit = 1 << f
            a, b = states[before], states[before | bit]
            removed, failed = a[0] - b[0], states[0][0] - states[bit][0]
            unique = states[whole ^ bit][0] - states[whole][0]
            out.append(("".join(names[i] for i in order), place, b[0], removed, failed - removed, unique, a[1] - b[1], a[2] - b[2], shapley[f]))
            before |= bit
    return out


STEP_COLUMNS = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step.

    A part is a value of ``lang``, null being the empty string. Filters see the whole text, null
    as empty. E fails a row whose text stands under a smaller doc_id anywhere in the table; rows
    without doc_id never fail it and have no label, and rows that share a doc_id do not fail it for each other.
    A document is good or toxic if any of its label rows says so. Extra columns are not
    used; an empty table gives an empty result.
    """
    names = FILTERS

    def walk(key, group: pd.DataFrame) -> pd.DataFrame:  # at most 32 rows
        masks, counts = group["mask"].tolist(), list(zip(*(group[c].tolist() for c in COUNTS), strict=True))
        found = pd.DataFrame(steps(gray_walk(masks, counts, len(names)), names), columns=STEP_COLUMNS)
        found.insert(0, "part", key[0])
        return found

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in STEP_COLUMNS[2:])
    return cells(docs, labels).groupBy("part").applyInPandas(walk, schema)
