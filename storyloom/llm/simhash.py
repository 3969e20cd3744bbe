"""SimHash near-duplicates through a positional byte index.

A fingerprint has eight bytes. Two fingerprints that differ in at most ``max_bits`` = 4 bits
agree in at least ``8 - max_bits`` of their bytes at the same place. The index therefore
posts each distinct fingerprint under every choice of four of its positional bytes (70
lists), so what meets in a list already shares that many; the shared positional bytes of a
pair are then tallied, pairs below the guaranteed count are left out, a pair is taken only
in the first list that holds it, and its bits are compared.

Lists longer than ``LIST_BLOCK`` (groups of near copies) are not compared as they stand:
they are posted again under choices of four of the eight half-bytes that are still open.
Such a list agrees in 48 bits and thus holds at most 65,536 fingerprints. A list yields a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import by_doc, store
from storyloom.llm.components import components

LIST_BLOCK = 4096
CHOICES = list(combinations(range(8), 4))
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    found = _WORDS.findall((text or "").translate(_LOWER))
    if not found:
        return 0
    if len(found) < words:
        parts = [" ".join(found)]
    else:
        parts = map(" ".join, zip(*[found[i:] for i in range(words)], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p.encode("utf-8", "replace"), 42) for p in parts), dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        block = hashes[start : start + 65536]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _nth_choice(x: np.ndarray, width: int) -> np.ndarray:
    """For each xor, the mask of the first four of eight ``width``-bit cells without a difference; 0 if fewer."""
    cell = np.uint64((1 << width) - 1)
    mask, seen = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for p in range(8):
        same = ((x >> np.uint64(width * p)) & cell == 0) & (seen < 4)
        mask |= same.astype(np.int64) << p
        seen += same
    return np.where(seen == 4, mask, 0)


def _compare(fps: np.ndarray, choice: int, max_bits: int, squeeze) -> list[tuple[int, int]]:
    """A spanning forest of the links of one list that belong to ``choice``."""
    n, parent, out = len(fps), list(range(len(fps))), []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    step = max(1, 4_000_000 // n)
    for start in range(0, n, step):
        x = fps[start : start + step, None] ^ fps[None, :]
        i, j = np.nonzero(_bits(x) <= max_bits)
        ahead = i + start < j
        i, j = i[ahead], j[ahead]
        own = squeeze(x[i, j]) == choice
        for a, b in zip((i[own] + start).tolist(), j[own].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[rb] = ra
                out.append((int(fps[a].view(np.int64)), int(fps[b].view(np.int64))))
    return out


def _spread(value: np.ndarray, cells: tuple, width: int) -> np.ndarray:
    """The chosen cells of each value, side by side."""
    cell, out = np.uint64((1 << width) - 1), np.zeros(len(value), np.uint64)
    for k, p in enumerate(cells):
        out |= ((value >> np.uint64(width * p)) & cell) << np.uint64(width * k)
    return out


def _post(width: int):
    """Batches of ``(fp)`` or ``(choice, fp)`` to postings ``(choice, key, fp)``.

    The second level posts the open half of a long first-level list by half-bytes.
    """

    def run(batches):
        for b in batches:
            fp = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            outer = b.column(0).to_numpy(zero_copy_only=False) if b.num_columns == 2 else None
            for c, cells in enumerate(CHOICES):
                if outer is None:
                    choice, key = np.full(len(fp), c, np.int64), _spread(fp, cells, 8)
                else:
                    key, choice = np.zeros(len(fp), np.uint64), outer * 128 + 128 + c
                    for o in np.unique(outer).tolist():
                        at = outer == o
                        rest = tuple(p for p in range(8) if p not in CHOICES[o])
                        inner = _spread(_spread(fp[at], rest, 8), cells, 4)
                        key[at] = _spread(fp[at], CHOICES[o], 8) | (inner << np.uint64(32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(choice.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["choice", "key", "fp"]
                )

    return run


def _mask(c: int) -> int:
    return sum(1 << p for p in CHOICES[c])


def _search(max_bits: int, limit: int | None):
    """Sorted postings to rows ``(kind, a, b)``: links (0), or members of long lists (1: choice, fp)."""

    def compare(choice, fps):
        if choice < 128:
            return _compare(fps, _mask(choice), max_bits, lambda x: _nth_choice(x, 8))
        outer, inner = divmod(choice - 128, 128)
        rest = tuple(p for p in range(8) if p not in CHOICES[outer])
        own = _mask(outer)

        def squeeze(x):
            # of the first list that holds the pair, and in it of the first list of half-bytes
            first = _nth_choice(x, 8) == own
            return np.where(first, _nth_choice(_spread(x, rest, 8), 4), 0)

        return _compare(fps, _mask(inner), max_bits, squeeze)

    def run(batches):
        state = {"at": None, "parts": [], "n": 0}

        def close():
            if state["n"] > 1 and (limit is None or state["n"] <= limit):
                return compare(state["at"][0], np.unique(np.concatenate(state["parts"]).view(np.uint64)))
            return []

        for b in batches:
            c, k, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(c):
                continue
            cut = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(c)]
            kinds, left, right = [], [], []
            size = ends - starts
            # lists of one inside the batch have no partner
            busy = np.flatnonzero((size > 1) | (np.arange(len(size)) == 0) | (np.arange(len(size)) == len(size) - 1))
            for r in busy.tolist():
                s, e = int(starts[r]), int(ends[r])
                here = (int(c[s]), int(k[s]))
                if here != state["at"]:
                    for x, y in close():
                        kinds.append(0), left.append(x), right.append(y)
                    state.update(at=here, parts=[], n=0)
                part = f[s:e]
                if limit is not None and state["n"] + len(part) > limit:
                    # too long: hand on what is held and all that follows
                    held = np.concatenate([*state["parts"], part])
                    kinds += [1] * len(held)
                    left += [here[0]] * len(held)
                    right += held.tolist()
                    state["parts"] = []
                else:
                    state["parts"].append(part)
                state["n"] += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["kind", "a", "b"])
        last = close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * len(last), pa.int32()), pa.array([x for x, _ in last], pa.int64()), pa.array([y for _, y in last], pa.int64())], names=["kind", "a", "b"]
        )

    return run


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """``(a, b)``: enough links between the fingerprints ``fp`` to connect what is linked."""
    if max_bits > 4:
        raise ValueError("lists of four positional bytes hold links of up to 4 bits")
    posted = distinct.select("fp").mapInArrow(_post(8), "choice int, key long, fp long")

    def searched(rows, limit):
        rows = rows.repartition("choice", "key").sortWithinPartitions("choice", "key")
        return rows.mapInArrow(_search(max_bits, limit), "kind int, a long, b long")

    first = store(searched(posted, LIST_BLOCK), "simhash-links")
    long_lists = first.filter("kind = 1").select(F.col("a").cast("int").alias("choice"), F.col("b").alias("fp"))
    again = long_lists.repartition("choice", "fp").mapInArrow(_post(4), "choice int, key long, fp long")
    second = store(searched(again, None), "simhash-links")
    return first.filter("kind = 0").unionByName(second).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    Texts without words (null, empty, white space) have fingerprint zero and are linked like
    any other. Repeated rows and ties share a component. A null doc_id is never the name of a
    component that has another one. Other columns of ``docs`` are not used; an empty table
    gives an empty result.
    """
    prints = store(fingerprints(docs, words), "simhash-prints")
    groups = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-groups")
    found = components(links(groups, max_bits))
    named = groups.join(found, groups["fp"] == found["node"], "left").select(groups["fp"].alias("_fp"), "least", F.coalesce("component", "fp").alias("_c"))
    ids = named.groupBy("_c").agg(F.min("least").alias("component_id"))
    named = named.select("_fp", "_c").join(ids, "_c").select("_fp", "component_id")
    out = prints.join(named, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """One document of each group: the rows whose doc_id names their component, once each.

    Rows that share that doc_id count as one document. Columns stay as they are.
    """
    names = judged.select(F.col("component_id").alias("doc_id")).distinct()
    return by_doc(docs, names, "left_semi").dropDuplicates(["doc_id"])
