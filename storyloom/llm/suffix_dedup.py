"""Repeated 50-byte strings across documents, by a range-partitioned sparse suffix sort.

Sorting every suffix of the corpus would move the corpus many times over. Only suffixes that
can start a repeat are sorted here:

1. The 50-byte strings of a text are grouped under anchors: the place of the least hash
   among the 35 grams of 16 bytes inside (leftmost of equals). Equal strings have equal
   anchors, so a string can only repeat if its anchor's gram occurs in another text. Hashes
   of anchors are packed and matched; one place in 17 is an anchor.
2. Anchors whose gram is shared are suffix starts. They are range-partitioned by their
   leading bytes at splitters sampled from the texts. A splitter is a leading gram itself,
   so equal grams never fall on two sides of a boundary and the last suffix before a
   boundary always differs from the first one behind it.
3. A bucket sorts its 50-byte strings by multikey quicksort on eight-byte words: runs that
   agree so far are split by the next word, runs of one are left out; strings whose checksum
   no other one has are left out before. In each final run the smallest doc_id keeps the string.

Every task first does step 3 on its own texts and sends only what it could not decide, each
string from one document; a string that stands in a third of all documents thus reaches its
bucket from one document for each batch of texts. Equal texts are found beforehand by digest, and only the smallest
doc_id of each goes through the steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from storyloom.llm.common import partitions, store, text_of

WINDOW = 50
GRAM = 16
_PLACE = np.uint64(24)  # low bits that hold a place in a chunk of at most 2**24 bytes
#: Candidate bytes that a task sorts at a time.
FLUSH_BYTES = 2_000_000
#: Documents read for the splitters.
SPLITTER_DOCS = 2_000
BUCKET_BYTES = 1_500_000
#: Bytes of texts whose anchor hashes meet in one task: a seventeenth of them are anchors, of which a chunk sends each hash once.
ANCHOR_BYTES = 4_000_000
#: Bytes of texts whose shared anchors are gathered in one task; what tells them comes in one row from each chunk and each task that matches.
PART_BYTES = 16_000_000
_UNITS = 1 << 30
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes from every place; the last 15 are without meaning."""
    h = (buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for step in (1, 2, 4, 8):
        ahead = h[step:] ^ (h[step:] >> np.uint64(31))
        h[:-step] = h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + ahead * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


class Chunk:
    """Texts side by side, with the anchor of each 50-byte string."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.buf)
        if n < WINDOW:
            self.windows = self.anchors = self.window_anchor = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, np.uint64)
            return
        ends = np.repeat(self.starts + self.sizes, self.sizes)
        hashes = _gram_hashes(self.buf)
        place = np.arange(n, dtype=np.uint64)
        least = (hashes >> _PLACE << _PLACE) | place
        least[place.astype(np.int64) + GRAM > ends] = _NONE
        for step in (1, 2, 4, 8, 16, 3):  # the least of 35 places
            least[:-step] = np.minimum(least[:-step], least[step:])
        self.windows = np.flatnonzero(np.arange(WINDOW, n + WINDOW) <= ends)
        self.window_anchor = (least[self.windows] & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.r_[True, self.window_anchor[1:] != self.window_anchor[:-1]] if len(self.windows) else np.zeros(0, bool)
        self.anchors = self.window_anchor[first]
        self.hashes = hashes[self.anchors]
        self._first = np.flatnonzero(first)

    def docs_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts + self.sizes, places, side="right")

    def runs(self, chosen: np.ndarray):
        """Of the chosen anchors: first string's place and number of strings."""
        ends = np.r_[self._first[1:], len(self.windows)]
        return self.windows[self._first[chosen]], (ends - self._first)[chosen]


def _chunks(texts, limit: int = 1 << 20):
    """``(numbers, Chunk)`` of at most ``limit`` bytes; a longer text is cut, its parts overlap by 49 bytes."""
    held, numbers, size = [], [], 0
    most = limit
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), most - WINDOW + 1):
            part = t[at : at + most]
            if held and size + len(part) > limit:
                yield numbers, Chunk(held)
                held, numbers, size = [], [], 0
            held.append(part)
            numbers.append((i, at))
            size += len(part)
    if held:
        yield numbers, Chunk(held)


def _perhaps_equal(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which strings share a slot with another one, by a checksum of their words: all that are equal, and few others."""
    h = np.zeros(len(at), np.uint64)
    for k in (0, 8, 16, 24, 32, 42):
        h = (h ^ words[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    bits = len(at).bit_length() + 2
    slot = (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)
    last, number = np.empty(1 << bits, np.int32), np.arange(len(at), dtype=np.int32)
    last[slot] = number
    many = np.zeros(1 << bits, bool)
    many[slot[last[slot] != number]] = True
    return np.flatnonzero(many[slot])


def equal_windows(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, new)``: strings that occur more than once, equal ones side by side; ``new`` marks a run's first."""
    words = np.ndarray((max(0, len(buf) - 7),), np.uint64, buffer=buf, strides=(1,))
    order = _perhaps_equal(words, at)
    run, new = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
    new[:1] = True
    for k in (GRAM, 0, 32, 42, 24, 8, 40):
        if len(order) < 2:
            return order[:0], new[:0]
        w = words[at[order] + k].byteswap()
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        # runs that agree in this word stay as they are
        mixed = np.zeros(len(first), bool)
        mixed[run[w != w[first][run]]] = True
        sort = np.flatnonzero(mixed[run])
        inner = sort[np.lexsort((w[sort], run[sort])) if len(first) > 1 else np.argsort(w[sort])]
        order[sort], w[sort] = order[inner], w[inner]
        new = new | np.r_[False, (w[1:] != w[:-1])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(order)])
        many = np.repeat(size > 1, size)
        order, new = order[many], new[many]
    return order, new


class Segments:
    """Runs of strings under judgement: text (doc_id and digest), place of the first in its text, number of strings, bytes."""

    def __init__(self):
        self.text, self.start, self.n, self.data, self.lead = [], [], [], [], []
        self.bytes = 0

    def add(self, text: np.ndarray, start, n, data: np.ndarray, lead=None):
        self.text.append(text), self.start.append(start), self.n.append(n), self.data.append(data)
        if lead is not None:
            self.lead.append(lead)
        self.bytes += len(data)

    def judge(self):
        """Per string: segment, place in its text, and whether a smaller doc_id has it."""
        text, start, n = (np.concatenate(x) for x in (self.text, self.start, self.n))
        doc = text[:, 0]
        buf = np.concatenate(self.data)
        base = np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1)
        seg = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order, new = equal_windows(buf, base[seg] + inner)
        lost = np.zeros(len(seg), bool)
        if len(order):
            first = np.flatnonzero(new)
            owner = doc[seg[order]]
            lost[order] = owner > np.minimum.reduceat(owner, first)[np.cumsum(new) - 1]
        return text, start, buf, base, seg, inner, lost


def _spans(text, seg, place, lost) -> list[tuple[int, int, bytes]]:
    """``(doc_id, digest, runs)`` of lost strings; runs are packed (first, number) pairs of consecutive places."""
    if not lost.any():
        return []
    seg, place = seg[lost], place[lost]
    o = np.lexsort((text[:, 1], text[:, 0]))
    number = np.empty(len(text), np.int64)
    number[o] = np.cumsum(np.r_[False, (text[o[1:]] != text[o[:-1]]).any(axis=1)])
    d = number[seg]
    o = np.lexsort((place, d))
    d, p, seg = d[o], place[o], seg[o]
    # a place that is lost twice is one
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (np.diff(p) > 1)])
    runs = np.column_stack([p[first], p[np.r_[first[1:], len(p)] - 1] - p[first] + 1]).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, np.diff(d[first]) != 0])
    names = text[seg[first[cut]]].tolist()
    return [(*name, runs[s:e].tobytes()) for name, s, e in zip(names, cut.tolist(), [*cut[1:].tolist(), len(runs)], strict=True)]


_Z = 1


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=_Z).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _cols(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _numbers(parts: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def packed_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, z)``: texts compressed before they are shuffled."""

    def run(batches):
        for b in batches:
            yield _cols(doc_id=b.column(0), digest=b.column(1), z=pa.array([_zip(t.encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()], pa.binary()))

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()), text_of()).mapInArrow(run, "doc_id long, digest long, z binary")


def _same_text(texts: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, digest): rows that share a doc_id are one text or texts of their own."""
    other = other.withColumnsRenamed({"doc_id": "_of", "digest": "_digest"})
    return texts.join(other, (F.col("doc_id") == F.col("_of")) & (F.col("digest") == F.col("_digest")), how).drop("_of", "_digest")


def shared_anchors(docs: DataFrame, buckets: int, parts: int) -> DataFrame:
    """``(part, hashes, digests, counts)``: anchor hashes that occur in another text too, packed by text; together, all of them.

    A row holds what one chunk, or one bucket of hashes, has to tell the texts of a part: all whose digests agree modulo
    ``parts``. Rows follow chunks and buckets, not the texts that meet in them.
    """

    def post(batches):
        for b in batches:
            seen, digests, texts = set(), [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d not in seen and len(t) >= WINDOW // 4:
                    seen.add(d), digests.append(d), texts.append(t.encode("utf-8", "surrogatepass"))
            for numbers, c in _chunks(texts):
                if not len(c.anchors):
                    continue
                name = np.array([digests[i] for i, _ in numbers], np.int64)
                h, d = c.hashes, c.docs_of(c.anchors).astype(np.uint16)
                o = np.lexsort((d, h))
                h, d = h[o], d[o]
                fresh = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
                h, d = h[fresh], d[fresh]
                first = np.r_[True, h[1:] != h[:-1]]
                run = np.cumsum(first) - 1
                many = np.bincount(run)[run] > 1
                # shared already in this chunk: every text is told, and one speaks for them
                yield from told(name[d[many]], h[many])
                h, d, many = h[first], d[first], many[first]
                b_of = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                cut = np.flatnonzero(np.r_[True, b_of[1:] != b_of[:-1]])
                ends = np.r_[cut[1:], len(h)]
                slices = list(zip(cut, ends, strict=True))
                yield _cols(
                    kind=pa.array(np.zeros(len(cut), np.int32)), key=pa.array(b_of[cut].astype(np.int64)),
                    a=pa.array([h[s:e].tobytes() for s, e in slices], pa.binary()),
                    b=pa.array([name[np.unique(d[s:e])].tobytes() for s, e in slices], pa.binary()),
                    c=pa.array([np.searchsorted(np.unique(d[s:e]), d[s:e]).astype(np.uint16).tobytes() for s, e in slices], pa.binary()),
                    d=pa.array([np.packbits(many[s:e]).tobytes() for s, e in slices], pa.binary()),
                )

    def told(digest, h):
        if not len(h):
            return
        names, number, counts = np.unique(digest, return_inverse=True, return_counts=True)
        h = h[np.argsort(number, kind="stable")]
        ends = np.cumsum(counts)
        part = names % parts
        rows = [(p, np.flatnonzero(part == p)) for p in np.unique(part).tolist()]
        yield _cols(
            kind=pa.array(np.ones(len(rows), np.int32)), key=pa.array([p for p, _ in rows], pa.int64()),
            a=pa.array([np.concatenate([h[ends[i] - counts[i] : ends[i]] for i in own]).tobytes() for _, own in rows], pa.binary()),
            b=pa.array([names[own].tobytes() for _, own in rows], pa.binary()),
            c=pa.array([counts[own].astype(np.int32).tobytes() for _, own in rows], pa.binary()), d=pa.nulls(len(rows), pa.binary()),
        )

    def match(t: pa.Table) -> pa.Table:
        hs, ds, ms = [], [], []
        for a, b, c, d in zip(*(t.column(x).to_pylist() for x in "abcd"), strict=True):
            h = np.frombuffer(a, np.uint64)
            hs.append(h)
            ds.append(np.frombuffer(b, np.int64)[np.frombuffer(c, np.uint16)])
            ms.append(np.unpackbits(np.frombuffer(d, np.uint8), count=len(h)).astype(bool))
        h, d, m = np.concatenate(hs), np.concatenate(ds), np.concatenate(ms)
        o = np.argsort(h, kind="stable")
        h, d, m = h[o], d[o], m[o]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(h)]))
        good = ((np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) | np.logical_or.reduceat(m, first))[run]
        found = list(told(d[good], h[good]))
        return packed(pa.Table.from_batches(found)) if found else out_schema.empty_table()

    def packed(t: pa.Table) -> pa.Table:
        return t.select(["key", "a", "b", "c"]).rename_columns(out_schema.names)

    out_schema = pa.schema([("part", pa.int64()), ("hashes", pa.binary()), ("digests", pa.binary()), ("counts", pa.binary())])
    texts = docs.select(F.xxhash64(text_of()).alias("digest"), text_of().alias("text"))
    posted = texts.mapInArrow(post, "kind int, key long, a binary, b binary, c binary, d binary")
    # told rows pass through their own group of one bucket, so that the texts are hashed once
    key = F.when(F.col("kind") == 0, F.col("key")).otherwise(F.lit(buckets) + F.pmod("key", F.lit(buckets))).alias("bucket")

    def either(t: pa.Table) -> pa.Table:
        return packed(t) if t.column("kind")[0].as_py() == 1 else match(t)

    return posted.withColumn("bucket", key).groupBy("bucket").applyInArrow(either, "part long, hashes binary, digests binary, counts binary")


def anchors_of(reps: DataFrame, shared: DataFrame, parts: int) -> DataFrame:
    """``(doc_id, digest, hashes)``: the rows of ``reps`` that have shared anchors, with all of them."""

    def gather(own: pa.Table, told: pa.Table) -> pa.Table:
        hashes, digests, counts = (_numbers(told.column(x).to_pylist(), kind) for x, kind in (("hashes", np.uint64), ("digests", np.int64), ("counts", np.int32)))
        of = np.repeat(digests, counts)
        hashes = hashes[np.argsort(of, kind="stable")]
        names, counts = np.unique(of, return_counts=True)
        ends = np.cumsum(counts)
        digest = own.column("digest").to_numpy()
        at = np.searchsorted(names, digest)
        met = np.flatnonzero(at < len(names))
        met = met[names[at[met]] == digest[met]]
        blobs = [hashes[ends[i] - counts[i] : ends[i]].tobytes() for i in at[met]]
        return pa.table({"doc_id": pa.array(own.column("doc_id").to_numpy()[met], pa.int64()), "digest": pa.array(digest[met], pa.int64()), "hashes": pa.array(blobs, pa.binary())})

    own = reps.select(F.col("doc_id").cast("long"), "digest", F.pmod("digest", F.lit(parts)).alias("part"))
    return own.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(gather, "doc_id long, digest long, hashes binary")


def splitters(docs: DataFrame, n_docs: int, buckets: int) -> np.ndarray:
    """Leading grams that cut the anchors of a bounded sample of texts into equal parts."""
    share = min(1.0, SPLITTER_DOCS / max(1, n_docs))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("splitters")), F.lit(_UNITS)) < int(share * _UNITS))

    def run(batches):
        for b in batches:
            leads = []
            for _, c in _chunks([t.encode("utf-8", "surrogatepass") for t in b.column(0).to_pylist()]):
                some = c.anchors[c.hashes % np.uint64(16) == 0]
                leads += [c.buf[p : p + GRAM].tobytes() for p in some.tolist()]
            yield _cols(lead=pa.array(leads, pa.binary()))

    found = np.array(sorted(bytes(r.lead) for r in sample.select(text_of()).mapInArrow(run, "lead binary").distinct().collect()), f"S{GRAM}")
    return found[np.linspace(0, len(found) - 1, min(buckets, len(found)) + 1).astype(int)[1:-1]] if len(found) else found


def removed_windows(docs: DataFrame, reps: DataFrame, n_docs: int, n_bytes: int) -> DataFrame:
    """``(doc_id, digest, runs)``: packed (place, number) pairs of strings that a smaller doc_id has."""
    spark: SparkSession = docs.sparkSession
    buckets = max(partitions(spark), -(-n_bytes // BUCKET_BYTES))
    parts = max(partitions(spark), -(-n_bytes // PART_BYTES))
    shared = store(shared_anchors(docs, max(partitions(spark), -(-n_bytes // ANCHOR_BYTES)), parts), "suffix-anchors")
    wanted = anchors_of(reps, shared, parts)
    cuts = spark.sparkContext.broadcast(splitters(docs, n_docs, buckets))
    # only the texts that have shared anchors go on
    texts = _same_text(packed_texts(docs), wanted, "inner").select("doc_id", "digest", "z", "hashes")

    def decide(segments: Segments, lead: bool):
        text, start, buf, base, seg, inner, lost = segments.judge()
        place = start[seg] + inner
        yield from _spans(text, seg, place, lost)
        if not lead:
            return
        # undecided strings go on as runs, each place of the smallest doc_id that has them here
        at = np.flatnonzero(~lost)
        cut = np.flatnonzero(np.r_[True, (seg[at][1:] != seg[at][:-1]) | (np.diff(at) != 1)]) if len(at) else at
        if not len(at):
            return
        n = np.diff(np.r_[cut, len(at)])
        first = at[cut]
        leads = np.concatenate(segments.lead)[seg[first]]
        bucket = np.searchsorted(cuts.value, leads, side="right") if len(cuts.value) else np.zeros(len(first), np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        names, ends = np.unique(bucket[by_bucket], return_index=True)
        for b, own in zip(names.tolist(), np.split(by_bucket, ends[1:]), strict=True):
            where = base[seg[first[own]]] + inner[first[own]]
            size = n[own] + WINDOW - 1
            data = buf[np.repeat(where - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
            yield b, text[seg[first[own]]].tobytes(), place[first[own]].tobytes(), n[own].astype(np.int32).tobytes(), _zip(data.tobytes())

    def local(batches):
        held = Segments()

        def flush():
            lost, rest = [], []
            if held.bytes:
                for r in decide(held, True):
                    (lost if len(r) == 3 else rest).append(r)
            if lost:
                none = pa.nulls(len(lost), pa.binary())
                yield _cols(
                    kind=pa.array([1] * len(lost), pa.int32()), key=pa.array([r[0] for r in lost], pa.int64()), digest=pa.array([r[1] for r in lost], pa.int64()),
                    a=pa.array([r[2] for r in lost], pa.binary()), b=none, c=none, d=none,
                )
            if rest:
                yield _cols(
                    kind=pa.array([0] * len(rest), pa.int32()), key=pa.array([r[0] for r in rest], pa.int64()), digest=pa.nulls(len(rest), pa.int64()),
                    **{x: pa.array([r[i + 1] for r in rest], pa.binary()) for i, x in enumerate("abcd")},
                )

        for b in batches:
            names, blobs = np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]), b.column(3).to_pylist()
            texts = [_unzip(z) for z in b.column(2).to_pylist()]
            for numbers, c in _chunks(texts):
                doc_no = c.docs_of(c.anchors)
                hit = np.zeros(len(c.anchors), bool)
                for k, (i, _) in enumerate(numbers):
                    s, e = np.searchsorted(doc_no, (k, k + 1))
                    hit[s:e] = np.isin(c.hashes[s:e], np.frombuffer(blobs[i], np.uint64))
                chosen = np.flatnonzero(hit)
                if not len(chosen):
                    continue
                place, n = c.runs(chosen)
                d = doc_no[chosen]
                size = n + WINDOW - 1
                data = c.buf[np.repeat(place - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
                grams = c.buf[c.anchors[chosen][:, None] + np.arange(GRAM)].view(f"S{GRAM}").ravel()
                offset = np.array([at for _, at in numbers], np.int64)
                held.add(names[[i for i, _ in numbers]][d], place - c.starts[d] + offset[d], n, data, grams)
                if held.bytes > FLUSH_BYTES:
                    yield from flush()
                    held = Segments()
        yield from flush()

    def sort_bucket(t: pa.Table) -> pa.Table:
        if t.column("kind")[0].as_py() == 1:
            return t.select(["key", "digest", "a"]).rename_columns(["doc_id", "digest", "runs"])
        held = Segments()
        for a, b, c, d in zip(*(t.column(x).to_pylist() for x in "abcd"), strict=True):
            held.add(np.frombuffer(a, np.int64).reshape(-1, 2), np.frombuffer(b, np.int64), np.frombuffer(c, np.int32).astype(np.int64), np.frombuffer(_unzip(d), np.uint8))
        found = list(decide(held, False))
        return pa.table({"doc_id": pa.array([r[0] for r in found], pa.int64()), "digest": pa.array([r[1] for r in found], pa.int64()), "runs": pa.array([r[2] for r in found], pa.binary())})

    sent = texts.mapInArrow(local, "kind int, key long, digest long, a binary, b binary, c binary, d binary")
    key = F.when(F.col("kind") == 0, F.col("key")).otherwise(F.lit(buckets) + F.pmod("key", F.lit(buckets))).alias("bucket")
    return sent.withColumn("bucket", key).groupBy("bucket").applyInArrow(sort_bucket, "doc_id long, digest long, runs binary")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per row of ``docs``; doc_id is an integer.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id.
    Null and empty texts, and texts of fewer than 50 bytes, lose nothing. Rows that repeat a
    doc_id and its text have the same result; texts that share a doc_id are judged one by one, and
    lose nothing to each other. A row without doc_id has no smaller one and is kept whole. Extra
    columns are not used; an empty table gives an empty result.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id has to be an integer: documents are compared by it")
    body = text_of()
    slim = docs.select("doc_id", F.unhex(F.md5(body)).alias("md5"), F.xxhash64(body).alias("digest"), F.octet_length(body).cast("long").alias("n"))
    slim = store(slim.filter("doc_id is not null"), "suffix-texts")
    total = slim.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("bytes")).first()
    reps = store(slim.groupBy("md5", "digest").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "suffix-reps")
    copies = slim.join(reps.select("md5", F.col("doc_id").alias("least")), "md5").filter((F.col("doc_id") > F.col("least")) & (F.col("n") >= WINDOW))
    own = docs.filter("doc_id is not null").select("doc_id", "text")
    lost = removed_windows(own, reps, total.docs, total.bytes or 0)
    whole = copies.select("doc_id", "digest", F.array(F.lit(None).cast("binary")).alias("runs")).distinct()
    lost = store(lost.groupBy("doc_id", "digest").agg(F.collect_list("runs").alias("runs")).unionByName(whole), "suffix-lost")
    z = docs.filter("doc_id is null").select("doc_id", "text")
    both = _same_text(packed_texts(own), lost, "left").select("doc_id", "z", "runs")
    both = both.unionByName(packed_texts(z).select("doc_id", "z", F.lit(None).cast("array<binary>").alias("runs")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(batches):
        for b in batches:
            rows = [remove(_unzip(t), r) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            c = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield _cols(
                doc_id=b.column(0), n_bytes=pa.array(c[0], pa.int64()), n_removed=pa.array(c[1], pa.int64()), n_spans=pa.array(c[2], pa.int64()), kept_sha256=pa.array(c[3], pa.string())
            )

    out = both.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def remove(text: bytes, runs: list[bytes | None] | None) -> tuple[int, int, int, str]:
    """Length, bytes removed, maximal removed runs, and the digest of what is kept; a null in ``runs`` takes all."""
    n = len(text)
    if not runs:
        return n, 0, 0, hashlib.sha256(text).hexdigest()
    if None in runs:
        return n, n, 1, hashlib.sha256(b"").hexdigest()
    pairs = _numbers(runs, np.int64).reshape(-1, 2)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, np.minimum(pairs[:, 0] + pairs[:, 1] + WINDOW - 1, n), -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()
