"""Similarity joins over trigram sets: all pairs at or above a threshold, by rare prefixes.

The similarity of two texts is shared / united over their trigram sets. Grams are put in one
order for all texts, rare ones first. Sets as similar as ``t`` share a gram among the first
``n - ceil(t n) + 1`` of each, so only these meet, and frequent grams, which come last, hardly ever
do. A meeting counts only if the sizes allow the similarity, and if the places of the shared gram leave
enough grams behind it. What is left is verified on the whole sets.

The rows of one gram are joined by sort and merge, where the adaptive skew join splits a gram that very
many texts begin with. Repeated texts are one text here; callers join back what holds them.

Where few grams make up all texts, nearly all texts meet, and often. How often at least follows from the counts of
the grams and the sizes of the prefixes, before any prefix is made (between two tables, from the prefixes). Then texts are
compared in blocks of like size instead: a task holds two blocks, keeps of each text a few words of bits, whose differences
are at most those of the sets, and counts shared grams only where the bits allow the similarity. No meeting is written. Blocks
are packed once, as compressed texts and words; grams are made of the words in the tasks, so that a text that is sent once for
each block it is compared with is a few dozen bytes then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.session import durable

THRESHOLD = 0.3
#: Taken off products of the threshold and a size before they are rounded up.
SLACK = 1e-9
#: Meetings that the join of the prefixes may make for each of its rows.
MEETINGS = 64
#: Texts of a block: a SHARE-th of all, within these.
BLOCK_ROWS = (2_048, 98_304)
SHARE = 12
#: Bytes of the texts, words and grams of a block, and of a packed piece of one.
BLOCK_BYTES = 64 * 1024 * 1024
PIECE_BYTES = 4 * 1024 * 1024
#: Words of 64 bits kept of a text, at most, and of the second look at texts that the first leaves.
WORDS = 32
AGAIN = 8
#: Texts of two blocks that are compared at a time, pairs and grams that are looked at again at a time, pairs that leave a task at a time.
TILE = (8, 4_096)
LOOKED_AT = 16_384
COUNTED = 2_000_000
PAIRS = 32_768
#: Level of zstd.
LEVEL = 9


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _grams(words: Column) -> Column:
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(
        padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    )
    return F.array_distinct(F.flatten(grams))


def trigrams(c: Column) -> Column:
    """Distinct three-letter windows of each alphanumeric word, padded "  w "."""
    return _grams(_words(c))


def _texts(df: DataFrame) -> DataFrame:
    """``text, words, n`` of the distinct texts that have any gram: the words with a space between, the size of the set."""
    rows = df.select("text").where("text is not null").distinct().select("text", F.array_join(_words(F.col("text")), " ").alias("words"))
    return rows.where("words <> ''").withColumn("n", F.size(_grams(F.split("words", " "))))


def gram_sets(texts: DataFrame) -> DataFrame:
    """``text, grams`` of ``text, words``."""
    return texts.select("text", _grams(F.split("words", " ")).alias("grams"))


def _least(t: float, n: Column) -> Column:
    return F.ceil(n * F.lit(t) - SLACK)


def _prefixes(sets: DataFrame, counts: DataFrame, t: float) -> DataFrame:
    """``text, n, gram, at``: the grams of a set's prefix with their places from 0, rarest first."""
    each = sets.select("text", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(counts, "gram")
    whole = each.groupBy("text", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "gram"))).alias("grams"))  # the grams of one text
    prefix = F.slice("grams", F.lit(1), (F.col("n") - _least(t, F.col("n")) + 1).cast("int"))
    return whole.select("text", "n", F.posexplode(prefix).alias("at", "g")).select("text", "n", F.col("g.gram").alias("gram"), "at")


def _meetings(a: DataFrame, b: DataFrame) -> float:
    """Rows that the join of two tables of prefixes makes, for each of theirs."""
    rows = lambda df, n: df.groupBy("gram").agg(F.count(F.lit(1)).cast("double").alias(n))
    per = rows(a, "n").join(rows(b, "m"), "gram", "full").agg(F.sum(F.col("n") * F.col("m")).alias("met"), F.sum("n").alias("n"), F.sum("m").alias("m")).first()
    return (per.met or 0) / max(1, (per.n or 0) + (per.m or 0))


def _least_meetings(counts: DataFrame, texts: DataFrame, t: float) -> float:
    """What ``_meetings`` of one table is at least, for prefixes of these sizes: no gram begins more texts than it is in, and the fewest
    rows are made where the others begin equally many."""
    rows = left = float(texts.agg(F.sum(F.col("n") - _least(t, F.col("n")) + 1)).first()[0] or 0)
    per = counts.groupBy("texts").agg(F.count(F.lit(1)).alias("grams")).collect()  # a line for each count: their sum is at most all grams of all texts
    grams, met = sum(r.grams for r in per), 0.0
    for r in sorted(per):
        if r.texts * grams >= left:
            met += left * left / grams
            break
        met, left, grams = met + r.grams * r.texts**2, left - r.grams * r.texts, grams - r.grams
    return met / max(1, 2 * rows)


def _classes(sizes: list, rows: int) -> list[tuple[int, int, int, int, int, int]]:
    """``low, high, own, other, own bytes, other bytes``: ranges of set sizes that a block can hold, or one size, with the texts of both sides."""
    out: list[tuple] = []
    for r in sorted(sizes):
        if out and max(out[-1][2] + r.own, out[-1][3] + r.other) <= rows and max(out[-1][4] + r.own_bytes, out[-1][5] + r.other_bytes) <= BLOCK_BYTES:
            low, _, own, other, own_bytes, other_bytes = out.pop()
            out.append((low, r.n, own + r.own, other + r.other, own_bytes + r.own_bytes, other_bytes + r.other_bytes))
        else:
            out.append(tuple(r[c] for c in ("n", "n", "own", "other", "own_bytes", "other_bytes")))
    return out


def _pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A piece of a block as one compressed value: each text with its words behind it, which are nearly the same bytes."""
    n = rows.num_rows
    both = pa.concat_arrays([c.cast(pa.string()) for name in ("text", "words") for c in rows.column(name).chunks])
    both = both.take(pa.array(np.arange(2 * n).reshape(2, n).T.ravel()))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("both", pa.string())])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([both], ["both"]))
    raw = sink.getvalue()
    data = pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bytes": pa.array([raw.size], pa.int64()), "data": pa.array([data], pa.binary())})


def _packed(texts: DataFrame, plan: list[tuple[int, int, int, int]]) -> DataFrame:
    """``block, bytes, data``: the blocks of ``texts`` in pieces."""
    held = F.broadcast(texts.sparkSession.createDataFrame(plan, "n int, cuts int, first int, pieces int"))  # a line for each size of a set
    at = F.xxhash64("text")
    block, piece = F.col("first") + F.pmod(at, F.col("cuts")), F.pmod(F.shiftrightunsigned(at, 32), F.col("pieces"))
    rows = texts.join(held, "n").select(block.cast("int").alias("block"), piece.cast("int").alias("piece"), "text", "words")
    return rows.groupBy("block", "piece").applyInArrow(_pack, "block int, bytes long, data binary")


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The grams of each text, with repeats: its row, and a number made of the three characters."""
    letters = np.frombuffer("\n".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    padded = np.concatenate([[32, 32], np.where(letters == 10, 32, letters), [32]])
    at = np.flatnonzero(padded[2:-1] != 32)
    here, before = padded[at + 2], padded[at + 1]
    two = np.where(before == 32, 32, padded[at])
    ends = padded[at + 3] == 32
    rows = np.cumsum(letters == 10)[at]
    codes = [two << 42 | before << 21 | here, before[ends] << 42 | here[ends] << 21 | 32]
    return np.concatenate([rows, rows[ends]]), np.concatenate(codes)


class _Block:
    """The texts of a block by size of their sets, with the grams of each as numbers that ``known`` gives."""

    def __init__(self, pieces: list[tuple[int, bytes]], known: dict[int, int]):
        texts, sizes, flat = [], [], []
        for size, data in pieces:
            both = pa.ipc.open_stream(pa.decompress(data, decompressed_size=size, codec="zstd")).read_all().column("both").combine_chunks()
            texts.append(both.take(pa.array(np.arange(0, len(both), 2))))
            row, codes = _codes(both.take(pa.array(np.arange(1, len(both), 2))))
            own = pa.array(codes).dictionary_encode()
            ids = np.array([known.setdefault(c, len(known)) for c in own.dictionary.to_pylist()])
            one = np.sort(row << 32 | ids[own.indices.to_numpy()])
            one = one[np.diff(one, prepend=-1) != 0]
            sizes.append(np.bincount(one >> 32, minlength=len(both) // 2))
            flat.append((one & 0xFFFFFFFF).astype(np.int32))
        self.n, self.flat = np.concatenate(sizes), np.concatenate(flat)
        self.begin = np.cumsum(self.n) - self.n
        order = np.argsort(self.n, kind="stable")
        self.texts = pa.concat_arrays(texts).take(pa.array(order))
        self.flat = np.concatenate([self.grams(order[lo : lo + LOOKED_AT])[0] for lo in range(0, len(order), LOOKED_AT)])
        self.n = self.n[order]
        self.begin = np.cumsum(self.n) - self.n

    def grams(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The grams of some texts, one after another, and where each begins."""
        n = self.n[at]
        begin = np.cumsum(n) - n
        return self.flat[np.repeat(self.begin[at] - begin, n) + np.arange(n.sum())], begin

    def bits(self, words: int, grams: int, factor: int) -> np.ndarray:
        """``words`` rows of 64 bits for each text; a bit is set if an odd number of the text's grams fall on it."""
        bit = ((np.arange(grams, dtype=np.uint64) * np.uint64(factor)) >> np.uint64(32)) % np.uint64(64 * words)
        out = np.zeros((words, len(self.n)), np.uint64)
        for w in range(words):
            mask = np.where(bit >> np.uint64(6) == w, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
            for lo in range(0, len(self.n), LOOKED_AT):
                begin, n = self.begin[lo : lo + LOOKED_AT], self.n[lo : lo + LOOKED_AT]
                out[w, lo : lo + LOOKED_AT] = np.bitwise_xor.reduceat(mask[self.flat[begin[0] : begin[-1] + n[-1]]], begin - begin[0])
        return out


def _words_for(n: float, t: float) -> int:
    """Words of bits kept of texts of ``n`` grams: the fewest that tell most apart which share a sixth of them, up to two bits for a gram."""
    words, most = 1, 2 * n * (1 - t) / (1 + t)
    while words < min(WORDS, max(2, -(-2 * n // 64))):
        odd = 32 * words * (1 - np.exp(-1.7 * n / (32 * words)))
        if odd - 3 * np.sqrt(odd * (1 - odd / (64 * words))) >= most:
            break
        words += 1
    return words


def _near(t: float, alone: bool) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of two blocks at or above ``t``; with ``alone`` both are blocks of one table, and a block that meets itself comes once."""
    share = (1 - t) / (1 + t)  # of the grams of two texts, what may be in one of them only

    def pairs(left: _Block, right: _Block, grams: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, m, same = left.n, right.n, left is right
        words = _words_for(float(max(np.median(n), np.median(m))), t)
        sides = (left,) if same else (left, right)
        first, second = ([b.bits(w, grams, factor) for b in sides] for w, factor in ((words, 0x9E3779B1), (AGAIN, 0x85EBCA77)))
        mine, theirs = first[0], first[-1]
        lows = np.searchsorted(m, np.ceil(n * t - SLACK))
        highs = np.searchsorted(m, np.floor(n / t + SLACK), side="right")
        if same:
            lows = np.maximum(lows, np.arange(1, len(n) + 1))
        held = np.zeros(grams, bool)
        tile = TILE[0] * TILE[1]
        differ, count, odd = np.empty(tile, np.uint64), np.empty(tile, np.uint8), np.empty(tile, np.uint8 if words <= 3 else np.uint16)

        def looked_at(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            near = np.bitwise_count(second[0][:, i] ^ second[-1][:, j]).sum(0, dtype=np.int64) <= (n[i] + m[j]) * share + SLACK
            near &= (j >= lows[i]) & (j < highs[i])
            i, j = i[near], j[near]
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            step = max(1, COUNTED // int(m[j].max(initial=1)))
            for at in range(0, len(i), step):
                a, b = i[at : at + step], j[at : at + step]
                gram, begin = right.grams(b)
                hits = np.empty(len(gram), np.int64)
                cuts = np.flatnonzero(np.diff(a, prepend=-1))
                for x, lo, hi in zip(a[cuts].tolist(), begin[cuts].tolist(), [*begin[cuts[1:]].tolist(), len(gram)], strict=True):
                    own = left.flat[left.begin[x] : left.begin[x] + n[x]]
                    held[own] = True
                    hits[lo:hi] = held[gram[lo:hi]]
                    held[own] = False
                shared = np.add.reduceat(hits, begin)
                like = shared / (n[a] + m[b] - shared)
                good = like >= t
                yield a[good], b[good], like[good]

        found, rows = [], 0
        for top in range(0, len(n), TILE[0]):
            end = min(top + TILE[0], len(n))
            for lo in range(lows[top], highs[end - 1], TILE[1]):
                hi = min(lo + TILE[1], highs[end - 1])
                shape, size = (end - top, hi - lo), (end - top) * (hi - lo)
                d, c, o = differ[:size].reshape(shape), count[:size].reshape(shape), odd[:size].reshape(shape)
                for w in range(words):
                    np.bitwise_xor(mine[w, top:end, None], theirs[w, None, lo:hi], out=d)
                    np.bitwise_count(d, out=c if w else o)
                    if w:
                        np.add(o, c, out=o)
                at = np.flatnonzero(odd[:size] <= int((n[end - 1] + m[hi - 1]) * share + SLACK))  # the bound grows with the sizes
                if len(at):
                    found.append((at // (hi - lo) + top, at % (hi - lo) + lo))
                    rows += len(at)
                if rows >= LOOKED_AT:
                    yield from looked_at(*(np.concatenate(x) for x in zip(*found, strict=True)))
                    found, rows = [], 0
        if found:
            yield from looked_at(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}
        for batch in batches:
            for side, size, data in zip(*(batch.column(c).to_pylist() for c in ("side", "bytes", "data")), strict=True):
                pieces[side].append((size, data))
        same = alone and key[0].as_py() == key[1].as_py()
        if not pieces[0] or not (same or pieces[1]):
            return
        known: dict[int, int] = {}
        left = _Block(pieces.pop(0), known)
        right = left if same else _Block(pieces.pop(1), known)

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            a, b, like = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([left.texts.take(pa.array(a)), right.texts.take(pa.array(b)), pa.array(like)], ["a", "b", "similarity"])

        found, rows = [], 0
        for some in pairs(left, right, len(known)):
            found.append(some)
            rows += len(some[0])
            if rows >= PAIRS:
                yield batch_of(found)
                found, rows = [], 0
        if found:
            yield batch_of(found)

    return run


def _block_pairs(own: DataFrame, other: DataFrame | None, t: float) -> DataFrame:
    """The pairs at or above ``t`` by blocks: every two that hold sizes alike enough meet in one task."""
    alone = other is None
    held = F.octet_length("text") + F.octet_length("words") + 8 * F.col("n")
    size = lambda df, side: df.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.sum(held).alias("bytes")).withColumn("side", F.lit(side))
    sizes = size(own, "own") if alone else size(own, "own").unionByName(size(other, "other"))
    # one line for each size of a set
    of = lambda c, s: F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0))
    sizes = sizes.groupBy("n").agg(*[of("c", s).alias(s) for s in ("own", "other")], *[of("bytes", s).alias(f"{s}_bytes") for s in ("own", "other")]).collect()
    least, most = BLOCK_ROWS
    rows = max(least, min(most, -(-max(sum(r.own for r in sizes), sum(r.other for r in sizes)) // SHARE)))
    first, plan, listed = {"own": 0, "other": 0}, {"own": [], "other": []}, {"own": [], "other": []}
    for low, high, *held in _classes(sizes, rows):
        for s, texts, size in zip(("own", "other"), held[:2], held[2:], strict=True):
            cuts = max(1, -(-texts // rows), -(-size // BLOCK_BYTES))
            plan[s] += [(r.n, cuts, first[s], max(1, -(-size // cuts // PIECE_BYTES))) for r in sizes if low <= r.n <= high]
            listed[s] += [(first[s] + i, low, high) for i in range(cuts)]
            first[s] += cuts
    met = [
        (i, j) for i, low, high in listed["own"] for j, low2, high2 in listed["own" if alone else "other"]
        if (i <= j or not alone) and high >= low2 * t - SLACK and high2 >= low * t - SLACK
    ]
    # a line for each block of each two that meet
    sent = [(0, i, i, j) for i, j in met], [(1, j, i, j) for i, j in met if i < j or not alone]
    to = lambda lines: F.broadcast(own.sparkSession.createDataFrame(lines, "side int, block int, i int, j int"))
    if alone:
        rows = _packed(own, plan["own"]).join(to(sent[0] + sent[1]), "block")
    else:
        rows = _packed(own, plan["own"]).join(to(sent[0]), "block").unionByName(_packed(other, plan["other"]).join(to(sent[1]), "block"))
    rows = rows.select("i", "j", "side", "bytes", "data").repartition(max(1, min(3 * len(met), 10_000)), "i", "j")
    pairs = rows.groupBy("i", "j").applyInArrow(_near(t, alone), "a string, b string, similarity double")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity") if alone else pairs


def similar_pairs(left: DataFrame, right: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, similarity`` of all pairs of texts at or above ``threshold`` (above 0, at most 1).

    ``left``, ``right``: ``text``. Without ``right`` the texts of ``left`` are paired among themselves, each
    pair once with ``a < b``. Null texts and texts without letters and digits are like nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold lies above 0 and is at most 1")
    t = float(threshold)
    own = durable(_texts(left))
    other = own if right is None else durable(_texts(right))
    sets, others = gram_sets(own), gram_sets(other)
    both = sets if right is None else sets.unionByName(others)
    counts = both.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    if right is None:
        counts = durable(counts)
        if _least_meetings(counts, own, t) > MEETINGS:
            return _block_pairs(own, None, t)

    a = durable(_prefixes(sets, counts, t))
    b = a if right is None else durable(_prefixes(others, counts, t))
    if _meetings(a, b) > MEETINGS:
        return _block_pairs(own, None if right is None else other, t)
    b = b.select(F.col("text").alias("_text"), F.col("n").alias("_n"), "gram", F.col("at").alias("_at"))
    met = a.join(b.hint("merge"), "gram")
    if right is None:
        met = met.where("text < _text")
    sizes = (F.col("n") >= _least(t, F.col("_n"))) & (F.col("_n") >= _least(t, F.col("n")))
    # shared grams: at most as many before this one as both have places there, and as many behind as both have left
    most = F.least("at", "_at") + 1 + F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")) - 1
    needed = F.ceil((F.col("n") + F.col("_n")) * F.lit(t / (1 + t)) - SLACK)
    pairs = met.where(sizes & (most >= needed)).select(F.col("text").alias("a"), F.col("_text").alias("b")).distinct()

    pairs = pairs.join(sets.select(F.col("text").alias("a"), F.col("grams").alias("_a")), "a")
    pairs = pairs.join(others.select(F.col("text").alias("b"), F.col("grams").alias("_b")), "b")
    similarity = F.size(F.array_intersect("_a", "_b")) / F.size(F.array_union("_a", "_b"))
    return pairs.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= t)
