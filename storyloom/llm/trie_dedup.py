"""Exact duplicates: compressed radix tries own the distinct byte strings.

Every task first inserts its own texts into a trie, so copies within a task leave as one
terminal. Terminals that share length and content hash with another one are then dealt out by
(length, content hash) and inserted, with their full bytes, into the trie of their partition;
its terminal nodes keep the identifier that stays and the number of rows. Equality is always
that of the bytes: the hash only chooses the partition.

Memory is bounded by spilling subtrees. A trie that holds more than ``held`` bytes gives up the
largest subtree of at most half of that. In the first pass, which only combines, such a subtree
leaves and begins anew; in an owners' pass it is closed: its strings, also those still to
come, are written to the shared folder and the next pass takes them, while at least half of
what was held stays and is settled. A string with more than ``FAN`` terminals is combined in
groups of ``FAN`` first, so a text that a third of all rows hold never meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from storyloom.llm.common import store, text_of

#: Bytes of labels and nodes that one trie holds.
HELD_BYTES = 64 << 20
#: What a node costs besides its label.
NODE_BYTES = 400
#: Terminals of one (length, hash) that go to one task.
FAN = 64
#: Text bytes per Arrow batch that a pass returns.
BATCH_BYTES = 8 << 20


class Node:
    """A node of the trie: the bytes on the edge to it, its children by first byte, its terminal."""

    __slots__ = ("label", "kids", "end", "held", "closed")

    def __init__(self, label: bytes, end=None):
        self.label, self.kids, self.end, self.closed = label, {}, end, False
        self.held = len(label) + NODE_BYTES


def _shared(key: bytes, at: int, label: bytes) -> int:
    """How many bytes ``label`` has in common with ``key`` from ``at``."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key[at + low : at + mid] == label[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A Patricia trie over byte strings; ``end`` of a node is its terminal's payload."""

    def __init__(self, limit: int = HELD_BYTES):
        self.limit, self.root = limit, Node(b"")

    def find(self, key: bytes, make: Callable[[], list]) -> list | None:
        """The payload of ``key``, made if new; None if the key lies in a closed subtree."""
        node, at, path = self.root, 0, [self.root]
        while True:
            if node.closed:
                return None
            if at == len(key):
                if node.end is None:
                    node.end = make()
                return node.end
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:], make())
                self._grow(path, kid.held)
                return kid.end
            if key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                path.append(node)
                continue
            n = _shared(key, at, kid.label)
            fork = Node(kid.label[:n])
            kid.label = kid.label[n:]
            kid.held -= n
            fork.kids[kid.label[0]] = kid
            fork.held += kid.held
            node.kids[key[at]] = fork
            self._grow(path, NODE_BYTES)

    @staticmethod
    def _grow(path: list[Node], n: int) -> None:
        for node in path:
            node.held += n

    def heavy(self) -> bool:
        return self.root.held > self.limit

    def spill(self, close: bool) -> Iterator[tuple[bytes, list]]:
        """Take out the largest subtree of at most half the limit; yields its strings and payloads."""
        node, prefix, path = self.root, [], []
        while node.held > self.limit // 2:
            if not node.kids:  # one string of more than half the limit: a task has to hold it
                self.limit += node.held
                return iter(())
            path.append(node)
            node = max(node.kids.values(), key=lambda kid: kid.held)
            prefix.append(node.label)
        if node.closed:
            self.limit *= 2  # what is heavy has been taken before
            return iter(())
        out = Node(node.label, node.end)
        out.kids = node.kids
        lost = node.held
        if close:
            node.kids, node.end, node.closed, node.held = {}, None, True, 0
        else:
            del path[-1].kids[node.label[0]]
        self._grow(path, -lost)
        return self._strings(out, b"".join(prefix[:-1]))

    def strings(self) -> Iterator[tuple[bytes, list]]:
        """All strings still held, with their payloads."""
        return self._strings(self.root, b"")

    @staticmethod
    def _strings(top: Node, before: bytes) -> Iterator[tuple[bytes, list]]:
        todo = [(top, before)]
        while todo:
            node, prefix = todo.pop()
            whole = prefix + node.label
            if node.end is not None:
                yield whole, node.end
            todo += [(kid, whole) for kid in node.kids.values()]


def lowered(text: bytes) -> bytes:
    """A-Z in lower case; every other byte, so every other character, as it is."""
    return text.lower()


def content_hash(digest: bytes, bits: int = 64) -> int:
    """The first ``bits`` bits of a digest, as a signed number."""
    return int.from_bytes(digest[:8], "big", signed=True) >> (64 - bits)


class _Order:
    """Which of two identifiers stays: the larger (or smaller) one, null least wanted, then the earlier row."""

    def __init__(self, largest: bool):
        self.largest = largest

    def better(self, a, a_at: int, b, b_at: int) -> bool:
        if a == b:
            return a_at < b_at
        if a is None or b is None:
            return b is None
        return a > b if self.largest else a < b


def _passes(kind, first: bool, held: int, bits: int, largest: bool, close: bool):
    """A map over batches: inserts texts, yields a link for each row and a terminal for each string."""
    schema = pa.schema([("ref", pa.int64()), ("node", pa.int64()), ("doc_id", kind), ("at", pa.int64()), ("size", pa.int64()), ("digest", pa.binary()),
                        ("text", pa.binary()), ("length", pa.int64()), ("hash", pa.int64()), ("whole", pa.bool_())])
    wins = _Order(largest).better

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        trie, nodes, refs = Trie(held), base, base
        out: list[tuple] = []

        def ends(strings, whole: bool):
            nonlocal out
            n = 0
            for text, (node, owner, at, size, key) in strings:
                out.append((None, node, owner, at, size, None, text, len(text), key, whole))
                n += len(text) + 100
                if n > BATCH_BYTES:
                    yield batch()
                    n = 0

        def batch():
            nonlocal out
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out = []
            return made

        for b in batches:
            columns = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                owner, text = columns["doc_id"][i].as_py(), columns["text"][i].as_py()
                if first:
                    text = lowered(text)
                    digest = hashlib.sha256(text).digest()
                    ref, at, size, key = refs, refs, 1, content_hash(digest, bits)
                    refs += 1
                else:
                    digest = None
                    ref, at, size, key = (columns[c][i].as_py() for c in ("node", "at", "size", "hash"))
                fresh = [nodes, owner, at, 0, key]
                end = trie.find(text, lambda fresh=fresh: fresh)
                if end is fresh or end is None:
                    nodes += 1
                if end is None:  # in a closed subtree: the next pass takes it
                    out.append((ref, fresh[0], owner if first else None, None, None, digest, None, None, None, None))
                    out.append((None, fresh[0], owner, at, size, None, text, len(text), key, False))
                    continue
                end[3] += size
                if wins(owner, at, end[1], end[2]):
                    end[1], end[2] = owner, at
                out.append((ref, end[0], owner if first else None, None, None, digest, None, None, None, None))
                if trie.heavy():
                    yield from ends(trie.spill(close), False)
            if out:
                yield batch()
        yield from ends(trie.strings(), True)
        if out:
            yield batch()

    return run


def duplicates(docs: DataFrame, keep: str = "largest", held: int = HELD_BYTES, bits: int = 64, fan: int = FAN) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for each row of ``docs``.

    Texts are equal if they are the same bytes after A-Z are lower-cased; null counts as empty.
    Of equal texts the row with the ``keep`` ("largest" or "smallest") doc_id stays; a null
    doc_id stays only where no other is there, and of rows that share the doc_id exactly one
    stays. ``doc_id`` may be of any type that Python can order. Very long texts are
    read whole. Extra columns are not used; an empty table gives an empty result. ``bits`` of the content
    hash choose the partition; fewer only make partitions larger.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    own = docs.schema["doc_id"].dataType
    kind = to_arrow_type(own)
    names = f"ref long, node long, doc_id {own.simpleString()}, at long, size long, digest binary, text binary, length long, hash long, whole boolean"

    def inserted(rows: DataFrame, first: bool, close: bool, name: str) -> tuple[DataFrame, DataFrame]:
        both = store(rows.mapInArrow(_passes(kind, first, held, bits, keep == "largest", close), names), name)
        return both.filter("ref is not null"), both.filter("ref is null")

    rows, ends = inserted(docs.select("doc_id", text_of().cast("binary").alias("text")), True, False, "trie-rows")
    counts = store(ends.groupBy("length", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "trie-counts")
    width = counts.agg(F.max("n")).first()[0] or 0
    carried = ["node", "doc_id", "at", "size", "text", "length", "hash"]
    pending = ends.select(*carried).join(counts.hint("merge"), ["length", "hash"]).select(*carried, "n")

    steps: list[tuple[DataFrame, DataFrame]] = []
    while width > fan:  # one string, many tasks: its terminals are combined in groups first
        cut = F.when(F.col("n") > fan, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / fan)))
        links, ends_ = inserted(pending.repartition("length", "hash", cut), False, False, "trie-combined")
        steps.append((links, ends_.filter(F.lit(False))))
        width = -(-width // fan)
        pending = ends_.select(*carried, F.lit(width).alias("n"))
    while width:
        links, ends_ = inserted(pending.select(*carried).repartition("length", "hash"), False, True, "trie-owners")
        steps.append((links, ends_.filter("whole")))
        pending = ends_.filter("not whole")
        left, done = (not part.isEmpty() for part in (pending, steps[-1][1]))
        width = width if left else 0
        held = held if done else 2 * held  # nodes alone were too many: only under tiny limits

    settled = ["node", "doc_id", "at", "size"]
    found = None
    for links, done in reversed(steps):
        here = done.select(*settled) if found is None else done.select(*settled).unionByName(found)
        found = links.select(F.col("ref").alias("_ref"), "node").join(here, "node").select(F.col("_ref").alias("node"), "doc_id", "at", "size")
    owners = ends.select(*settled)
    if found is not None:
        met = found.select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"), F.col("at").alias("_at"), F.col("size").alias("_size"))
        owners = owners.join(met, F.col("node") == F.col("_node"), "left")
        pick = F.col("_node").isNotNull()
        owners = owners.select("node", *[F.when(pick, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("_id", "doc_id"), ("_at", "at"), ("_size", "size"))])
    owners = owners.select("node", F.col("doc_id").alias("keep_id"), F.col("at").alias("_at"), F.col("size").alias("group_size"))
    out = rows.select("ref", "node", "doc_id", "digest").join(owners, "node")
    kept = (F.col("ref") == F.col("_at")).alias("kept")
    return out.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))
