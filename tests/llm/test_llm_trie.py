"""Exact duplicates by tries: spilling, colliding hashes, hot texts, odd inputs."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from storyloom.llm import trie_dedup
from storyloom.llm.trie_dedup import Trie

BASE = "doc_id long, text string, node long, digest string, Size long, whole boolean, kept string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def brute(rows, largest=True):
    groups = defaultdict(list)
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        groups[low].append(i)
    out = []
    for low, found in groups.items():
        known = [i for i in found if i is not None]
        keep = (max if largest else min)(known) if known else None
        left = 1
        for i in sorted(found, key=lambda i: (i is None, i)):
            stays = left if i == keep else 0
            left -= stays
            out.append((i, keep, len(found), bool(stays), hashlib.sha256(low.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, 1, "x", 2, True, "k") for i, t in rows], BASE).repartition(parts)


ROWS = [
    (1, "Same Text"), (2, "same text"), (2, "same text"), (9, "SAME TEXT"), (3, None), (4, ""), (5, "ÄÖ"), (6, "äÖ"), (None, "same text"),
    (None, "alone"), (7, LONG), (8, LONG.upper()), (10, LONG + "x"), (11, "same"), (12, "same text "), (13, "\x00"), (13, "other"), (14, "K"), (15, "K"),
]


def test_rules_and_odd_rows(spark):
    assert rows_of(trie_dedup.duplicates(frame(spark, ROWS))) == brute(ROWS)
    assert rows_of(trie_dedup.duplicates(frame(spark, ROWS), keep="smallest")) == brute(ROWS, largest=False)


def test_empty_table(spark):
    got = trie_dedup.duplicates(spark.createDataFrame([], BASE))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and got.count() == 0


def test_identifiers_that_are_strings(spark):
    rows = [("b", "x"), ("a", "X"), (None, "x"), ("é", "y")]
    got = trie_dedup.duplicates(spark.createDataFrame(rows, "doc_id string, text string"))
    assert rows_of(got) == brute(rows)


@pytest.mark.parametrize("held,bits,fan", [(1 << 20, 64, 64), (4_000, 64, 4), (3_000, 1, 2), (20_000, 2, 64)])
def test_spilled_subtrees_and_colliding_hashes(spark, held, bits, fan):
    rng = random.Random(5)
    texts = [f"{rng.choice(['pre', 'prefix', 'other'])} {rng.randrange(150)} {'tail' * rng.randrange(4)}" for _ in range(600)]
    rows = [(rng.randrange(400), t) for t in texts] + [(1000 + i, "hot") for i in range(300)]
    got = trie_dedup.duplicates(frame(spark, rows, 24), held=held, bits=bits, fan=fan)
    assert rows_of(got) == brute(rows)


def test_trie_keeps_every_string_once():
    rng = random.Random(7)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(500)]
    trie, seen = Trie(), {}
    for k in keys:
        assert trie.find(k, lambda: [len(seen)]) is seen.setdefault(k, trie.find(k, list))
    assert {k: end for k, end in trie.strings()} == seen


def test_a_closed_subtree_takes_nothing_and_loses_nothing():
    rng = random.Random(8)
    keys = [f"{rng.randrange(40)}-{rng.randrange(1000)}".encode() for _ in range(2000)]
    trie, out, refused = Trie(20_000), [], []
    for k in keys:
        if trie.find(k, lambda: ["end"]) is None:
            refused.append(k)
        elif trie.heavy():
            out += [s for s, _ in trie.spill(True)]
    rest = [s for s, _ in trie.strings()]
    assert len(set(rest)) == len(rest) and len(set(out)) == len(out)
    assert set(rest) | set(out) | set(refused) == set(keys) and not set(rest) & (set(out) | set(refused))
    assert rest and refused


def test_query_follows_its_check_text(spark, folder):
    from storyloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", F.col("text")).collect()]
    assert rows_of(QUERIES["op11_trie_dedup"](spark, folder)) == brute(rows)
