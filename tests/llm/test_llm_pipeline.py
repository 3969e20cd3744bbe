"""Every stage of the pipeline against a brute-force version over the rows that the stage is given."""

import collections
import re

import duckdb
import numpy as np
import pytest
import xxhash

from storyloom.llm import decontaminate, toxicity
from storyloom.llm.common import store, table
from storyloom.llm.queries import ORACLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def stages(spark, folder):
    """``{name: (what the stage was given, what it returned)}``."""
    import corpus_pipeline

    out, rows = {}, table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        after = store(stage(spark, rows, folder), f"test-{name}")
        out[name] = (rows, after)
        rows = after
    return out


def test_toxicity(spark, folder, stages):
    before, after = stages["toxicity"]
    models = toxicity.train(table(spark, folder, "documents"), table(spark, folder, "labels"))

    def rejected(text):
        if not toxicity.words_of(text):
            return False
        bag, p = {f for w in toxicity.words_of(text) for f in toxicity.features_of(w)}, []
        for i, m in enumerate(models):
            p.append(toxicity._sigmoid(sum(m.get(f, 0) for f in bag) + sum(m.get(f" {j}", 0) * p[j] for j in range(i)) + m.get(" b", 0)))
        return p[-1] > toxicity.THRESHOLD

    want = [(d, t) for d, t in rows_of(before) if not rejected(t or "")]
    assert rows_of(after) == want and len(want) < before.count()


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    rows = rows_of(before)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    gone = {r[0]: {int(n) for n in r[3].split(",") if n} for r in con.execute(f"SELECT doc_id, n_lines, n_dropped, dropped FROM ({ORACLES['op4_line_dedup_wide']})").fetchall()}
    want = []
    for d, t in rows:
        left = "\n".join(line for i, line in enumerate((t or "").split("\n")) if i not in gone[d])
        if not gone[d] or left.strip():
            want.append((d, left if gone[d] else t))
    assert rows_of(after) == sorted(want) and any(gone.values())


def test_simhash(stages):
    before, after = stages["simhash_dedup"]
    rows = rows_of(before)

    def print_of(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = np.array([print_of(t) for _, t in rows], np.uint64)
    group = list(range(len(fps)))
    for _ in range(len(fps)):  # labels spread until they settle
        new = [min(group[j] for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4).tolist()) for i in range(len(fps))]
        if new == group:
            break
        group = new
    assert rows_of(after) == [rows[i] for i in range(len(rows)) if group[i] == i]


def test_decontamination(spark, folder, stages):
    before, after = stages["decontamination"]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    held = [grams(decontaminate.words_of(r.text)) for r in table(spark, folder, "benchmark").collect()]

    def leaks(text):
        own = grams(decontaminate.words_of(text))
        return any(g and len(g & own) >= 0.8 * len(g) for g in held)

    assert rows_of(after) == [(d, t) for d, t in rows_of(before) if not leaks(t or "")]


def test_mixing(stages):
    before, after = stages["mixing"]
    given = {r.doc_id: r for r in before.collect()}
    size = {d: len(WORD.findall(r.text or "")) for d, r in given.items()}
    total = collections.Counter()
    for d, r in given.items():
        total[r.source] += size[d]
    # targets: 150% of all sizes by weight, twice a source's own size at most, the excess reshared
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(total, key=lambda s: (s is None, (s or "").encode())))}
    target, open_, left = {}, set(total), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2 * total[s]
            left -= target[s]
            open_.discard(s)
    taken = collections.Counter()
    for r in after.collect():
        assert r.text == given[r.doc_id].text and r.size == size[r.doc_id] and 1 <= r.copies <= 2 and r.taken == r.copies * r.size
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= max(size.values()), s
    assert after.select("doc_id").distinct().count() == after.count()
