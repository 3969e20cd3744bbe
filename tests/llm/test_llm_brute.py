"""The corpus operators against brute-force versions on the small tables."""

import collections
import re

import duckdb
import numpy as np
import pytest
import xxhash
from compare import connect, difference, duck_rows, spark_rows
from pyspark.sql import functions as F

from storyloom.llm import ann, decontaminate, html_extract, suffix_dedup, toxicity, warc
from storyloom.llm.common import table
from storyloom.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(folder):
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_check_texts(spark, folder, key):
    assert difference(spark_rows(QUERIES[key](spark, folder)), duck_rows(connect(folder), ORACLES[key])) is None


def test_mixing(spark, folder, docs):
    got = QUERIES["op1_mixing"](spark, folder).toPandas()
    again = QUERIES["op1_mixing"](spark, folder).toPandas()
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == size
    total = collections.Counter()
    for d, _, s in docs:
        total[s] += size[d]
    order = sorted(s for s in total if s is not None) + [s for s in total if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, free, left = {}, set(order), 1.5 * sum(total.values())
    while True:
        over = [s for s in free if weight[s] * left / sum(weight[x] for x in free) > 2 * total[s]]
        if not over:
            break
        for s in over:
            want[s] = 2 * total[s]
            left -= want[s]
            free.discard(s)
    want |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
    for s, rows in got.groupby("source", dropna=False):
        assert rows.target.iloc[0] == pytest.approx(want[s])
        assert (rows.source_size == total[s]).all()
        assert rows.taken.sum() == pytest.approx(want[s], rel=0.05)
    assert (got.taken <= 2 * got["size"]).all()
    # exponential tilts: within a source, rates rise or fall with size
    for _, rows in got[got["size"] > 0].groupby("source"):
        rate = rows.sort_values("size").rate.to_numpy()
        assert (np.diff(rate) >= -1e-12).all() or (np.diff(rate) <= 1e-12).all()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))


def test_decontamination(spark, folder, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{folder}/benchmark.parquet'").fetchall()
    got = QUERIES["op2_decontamination"](spark, folder).toPandas()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    held = {i: grams(decontaminate.words_of(t)) for i, t in items}
    want = set()
    for d, t, _ in docs:
        own = grams(decontaminate.words_of(t))
        want |= {(d, i) for i, g in held.items() if g and len(g & own) >= 0.8 * len(g)}
    assert want and set(zip(got.doc_id, got.item_id, strict=True)) == want


def test_wand_equals_full_scores():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(4, 30)))) for i in range(150)]
    df = collections.Counter(w for _, t in items for w in set(t.split()))
    idf = {w: float(np.log(1 + (len(items) - n + 0.5) / (n + 0.5))) for w, n in df.items()}
    mean = sum(len(t.split()) for _, t in items) / len(items)
    index = decontaminate.Index(items, idf, mean, 0.45)

    def weights(text):
        tf = collections.Counter(text.split())
        norm = decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(text.split()) / mean)
        w = {t: idf[t] * c * (decontaminate.K1 + 1) / (c + norm) for t, c in tf.items()}
        return {t: x / sum(w.values()) for t, x in w.items()}

    for _ in range(40):
        passage = set(rng.choice(vocabulary, 25))
        full = {i: sum(x for t, x in weights(text).items() if t in passage) for i, text in items}
        want = {i for i, s in full.items() if s >= 0.45}
        found = dict(index.search(np.array(sorted(index.terms[w] for w in passage if w in index.terms))))
        assert set(found) == want and all(found[i] == pytest.approx(full[i]) for i in want)
        # the essential lists leave every such item possible
        left = index.candidates(np.array([index.terms.get(w, -1) for w in passage])).get(0, np.zeros(0))
        assert want <= set(left.tolist())


def test_toxicity_on_unseen_rows():
    rows = duckdb.sql(
        "SELECT d.text, l.quality, l.toxic, hash(d.text) % 4 AS fold FROM '/root/testdata/sf0.1/documents.parquet' d "
        "JOIN '/root/testdata/sf0.1/labels.parquet' l ON d.doc_id = l.doc_id ORDER BY hash(d.doc_id)"
    ).df()
    seen, new = rows[:2400], rows[2400:]
    new = new[~new.text.isin(set(seen.text))]
    labels = np.column_stack([seen.quality == 0, seen.toxic == 1]).astype(int)
    fitted = toxicity.fit_chain(seen.text.tolist(), labels, seen.fold.to_numpy().astype(int))
    models = [dict(zip(g.feature, g.weight, strict=True)) for _, g in fitted.groupby("link")]
    assert " 0" in models[1]  # the second link sees the first
    said = []
    for text in new.text:
        bag, p = {f for w in toxicity.words_of(text) for f in toxicity.features_of(w)}, []
        for i, m in enumerate(models):
            p.append(toxicity._sigmoid(sum(m.get(f, 0) for f in bag) + sum(m[f" {j}"] * p[j] for j in range(i)) + m[" b"]))
        said.append(p[-1] > toxicity.THRESHOLD)
    said, toxic = np.array(said), new.toxic.to_numpy() == 1
    assert said[toxic].mean() >= 0.85 and said[~toxic].mean() <= 0.02


def test_toxicity_query(spark, folder):
    got = QUERIES["op3_toxicity"](spark, folder).toPandas().merge(table(spark, folder, "labels").toPandas(), on="doc_id")
    assert (got.rejected == (got.toxic == 1)).mean() > 0.9
    assert got.p_poor.between(0, 1).all() and got.p_toxic.between(0, 1).all()


def test_neighbours(spark, folder):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    got = QUERIES["op5_learned_partitions"](spark, folder).toPandas()
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = [ids[j] for j in np.lexsort((ids, d)) if j != i][:10]
        own = got[got.query_id == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert own.score.tolist() == [d[np.searchsorted(ids, v)] for v in own.vec_id]
        assert list(zip(own.score, own.vec_id, strict=True)) == sorted(zip(own.score, own.vec_id, strict=True))
        hits, total = hits + len(set(want) & set(own.vec_id)), total + 10
    assert hits >= 0.9 * total


def test_neighbours_in_clusters_skip_parts():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 12)) * 4
    x = np.unique(centres[rng.integers(0, 16, 1500)] + rng.normal(size=(1500, 12)) * 0.3, axis=0)
    labels = ann.partition(x, 8)
    assert np.bincount(labels, minlength=8).min() >= 180
    _, probes = ann.fit_router(x, 8, 10)
    assert probes <= 4


def test_simhash(spark, folder, docs):
    got = QUERIES["op6_simhash"](spark, folder).toPandas().sort_values("doc_id")

    def print_of(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = np.array([print_of(t) for _, t, _ in docs], np.uint64)
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4).tolist():
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert got.component_id.tolist() == [docs[root(i)][0] for i in range(len(fps))]


def brute_removal(texts):
    """texts: (doc_id, bytes) in order of doc_id, ids unique."""
    seen, out = set(), {}
    for d, b in texts:
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = np.zeros(len(b), bool)
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + 50] = True
        seen.update(own)
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def test_suffix_dedup(spark, folder, docs):
    import hashlib

    got = QUERIES["op7_suffix_dedup"](spark, folder).collect()
    want = brute_removal([(d, (t or "").encode()) for d, t, _ in docs])
    assert len(got) == len(want)
    for r in got:
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_planted(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 500)
    monkeypatch.setattr(suffix_dedup._chunks, "__defaults__", (700,))
    rng = np.random.default_rng(11)
    passage, other = rng.bytes(180).hex(), "été " * 40
    texts = [(i, rng.bytes(40).hex() + (passage if i % 3 else "") + rng.bytes(30).hex() + (other if i % 2 else "")) for i in range(60)]
    texts += [(60, "a" * 400), (61, "a" * 49), (62, "a" * 50), (63, passage[:49]), (64, passage[10:60]), (65, texts[5][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    want = brute_removal([(d, t.encode()) for d, t in texts])
    for r in suffix_dedup.deduplicate(df).collect():
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest()), r.doc_id


def test_shared_anchors_are_told_in_packed_rows(spark):
    """A row for each chunk or bucket and part of the texts, not for each bucket and text; every shared anchor is told."""
    rng = np.random.default_rng(5)
    passages = [rng.bytes(60).hex() for _ in range(40)]
    df = spark.createDataFrame([(i, rng.bytes(20).hex() + "".join(rng.permutation(passages)[:20])) for i in range(120)], "doc_id long, text string").repartition(3)
    shared = suffix_dedup.shared_anchors(df, 16, 2).collect()
    assert len(shared) <= (3 + 16) * 2
    told = {}
    for r in shared:
        names, counts = np.frombuffer(r.digests, np.int64), np.frombuffer(r.counts, np.int32)
        assert set(names % 2) == {r.part}
        for name, h in zip(np.repeat(names, counts).tolist(), np.frombuffer(r.hashes, np.uint64).tolist(), strict=True):
            told.setdefault(name, set()).add(h)
    texts = {r.d: suffix_dedup.Chunk([r.text.encode()]).hashes.tolist() for r in df.selectExpr("xxhash64(text) d", "text").collect()}
    n = collections.Counter(h for hashes in texts.values() for h in set(hashes))
    assert told == {d: {h for h in hashes if n[h] > 1} for d, hashes in texts.items()}
    reps = df.selectExpr("doc_id", "xxhash64(text) digest")
    got = suffix_dedup.anchors_of(reps, spark.createDataFrame(shared), 2).collect()
    assert sorted(r.digest for r in got) == sorted(told) and all(set(np.frombuffer(r.hashes, np.uint64).tolist()) == told[r.digest] for r in got)


def test_windows_without_an_equal_one_are_left_out():
    rng = np.random.default_rng(6)
    buf = rng.integers(0, 3, 30_000).astype(np.uint8)
    buf[20_000:20_400] = buf[100:500]
    at = np.arange(len(buf) - 49)
    words = np.ndarray((len(buf) - 7,), np.uint64, buffer=buf, strides=(1,))
    some = suffix_dedup._perhaps_equal(words, at)
    assert len(some) < len(at) / 2 and {*range(100, 451), *range(20_000, 20_351)} <= set(some.tolist())
    order, new = suffix_dedup.equal_windows(buf, at)
    assert sorted(order.tolist()) == [*range(100, 451), *range(20_000, 20_351)] and new.sum() == 351


def test_html_articles(folder):
    from html import unescape

    for page, html in duckdb.sql(f"SELECT page_id, html FROM '{folder}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:h1|p)>", article)]
        assert html_extract.main_text(html) == "\n".join(p for p in parts if p), page


def test_html_furniture():
    long = "This is a paragraph, long enough to count as text of the article, with commas."
    page = f"""<html><body class="has-sidebar"><header><h1>Site</h1></header><ul class="main-menu"><li>Home</li></ul>
    <div class="cookie-notice">We use cookies</div><div id="post"><div class="top"><h2>Head &amp; line</h2></div>
    <div class="content"><p>{long}</p><div class="ad-slot">Buy</div><p>Short&nbsp;one.</p><ul><li>first<li>second</ul>
    <form><p>Your name</p></form><p>{long} <a href="x">A link</a>.</p><script>var a = "</p><p>no</p>";</script></div>
    <section id="comments"><p>{long} said a reader, who wrote more than the author, again and again.</p></section></div>
    <aside><p>{long}</p></aside><footer>Foot</footer></body></html>"""
    assert html_extract.main_text(page) == "\n".join(["Head & line", long, "Short one.", "first", "second", f"{long} A link."])


def test_html_without_structure():
    assert html_extract.main_text(None) == "" and html_extract.main_text("") == ""
    assert html_extract.main_text("just &lt;text&gt; &eacute") == "just <text> é"
    assert html_extract.main_text("<div>menu</div><article><h1>T</h1><p>a</p></article><div>other</div>") == "T\na"
    assert html_extract.main_text("<p>a<p>b<b>c</p>d < e") == "a\nbc\nd < e"
    assert html_extract.main_text("<div><span>x" * 20_000).count("x") == 20_000


def test_warc_magic_in_payload(spark, tmp_path):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [(i, f"http://h/{i}", body) for i, body in enumerate(["é" * 50, fake * 3, "x" + fake, None, "", "WARC/1.0\r\n", "é" * 50, "a\r\n\r\nb"])]
    df = spark.createDataFrame(pages * 1, "page_id long, url string, html string").repartition(2)
    for n, compression in enumerate(("gzip", "none")):
        path = str(tmp_path / f"w{n}")
        warc.write_archives(df, path, compression=compression)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
        try:
            back = {r.record_id: r for r in warc.read_archives(spark, path).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert set(back) == {str(p[0]) for p in pages}
        for page, _, html in pages:
            r = back[str(page)]
            assert r.payload_bytes == len((html or "").encode()) and r.payload_digest == r.declared_digest
        assert back["6"].record_type == "revisit" and back["6"].refers_to == "0"
        assert back["4"].refers_to == "3" and back["3"].record_type == "response"


def test_pipeline_stages(spark, folder, docs):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = table(spark, folder, "documents")
    sizes = [rows.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.store(stage(spark, rows, folder), name)
        if name != "mixing":
            assert out.columns == columns
        sizes.append(out.count())
        if name == "line_dedup":
            assert out.filter(F.col("n_chars") != F.char_length("text")).count() == 0
        rows = out
    assert all(a >= b > 0 for a, b in zip(sizes, sizes[1:]))
    assert rows.select("doc_id").distinct().count() == rows.count()


LONG = "A paragraph of the article that is long enough to score, with a comma, and goes on for a while so that it counts for something in the end."
MENU = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul>'


@pytest.mark.parametrize(
    ("html", "want"),
    [
        # the second section is short
        (f"<div><section>{f'<p>{LONG}</p>' * 5}</section><section><h2>B</h2><p>{LONG[:90]}</p></section></div>", [LONG] * 5 + ["B", LONG[:90]]),
        # references inside the article
        (f"<article><p>{LONG}</p><ul><li><a href='1'>One</a></li><li><a href='2'>Two</a></li><li><a href='3'>Three</a></li></ul></article>", [LONG, "One", "Two", "Three"]),
        # names that only begin like furniture, and names that are
        (f'<article><p>{LONG}</p><p class="share-price">Up 3%.</p><div class="related-work">Others did it.</div><div class="share-buttons">Post it</div><div class="ad">Buy</div><div class="related-posts">More</div><section id="comments"><p>{LONG} says a reader</p></section></article>', [LONG, "Up 3%.", "Others did it."]),
        # a table and loose text beside the container
        (f"<div><div><p>{LONG}</p><p>{LONG}</p></div><table><tr><td>1</td><td>2</td></tr></table>and so on</div>", [LONG, LONG, "1", "2", "and so on"]),
        # divs without any mark, furniture by name and by tag around them
        (f'<body><div id="header"><p>{LONG}</p></div>{MENU}<div class="page"><h1>Title</h1><div><p>{LONG}</p>text <b>bold</b> text<p>short</p></div><div><p>{LONG[:60]}</p></div></div><div class="footer">(c)</div></body>', ["Title", LONG, "text bold text", "short", LONG[:60]]),
        (f"<body><h1>T</h1><p>{LONG}</p><p>{LONG}</p><nav>x</nav><ul><li>a point that is made in a list, not in a paragraph</li></ul></body>", ["T", LONG, LONG, "a point that is made in a list, not in a paragraph"]),
        (f"<main><h1>T</h1><div><p>{LONG}</p></div><div><p>end</p></div><aside>no</aside></main><div>{MENU}</div>", ["T", LONG, "end"]),
    ],
)
def test_container_keeps_the_whole_article(html, want):
    assert html_extract.main_text(html).split("\n") == want
