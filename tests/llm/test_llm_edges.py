"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from storyloom.llm import ann, decontaminate, html_extract, line_dedup, mixing, simhash, suffix_dedup, toxicity, url_filter, warc

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(40_000))
LINE = "a line that is long enough to take part"
CLASH = (
    "size long, copies long, rate double, target double, line string, line_no long, id string, first string, fp long, node long, "
    "component long, component_id long, digest long, runs string, z string, item_id long, score double, rejected boolean, _of long, _n long, "
    "file string, block long, value string, host string, rule string, part int, query string"
)
BASE = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, f"{LINE}\n\n{LINE}!", "en", "a", 1), (1, f"{LINE}\n\n{LINE}!", "en", "a", 1), (2, None, None, None, None), (3, "", "en", None, 0),
    (4, " \t\n\r ", "en", "", 5), (5, LONG, "en", "b", len(LONG)), (6, LONG + " end", "en", "b", len(LONG) + 4), (None, f"{LINE}?", "en", "a", 9),
    (7, f"x{LINE}", "xx", "é", 3), (8, "one", "en", "é", 3), (9, "ONE", "en", "\x00", 3),
]


def with_clash(df):
    names = [f.strip().split() for f in CLASH.split(",")]
    return df.select("*", *[F.lit(None).cast(k).alias(c) for c, k in names if c not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    return with_clash(spark.createDataFrame(ROWS, BASE)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return with_clash(spark.createDataFrame([], BASE))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://A.org/x", "<p>b"), (1, "http://A.org/x", "<p>b"), (2, None, None), (3, "no scheme", ""), (4, "x://", "<p>b"), (None, "a://b\r\nc", "WARC/1.0\r\n"), (5, "h://q.example.org/en/12", LONG)]
    return with_clash(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3)


@pytest.fixture(scope="module")
def no_pages(spark):
    return with_clash(spark.createDataFrame([], "page_id long, url string, html string"))


def ids(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_mixing(docs, none):
    got = mixing.mix(docs)
    assert ids(got, "doc_id") == ids(docs, "doc_id")
    by = {(r.doc_id, r.source): r for r in got.collect()}
    assert by[(2, None)].size == 0 and by[(2, None)].taken == 0 and by[(2, None)].source_size == 0
    assert by[(5, "b")].size == 80_000 and by[(5, "b")].copies <= 2
    kept = mixing.apply_mix(docs, got)
    # the documents' own columns of these names stay; the decisions stand beside them
    assert kept.columns[: len(docs.columns)] == docs.columns and kept.columns[len(docs.columns) :] == ["_size", "source_size", "_target", "_rate", "_copies", "taken"]
    assert kept.filter("_copies < 1 or copies is not null").count() == 0
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none, mixing.mix(none)).count() == 0


def test_lines(docs, none):
    gone = line_dedup.dropped_lines(docs)
    got = {r.doc_id: r for r in line_dedup.summary(docs, gone).collect()}
    # a null doc_id comes first; lines near to its line go
    assert got[None].n_dropped == 0 and got[1].dropped == "0,2"
    assert got[7].n_dropped == 0 or got[7].dropped == "0"
    assert got[6].n_dropped == 0 and got[2].n_lines == 1 and got[4].n_dropped == 0
    kept = line_dedup.apply_dropped(docs, gone)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1").count() == 0 and kept.filter("doc_id in (2, 3, 4)").count() == 3
    assert line_dedup.summary(none, line_dedup.dropped_lines(none)).count() == 0


def test_near_lines_exactly(spark):
    base = "The quick brown fox jumps over the lazy dog " * 6
    lines = [base + "end", base + "end.", base + "End", base + "enDd", "Q" + base + "end", base[:150] + base[151:] + "end", base[:40] + "#" + base[41:] + "end", base + "fin", base]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string").repartition(4)

    def near(a, b):
        short, long = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    want = [(j,) for j in range(len(lines)) if any(near(lines[i], lines[j]) for i in range(j))]
    assert ids(line_dedup.dropped_lines(df), "doc_id") == want


def test_near_lines_within_more_edits(spark, monkeypatch):
    """Lines of two and three edits go too; keys of many lines are judged by nested deletions."""
    monkeypatch.setattr(line_dedup, "SMALL", 2)
    import random

    rng = random.Random(5)

    def edited(s, n):
        for _ in range(n):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("xyz#") + s[i:], s[:i] + rng.choice("xyz#") + s[i + 1 :]])
        return s

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    # unlike lines with one beginning, so that a line's near one is seldom the earliest of its key
    bases = ["All that stands at the start is shared by each " + "".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (8, 8, 25, 25, 60, 90)]
    lines = list(dict.fromkeys(edited(b, n) for n in (0, 6, 5, 4, 3, 3, 2, 2, 1) for b in bases + [bases[0][:26], bases[1][:45]]))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    for bound in (1, 2, 3):
        def near(a, b, bound=bound):
            return distance(a, b) <= min(bound, max(1, max(len(a), len(b)) // 20))

        long = [len(x) >= 20 for x in lines]
        want = [(j,) for j in range(len(lines)) if long[j] and any(long[i] and near(lines[i], lines[j]) for i in range(j))]
        assert ids(line_dedup.dropped_lines(df, bound=bound), "doc_id") == want


def test_short_equal_lines(spark):
    """Equal lines go at any length; short lines with an edit and blank lines stay."""
    texts = ["Read more\n\n \n買う", "Read more\nRead mora\n\n \n買う\n買る", "買う"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bound in (1, 3):
        gone = line_dedup.dropped_lines(df, bound=bound)
        assert ids(gone, "doc_id", "line_no") == [(1, 0), (1, 4), (2, 0)]
    assert [r.text for r in line_dedup.apply_dropped(df, gone).orderBy("doc_id").collect()] == [texts[0], "Read mora\n\n \n買る"]


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs)
    assert ids(got, "doc_id") == ids(docs, "doc_id")
    by = {r.doc_id: r for r in got.collect()}
    assert {by[i].component_id for i in (2, 3, 4)} == {2} and by[2].fingerprint == "0" * 16
    assert by[8].component_id == by[9].component_id == 8 and by[5].component_id == by[6].component_id == 5
    kept = simhash.keep_one(docs, got)
    assert kept.columns == docs.columns
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_long_lists(spark, monkeypatch):
    """A group of near copies that is posted again by half-bytes keeps its links."""
    monkeypatch.setattr(simhash, "LIST_BLOCK", 20)
    import numpy as np

    rng = np.random.default_rng(2)
    fps = {0}
    for _ in range(3):
        for f in sorted(fps)[:60]:
            for _ in range(4):
                fps.add(f ^ sum(1 << int(b) for b in rng.choice(62, 2, replace=False)))
    fps = np.array(sorted(fps), np.int64)
    links = simhash.links(spark.createDataFrame([(int(f),) for f in fps], "fp long").repartition(5))
    parent = {int(f): int(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = 0
    for r in links.collect():
        assert int(r.a ^ r.b).bit_count() <= 4
        parent[root(r.a)] = root(r.b)
        n += 1
    assert len({root(int(f)) for f in fps}) == 1 and n < len(fps) ** 2 / 20


def test_decontamination(spark, docs, none):
    items = with_clash(spark.createDataFrame([(1, LINE), (1, LINE), (2, None), (3, ""), (None, LINE), (4, "word1"), (5, LINE)], "item_id long, text string"))
    got = ids(decontaminate.contaminated(docs, items), "doc_id", "item_id")
    assert (1, 1) in got and (1, 5) in got and (5, 4) in got and len(set(got)) == len(got)
    assert not [p for p in got if p[0] in (2, 3, 4) or p[1] in (2, 3, None)]
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items.filter("item_id > 9")).count() == 0
    assert decontaminate.without_leaks(docs, decontaminate.contaminated(docs, items)).columns == docs.columns


def test_toxicity(spark, docs, none):
    labels = with_clash(spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 1), (None, 1, 1), (8, None, 1), (3, 1, 0)], "doc_id long, quality int, toxic int"))
    models = toxicity.train(docs, labels)
    got = toxicity.score(docs, models)
    assert ids(got, "doc_id") == ids(docs, "doc_id")
    assert got.filter("doc_id in (2, 3, 4) and rejected").count() == 0
    assert toxicity.keep_clean(docs, got).columns == docs.columns
    assert toxicity.score(none, models).count() == 0
    blank = toxicity.score(docs, toxicity.train(none, labels.filter("doc_id > 99")))
    assert blank.count() == len(ROWS) and blank.filter("rejected").count() == 0


def test_suffixes(docs, none):
    got = {r.doc_id: r for r in suffix_dedup.deduplicate(docs).collect()}
    assert suffix_dedup.deduplicate(docs).count() == len(ROWS)
    assert got[2].n_bytes == 0 and got[5].n_removed == 0 and got[6].n_removed > len(LONG) - 60 and got[1].n_removed == 0
    assert suffix_dedup.deduplicate(none).count() == 0


def test_texts_that_share_an_id(spark):
    rows = [(1, "q" * 60), (2, "q" * 60), (2, "other " * 20), (3, "other " * 20), (2, "x" + "q" * 55), (4, "z" * 70), (4, "z" * 70 + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.deduplicate(df).collect())
    assert got == [(1, 60, 0), (2, 56, 55), (2, 60, 60), (2, 120, 0), (3, 120, 120), (4, 70, 0), (4, 71, 0)]
    with pytest.raises(TypeError):
        suffix_dedup.deduplicate(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (100, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = with_clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(3)
    got = ids(ann.search(df, F.col("vec_id") % 100 == 0), "query_id", "rank", "vec_id")
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert ann.search(df.filter("vec_id > 1000"), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_among_copies(spark, monkeypatch):
    """Thousands of equal vectors, several blocks: the smallest ids are found."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 5)
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 1500, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.rand(3) + 9, F.rand(4))).cast("array<float>").alias("embedding"))
    got = ann.search(df, F.col("vec_id") % 100 == 0).filter("query_id = 700").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(10)) and all(r.score == 0 for r in got)


def test_pages(spark, pages, no_pages):
    urls = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert (urls[1].host, urls[1].path, urls[1].rule, urls[1].verdict) == ("a.org", "/x", "org/", "allow")
    assert urls[2].host == urls[3].host == urls[4].host == "" and urls[2].rule is None
    assert (urls[5].rule, urls[5].verdict) == ("example.org/en/1", "block")
    texts = html_extract.extract(pages)
    assert texts.count() == 7 and {r.text for r in texts.filter("page_id = 2").collect()} == {""}
    assert url_filter.judge_urls(no_pages).count() == html_extract.extract(no_pages).count() == 0


def test_archives(pages, no_pages, tmp_path):
    got = warc.round_trip(pages, str(tmp_path / "w"))
    assert ids(got, "page_id") == ids(pages, "page_id")
    by = {r.page_id: r for r in got.collect()}
    assert by[4].record_type == "revisit" and by[4].refers_to == 1 and by[3].refers_to == 2 and by[None].payload_bytes == 10
    assert warc.round_trip(no_pages, str(tmp_path / "none")).count() == 0


def test_url_rules_by_token():
    for url, rule in [("http://es/", None), ("http://xexample.org/es/", "org/"), ("http://a.example.org/es/1", "example.org/es/"), ("http://org", None), ("HTTP://Example.ORG/en/12", "example.org/en/1"), ("http://example.org/en/2", "org/"), ("http://b.com/de/x", "com/de/"), ("http://b.com/d", None)]:
        index = url_filter.RuleIndex(url_filter.RULES, {})
        assert index.judge(*url_filter.split_url(url))[0] == rule, url


def test_stages_judge_each_row_by_its_own_text(spark, folder, monkeypatch):
    """Null ids, and ids that unlike texts share, take no other document along."""
    import corpus_pipeline

    leak = spark.read.parquet(f"{folder}/benchmark.parquet").filter("length(text) > 100").orderBy("item_id").first().text
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma")]
    ids_ = (None, None, None, 7, 7)
    rows = [(i, t, "en", "a", len(t)) for i, t in zip(ids_, [texts[0], texts[1], leak, texts[2], leak], strict=True)]
    df = with_clash(spark.createDataFrame(rows, BASE)).withColumn("_own", F.lit(1))

    kept = corpus_pipeline.drop_leaks(spark, df, folder)
    assert kept.columns == df.columns
    assert ids(kept, "doc_id", "text") == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2])], key=repr)

    monkeypatch.setattr(toxicity, "train", lambda *_: None)
    monkeypatch.setattr(toxicity, "score", lambda d, _: d.select("doc_id", (F.col("text") == leak).alias("rejected")))
    kept = corpus_pipeline.reject_toxic(spark, df, folder)
    assert ids(kept, "doc_id", "text") == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2])], key=repr)

    copies = df.unionByName(df.filter("doc_id is null").withColumn("doc_id", F.lit(9).cast("long")))
    kept = corpus_pipeline.keep_one_of_each(spark, copies, folder)
    assert kept.columns == df.columns
    assert ids(kept, "doc_id", "text") == sorted([(7, leak), (7, texts[2]), (9, texts[0]), (9, texts[1])], key=repr)


def test_pipeline_stages_tell_rows_without_ids_apart(spark, folder):
    import corpus_pipeline

    line = "a first line that two unlike texts share, long enough to be judged"
    rows = [(None, f"{line}\nthe one goes on about this and that"), (None, f"{line}\nquite another text follows here"), (3, line), (3, "unlike but of the same id, and of some length")]
    df = spark.createDataFrame([(i, t, "en", "a", 7, 1.5) for i, t in rows], BASE + ", Size double")
    kept = corpus_pipeline.drop_repeated_lines(spark, df, folder)
    assert kept.columns == df.columns
    # the line stays where it stands first: rows without doc_id come last
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert got == [(0, "quite another text follows here"), (0, "the one goes on about this and that"), (3, line), (3, "unlike but of the same id, and of some length")]
    mixed = corpus_pipeline.mix_sources(spark, df, folder)
    assert mixed.columns == [*df.columns, "_size", "source_size", "target", "rate", "copies", "taken"]
    assert {r.Size for r in mixed.collect()} == {1.5} and mixed.filter("taken <> copies * _size").count() == 0


def test_pipeline_runs_over_odd_tables(spark, folder, tmp_path):
    import shutil

    import corpus_pipeline

    for name in ("labels", "benchmark"):
        shutil.copy(f"{folder}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame(ROWS + [(None, None, None, None, None)] * 2, BASE)
    both = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(odd)
    both.withColumn("target", F.lit("own")).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "target", "size", "source_size", "_target", "rate", "copies", "taken"]
    rows = out.collect()
    assert rows and all(r.target == "own" and r.copies > 0 for r in rows)
