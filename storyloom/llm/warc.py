"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Writing. Each page becomes one record. Among records with equal payloads the one with the
smallest page_id carries the payload (``response``), the others refer to it (``revisit``).
Spark's text writer ends every row with its separator, which is what ends a WARC record.

Reading. The text reader splits at the magic ``WARC/1.0``, wherever it stands, so a payload
that contains the magic yields false candidates. Every candidate names its successor: its
own offset plus the length that its header declares. Only what the chain reaches from the
start of the file is a record. Chains are shortened in two steps: within one input split,
each candidate's chain is followed to the offset where it leaves the split; over the splits
of a file these exits are combined by pointer jumping, doubling the span with each round.
Text that a record holds beyond its own row (magic inside the payload) is put together from
the rows that follow.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import store

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records per file, so that one file stays near the usual size of an archive.
FILE_RECORDS = 50_000


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight digits from every five bytes."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """One record per row of ``pages(page_id, url, html)``; a null html is an empty payload.

    Rows that repeat both page_id and payload are each written as the response. A null
    page_id comes after all others. Line ends in a URL are percent-encoded; a null URL has
    no header line. With ``compression`` "none" the files can be split among tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    d = pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload.cast("binary")).alias("digest"))
    firsts = d.groupBy("digest").agg(F.min("page_id").alias("first")).withColumnRenamed("digest", "_of")
    d = d.join(firsts, F.col("digest") == F.col("_of"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    own = F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(_HTTP), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.concat(http, F.when(own, F.col("payload")).otherwise(""))
    clean = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(own, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(~own, F.concat(F.lit("WARC-Refers-To: "), name("first"))),
        F.when(~own, F.lit(f"WARC-Profile: {_REVISIT}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(END), block, F.lit("\r\n"))
    d.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path, compression=compression)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, with its place: ``(file, block, seq, value)``."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value"
    )


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def _facts(segments: DataFrame) -> DataFrame:
    """Per segment: its length, what its header says, and its payload's digest if it is whole."""
    data = F.col("value").cast("binary")
    head = F.substring_index("value", END, 1)
    s = segments.withColumn("len", F.octet_length("value").cast("long")).withColumn("_head", F.when(F.instr("value", END) > 0, head))
    size = _field(F.col("_head"), "Content-Length")
    s = s.withColumn("_size", F.when(size.rlike("^[0-9]{1,15}$"), size).cast("long"))
    s = s.withColumn("_skip", F.octet_length("_head").cast("long") + len(END))
    s = s.withColumn("span", F.col("_skip") + F.col("_size") + len(END))
    block = F.substring(data, (F.col("_skip") + 1).cast("int"), F.col("_size").cast("int"))
    whole = F.col("span") == F.col("len")
    s = s.withColumn("_block", F.when(whole, block))
    return s.select(
        "file", "block", "seq", "len", "span", "_skip", "_size",
        _field(F.col("_head"), "WARC-Type").alias("type"),
        _field(F.col("_head"), "WARC-Record-ID").alias("id"),
        _field(F.col("_head"), "WARC-Refers-To").alias("refers"),
        _field(F.col("_head"), "WARC-Payload-Digest").alias("declared"),
        *_payload(F.col("_block")),
    )


def _payload(block: Column) -> list[Column]:
    """Of an HTTP response block: the declared length, the payload's length and digest."""
    text = block.cast("string")
    http = F.substring_index(text, END, 1)
    start = F.octet_length(http) + len(END)
    body = F.substring(block, (start + 1).cast("int"), F.octet_length(block))
    told = F.regexp_extract(http, r"(?im)^Content-Length:[ \t]*([0-9]+)", 1)
    return [
        F.when(told != "", told).cast("long").alias("told"),
        F.greatest(F.octet_length(block) - start, F.lit(0)).cast("long").alias("bytes"),
        base32_sha1(body).alias("digest"),
    ]


def _placed(facts: DataFrame) -> DataFrame:
    """Adds ``at``, the offset of the magic before a segment, and ``next``, its successor's."""
    step = F.col("len") + len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = facts.groupBy("file", "block").agg(F.sum(step).alias("_all"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select(F.col("file").alias("_f"), F.col("block").alias("_b"), (F.sum("_all").over(before) - F.col("_all")).alias("_from"))
    rows = facts.withColumn("_upto", F.sum(step).over(inside))
    rows = rows.join(blocks, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    rows = rows.withColumn("at", F.col("_from") + F.col("_upto") - F.col("len") - 2 * len(MAGIC))
    return rows.withColumn("next", F.col("at") + len(MAGIC) + F.col("span")).drop("_f", "_b", "_from", "_upto")


def _exits(g: pd.DataFrame) -> pd.DataFrame:
    """Where the chain of each candidate of one split leaves it; successors lie behind, so one pass from the end will do."""
    g = g.sort_values("at")
    out: dict[int, int] = {}
    for at, nxt in zip(g["at"].tolist()[::-1], g["next"].tolist()[::-1], strict=True):
        out[at] = out.get(nxt, nxt)
    return pd.DataFrame({"file": g["file"].iloc[0], "at": list(out), "exit": list(out.values())})


def _follow(g: pd.DataFrame) -> pd.DataFrame:
    """The records of one split: the chain from where it enters, at most once."""
    g = g.sort_values("at")
    entry, hits = g["entry"].iloc[0], []
    for at, nxt in zip(g["at"].tolist(), g["next"].tolist(), strict=True):
        if at == entry:
            hits.append(at)
            entry = nxt
    return pd.DataFrame({"file": g["file"].iloc[0], "block": g["block"].iloc[0], "at": hits})


def _chain(candidates: DataFrame) -> DataFrame:
    """``(file, block, at)`` of the candidates ``(file, block, at, next)`` that a file's start reaches."""
    jumps = store(candidates.groupBy("file", "block").applyInPandas(lambda g: _exits(g), "file string, at long, exit long"), "warc-jumps")
    reached = jumps.filter("at = 0").select("file", "at")
    splits = candidates.select("file", "block").distinct().groupBy("file").count().agg(F.max("count")).first()[0] or 0
    span, step = 1, jumps
    while span < splits:
        onward = reached.join(step, ["file", "at"]).select("file", F.col("exit").alias("at"))
        reached = store(reached.unionByName(onward).distinct(), "warc-reached")
        hop = step.select("file", F.col("at").alias("exit"), F.col("exit").alias("_to"))
        step = store(step.join(hop, ["file", "exit"], "left").select("file", "at", F.coalesce("_to", "exit").alias("exit")), "warc-jumps")
        span *= 2
    entries = candidates.join(reached, ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"))
    return candidates.join(entries, ["file", "block"]).groupBy("file", "block").applyInPandas(lambda g: _follow(g), "file string, block long, at long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, record_type, refers_to, payload_bytes, payload_digest, declared_digest)`` per record.

    A revisit has the length and digest of the payload it refers to, as its record states them.
    An empty folder gives no rows.
    """
    # lengths, header fields and digests in one pass; the text itself is not kept
    rows = store(_placed(_facts(_segments(spark, path))), "warc-segments")
    links = rows.filter(F.col("next").isNotNull() & (F.col("at") >= 0)).select("file", "block", "at", "next")
    real = store(_chain(links), "warc-records")
    found = rows.join(real, ["file", "block", "at"])
    broken = found.filter("span <> len").select("file", "at", "next", "_skip", "_size")
    whole = found.filter("span = len")
    facts = ["type", "id", "refers", "declared", "told", "bytes", "digest"]
    out = whole.select(*facts)
    if broken.take(1):
        out = out.unionByName(_rejoined(spark, path, rows, broken, facts))
    number = lambda c: F.regexp_extract(F.col(c), "^<urn:page:(.*)>$", 1)
    again = F.col("type") == "revisit"
    bare = F.regexp_replace("declared", "^sha1:", "")
    return out.select(
        number("id").alias("record_id"), F.col("type").alias("record_type"), number("refers").alias("refers_to"),
        F.when(again, F.col("told")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(again, bare).otherwise(F.col("digest")).alias("payload_digest"), bare.alias("declared_digest"),
    )


def _rejoined(spark: SparkSession, path: str, rows: DataFrame, broken: DataFrame, facts: list[str]) -> DataFrame:
    """Records whose text goes on behind a magic: their segments, in order, put together."""
    parts = rows.select("file", "block", "seq", F.col("at").alias("_at"))
    owner = broken.select(F.col("file").alias("_f"), "at", "next", "_skip", "_size")
    # spans of one file do not overlap: the owner is the last broken record that starts at or before the segment
    marks = owner.select(F.col("_f").alias("file"), F.col("at").alias("_at"), F.struct("at", "next", "_skip", "_size").alias("own"))
    last = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = parts.join(marks, ["file", "_at"], "left").withColumn("own", F.last("own", ignorenulls=True).over(last))
    held = held.filter("own is not null and _at < own.next").select("file", "block", "seq", "_at", "own")
    # read again: sequence numbers agree, since the same files are split the same way
    placed = _placed(_segments(spark, path).withColumn("len", F.octet_length("value").cast("long")).withColumn("span", F.lit(0).cast("long")))
    text = placed.select("file", F.col("at").alias("_at"), "value").join(held.select("file", "_at", "own"), ["file", "_at"])
    text = text.groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("_parts"))
    full = F.array_join(F.transform("_parts", lambda p: p["value"]), MAGIC)
    data = F.substring(full.cast("binary"), (F.col("own._skip") + 1).cast("int"), F.col("own._size").cast("int"))
    names = ["type", "id", "refers", "declared"]
    known = rows.select("file", F.col("at").alias("_o"), *names)
    text = text.select("file", F.col("own.at").alias("_o"), data.alias("_block")).join(known, ["file", "_o"])
    return text.select(*names, *_payload(F.col("_block"))).select(*facts)


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes ``pages`` to ``path`` and reads them back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``."""
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    back = read_archives(pages.sparkSession, path)
    page = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
