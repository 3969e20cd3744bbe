"""Charset detection learned from samples: byte pairs counted by Spark, one naive Bayes score per charset."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Charsets in use for Western European, Cyrillic and Greek pages, as Python names them.
CHARSETS = ["cp1252", "cp850", "mac_roman", "utf-16-le", "utf-16-be", "cp1251", "koi8_r", "cp1253"]
PAIRS = 1 << 17
#: Bytes of a body that are scored; a body of any length is decoded whole.
SCORED = 1 << 16


def pairs_of(body: bytes) -> np.ndarray:
    """Adjacent byte pairs of a body of which one is beyond ASCII or null, as numbers; pairs of plain ASCII say nothing.

    Pairs at even and odd places differ, which tells the two byte orders of UTF-16 apart.
    """
    b = np.frombuffer(body, np.uint8).astype(np.int64)
    if len(b) < 2:
        return np.zeros(0, np.int64)
    odd = (b >= 128) | (b == 0)
    place = np.arange(len(b) - 1) % 2
    return (place * 65536 + b[:-1] * 256 + b[1:])[odd[:-1] | odd[1:]]


@dataclass
class CharsetModel:
    """``weights``: log probabilities, charsets x byte pairs: 1 MiB a charset, whatever the samples."""

    names: list[str]
    weights: np.ndarray

    def ranked(self, body: bytes) -> list[str]:
        """Charsets by falling score; only those whose samples had a like pair at all lead."""
        found = pairs_of(body[:SCORED])
        scores = self.weights[:, found].sum(1) if len(found) else np.zeros(len(self.names))
        return [self.names[i] for i in np.argsort(-scores, kind="stable")]


def encoded(texts: DataFrame, charsets: list[str]) -> DataFrame:
    """``charset, body``: every text in every charset that has all its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, bodies = [], []
            for text in b.column(0).to_pylist():
                for c in charsets:
                    try:
                        bodies.append((text or "").encode(c))
                    except UnicodeEncodeError:
                        continue
                    names.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["charset", "body"])

    return texts.select("text").mapInArrow(run, "charset string, body binary")


def train_charsets(samples: DataFrame) -> CharsetModel:
    """Model of labelled ``samples`` (``charset, body``): pairs are counted in the tasks and added up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total = held.setdefault(name, np.zeros(PAIRS, np.int64))
                np.add.at(total, pairs_of(body or b""), 1)
        for name, total in held.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["charset", "pair", "n"])

    counts = samples.select("charset", "body").mapInArrow(count, "charset string, pair int, n long").groupBy("charset", "pair").agg(F.sum("n").alias("n"))
    rows = counts.collect()  # at most PAIRS for each charset
    names = sorted({r.charset for r in rows})
    n = np.ones((len(names), PAIRS))
    for r in rows:
        n[names.index(r.charset), r.pair] += r.n
    return CharsetModel(names, np.log(n / n.sum(1, keepdims=True)))


def decode_learned(body: Column, model: CharsetModel) -> Column:
    """Text of a body that names no charset: valid UTF-8 as such, else by the best-scored charset that reads it strictly."""
    context_model = model

    @F.pandas_udf(StringType())
    def guess(bodies: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            b = bytes(b)
            for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
                if b.startswith(mark):
                    return b.decode(name, errors="ignore")
            for name in context_model.ranked(b):
                try:
                    return b.decode(name)
                except UnicodeDecodeError:
                    continue
            return b.decode("utf-8", errors="ignore")

        return pd.Series([one(b) for b in bodies], dtype=object)

    text = body.cast("string")
    # UTF-16 of plain ASCII is valid UTF-8 full of null characters
    valid = F.is_valid_utf8(text) & ~F.contains(text, F.lit("\x00"))
    return F.when(valid, F.regexp_replace(text, "^\\uFEFF", "")).otherwise(guess(F.when(~valid, body)))
