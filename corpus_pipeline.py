"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet to the shared
folder and read again as the next stage's documents. All but the last return the columns of ``docs``.

In every stage each row is a document of its own: rows without doc_id, and unlike texts that share one, are told
apart by their text, and rows that repeat a doc_id and its text have one fate. Null and empty texts, and texts of
any length, are read as they are; other columns, whatever their names, are carried along. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from storyloom.llm.common import by_row, ready, store, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go. Null and empty texts are scored like any other; they have no feature and stay."""
    models = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return by_row(docs, lambda d: toxicity.score(d, models), toxicity.keep_clean)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to an earlier line go; rows without doc_id come last. Texts without lines stay, texts that lose all their lines go."""
    ready(spark)
    judge = lambda d: line_dedup.dropped_lines(d, bound=line_dedup.EDIT_BOUND)
    return by_row(docs, judge, line_dedup.apply_dropped, ordered=True, short=True)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays, rows without one last; texts without words are one group."""
    ready(spark)
    return by_row(docs, simhash.near_duplicates, simhash.keep_one, ordered=True)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; null and empty texts hold none."""
    items = table(spark, sf_dir, "benchmark")
    return by_row(docs, lambda d: decontaminate.contaminated(d, items), decontaminate.without_leaks)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with their copies and the other decisions as further columns; texts without words stay once."""
    ready(spark)
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The chain's models are learned, so SQL cannot express the rows; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: what the stages leave of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
