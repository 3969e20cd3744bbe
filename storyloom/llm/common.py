"""Helpers shared by the corpus operators: tables, the shared folder, word rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.session import shared_dir, tune

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators rely on."""
    tune(spark)
    # one row may be a whole book: bound what one Arrow batch holds
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def by_doc(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join on doc_id, where null equals null; only the left doc_id stays.

    What is joined grows with the corpus, so the join is by sort and merge at every size.
    """
    (name,) = free(docs, "_of")
    other = other.withColumnRenamed("doc_id", name).hint("merge")
    joined = docs.join(other, F.col("doc_id").eqNullSafe(F.col(name)), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(name)


def by_row(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame, DataFrame], DataFrame], ordered: bool = False, short: bool = False) -> DataFrame:
    """``keep(docs, judge(docs))`` with a row's own id and text as its doc_id meanwhile.

    Rows with a null doc_id, and unlike texts that share one, are documents of their own. The
    key is a string, or with ``ordered`` a struct that sorts as doc_id does, nulls last. A ``short`` key has a
    64-bit hash of the text in it, for judges that shuffle a key with every line.
    """
    (own,) = free(docs, "_own")
    digest = F.xxhash64(text_of()) if short else F.md5(text_of())
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), digest.cast("string"))
    if ordered:
        key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), digest.alias("digest"))
    rows = docs.withColumn(own, F.col("doc_id")).withColumn("doc_id", key)
    return keep(rows, judge(rows)).withColumn("doc_id", F.col(own)).select(*docs.columns)
