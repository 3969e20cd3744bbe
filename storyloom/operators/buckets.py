"""Tables kept in buckets of a key: a merge reads and rewrites only the buckets its rows fall into.

A bucketed table is a Parquet folder partitioned by ``bucket``, a hash of the key. Marks of finished work are kept in
a table that is clustered by key and partitioned by day: joins with it need no shuffle on its side, and
days beyond the retention period are neither read nor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.ingest import SEEN_DAYS
from storyloom.session import durable

BUCKETS = 64


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, key: Column, buckets: int = BUCKETS) -> None:
    """Store ``rows`` by bucket of ``key``; a row's key never changes."""
    rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def merge_into(
    path: str, incoming: DataFrame, key: Column, incoming_key: Column, fold: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS
) -> list[int]:
    """Replace the touched buckets by ``fold(their rows, incoming)``; returns their numbers.

    ``key`` names a row of the table, ``incoming_key`` gives an arriving row the same name. Rows that ``fold``
    returns must lie in the touched buckets. The other buckets' files are neither read nor written.
    """
    spark = incoming.sparkSession
    arriving = durable(incoming)
    touched = sorted(r.b for r in arriving.select(_bucket(incoming_key, buckets).alias("b")).distinct().collect())  # at most ``buckets``
    if not touched:
        return touched
    target = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
    # written before the buckets it is made of are replaced
    out = durable(fold(target, arriving).withColumn("bucket", _bucket(key, buckets)))
    if not out.where(~F.col("bucket").isin(touched)).isEmpty():
        raise ValueError("a merged row left the buckets of the arriving keys")
    out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


# -- marks ---------------------------------------------------------------------


def create_marks(spark: SparkSession, table: str, keys: dict[str, str], buckets: int = BUCKETS, path: str | None = None) -> None:
    """A table of marks, in the warehouse or under ``path``: key columns with their types, ``done_at`` and its ``day``."""
    columns = ", ".join(f"{k} {t}" for k, t in keys.items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, done_at timestamp, day date) USING parquet PARTITIONED BY (day) CLUSTERED BY ({', '.join(keys)}) INTO {buckets} BUCKETS" + (f" LOCATION '{path}'" if path else ""))


def add_marks(table: str, marks: DataFrame) -> None:
    """Append ``marks`` (key columns and ``done_at``) to the days they fall on."""
    spark = marks.sparkSession
    rows = marks.withColumn("day", F.to_date("done_at"))
    rows.select(*spark.table(table).columns).write.insertInto(table)


def live_marks(spark: SparkSession, table: str, as_of: Column, days: int = SEEN_DAYS) -> DataFrame:
    """Marks that count at ``as_of``; only the days of the retention period are read."""
    since = as_of - F.make_dt_interval(F.lit(days))
    rows = spark.table(table)
    return rows.where((F.col("day") >= F.to_date(since)) & (F.col("day") <= F.to_date(as_of)) & (F.col("done_at") > since) & (F.col("done_at") <= as_of))


def without_marks(jobs: DataFrame, table: str, keys: list[str], as_of: Column, days: int = SEEN_DAYS) -> DataFrame:
    """Jobs whose key has no live mark; only the jobs are shuffled, to where the marks lie."""
    live = live_marks(jobs.sparkSession, table, as_of, days)
    return jobs.join(live.select(*keys).hint("merge"), keys, "left_anti")


def drop_expired(spark: SparkSession, table: str, before) -> int:
    """Drop the days before the date ``before``; returns how many went."""
    days = [r[0].split("=")[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]  # one line for each kept day
    old = [d for d in days if d < str(before)]
    for d in old:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (day = DATE '{d}')")
    return len(old)
