"""Structured Streaming forms of the stages, with replay-safe writes.

Multi-table micro-batches are committed as one Parquet write under the batch id and one rename, so a
batch is there as a whole or not at all, and a replayed batch is recognised and skipped.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from storyloom.functions import urls as U
from storyloom.operators import ingest, stages
from storyloom.session import durable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEEN = f"{ingest.SEEN_DAYS} days"
TTL_MS = ingest.SEEN_DAYS * 24 * 3600 * 1000


# -- commits -------------------------------------------------------------------


def _folder(spark: SparkSession, path: str):
    """A path and the file system that holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit_batch(frames: dict[str, DataFrame], root: str, batch_id: int) -> bool:
    """Write several tables in one commit; False when the batch was there already.

    The batch is written beside the table, in a folder that Spark does not read, and becomes part of it by
    one rename. Who reads or follows the table meets whole batches only, and a replay never touches one.
    The store has to rename folders as a whole, as HDFS and local disks do.
    """
    spark = next(iter(frames.values())).sparkSession
    at, store = _folder(spark, f"{root}/batch={batch_id}")
    if store.exists(at):
        return False
    out = None
    for name, df in frames.items():
        columns = [
            (F.struct(*[F.col(c) for c in df.columns]) if other == name else F.lit(None).cast(frames[other].schema)).alias(other)
            for other in frames
        ]
        part = df.select(F.lit(name).alias("kind"), *columns)
        out = part if out is None else out.unionByName(part)
    beside = f"{root}/_writing/batch={batch_id}"
    out.write.mode("overwrite").partitionBy("kind").parquet(beside)
    if not store.rename(_folder(spark, beside)[0], at):
        raise OSError(f"batch {batch_id} was written but could not be moved into {root}")
    return True


def _any(spark: SparkSession, root: str) -> bool:
    at, store = _folder(spark, root)
    return store.exists(at) and any(f.getPath().getName().startswith("batch=") for f in store.listStatus(at))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of all committed batches, with the batch it came in."""
    return spark.read.parquet(root).where(F.col("kind") == name).select("batch", f"{name}.*")


def follow_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The same table as a stream, for the next stage: each committed batch once."""
    rows = spark.readStream.schema(spark.read.parquet(root).schema).parquet(root)
    return rows.where(F.col("kind") == name).select(f"{name}.*")


def run_stage(
    stream: DataFrame, stage: Callable[[DataFrame], dict[str, DataFrame]], root: str, checkpoint: str
) -> StreamingQuery:
    """Drain what is there through ``stage`` and stop; every table of a micro-batch
    appears in one commit."""

    def write(batch: DataFrame, batch_id: int) -> None:
        commit_batch(stage(batch), root, batch_id)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# -- sources -------------------------------------------------------------------


def item_stream(spark: SparkSession, path: str) -> DataFrame:
    """Landed item JSON lines as a stream with event time ``ts``."""
    landed = spark.readStream.schema("seq long, value string").parquet(path)
    items = ingest.parse_items(landed)
    return items.withColumn("ts", F.timestamp_seconds("time"))


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """Landed job text, one job per line, as ``value``."""
    return spark.readStream.text(path)


# -- stateful operators --------------------------------------------------------


def unmarked(batch: DataFrame, marks: DataFrame | None, keys: list[str], now: Column, order: str) -> DataFrame:
    """The newest row of each key that carries no live mark.

    Rows of a key are combined on the map side before they meet, and marks are unique per
    key and batch, so a key in a third of all rows costs one row per task.
    """
    rest = [c for c in batch.columns if c not in keys]
    newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
    if marks is None:
        return newest.select(*batch.columns)
    return ingest.not_done(newest, marks, keys, now).select(*batch.columns)


def marking(
    stage: Callable[[DataFrame], dict[str, DataFrame]], root: str, keys: list[str], now: Callable[[], Column], order: str
) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """A stage that sees each key once per retention period.

    The marks are a table of the same commit as the stage's output: a key counts as done
    exactly when what was made of it is there, so failed batches are tried again.
    """

    def run(batch: DataFrame) -> dict[str, DataFrame]:
        spark = batch.sparkSession
        marks = read_table(spark, root, "mark") if _any(spark, root) else None
        at = now()
        fresh = unmarked(batch, marks, keys, at, order)
        return {**stage(fresh), "mark": fresh.select(*keys, at.alias("done_at"))}

    return run


def _one_per_batch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Repeats of a key inside an Arrow batch go before the shuffle: a key in a third of all rows sends a row per batch."""

    def combine(batches):
        for pdf in batches:
            yield pdf.drop_duplicates(keys)

    return rows.mapInPandas(combine, rows.schema)


def first_seen_in_event_time(items: DataFrame, as_of_cutoff: Column) -> DataFrame:
    """Good items, each id once per retention period of event time ``ts``.

    The quality rule comes first: a rejected item leaves no mark and is judged again.
    """
    good = items.where(ingest.is_good(as_of_cutoff))
    return _one_per_batch(good, ["id"]).withWatermark("ts", SEEN).dropDuplicatesWithinWatermark(["id"])


def publish_once(jobs: DataFrame, at: str | None = None, within: str = SEEN) -> DataFrame:
    """Jobs with a new key, and all jobs without one.

    With the event time column ``at`` a key is remembered for ``within``, so state has an end; without it, for good.
    """
    keyed = _one_per_batch(jobs.where("job_key is not null"), ["job_key"])
    if at is None:
        keyed = keyed.dropDuplicates(["job_key"])
    else:
        keyed = keyed.withWatermark(at, within).dropDuplicatesWithinWatermark(["job_key"])
    return keyed.unionByName(jobs.where("job_key is null"))


class SetIfAbsent(StatefulProcessor):
    """Lets the first row of a key through and marks the key for the retention period of
    processing time. Only a flag is kept per key, whatever number of rows it has."""

    def init(self, handle) -> None:
        self.mark = handle.getValueState("mark", "done boolean", TTL_MS)

    def handleInputRows(self, key, rows, timer_values):
        first = None
        for pdf in rows:
            if first is None and len(pdf):
                first = pdf.head(1)
        if first is not None and not self.mark.exists():
            self.mark.update((True,))
            yield first
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def mark_first(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotency by (story) or (article, model): a marked key is not processed again
    until its mark expires. Needs the RocksDB state store and a query that keeps running:
    expiry by processing time never lets an availableNow drain end; use ``marking`` there.

    All rows of a micro-batch share one processing time, so one of them per Arrow batch is enough.
    """
    return _one_per_batch(jobs, keys).groupBy(*keys).transformWithStateInPandas(
        SetIfAbsent(), outputStructType=jobs.schema, outputMode="Append", timeMode="ProcessingTime"
    )


def daily_counters(metrics: DataFrame) -> DataFrame:
    """Running sums per UTC day, kind and name; emit in update or complete mode."""
    return (
        metrics.withWatermark("at", "1 day")
        .groupBy(F.window("at", "1 day").alias("w"), "kind", "name")
        .agg(F.sum("value").alias("value"))
        .select(F.to_date("w.start").alias("day"), "kind", "name", "value")
    )


# -- routes --------------------------------------------------------------------


class HoldUntilVisible(StatefulProcessor):
    """Holds each retry job until its ``visible_at`` and lets it through once.

    A job is kept under its own key (trace and attempt), so state is one row per waiting job and no key
    is shared by many. A timer at ``visible_at`` releases it when event time has come that far.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "visible_at long, value string")

    def handleInputRows(self, key, rows, timer_values):
        due = None
        for pdf in rows:
            for value, at in zip(pdf["value"], pdf["visible_at"], strict=True):
                due = (int(at), value) if due is None else max(due, (int(at), value))
        # a job that arrives again while it waits, or after it was let through, is the same job
        if due is not None and not self.held.exists():
            self.held.update(due)
            if due[0] > timer_values.getCurrentWatermarkInMs():
                self.handle.registerTimer(due[0])
            else:
                yield self._out(key, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # named as Spark passes them
        due = self.held.get()
        yield self._out(key, (due[0], due[1]))

    @staticmethod
    def _out(key, due) -> pd.DataFrame:
        return pd.DataFrame({"trace_id": [key[0]], "attempt": pd.array([key[1]], "Int32"), "visible_at": [due[0]], "value": [due[1]]})

    def close(self) -> None:
        pass


def delayed(jobs: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A stream of retry jobs (``trace_id, attempt, visible_at, value``, event time ``at``) in which each comes out when it is due.

    Due is what event time has passed, so any later arrival drives the clock. Needs the RocksDB state store.
    """
    rows = jobs.withWatermark("at", late).select("trace_id", F.coalesce("attempt", F.lit(0)).cast("int").alias("attempt"), F.coalesce("visible_at", F.lit(0)).cast("long").alias("visible_at"), "value", "at")
    return rows.groupBy("trace_id", "attempt").transformWithStateInPandas(
        HoldUntilVisible(), outputStructType="trace_id string, attempt int, visible_at long, value string", outputMode="Append", timeMode="EventTime"
    )


def jobs_with_bodies(jobs: DataFrame, bodies: DataFrame, wait: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Scrape jobs joined with the bodies that land for them, as streams: a job without a body within ``wait`` comes out with none.

    ``jobs``: value, trace_id, url, ``asked_at``; ``bodies``: url, status, content_type, html, ``landed_at``. A body that
    landed up to ``wait`` before or after the job counts. Both sides leave the state once event time is past that window.
    """
    j = jobs.withColumn("url", U.canonical_url(F.col("url"))).withWatermark("asked_at", late)
    b = bodies.select(U.canonical_url(F.col("url")).alias("_url"), "status", "content_type", "html", "landed_at").withWatermark("landed_at", late)
    near = F.expr(f"landed_at >= asked_at - interval {wait} and landed_at <= asked_at + interval {wait}")
    return j.join(b, (F.col("url") == F.col("_url")) & near, "left").drop("_url")


def scrape_joined(batch: DataFrame, language: Column, now_ms: Column) -> dict[str, DataFrame]:
    """The scrape stage for a micro-batch of ``jobs_with_bodies``: jobs that met no body are tried again later."""
    batch = durable(batch)
    # a job that met several bodies is one job; the stage chooses among the bodies of a page
    jobs = batch.groupBy("trace_id").agg(F.any_value("value").alias("value"))
    bodies = batch.where("landed_at is not null").select("url", "status", "content_type", "html").distinct()
    return stages.scrape_stage(jobs.select("value"), bodies, language, now_ms)


def requeue(batch: DataFrame, now_ms: Column) -> dict[str, DataFrame]:
    """Retry jobs due now, and the ones to put back until their time comes: the batch form of ``delayed``."""
    due = F.col("visible_at").isNull() | (F.col("visible_at") <= now_ms)
    return {"due": batch.where(due), "waiting": batch.where(~due)}


def decode_stage(batch: DataFrame) -> dict[str, DataFrame]:
    """Job text to good jobs and dead letters: nothing that arrived is lost."""
    decoded = ingest.decode_jobs(batch)
    return {
        "job": decoded.where("reason is null").select("value"),
        "dead": decoded.where("reason is not null").select("reason", "value"),
    }


def scrape_stage(bodies: DataFrame, language: Column, now_ms: Column) -> Callable[[DataFrame], dict[str, DataFrame]]:
    return lambda batch: stages.scrape_stage(batch, bodies, language, now_ms)


# -- merge on read -------------------------------------------------------------


def current_stories(log: DataFrame) -> DataFrame:
    """State of the append-only story log: the upsert rules as one aggregate, so a
    micro-batch appends its rows and never rewrites the table."""
    def known(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)

    latest = F.max_by(F.struct("source", "title", "url", "domain", "author"), "seq").alias("l")
    return log.groupBy("id", "hn_id").agg(latest, known("points"), known("comments_count"), F.min("created_at").alias("created_at")).select(
        "id", "hn_id", "l.*", "points", "comments_count", "created_at"
    )

