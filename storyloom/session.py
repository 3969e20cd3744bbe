"""Session helpers: settings the jobs rely on, and the shared folder for durable steps."""

from __future__ import annotations

import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Runtime settings every job expects. Timestamps are formatted in UTC, and Arrow
# batches are kept small because one row may be a whole web page.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    # Python functions travel with their code, so executors need no installed package
    cloudpickle.register_pickle_by_value(sys.modules["storyloom"])
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; the cluster names it in the session.

    Only in a session on one machine (unit tests) an unset name falls back to a temporary
    folder; on a cluster that folder would be another one on each executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="storyloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df):
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


SMALL_BYTES = 128 * 1024 * 1024


def spread(df, key: str):
    """Share out a small input before costly work on each row.

    A small table often sits in one row group and would keep one core busy. Its planned
    size decides: below one ordinary split per core it is dealt out by ``key``; a larger
    input already has enough splits and is left alone, so nothing big is ever shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) >= SMALL_BYTES * cores:
        return df
    return df.repartition(cores, key)
