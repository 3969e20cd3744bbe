"""Run metrics: daily sums, newest run, retention; redaction of log rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RETENTION_DAYS = 8
# Keys whose values never leave the log.
SECRET_KEYS = frozenset(
    ["api_key", "authorization", "password", "secret", "token", "access_token", "refresh_token"]
)


def daily(metrics: DataFrame) -> DataFrame:
    """Sum per UTC day, kind and name; counters are whole numbers."""
    total = F.sum("value")
    sums = metrics.groupBy(F.to_date("at").alias("day"), "kind", "name").agg(total.alias("total"))
    return sums.select("day", "kind", "name", F.when(F.col("kind") == "counter", F.round("total")).otherwise(F.col("total")).alias("value"))


def last_run(metrics: DataFrame) -> DataFrame:
    """All rows of the newest run."""
    newest = metrics.agg(F.max_by("run_id", F.struct("at", "run_id"))).scalar()
    return metrics.where(F.col("run_id") == newest)


def retained(daily_sums: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return daily_sums.where(F.col("day") >= F.date_sub(as_of.cast("date"), days))


def scrub(value):
    """A JSON value with the values of secret keys replaced, at any depth."""
    if isinstance(value, dict):
        return {k: "[REDACTED]" if k.lower() in SECRET_KEYS else scrub(v) for k, v in value.items()}
    if isinstance(value, list):
        return [scrub(v) for v in value]
    return value


@F.pandas_udf(StringType())
def redact_json(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Scrub JSON text in Arrow batches; text that is no JSON is passed on."""
    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(scrub(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return text
        except RecursionError:
            return '"[REDACTED]"'  # nested beyond what can be read: nothing of it is shown

    for batch in rows:
        yield batch.map(one)
