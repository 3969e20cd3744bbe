"""Registry pairing each query with its DuckDB check text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.plans.oracle_views import with_views
from storyloom.session import tune
from storyloom.sources.entities import Entities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.date_format(c, MICROS)
    if isinstance(kind, T.StructType):
        return F.concat_ws(":", *[_text(c[f.name], f.dataType).cast("string") for f in kind.fields])
    return c.cast("string")


def flat(df: DataFrame) -> DataFrame:
    """Nested values and timestamps as text, so two engines can be compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            out.append(F.array_join(F.transform(c, lambda x: _text(x, inner)), "|").alias(f.name))
        elif isinstance(f.dataType, (T.StructType, T.TimestampType)):
            out.append(F.when(c.isNotNull(), _text(c, f.dataType)).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def query(key: str, oracle: str | None = None):
    """Register ``fn(entities) -> DataFrame`` under ``key``."""

    def register(fn: Callable[[Entities], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return flat(fn(Entities(tune(spark), folder)))

        run.__name__ = key
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = with_views(oracle)
        return fn

    return register
