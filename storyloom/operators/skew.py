"""Joins and de-duplication that survive one key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 100  # keys beyond these hold less than a hundredth of the rows each
HOT_ROWS = 100_000  # rows of one key that one task takes


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> Column:
    """Scalar map of at most HOT_KEYS heavy keys to the tasks each is spread over.

    The sketch is one mergeable buffer per task, so finding the heavy keys costs a
    narrow scan and no shuffle of the keys. Salting never changes a join's result,
    so an approximate answer is enough.
    """
    sketch = df.agg(F.expr(f"approx_top_k({key}, {HOT_KEYS}, 10000)").alias("top"))
    heavy = F.expr(
        f"map_from_entries(transform(filter(top, x -> x.count >= {min_rows} and x.item is not null), "
        f"x -> struct(x.item, cast(ceil(x.count / {max(1, min_rows)}) + 1 as int))))"
    )
    return sketch.select(heavy.alias("heavy")).scalar()


def hot_from_counts(counts: DataFrame, key: str, n: str = "n", min_rows: int = HOT_ROWS) -> Column:
    """The same map from a frame that already counts rows per key."""
    top = counts.where((F.col(n) >= min_rows) & F.col(key).isNotNull()).orderBy(F.col(n).desc()).limit(HOT_KEYS)
    tasks = (F.ceil(F.col(n) / max(1, min_rows)) + 1).cast("int")
    return top.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), tasks))).alias("heavy")).scalar()


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    spread: str = "id",
    min_rows: int = HOT_ROWS,
    heavy: Column | None = None,
) -> DataFrame:
    """Join ``left`` (any skew on ``key``) with ``right`` (one row per ``key``).

    ``heavy`` is the map of heavy keys when the caller already has it; otherwise it is
    sketched from ``left``.

    Rows of a heavy key are spread over as many tasks as it has multiples of ``min_rows``,
    by a hash of ``spread``, and only the heavy keys of ``right`` are repeated. This is for
    plans whose next step needs the rows of a key together, where the adaptive skew join
    does not split them. Null keys never match, so they are
    spread as well instead of meeting in one task.
    """
    if heavy is None:
        heavy = hot_keys(left, key, min_rows)
    tasks = F.coalesce(F.try_element_at(heavy, F.col(key)), F.lit(1))
    bucket = F.pmod(F.xxhash64(F.col(spread)), F.when(F.col(key).isNull(), 1 << 20).otherwise(tasks)).cast("int")
    salted_left = left.withColumn("_salt", bucket)
    copies = F.sequence(F.lit(0), tasks - 1)
    salted_right = right.withColumn("_salt", F.explode(copies))
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def newest(df: DataFrame, key: str, order: list[Column], keep: list[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order`` struct.

    ``max_by`` combines on the map side, so a heavy key sends one row per task.
    """
    best = F.max_by(F.struct(*keep), F.struct(*order)).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in keep])
