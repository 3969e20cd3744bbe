"""Connected components of a link table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import store

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: every node hands its larger (or smaller) neighbours to its least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
    moved = both.join(least, both["a"] == least["c"])
    if large:
        moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("x"), "a", "m").select(F.explode(F.array("x", "a")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``links(a, b)``; a component is named by its least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): the number of links
    never grows, and a node of any degree is only ever joined with its minimum. Every step
    is written to the shared folder.
    """
    links = store(links.filter("a <> b").distinct(), "links")
    state = None
    for _ in range(MAX_ROUNDS):
        links = store(_star(_star(links, True), False), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
