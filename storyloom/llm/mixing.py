"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Among all non-negative document rates that meet each source's token target, the operator
takes those of least relative entropy to "every document once". Their dual has one
multiplier per source and the rates are exponential tilts of the document's own tokens,
``rate = min(cap, exp(lambda * size / mean_size))``. Newton iterations find the multipliers.
All sums run over the histogram (source, size, documents), which is exact, because the rate
depends on nothing else, and keeps a source with a third of all rows small.

Rates become whole copies by systematic rounding along falling size within a source, and
what is left of the target is filled with whole documents that fit into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import free, store, text_of, word_count

MAX_NEWTON = 60
TOLERANCE = 1e-9
#: documents of one (source, size) cell that one task ranks together
CELL_BLOCK = 10_000
FILL_ROUNDS = 3

_KEY = "_mix_source"


def targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(_mix_source, source_size, target)``: shares by weight, stopped at ``cap`` times the size.

    Sources in code-point order, null last, take the weights in turn. The level ``theta``
    with ``target = min(cap * size, weight * theta)`` is where resharing the excess ends.
    """
    ordered = Window.orderBy(F.col(_KEY).isNull(), _KEY)
    n = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), n + 1)
    all_rows = Window.partitionBy(F.lit(1))
    rising = all_rows.orderBy("_full_at", F.col(_KEY).isNull(), _KEY)
    up_to = rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = sizes.withColumn("_w", weight).withColumn("_limit", cap * F.col("source_size"))
    q = q.withColumn("_full_at", F.col("_limit") / F.col("_w"))
    q = q.withColumn("_goal", total * F.sum("source_size").over(all_rows)).withColumn("_sum_w", F.sum("_w").over(all_rows))
    # the level if the sources before this one are full
    full = F.coalesce(F.sum("_limit").over(up_to), F.lit(0.0)) - F.col("_limit")
    open_w = F.col("_sum_w") - F.sum("_w").over(up_to) + F.col("_w")
    q = q.withColumn("_level", F.greatest(F.try_divide(F.col("_goal") - full, open_w), F.lit(0.0)))
    q = q.withColumn("_theta", F.max(F.when(F.col("_level") <= F.col("_full_at"), F.col("_level"))).over(all_rows))
    target = F.least(F.col("_limit"), F.coalesce(F.col("_w") * F.col("_theta"), F.col("_limit")))
    return q.select(_KEY, "source_size", target.alias("target"))


def _join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the source, where null equals null."""
    right = right.withColumnRenamed(_KEY, "_other")
    return left.join(right, F.col(_KEY).eqNullSafe(F.col("_other")), how).drop("_other")


def solve(cells: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """The multiplier of each source: ``(_mix_source, source_size, target, mean, lam)``.

    A target at the cap has its multiplier at infinity; such a source is marked by null.
    Newton steps that leave the bracket known so far are replaced by its middle.
    """
    floor = cells.filter("size > 0").groupBy(_KEY).agg(F.min("size").alias("_least"), F.sum("docs").alias("_n"))
    x0 = F.try_divide(F.col("_least"), F.col("mean"))
    s = _join(goals, floor, "left")
    s = s.withColumn("mean", F.try_divide(F.col("source_size"), F.col("_n")))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    ratio = F.try_divide(F.col("target"), F.col("source_size"))
    s = s.select(
        _KEY, "source_size", "target", "mean",
        F.when(~full, F.lit(0.0)).alias("lam"),
        F.when(~full, F.when(ratio < 1, F.try_divide(F.log(ratio), x0)).otherwise(0.0)).alias("lo"),
        F.when(~full, F.when(ratio < 1, F.lit(0.0)).otherwise(F.try_divide(F.log(F.lit(float(cap))), x0))).alias("hi"),
        F.when(~full, F.lit(1.0)).alias("gap"),
    )
    s = store(s, "mix-dual")
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))
    for _ in range(MAX_NEWTON):
        rows = _join(cells, s.filter(F.col("lam").isNotNull()))
        tokens = F.col("docs") * F.col("size")
        sums = rows.groupBy(_KEY).agg(
            F.sum(tokens * F.least(tilt, F.lit(float(cap)))).alias("_value"),
            F.sum(F.when(tilt < cap, tokens * tilt * F.col("size") / F.col("mean")).otherwise(0.0)).alias("_slope"),
        )
        j = _join(s, sums, "left")
        over = F.col("_value") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - (F.col("_value") - F.col("target")) / F.when(F.col("_slope") > 0, F.col("_slope"))
        gap = F.try_divide(F.abs(F.col("_value") - F.col("target")), F.col("target"))
        done = F.coalesce(gap < TOLERANCE, F.lit(True))
        inside = (step >= lo) & (step <= hi)
        s = store(
            j.select(
                _KEY, "source_size", "target", "mean",
                F.when(done, F.col("lam")).when(inside, step).otherwise((lo + hi) / 2).alias("lam"),
                F.when(F.col("lam").isNotNull(), lo).alias("lo"), F.when(F.col("lam").isNotNull(), hi).alias("hi"), gap.alias("gap"),
            ),
            "mix-dual",
        )
        if not s.filter(F.col("gap") >= TOLERANCE).take(1):
            break
    return s


def _round(cells: DataFrame, cap: float) -> DataFrame:
    """Whole copies per cell, their tokens close to the source's target."""
    source = Window.partitionBy(_KEY)
    falling = source.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rate = F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))))
    )
    most = (F.floor(F.lit(float(cap))) * F.col("docs")).cast("long")
    c = cells.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(1.0))
    c = c.withColumn("_want", F.col("rate") * F.col("docs"))
    up_to = F.sum("_want").over(falling)
    c = c.withColumn("_up_to", up_to)
    k = F.floor(F.col("_up_to") + 0.5) - F.floor(F.col("_up_to") - F.col("_want") + 0.5)
    c = c.withColumn("_k", F.greatest(F.lit(0), F.least(k.cast("long"), most)))
    for n in range(FILL_ROUNDS):
        c = c.withColumn("_left", F.col("target") - F.sum(F.col("_k") * F.col("size")).over(source))
        room = F.when(F.col("_left") > 0, most - F.col("_k")).otherwise(F.col("_k"))
        small = F.col("size") <= F.abs(F.col("_left")) / (4 if n < FILL_ROUNDS - 1 else 1)
        c = c.withColumn("_room", F.when(small & (F.col("size") > 0), room).otherwise(0))
        before = F.sum(F.col("_room") * F.col("size")).over(falling) - F.col("_room") * F.col("size")
        c = c.withColumn("_before", before)
        units = F.floor((F.abs(F.col("_left")) - F.col("_before")) / F.greatest(F.col("size"), F.lit(1))).cast("long")
        units = F.greatest(F.lit(0).cast("long"), F.least(units, F.col("_room")))
        c = c.withColumn("_k", F.col("_k") + F.when(F.col("_left") > 0, units).otherwise(-units))
    return c.select(_KEY, "size", "docs", "source_size", "target", "rate", "_k")


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(doc_id, source, size, source_size, target, rate, copies, taken)``, one row per row of ``docs``.

    ``size`` counts words; a null or empty text has size 0, rate 1 and one copy without
    words. A null source is a source of its own. Repeated rows are separate documents.
    Copies never exceed ``floor(cap)``. Which of equally sized documents of a source get
    the odd copy is decided by the hash of ``doc_id``, so reruns agree. Other columns of
    ``docs`` are not used, whatever their names; an empty table gives an empty result.
    """
    d = docs.select("doc_id", F.col("source").alias(_KEY), word_count().alias("size"))
    d = store(d, "mix-sizes")
    cells = store(d.groupBy(_KEY, "size").agg(F.count(F.lit(1)).alias("docs")), "mix-cells")
    sizes = cells.groupBy(_KEY).agg(F.sum(F.col("docs") * F.col("size")).alias("source_size"))
    dual = solve(cells, store(targets(sizes, weights, total, cap), "mix-targets"), cap)
    c = _join(cells, dual.drop("lo", "hi", "gap"))
    c = store(_round(c, cap), "mix-copies")
    # spread each cell's copies over its documents, in blocks, since one cell may be huge
    rows = d.join(c.withColumnRenamed(_KEY, "_k2").withColumnRenamed("size", "_size2"), F.col(_KEY).eqNullSafe(F.col("_k2")) & (F.col("size") == F.col("_size2")))
    order = F.xxhash64(F.col("doc_id"), F.lit("mix"))
    rows = rows.drop("_k2", "_size2").withColumn("_h", order)
    rows = rows.withColumn("_block", F.pmod(F.col("_h"), F.ceil(F.col("docs") / CELL_BLOCK)))
    blocks = rows.groupBy(_KEY, "size", "_block").agg(F.count(F.lit(1)).alias("_in"))
    w = Window.partitionBy(_KEY, "size").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("_before", F.sum("_in").over(w) - F.col("_in"))
    blocks = blocks.select(F.col(_KEY).alias("_k3"), F.col("size").alias("_size3"), F.col("_block").alias("_block3"), "_before")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(_KEY, "size", "_block").orderBy("_h", "doc_id")))
    out = ranked.join(blocks, F.col(_KEY).eqNullSafe(F.col("_k3")) & (F.col("size") == F.col("_size3")) & (F.col("_block") == F.col("_block3")))
    base = F.floor(F.col("_k") / F.col("docs")).cast("long")
    odd = (F.col("_before") + F.col("_rank") <= F.col("_k") - base * F.col("docs")).cast("long")
    out = out.withColumn("copies", base + odd)
    return out.select(
        "doc_id", F.col(_KEY).alias("source"), "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


DECISIONS = ["size", "source_size", "target", "rate", "copies", "taken"]


def apply_mix(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` with its decision columns, without the documents that the mix takes no time.

    All columns of ``docs`` stay; a decision whose name is taken there gets underscores in front. Rows that
    share ``doc_id``, source and size are alike to the mix and matched in any order.
    """
    names = free(docs, *DECISIONS)
    words, nth, nth2, id2, source2, size2 = free(docs, "_words", "_nth", "_nth2", "_id2", "_source2", "_words2")
    left = docs.withColumn(words, word_count())
    left = left.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "source", words).orderBy("doc_id")))
    right = decided.withColumn(nth2, F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.col("copies").desc())))
    right = right.select(
        F.col("doc_id").alias(id2), F.col("source").alias(source2), F.col("size").alias(size2), nth2, *[F.col(d).alias(n) for d, n in zip(DECISIONS, names, strict=True)]
    )
    same = F.col("doc_id").eqNullSafe(F.col(id2)) & F.col("source").eqNullSafe(F.col(source2)) & (F.col(words) == F.col(size2)) & (F.col(nth) == F.col(nth2))
    return left.join(right, same).filter(F.col(names[DECISIONS.index("copies")]) > 0).select(*docs.columns, *names)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` after ``mix(docs, **how)``, see ``apply_mix``; rows without doc_id, and texts that share one, are told apart by their text."""
    (own,) = free(docs, "_own")
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text_of()))
    rows = docs.withColumn(own, F.col("doc_id")).withColumn("doc_id", key)
    return apply_mix(rows, mix(rows, **how)).withColumn("doc_id", F.col(own)).drop(own)
