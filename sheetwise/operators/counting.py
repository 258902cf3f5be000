"""Exact two-dimensional range counts inside groups, without pairing rows.

"How many others in my photo score at least this and are larger than that" is a pair question;
joining a photo with itself grows with the square of its rows. Here each group is put in ``x``
order once and split into power-of-two blocks of ranks. A query over a prefix of ranks is the
sum of at most log2(n) such blocks, and in each block the answer is a running count along ``y``.
Rows grow by log2(n), never by n, and every step is an :func:`ordered` pass, so one huge group
spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.operators.ordered import HOT_ROWS, group_sum, ordered, running_sum


def dominance_counts(
    points: DataFrame, queries: DataFrame, keys: Sequence[str], ids: Sequence[str], hot_rows: int | None = HOT_ROWS,
    measures: Mapping[str, str] | None = None,
) -> DataFrame:
    """Weighted counts of points below two limits, summed per ``keys + ids``.

    ``points`` holds ``keys, x, y``. Each row of ``queries`` holds ``keys, ids, x, x_closed, y,
    y_closed, weight`` and adds ``weight`` times the number of points of its group with
    ``x < limit`` (``<=`` where closed) and the same for ``y``; an optional column ``base`` adds that
    multiple of the points within the ``x`` limit alone. Several rows may share their ids, so any
    rectangle is a sum of corners. Result: ``keys, ids, count``, or with ``measures`` (output column ->
    value of the queries' ``measure``) one column each.
    """
    keys, ids = list(keys), list(ids)
    extra = [*ids, *(["measure"] if measures else [])]
    nothing = [F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in extra]
    point_rows = points.select(
        *keys, *nothing, F.col("x").cast("double"), F.col("y").cast("double"),
        F.lit(1).alias("x_tie"), F.lit(1).alias("y_tie"), F.lit(0).alias("weight"), F.lit(0).alias("base"), F.lit(1).cast("long").alias("is_point"),
    )
    query_rows = queries.select(
        *keys, *extra, F.col("x").cast("double"), F.col("y").cast("double"),
        F.when(F.col("x_closed"), 2).otherwise(0).alias("x_tie"),
        F.when(F.col("y_closed"), 2).otherwise(0).alias("y_tie"),
        F.col("weight").cast("int").alias("weight"),
        (F.col("base").cast("int") if "base" in queries.columns else F.lit(0)).alias("base"), F.lit(0).cast("long").alias("is_point"),
    )
    # Points alike in x and y are interchangeable and queries do not count, so no further tie-breaker is needed.
    placed, placed_hot = ordered(
        point_rows.unionByName(query_rows), keys, ["x", "x_tie", "y"],
        {"upto": running_sum("is_point"), "size": group_sum("is_point")}, hot_rows, with_pool=True,
    )
    counted = ordered(
        _blocks(placed, keys, extra), [*keys, "level", "block"], ["y", "y_tie"], {"below": running_sum("is_point")},
        hot_rows, pool=_blocks(placed_hot, keys, extra),
    )
    part = F.col("direct") + F.col("weight") * F.when(F.col("level") >= 0, F.col("below")).otherwise(0)
    if measures:
        sums = [F.sum(F.when(F.col("measure") == m, part).otherwise(0)).cast("long").alias(n) for n, m in measures.items()]
    else:
        sums = [F.sum(part).cast("long").alias("count")]
    return counted.filter(F.col("is_point") == 0).groupBy(*keys, *ids).agg(*sums)


def _blocks(placed: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """One row per block a point lies in or a query reads; level -1 where a query reads none.

    Points sit in the even blocks of every level; a query with prefix p reads block (p >> l) - 1 of each
    level l whose bit is set in p. ``direct`` is what a query gets from its prefix alone, on its first row.
    """
    levels = "sequence(0, int(floor(log2(greatest(size, 1)))))"
    own = f"transform({levels}, l -> named_struct('level', l, 'block', shiftright(upto - 1, l)))"
    read = f"transform({levels}, l -> named_struct('level', l, 'block', shiftright(upto, l) - 1))"
    stay = "array(named_struct('level', -1, 'block', 0L))"
    blocks = (
        f"CASE WHEN is_point = 1 THEN filter({own}, b -> b.block % 2 = 0) WHEN upto = 0 THEN {stay} "
        f"ELSE filter({read}, b -> b.block % 2 = 0) END"
    )
    spread = placed.select(
        *keys, *extra, "y", "y_tie", "weight", "is_point", "upto", "base", F.posexplode_outer(F.expr(blocks)).alias("_at", "_b")
    ).filter(F.col("_b").isNotNull())
    return spread.select(
        *keys, *extra, "y", "y_tie", "weight", "is_point",
        F.when(F.col("_at") == 0, F.col("base") * F.col("upto")).otherwise(0).alias("direct"),
        F.col("_b.level").alias("level"), F.col("_b.block").alias("block"),
    )
