"""Window-style columns over groups of any size.

A plain window puts each group into one task. That is fine until one photo, user or name
holds a large part of the table. :func:`ordered` gives the same columns, but cuts the groups above
``hot_rows`` into cells along the whole ordering, at quantiles of a sample of the group, runs the window per
(group, cell) and adds what the earlier (or later) cells contribute from a small carry table.

One count per call tells whether there is any hot group; if not, the plan is a plain window and the input is
read once. The list of hot groups is at most ``MAX_HOT`` rows of at most ``CELLS`` cuts, so it may be broadcast whatever the size of
the data. Groups that do not make the list hold less than 1/MAX_HOT of the rows each, an even share of that many tasks. The cells only
decide where work runs; results are exact. A part whose ordering is all equal stays in one cell, and
rows with a null key are not cut.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheetwise.session import settle

HOT_ROWS = 1_000_000
MAX_HOT = 1024
CELLS, STEP = 256, 16
#: Rows of a hot group, about, whose order gives the cuts.
SAMPLE = 4096


@dataclass(frozen=True)
class Spec:
    """One derived column: what to compute (``kind``) over which expression."""

    kind: str
    expr: Column


def running_sum(expr: Column | str) -> Spec:
    """Sum of ``expr`` over the rows up to and including this one."""
    return Spec("sum", _col(expr))


def running_max(expr: Column | str) -> Spec:
    """Largest ``expr`` over the rows up to and including this one."""
    return Spec("max", _col(expr))


def position() -> Spec:
    """1-based place of the row in its group."""
    return Spec("sum", F.lit(1).cast("long"))


def last_seen(expr: Column | str) -> Spec:
    """Latest non-null ``expr`` up to and including this row."""
    return Spec("last", _col(expr))


def previous(expr: Column | str) -> Spec:
    """``expr`` of the row before, null on the first row."""
    return Spec("prev", _col(expr))


def following(expr: Column | str) -> Spec:
    """``expr`` of the next row, null on the last row."""
    return Spec("next", _col(expr))


def first_of_group(expr: Column | str) -> Spec:
    """``expr`` of the group's first row."""
    return Spec("first", _col(expr))


def last_of_group(expr: Column | str) -> Spec:
    """``expr`` of the group's last row."""
    return Spec("final", _col(expr))


def group_sum(expr: Column | str) -> Spec:
    """Sum of ``expr`` over the whole group."""
    return Spec("total", _col(expr))


def group_size() -> Spec:
    """Rows in the group."""
    return Spec("total", F.lit(1).cast("long"))


def group_max(expr: Column | str) -> Spec:
    """Largest ``expr`` of the whole group."""
    return Spec("peak", _col(expr))


def _col(expr: Column | str) -> Column:
    return F.col(expr) if isinstance(expr, str) else expr


def hot_groups(df: DataFrame, keys: Sequence[str], *extra: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The largest groups above ``hot_rows``, at most ``MAX_HOT`` of them, with extra aggregates."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"), *extra)
        .filter(F.col("_rows") > hot_rows)
        .orderBy(F.desc("_rows"), *keys)
        .limit(MAX_HOT)
    )


def with_cells(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], hot_rows: int = HOT_ROWS, pool: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Add ``_cell`` (0 outside hot groups; never falls along ``order``) and return the hot rows' twin; ``df`` itself and None if no
    group is hot.

    ``pool`` holds at least all rows of the groups that can be hot; all of ``df`` when left out.
    """
    pool, keys = df if pool is None else pool, list(keys)
    listed = hot_groups(pool, keys, hot_rows=hot_rows)
    if listed.isEmpty():
        return df, None
    listed = settle(listed, "hot-groups")
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    share = F.greatest(F.floor(F.col("_rows") / SAMPLE), F.lit(1))
    sampled = pool.join(F.broadcast(listed), _same(pool, listed, keys)).filter(F.pmod(F.xxhash64(*order), share) == 0)
    tuples = sampled.select(*[listed[k].alias(k) for k in keys], place.alias("_p")).distinct()
    sample = F.array_sort(F.collect_list("_p"))
    cut = lambda i: F.get(F.col("_s"), F.floor(i * F.size("_s") / CELLS).cast("int"))
    cuts = tuples.groupBy(*keys).agg(sample.alias("_s")).select(
        *keys, F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(CELLS - 1)), cut)).alias("_cuts"))
    steps = F.sequence(F.lit(STEP), F.lit(CELLS - 1), F.lit(STEP))
    heads = F.filter(F.transform(steps, lambda i: F.get(F.col("_cuts"), i - 1)), lambda c: c.isNotNull())
    cuts = settle(cuts.withColumn("_heads", heads), "cuts")

    def cell_of(side: DataFrame, how: str) -> DataFrame:
        """Cuts up to a row: whole steps first, then within the step."""
        own = [c for c in side.columns if c != "_cell"]
        joined = side.join(F.broadcast(cuts), _same(side, cuts, keys), how)
        joined = joined.select(*[side[f"`{c}`"] for c in own], F.col("_cuts"), F.col("_heads"))
        whole = F.size(F.filter("_heads", lambda c: c <= place)) * STEP
        joined = joined.withColumn("_whole", whole)
        within = F.size(F.filter(F.slice("_cuts", F.col("_whole") + 1, F.lit(STEP)), lambda c: c <= place))
        cell = F.when(F.col("_cuts").isNull(), 0).otherwise(F.col("_whole") + within)
        return joined.withColumn("_cell", cell).drop("_cuts", "_heads", "_whole")

    return cell_of(df, "left"), cell_of(pool, "inner")


def _same(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [one[k] == two[k] for k in keys])


Stage = Mapping[str, Spec] | Callable[[DataFrame], DataFrame]


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    columns: Stage,
    hot_rows: int | None = HOT_ROWS,
    *,
    then: Sequence[Stage] = (),
    pool: DataFrame | None = None,
    with_pool: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Add ``columns`` to ``df``, computed per ``keys`` along ``order`` (all ascending, total order).

    Negate a numeric column to sort it downwards. Stages in ``then`` run in the same partitioning,
    with no further shuffle: either more columns, which may refer to the earlier ones, or a function
    that derives plain columns. ``hot_rows=None`` skips the hot-group pass; use it only where the
    format bounds the group (for example a 33-point edge).

    A later pass over finer keys can only be hot inside the groups hot here: ``with_pool`` also returns
    the rows of the hot groups, and after the same steps they are that pass's ``pool``, which spares it
    a look at everything else.
    """
    keys = list(keys)
    order = [_col(c) for c in order]
    if hot_rows is None:
        frame, hot_frame, parts = df, None, keys
    else:
        frame, hot_frame = with_cells(df, keys, order, hot_rows, pool)
        parts = keys if hot_frame is None else [*keys, "_cell"]

    for stage in (columns, *then):
        if callable(stage):
            frame = stage(frame)
            hot_frame = hot_frame if hot_frame is None else stage(hot_frame)
            continue
        kinds = {s.kind for s in stage.values()}
        if hot_frame is None:
            frame = _in_group(frame, parts, order, stage, kinds, "")
            continue
        carry = _carry(hot_frame, keys, order, stage)  # the windows have dealt out the rows by its keys already
        kept = frame.columns
        merged = [_merge(n, s) for n, s in stage.items()]

        def apply(side: DataFrame) -> DataFrame:
            local = _in_group(side, parts, order, stage, kinds, "_l_")
            return local.join(carry, parts, "left").select(*[F.col(f"`{c}`") for c in kept], *merged)

        frame, hot_frame = apply(frame), apply(hot_frame)
    out = [c for c in frame.columns if c != "_cell"]
    first = [c for c in df.columns if c in out]
    shape = [F.col(f"`{c}`") for c in [*first, *[c for c in out if c not in first]]]
    if with_pool:
        return frame.select(*shape), (frame.filter(F.lit(False)) if hot_frame is None else hot_frame).select(*shape)
    return frame.select(*shape)


def _in_group(df: DataFrame, parts: list[str], order: list[Column], columns: Mapping[str, Spec], kinds: set[str], prefix: str) -> DataFrame:
    """The columns within each (group, cell), by plain windows."""
    line = W.partitionBy(*parts).orderBy(*order)
    upto = line.rowsBetween(W.unboundedPreceding, 0)
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    local = {
        "sum": lambda e: F.sum(e).over(upto),
        "max": lambda e: F.max(e).over(upto),
        "last": lambda e: F.last(e, ignorenulls=True).over(upto),
        "prev": lambda e: F.lag(e).over(line),
        "next": lambda e: F.lead(e).over(line),
        "first": lambda e: F.first(e).over(upto),
        "final": lambda e: F.last(e).over(whole),
        "total": lambda e: F.sum(e).over(whole),
        "peak": lambda e: F.max(e).over(whole),
    }
    return df.select(
        "*",
        *[local[s.kind](s.expr).alias(f"{prefix}{n}") for n, s in columns.items()],
        *([F.row_number().over(line).alias("_i")] if prefix and "prev" in kinds else []),
        *([F.lead(F.lit(1)).over(line).isNull().alias("_end")] if prefix and "next" in kinds else []),
    )


def _carry(hot_only: DataFrame, keys: list[str], order: list[Column], columns: Mapping[str, Spec]) -> DataFrame:
    """Per (group, cell) of the hot groups: what the other cells contribute to each column."""
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    gather = {
        "sum": lambda e: F.sum(e),
        "max": lambda e: F.max(e),
        "last": lambda e: F.max_by(e, F.when(e.isNotNull(), place)),
        "prev": lambda e: F.max_by(F.struct(e.alias("v")), place),
        "next": lambda e: F.min_by(F.struct(e.alias("v")), place),
        "first": lambda e: F.min_by(F.struct(e.alias("v")), place),
        "final": lambda e: F.max_by(F.struct(e.alias("v")), place),
        "total": lambda e: F.sum(e),
        "peak": lambda e: F.max(e),
    }
    summed = hot_only.groupBy(*keys, "_cell").agg(
        F.count(F.lit(1)).alias("_rows"), *[gather[s.kind](s.expr).alias(n) for n, s in columns.items()]
    )
    line = W.partitionBy(*keys).orderBy("_cell")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    flat = W.partitionBy(*keys)
    spread = {
        "sum": lambda c: F.sum(c).over(before),
        "max": lambda c: F.max(c).over(before),
        "last": lambda c: F.last(c, ignorenulls=True).over(before),
        "prev": lambda c: F.lag(c).over(line),
        "next": lambda c: F.lead(c).over(line),
        "first": lambda c: F.first(c).over(before),
        "final": lambda c: F.last(c).over(line.rowsBetween(1, W.unboundedFollowing)),
        "total": lambda c: F.sum(c).over(flat),
        "peak": lambda c: F.max(c).over(flat),
    }
    return summed.select(
        *keys, "_cell", *[spread[s.kind](F.col(n)).alias(f"_c_{n}") for n, s in columns.items()]
    )


def _merge(name: str, spec: Spec) -> Column:
    mine, theirs = F.col(f"_l_{name}"), F.col(f"_c_{name}")
    if spec.kind == "sum":
        merged = F.when(theirs.isNull(), mine).when(mine.isNull(), theirs).otherwise(mine + theirs)
    elif spec.kind == "max":
        merged = F.greatest(mine, theirs)
    elif spec.kind == "last":
        merged = F.coalesce(mine, theirs)
    elif spec.kind == "prev":
        merged = F.when(F.col("_i") > 1, mine).otherwise(theirs["v"])
    elif spec.kind == "next":
        merged = F.when(~F.col("_end"), mine).otherwise(theirs["v"])
    elif spec.kind in ("first", "final"):
        merged = F.when(theirs.isNotNull(), theirs["v"]).otherwise(mine)
    else:  # total, peak: the carry row already holds the whole group's value
        merged = F.coalesce(theirs, mine)
    return merged.alias(name)


BLOCK_ROWS = 100_000


def sliding(
    df: DataFrame, keys: Sequence[str], pos: str, stages: Sequence[Mapping[str, Callable[[W], Column]]], reach: int,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Columns over a frame of at most ``reach`` rows either way along the dense position ``pos`` (from 1).

    A group is cut into blocks of ``block_rows`` positions; rows within ``reach`` of a block's edge
    are also copied to the neighbour, so each block is a window of its own. Each stage maps names to
    functions of the ordered window; later stages may use earlier names, so ``reach`` is the sum of
    the stages' frames.
    """
    block = F.floor((F.col(pos) - 1) / block_rows)
    low, high = F.floor((F.col(pos) - 1 - reach) / block_rows), F.floor((F.col(pos) - 1 + reach) / block_rows)
    spread = df.withColumn("_own", block).withColumn(
        "_block", F.explode_outer(F.sequence(F.greatest(low, F.lit(0).cast("long")), high))
    )
    line = W.partitionBy(*keys, "_block").orderBy(pos)
    for stage in stages:
        spread = spread.select("*", *[fn(line).alias(n) for n, fn in stage.items()])
    return spread.filter(F.col("_block") == F.col("_own")).drop("_block", "_own")


def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group.

    ``row_number() <= k`` is planned as a group limit before the shuffle, so at most ``k`` rows
    per group and map task travel, however large the group.
    """
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    Filters on plain derived columns are pushed below them with the whole expression repeated per use;
    a generator stops that, so large expressions stay computed once and in compiled code.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
