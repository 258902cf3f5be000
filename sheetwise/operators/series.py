"""Ordered samples: smoothing, running lengths, runs, clusters, merged segments, status changes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheetwise.operators.ordered import (
    BLOCK_ROWS, HOT_ROWS, following, group_size, last_seen, ordered, position, previous, running_max, running_sum, sliding,
)
from sheetwise.operators.outlines import STRAIGHT_RMS
from sheetwise.operators.stats import hist_percentile
from sheetwise.session import ship_package


def smooth_series(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, passes: int = 1, out: str = "smooth",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """1-2-1 filter along ``order``, applied ``passes`` times; the first and last row stay."""
    stages = []
    for _ in range(passes):
        stages.append({"_before": previous(out), "_after": following(out)})
        stages.append(lambda f: f.withColumn(
            out,
            F.when(F.col("_before").isNull() | F.col("_after").isNull(), F.col(out))
            .otherwise(0.25 * F.col("_before") + 0.5 * F.col(out) + 0.25 * F.col("_after")),
        ).drop("_before", "_after"))
    return ordered(df.withColumn(out, F.col(value)), keys, order, stages[0], hot_rows, then=stages[1:])


def cumulative_length(
    points: DataFrame, keys: Sequence[str], order: Sequence[str], x: str = "x", y: str = "y", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Add ``length``: running distance along the points, 0 at the first."""
    dx, dy = F.col(x) - F.col("_p.x"), F.col(y) - F.col("_p.y")
    return ordered(
        points, keys, order, {"_p": previous(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))}, hot_rows,
        then=[
            lambda f: f.withColumn("_step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))),
            {"length": running_sum("_step")},
        ],
    ).drop("_p", "_step")


def runs_from_edge(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, miss: int = 3, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Per group, how far the hits reach from the edge: place of the last hit before ``miss + 1`` misses in a row.

    Result: ``keys, depth`` (0 = none).
    """
    placed = ordered(
        df.withColumn("_hit", hit), keys, order, {"_pos": position()}, hot_rows,
        then=[{"_last": last_seen(F.when(F.col("_hit"), F.col("_pos")))}],
    )
    # The first break comes exactly miss + 1 rows after the last hit that counts.
    broken = F.col("_pos") - F.coalesce(F.col("_last"), F.lit(0)) == miss + 1
    return placed.groupBy(*keys).agg(
        F.coalesce(
            F.min(F.when(broken, F.col("_pos"))) - (miss + 1), F.max(F.when(F.col("_hit"), F.col("_pos"))), F.lit(0)
        ).alias("depth")
    )


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """The flagged rows with their place ``pos`` (0-based), their group's size ``n`` and an ``island`` id per run."""
    placed = ordered(
        df.withColumn("_flag", flag), keys, order,
        {"_pos": position(), "_seen": running_sum(F.when(F.col("_flag"), 1).otherwise(0)), "n": group_size()}, hot_rows,
    )
    kept = placed.filter(F.col("_flag"))
    return kept.withColumn("island", F.col("_pos") - F.col("_seen")).withColumn("pos", F.col("_pos") - 1).drop("_flag", "_pos", "_seen")


def min_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, fraction: float = 0.08, value: str | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Maximal flagged runs of at least ``max(3, fraction of the group)`` rows: ``keys, start, stop, length``.

    With ``value``, a run must also be straight: the RMS distance of (place, value) to its line below 1.2.
    """
    marked = islands(df, keys, order, flag, hot_rows)
    extra = []
    if value is not None:
        xx, yy, xy = F.var_pop("pos"), F.var_pop(value), F.covar_pop("pos", value)
        least = (xx + yy) / 2 - F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
        extra.append(F.sqrt(F.greatest(F.lit(0.0), least)).alias("_rms"))
    runs = marked.groupBy(*keys, "island").agg(
        F.min("pos").alias("start"), F.max("pos").alias("stop"), F.count(F.lit(1)).alias("length"), F.max("n").alias("_n"), *extra
    )
    long_enough = F.col("length") >= F.greatest(F.lit(3), F.floor(F.col("_n") * fraction))
    if value is not None:
        long_enough = long_enough & (F.col("_rms") < STRAIGHT_RMS)
    return runs.filter(long_enough).drop("island", "_n", *(["_rms"] if value is not None else []))


def clusters(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, min_rows: int = 2, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Runs of flagged rows with at least ``min_rows``: ``keys, center`` (mean place / group size), ``length``."""
    marked = islands(df, keys, order, flag, hot_rows)
    return (
        marked.groupBy(*keys, "island")
        .agg((F.avg("pos") / F.max("n")).alias("center"), F.count(F.lit(1)).alias("length"))
        .filter(F.col("length") >= min_rows)
        .drop("island")
    )


def coalesce_segments(
    segments: DataFrame, keys: Sequence[str], start: str, end: str, gap: float, tie: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Merge segments of one line whose gap is below ``gap``: ``keys, start, end, support, pieces``.

    ``keys`` hold the photo and the line's bucket (angle, offset). Merging is transitive along the
    line; a greedy longest-first merge gives the same lines unless chains overlap at their ends.
    ``support`` is the summed length of the pieces.
    """
    apart = F.coalesce(F.col(start) - F.col("_reach") >= gap, F.lit(True))
    merged = ordered(
        segments, keys, [start, end, *tie], {"_far": running_max(end)}, hot_rows,
        then=[
            {"_reach": previous("_far")},
            lambda f: f.withColumn("_new", F.when(apart, 1).otherwise(0)),
            {"_line": running_sum("_new")},
        ],
    )
    return merged.groupBy(*keys, "_line").agg(
        F.min(start).alias("start"), F.max(end).alias("end"), F.sum(F.col(end) - F.col(start)).alias("support"),
        F.count(F.lit(1)).alias("pieces"),
    ).drop("_line")


def moving_status(
    polls: DataFrame, keys: Sequence[str], order: Sequence[str], status: str, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """The polls where the status changed (the first poll counts), with the status before."""
    linked = ordered(polls, keys, order, {"was": previous(status)}, hot_rows)
    return linked.filter(~F.col("was").eqNullSafe(F.col(status)))


def baseline_normalize(
    series: DataFrame, keys: Sequence[str], order: Sequence[str], level: str, reach: int = 3,
    hot_rows: int | None = HOT_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Divide by the local paper level and stretch the blacks; add ``normalized`` (0-255).

    Paper is the local maximum, averaged, and never below ``max(60, 0.55 x its 95th percentile)``.
    Blacks stretch from the 0.5th percentile (at most 80) when that is above 10.
    """
    keys = list(keys)
    placed = ordered(series, keys, order, {"_pos": position()}, hot_rows)
    lit = sliding(
        placed, keys, "_pos",
        [
            {"_top": lambda w: F.max(level).over(w.rowsBetween(-reach, reach))},
            {"_paper": lambda w: F.floor(F.avg("_top").over(w.rowsBetween(-reach, reach)) + 0.5).cast("int")},
        ],
        2 * reach, block_rows,
    )
    typical = hist_percentile(lit, keys, "_paper", {"_typical": 0.95})
    floor = F.greatest(F.lit(60.0), F.col("_typical") * 0.55)
    raw = lit.join(typical, keys).withColumn(
        "_flat", F.least(F.lit(255), F.floor(F.col(level) / F.greatest(F.col("_paper"), floor) * 255 + 0.5).cast("int"))
    )
    dark = hist_percentile(raw, keys, "_flat", {"_dark": 0.005})
    black = F.least("_dark", F.lit(80))
    alpha = 255.0 / (255 - black)
    stretched = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(F.col("_flat") * alpha - black * alpha + 0.5)))
    out = raw.join(dark, keys).withColumn("normalized", F.when(black > 10, stretched.cast("int")).otherwise(F.col("_flat")))
    return out.drop("_pos", "_top", "_paper", "_typical", "_flat", "_dark")


#: Cells of the padded grids that one task solves side by side.
BLOCK_CELLS = 1 << 20


def min_cost_track(
    costs: DataFrame, keys: Sequence[str], step: str, state: str, cost: str, reach: int = 12, linear: float = 0.04,
    quadratic: float = 0.02, end_pull: float = 0.02, center: int | None = None, fill: tuple[int, int, float] | None = None,
) -> DataFrame:
    """Cheapest path through each group's steps: ``keys, step, state``.

    Moving by ``d`` states costs ``linear * |d| + quadratic * d^2`` and at most ``reach`` states per
    step; with ``center`` both ends pay ``end_pull`` per state away from it. First state wins ties.
    Missing (step, state) cells are barred, or with ``fill = (first, last, cost)`` those states of every step cost that much.
    A group is one traced side: its size is steps x states of the sampling grid, whatever the size of the table, so duplicates
    are summed before the shuffle. A task walks the steps of many groups at once.
    """
    ship_package(costs.sparkSession)
    keys = list(keys)
    value = F.col(cost) if fill is None else F.coalesce(F.col(cost).cast("double"), F.lit(0.0))
    cells = costs.groupBy(*keys, step, state).agg(F.sum(value).cast("double").alias("_cost"))
    schema = T.StructType([*[cells.schema[k] for k in keys], cells.schema[step], cells.schema[state]])
    kinds = to_arrow_schema(schema)

    def solved(sides: list) -> pa.RecordBatch:
        sides.sort(key=lambda side: len(side[1]))
        tables = [side_grid(*(side[i].to_numpy(zero_copy_only=False) for i in (1, 2, 3)), fill) for side in sides]
        pulls = [0.0 if center is None else end_pull * np.abs(states - center) for _, states, _ in tables]
        paths = cheapest_paths([table for _, _, table in tables], pulls, reach, linear, quadratic)
        heads = pa.Table.from_batches([side[0] for side in sides]).take(pa.array(np.repeat(np.arange(len(sides)), [len(x) for x in paths])))
        found = [np.concatenate([steps for steps, _, _ in tables]), np.concatenate([states[x] for (_, states, _), x in zip(tables, paths, strict=True)])]
        columns = [*(heads[k].combine_chunks() for k in keys), *map(pa.array, found)]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, kinds, strict=True)], schema=kinds)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, size = [], 0
        for side in _sides(batches, keys):
            sides.append((side.select(keys).slice(0, 1), side[step], side[state], side["_cost"]))
            size += len(side) if fill is None else len(pc.unique(side[step])) * (fill[1] + 1 - fill[0])
            if size >= BLOCK_CELLS:
                yield solved(sides)
                sides, size = [], 0
        if sides:
            yield solved(sides)

    return cells.repartition(*keys).sortWithinPartitions(*keys, step).mapInArrow(solve, schema)


def _sides(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each group as one batch; rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            code = batch[k].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
            new[0] |= bool(held) and held[-1][k][-1].as_py() != batch[k][0].as_py()
        cuts = np.flatnonzero(new).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if new[a] and held:
                yield joined()
                held.clear()
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield joined()


def side_grid(p: np.ndarray, q: np.ndarray, c: np.ndarray, fill: tuple[int, int, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps, states and the cost table of one side from its cells."""
    steps, row = np.unique(p, return_inverse=True)
    first, last = (q.min(), q.max()) if fill is None else (min(q.min(), fill[0]), max(q.max(), fill[1]))
    states = np.arange(first, last + 1)
    table = np.full((len(steps), len(states)), np.inf)
    if fill is not None:
        table[:, fill[0] - first : fill[1] + 1 - first] = 0.0
    table[row, (q - first).astype(np.int64)] = c
    if fill is not None:
        table[:, fill[0] - first : fill[1] + 1 - first] += fill[2]
    return steps, states, table


def cheapest_paths(tables: list[np.ndarray], pulls: list, reach: int, linear: float, quadratic: float) -> list[np.ndarray]:
    """:func:`cheapest_path` of several tables, step by step for all of them; shorter and narrower ones are padded."""
    many, tall, wide = len(tables), max(len(t) for t in tables), max(t.shape[1] for t in tables)
    counts, widths = np.array([len(t) for t in tables]), np.array([t.shape[1] for t in tables])
    cost, pull = np.full((tall, many, wide), np.inf), np.zeros((many, wide))
    for i, t in enumerate(tables):
        cost[: len(t), i, : t.shape[1]] = t
        pull[i, : t.shape[1]] = pulls[i]
    side = min(reach, wide - 1)
    shifts = np.arange(-side, side + 1)
    moves = linear * np.abs(shifts) + quadratic * shifts * shifts
    total = cost[0] + pull
    came = np.zeros((tall, many, wide), np.int32)
    final = np.where((counts == 1)[:, None], total, np.inf)
    padded = np.full((many, wide + 2 * side), np.inf)
    for i in range(1, tall):
        padded[:, side : side + wide] = total
        # row s holds the cost of arriving from state j + shifts[s]; the first of equal shifts stays
        arrive = np.lib.stride_tricks.sliding_window_view(padded, wide, axis=1) + moves[:, None]
        pick = arrive.argmin(axis=1)
        best = np.take_along_axis(arrive, pick[:, None], axis=1)[:, 0]
        came[i] = np.arange(wide) + shifts[pick]
        total = best + cost[i]
        ended = counts == i + 1
        if ended.any():
            final[ended] = total[ended] + pull[ended]
    at = np.array([final[i, : widths[i]].argmin() for i in range(many)])
    path = np.zeros((tall, many), np.int64)
    for i in range(tall - 1, -1, -1):
        live = counts > i
        path[i, live] = at[live]
        if i:
            at = np.where(live, came[i, np.arange(many), np.clip(at, 0, wide - 1)], at)
    return [path[: counts[i], i] for i in range(many)]


def cheapest_path(table: np.ndarray, pull: np.ndarray | float, reach: int, linear: float, quadratic: float) -> np.ndarray:
    """State index per row of ``table`` on the cheapest path, by dynamic programming over whole rows."""
    count, width = table.shape
    shifts = np.arange(-min(reach, width - 1), min(reach, width - 1) + 1)
    moves = linear * np.abs(shifts) + quadratic * shifts * shifts
    total = table[0] + pull
    came = np.zeros((count, width), dtype=np.int64)
    for i in range(1, count):
        wide = np.full(width + 2 * len(shifts), np.inf)
        wide[len(shifts) : len(shifts) + width] = total
        # row s holds the cost of arriving from state j + shifts[s]
        arrive = np.stack([wide[len(shifts) + s : len(shifts) + s + width] for s in shifts]) + moves[:, None]
        best = arrive.argmin(axis=0)
        came[i] = np.arange(width) + shifts[best]
        total = arrive[best, np.arange(width)] + table[i]
    if count > 1:
        total = total + pull
    path = np.empty(count, dtype=np.int64)
    path[-1] = total.argmin()
    for i in range(count - 1, 0, -1):
        path[i - 1] = came[i, path[i]]
    return path
