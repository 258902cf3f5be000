"""Joins inside a photo or a name: partners, quads from lines, free names, next events, nearest rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.functions import geometry as g
from sheetwise.functions.names import extension, sanitize_desktop, stem
from sheetwise.operators.counting import dominance_counts
from sheetwise.operators.ordered import HOT_ROWS, computed_once, last_seen, ordered, position, running_sum
from sheetwise.session import settle

HALF_PI = 1.5707963267948966
PI = 3.141592653589793


def partnered(
    blobs: DataFrame, short_side: float, photo: str = "photo_id", idx: str = "blob_idx", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Keep blobs with a partner of similar radius in the same row or column; a lone one must be very round.

    ``blobs`` holds ``photo, idx, x, y, radius, circularity``. The partners are counted, not paired:
    a rectangle around each blob (position within 3 % of the short side, radius within 25 %), once
    along x and once along y. Any other row is another blob, also one with the same index.
    """
    reach = 0.03 * short_side
    blobs = blobs.withColumn("_blob", F.struct(idx, F.col("x").alias("bx"), F.col("y").alias("by"), F.col("radius").alias("br")))
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("at")) for a in ("x", "y")])
    tall = blobs.select(photo, "_blob", F.col("radius").cast("double").alias("radius"), F.inline_outer(axes))
    points = tall.select(photo, "axis", F.col("at").alias("x"), F.col("radius").alias("y"))
    corners = []
    for x, x_closed, sign_x in ((F.col("at") + reach, False, 1), (F.col("at") - reach, True, -1)):
        for y, y_closed, sign_y in ((F.col("radius") * 1.25, False, 1), (F.col("radius") * 0.75, True, -1)):
            corners.append(F.struct(
                x.alias("x"), F.lit(x_closed).alias("x_closed"), y.alias("y"), F.lit(y_closed).alias("y_closed"),
                F.lit(sign_x * sign_y).alias("weight"),
            ))
    queries = tall.select(photo, "axis", "_blob", F.inline_outer(F.array(*corners)))
    near = dominance_counts(points, queries, [photo, "axis"], ["_blob"], hot_rows)
    # a blob finds itself once; equal rows find each other
    partners = near.groupBy(photo, "_blob").agg((F.max("count") > 1).alias("_partnered"))
    return blobs.join(partners, [photo, "_blob"]).filter(F.col("_partnered") | (F.col("circularity") >= 0.85)).drop("_partnered", "_blob")


def _fold_angle(a: Column) -> Column:
    """An angle difference folded into +-90 degrees (lines have no direction)."""
    once = F.when(a > HALF_PI, a - PI).when(a < -HALF_PI, a + PI).otherwise(a)
    return F.when(once > HALF_PI, once - PI).when(once < -HALF_PI, once + PI).otherwise(once)


def quads_from_lines(
    lines: DataFrame, width: Column, height: Column, photo: str = "photo_id", idx: str = "line_idx"
) -> DataFrame:
    """Every plausible quad of four lines of a photo's pool: ``photo, a, b, c, d, corners``.

    The pool (``line_pool``) bounds a photo at 26 lines. Near-parallel pairs are formed first, then
    crossing pairs of pairs, so the angle tests cut the combinations before four lines meet; of a
    foursome's pairings the most parallel one counts. One shuffle on the photo serves every step.
    """
    angle = F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
    line = lines.select(photo, F.struct(
        F.col(idx).alias("i"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.cos(angle).alias("dx"), F.sin(angle).alias("dy"), angle.alias("angle")
    ).alias("l"))
    left = line.select(photo, F.col("l").alias("p"))
    right = line.select(photo, F.col("l").alias("q"))
    apart = F.abs(_fold_angle(F.col("p.angle") - F.col("q.angle")))
    pairs = left.join(right, photo).filter((F.col("p.i") < F.col("q.i")) & (apart <= 0.6)).withColumn("apart", apart)
    one = pairs.select(photo, F.col("p").alias("p0"), F.col("q").alias("p1"), F.col("apart").alias("d1"))
    two = pairs.select(photo, F.col("p").alias("q0"), F.col("q").alias("q1"), F.col("apart").alias("d2"))
    crossing = F.abs(_fold_angle(F.col("p0.angle") - F.col("q0.angle"))) >= 0.5
    ids = F.array_sort(F.array("p0.i", "p1.i", "q0.i", "q1.i"))
    fours = one.join(two, photo).filter(
        (F.col("p0.i") < F.col("q0.i")) & (F.col("p1.i") != F.col("q0.i")) & (F.col("p1.i") != F.col("q1.i")) & crossing
    ).withColumn("ids", ids)
    best = fours.groupBy(photo, "ids").agg(
        F.min_by(F.struct("p0", "q0", "p1", "q1"), F.struct((F.col("d1") + F.col("d2")).alias("d"), F.col("p1.i").alias("i"))).alias("f")
    )
    ring = ["p0", "q0", "p1", "q1"]
    f = F.col("f")
    corners, sound = [], F.lit(True)
    for k in range(4):
        a, b = f[ring[k]], f[ring[(k + 1) % 4]]
        den = a["dx"] * b["dy"] - a["dy"] * b["dx"]
        t = F.try_divide((b["x"] - a["x"]) * b["dy"] - (b["y"] - a["y"]) * b["dx"], den)
        corners.append(g.point(a["x"] + a["dx"] * t, a["y"] + a["dy"] * t))
        sound = sound & (F.abs(den) >= 1e-6)
    frame = computed_once(best, corners=F.when(sound, F.array(*corners)))
    c = F.col("corners")
    inside = c.isNotNull()
    for k in range(4):
        x, y = c[k]["x"], c[k]["y"]
        inside = inside & (x >= -0.08 * width) & (y >= -0.08 * height) & (x <= 1.08 * width) & (y <= 1.08 * height)
    area = F.abs(g.quad_signed_area(c)) / (width * height)
    kept = frame.filter(inside & g.quad_is_convex(c) & (area >= 0.025) & (area <= 0.985))
    return kept.select(photo, *[F.col("ids")[k].alias(n) for k, n in enumerate("abcd")], "corners")


def next_event(rows: DataFrame, events: DataFrame, key: str, at: str, seq: str, fields: Sequence[str], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """As-of join: to each row the first event of its key with ``seq > at``, as struct ``event`` (null = none).

    Rows and events are merged in one ordered pass per key; no row meets more than one event.
    """
    body = F.struct(F.col(seq).alias("seq"), *[F.col(f) for f in fields])
    payload = F.struct(*[F.col(c) for c in rows.columns])
    both = rows.select(
        F.col(key), (-F.col(at)).alias("_o"), F.lit(0).alias("_tie"), payload.alias("_row"),
        F.lit(None).cast(events.select(body.alias("b")).schema["b"].dataType).alias("_event"),
    ).unionByName(events.select(
        F.col(key), (-F.col(seq)).alias("_o"), F.lit(1).alias("_tie"),
        F.lit(None).cast(rows.select(payload.alias("r")).schema["r"].dataType).alias("_row"), body.alias("_event"),
    ))
    merged = ordered(both, [key], ["_o", "_tie"], {"event": last_seen("_event")}, hot_rows)
    return merged.filter(F.col("_row").isNotNull()).select("_row.*", "event")


def apply_inbox_events(
    sessions: DataFrame, events: DataFrame, session: str = "session", name: str = "name", hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Sessions after a log of inbox renames and removals, applied in order.

    ``events`` holds ``seq, kind (rename | remove), name, new_name``. A rename moves every session that
    holds the old name at that moment; a removal drops it. Each rename is linked once to the next event of
    its new name (an as-of join); the links are then doubled until all reach their last event, so a chain of n renames
    takes log n rounds, whatever its length.
    """
    log = events.select(F.col("seq").cast("long").alias("seq"), "kind", F.col("name").alias(name), F.col("new_name"))
    renames = log.filter(F.col("kind") == "rename").select("seq", F.col("new_name").alias(name), F.col("new_name").alias("_ends"))
    linked = next_event(renames, log, name, "seq", "seq", ["kind"], hot_rows)
    links = linked.select("seq", F.col("event.seq").alias("_to"), F.lit(False).alias("_removed"), "_ends").unionByName(
        log.filter(F.col("kind") != "rename").select(
            "seq", F.lit(None).cast("long").alias("_to"), F.lit(True).alias("_removed"), F.lit(None).cast("string").alias("_ends")))
    links = settle(links, "renames")
    while not links.filter(F.col("_to").isNotNull()).isEmpty():
        after = links.select(F.col("seq").alias("_to"), F.struct(F.col("_to").alias("to"), "_removed", "_ends").alias("_next"))
        jumped = links.join(after, "_to", "left")
        moved = F.col("_next").isNotNull()
        links = settle(jumped.select(
            "seq", F.when(moved, F.col("_next.to")).alias("_to"),
            *[F.when(moved, F.col(f"_next.{c}")).otherwise(F.col(c)).alias(c) for c in ("_removed", "_ends")]), "renames")
    first = next_event(sessions.withColumn("_at", F.lit(-1).cast("long")), log, name, "_at", "seq", ["kind"], hot_rows)
    ends = first.withColumn("seq", F.col("event.seq")).join(links.drop("_to"), "seq", "left")
    kept = ends.filter(~F.coalesce("_removed", F.lit(False)))
    return kept.select(*[F.col(c) if c != name else F.coalesce("_ends", c).alias(c) for c in sessions.columns])


def arrivals(now: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Names of the listing that were not known before, whatever their letter case."""
    seen = known.select(F.lower(name).alias("_name")).distinct()
    return now.withColumn("_name", F.lower(name)).join(seen, "_name", "left_anti").drop("_name")


MAX_SUFFIX = 10_000


def assign_unique_names(
    batch: DataFrame, taken: DataFrame, order: str, name: str = "name", out: str = "final_name", hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Give each row of the batch, in ``order``, the first free of ``name``, ``stem (1).ext``, ``stem (2).ext``, ...

    ``taken`` lists the names that exist or are reserved. The r-th free number of a name is r plus the
    taken numbers below it, a running count, so a name wanted a million times is one ordered pass. A
    wanted name may itself be a numbered form of another one; then the earlier row keeps it. Names form a forest by their numbers, and
    a name is contended by its own first row and the rows of its parent only, so the names of one depth are settled at once, from the
    outermost in: as many rounds as there are depths, however many names collide. From number 10000 on the row gets ``stem-<id>.ext``.
    """
    parsed = _numbered(taken.select(F.col(name).alias("_n")).distinct(), "_n")
    wanted = batch.withColumn("_wanted", F.col(name))
    ranked = ordered(wanted, ["_wanted"], [order], {"_rank": position()}, hot_rows).withColumn("_rank", F.col("_rank") - 1)

    def named(rows: DataFrame, blocked: DataFrame) -> DataFrame:
        numbered = _free_numbers(rows, blocked, order, hot_rows)
        return numbered.withColumn(out, _with_number(F.col("_wanted"), F.col("_number"), F.col(order)))

    if not _may_nest(batch, name):
        return named(ranked, parsed).drop("_wanted", "_rank", "_number")
    ranked = settle(computed_once(ranked, _depth=_depth(F.col("_wanted"))), "names")
    firsts = ranked.groupBy("_wanted").agg(F.min(order).alias(order))
    marks = settle(firsts.select(order, F.inline(_slots(F.col("_wanted")))).filter(F.col("_slot") > 0), "firsts")
    done, parsed = None, settle(parsed, "taken")
    for row in ranked.select("_depth").distinct().orderBy("_depth").collect():  # a row for each depth of numbers in one name
        rows = ranked.filter(F.col("_depth") == row["_depth"])
        own = rows.select("_wanted").distinct()
        blocked = parsed.join(own, "_wanted", "left_semi")
        if done is not None:
            above = done.select(F.col(out).alias("_wanted"), F.lit(0).cast("long").alias("_slot"))
            blocked = blocked.unionByName(above.join(own, "_wanted", "left_semi")).distinct()
        level = settle(named(rows, _passed_over(rows, marks.join(own, "_wanted", "left_semi"), blocked, order, hot_rows)), "level")
        done = level if done is None else done.unionByName(level)
    return done.drop("_wanted", "_rank", "_number", "_depth")


def _passed_over(rows: DataFrame, marks: DataFrame, blocked: DataFrame, order: str, hot_rows: int | None) -> DataFrame:
    """``_wanted, _slot``: the numbers that no row of a name gets: taken ones, and those whose own first row comes before the row whose turn it is.

    A name has fewer than ``MAX_SUFFIX`` numbers, so its list is bounded.
    """
    waiting = rows.select("_wanted", order, F.lit(None).cast("long").alias("_slot"), F.lit(1).alias("_row"))
    both = waiting.unionByName(marks.select("_wanted", order, "_slot", F.lit(0).alias("_row")))
    counted = ordered(both, ["_wanted"], [order, "_row"], {"_before": running_sum(F.col("_row"))}, hot_rows).filter(F.col("_row") == 0)
    slots = counted.select("_wanted", "_slot", F.col("_before").cast("long").alias("_before"))
    slots = slots.unionByName(blocked.select("_wanted", "_slot", F.lit(-1).cast("long").alias("_before")))
    slots = slots.groupBy("_wanted", "_slot").agg(F.min("_before").alias("_before"))
    listed = slots.groupBy("_wanted").agg(F.sort_array(F.collect_list(F.struct("_slot", "_before"))).alias("_s"))
    return listed.select("_wanted", F.explode(_swept("_s._slot", "_s._before")).alias("_slot"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _swept(slots: pd.Series, before: pd.Series) -> pd.Series:
    """Of each name's contended numbers, in order, those passed over; ``before`` counts the name's rows ahead of the number's own first row."""

    def passed(own: Iterable[int], ahead: Iterable[int]) -> list[int]:
        out: list[int] = []
        for slot, rows in zip(own, ahead, strict=True):
            if slot - len(out) >= rows:  # the row whose turn it is comes later
                out.append(int(slot))
        return out

    return pd.Series([passed(a, b) for a, b in zip(slots, before, strict=True)])


_SUFFIX = r"^(.*) \(([1-9][0-9]{0,3})\)$"


def _may_nest(batch: DataFrame, name: str) -> bool:
    """True when some wanted name already looks numbered: only then can two wanted names meet."""
    return not batch.filter(stem(F.col(name)).rlike(_SUFFIX)).limit(1).isEmpty()


def _slots(n: Column) -> Column:
    """The numbers a name blocks: 0 of itself, and n of the name it is the n-th form of."""
    s = stem(n)
    own = F.struct(n.alias("_wanted"), F.lit(0).cast("long").alias("_slot"))
    number = F.nullif(F.regexp_extract(s, _SUFFIX, 2), F.lit("")).cast("long")
    form = F.struct(F.concat(F.regexp_extract(s, _SUFFIX, 1), extension(n)).alias("_wanted"), number.alias("_slot"))
    return F.when(s.rlike(_SUFFIX), F.array(own, form)).otherwise(F.array(own))


def _depth(n: Column) -> Column:
    """How many numbers stand one after the other at the end of the stem."""
    return F.regexp_count(F.regexp_extract(stem(n), r"(?: \([1-9][0-9]{0,3}\))+$", 0), F.lit(r"\("))


def name_root(n: Column) -> Column:
    """The name without the numbers at the end of its stem. Only names of one root can collide."""
    return F.concat(F.regexp_replace(stem(n), r"(?: \([1-9][0-9]{0,3}\))+$", ""), extension(n))


def _numbered(names: DataFrame, col: str) -> DataFrame:
    """``_wanted, _slot``: what each name blocks."""
    return names.select(F.inline_outer(_slots(F.col(col)))).distinct()


def _free_numbers(ranked: DataFrame, parsed: DataFrame, order: str, hot_rows: int | None) -> DataFrame:
    blocked = ordered(parsed, ["_wanted"], ["_slot"], {"_m": position()}, hot_rows)
    # a taken slot t with m taken slots before it lies behind t - m free ones
    marks = blocked.select("_wanted", (F.col("_slot") - F.col("_m") + 1).alias("_rank"), F.lit(0).alias("_kind"))
    both = ranked.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    counted = ordered(both, ["_wanted"], ["_rank", "_kind", order], {"_below": running_sum(1 - F.col("_kind"))}, hot_rows)
    return counted.filter(F.col("_kind") == 1).withColumn("_number", F.col("_rank") + F.col("_below")).drop("_kind", "_below")


def _with_number(name: Column, number: Column, row: Column) -> Column:
    numbered = F.concat(stem(name), F.lit(" ("), number.cast("string"), F.lit(")"), extension(name))
    unique = F.concat(stem(name), F.lit("-"), F.md5(F.concat_ws("/", name, row.cast("string"))), extension(name))
    return F.when(number == 0, name).when(number < MAX_SUFFIX, numbered).otherwise(unique)


def rename_plan(
    renames: DataFrame, existing: DataFrame, old: str = "old", typed: str = "typed", order: str = "order",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """``action`` (reject, keep, recase, move) and ``final_name`` of each typed rename.

    ``existing`` lists the names in the inbox. A missing extension keeps the old one; a change of letter
    case only is no collision.
    """
    frame = computed_once(renames, _clean=sanitize_desktop(F.col(typed)))
    cleaned = F.col("_clean")
    frame = computed_once(frame, name=F.when(
        (extension(cleaned) == "") & (cleaned != ""), F.concat(cleaned, extension(F.col(old)))).otherwise(cleaned))
    planned = computed_once(frame, action=(
        F.when(cleaned == "", "reject").when(F.col("name") == F.col(old), "keep")
        .when(F.lower("name") == F.lower(old), "recase").otherwise("move")
    )).drop("_clean")
    moves = assign_unique_names(planned.filter(F.col("action") == "move"), existing, order, hot_rows=hot_rows)
    settled = F.when(F.col("action") == "recase", F.col("name")).when(F.col("action") == "keep", F.col(old))
    rest = planned.filter(F.col("action") != "move").withColumn("final_name", settled)
    return moves.unionByName(rest).drop("name")


def nearest_sample(cols: DataFrame, samples: DataFrame, place: Column, count: Column, on: Sequence[str], bucket: str, last: int = 160) -> DataFrame:
    """Join column ``place`` of ``count`` with the edge sample it falls on (halves to the even sample)."""
    at = F.rint(place / F.greatest(count - 1, F.lit(1)) * last).cast("int")
    return cols.withColumn(bucket, at).join(samples, [*on, bucket])


def nearest_points(points: DataFrame, quads: DataFrame, photo: str = "photo_id", quad: str = "corners") -> DataFrame:
    """For each corner of a photo's quad the first nearest point: ``photo, corner, pos, distance``.

    Every point meets four corners; the minimum is aggregated before the shuffle.
    """
    met = points.join(quads.select(photo, F.col(quad).alias("_quad")), photo)
    p = F.struct("x", "y")
    nearest = met.groupBy(photo).agg(*[
        F.min(F.struct(g.distance(p, F.col("_quad")[k]).alias("distance"), F.col("pos"))).alias(f"_n{k}") for k in range(4)
    ])
    rows = F.array(*[
        F.struct(F.lit(k).alias("corner"), F.col(f"_n{k}.pos").alias("pos"), F.col(f"_n{k}.distance").alias("distance")) for k in range(4)
    ])
    return nearest.select(photo, F.inline_outer(rows))


def rotation_distance(a: Column, b: Column) -> Column:
    """Least mean corner distance of two quads over the four rotations."""
    p, q = g.quad_points(a), g.quad_points(b)
    means = []
    for r in range(4):
        d = [g.distance(p[(i + r) % 4], q[i]) for i in range(4)]
        means.append((d[0] + d[1] + d[2] + d[3]) / 4)
    return F.least(*means)


def nearest_to_truth(cands: DataFrame, truth: DataFrame, photo: str = "photo_id", idx: str = "cand_idx") -> DataFrame:
    """Per photo the candidate whose corners lie nearest to the true quad, first on ties."""
    met = cands.join(truth.select(photo, F.col("corners").alias("_truth")), photo)
    d = rotation_distance(F.col("corners"), F.col("_truth"))
    best = met.groupBy(photo).agg(F.min(F.struct(d.alias("distance"), F.col(idx))).alias("_b"))
    return best.select(photo, F.col(f"_b.{idx}").alias(idx), F.col("_b.distance").alias("distance"))


def scenario_grid(scenes: DataFrame, seeds: int, name: str = "name") -> DataFrame:
    """Every scene with seeds 0..seeds-1: ``key = name-seed``. Rows multiply by a constant, no join."""
    grid = scenes.withColumn("seed", F.explode_outer(F.sequence(F.lit(0), F.lit(seeds - 1))))
    return grid.withColumn("key", F.concat(F.col(name).cast("string"), F.lit("-"), F.col("seed").cast("string")))


TOLERANCE = 14.0


def color_distance(l1: Column, a1: Column, b1: Column, l2: Column, a2: Column, b2: Column) -> Column:
    """Distance in which lightness weighs half."""
    dl, da, db = (l1 - l2) * 0.5, a1 - a2, b1 - b2
    return F.sqrt(dl * dl + da * da + db * db)


def nearer_to(samples: DataFrame, refs: DataFrame, on: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Add ``hit``: the sample is nearer to its side's outside than to the page, and near enough.

    ``samples`` holds ``l, a, b``; ``refs`` one row per side with ``out_l, out_a, out_b, page_l, page_a,
    page_b``. Sides whose outside resembles the page are left out.
    """
    c = F.col
    clear = refs.filter(
        color_distance(c("out_l"), c("out_a"), c("out_b"), c("page_l"), c("page_a"), c("page_b")) >= 2 * tolerance
    )
    met = samples.join(clear, list(on))
    outside = color_distance(c("l"), c("a"), c("b"), c("out_l"), c("out_a"), c("out_b"))
    page = color_distance(c("l"), c("a"), c("b"), c("page_l"), c("page_a"), c("page_b"))
    hit = (outside < page) & (outside < 3 * tolerance)
    return met.withColumn("hit", hit).drop("out_l", "out_a", "out_b", "page_l", "page_a", "page_b")
