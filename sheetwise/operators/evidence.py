"""What the brightness samples of a photo say about outlines on it, and growing a pick by that evidence.

Samples are rows ``photo, x, y, gray, sat``: a photo read on a grid. Outlines are convex quads in the same units. Samples and
outlines meet on cells of the photo, so one photo with very many samples or outlines is spread over many keys, and an outline meets only
the samples near it. Every judgement is an aggregate per outline, or per pair of an inner outline (the panel) and a larger one.

An outline with a null corner, or in a photo without samples, meets none: it has no print inside, no paper added, and neutral appearance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import geometry as g
from sheetwise.operators.candidates import GROW_AREA, GROW_CONTAINS, GROW_MARGIN
from sheetwise.operators.ordered import computed_once
from sheetwise.operators.outlines import corners_on_outline, quad_overlap
from sheetwise.operators.stats import MARGIN_LIFT, MIN_BAND, band_means, extra_paper_tests, like_colour
from sheetwise.session import settle

# Widths of the bands along an outline and of the strips beside its sides, in pixels.
BAND = 16.0
NEAR, FAR = 3.0, 12.0
ON_OUTLINE = 0.025
#: Ends of a side that its strips leave out.
PRINT_ENDS, LIFT_ENDS = 1 / 24, 1 / 16
#: Cells across the longer edge of the frame.
CELLS = 16

PAIR = ("pick_idx", "cand_idx")


class Frame:
    """Width and height of the photos, and the samples' key."""

    def __init__(self, width: float, height: float, photo: str = "photo_id", cells: int = CELLS):
        self.width, self.height, self.photo = float(width), float(height), photo
        self.cell = max(self.width, self.height) / cells

    def last(self, size: float) -> int:
        """Number of the last cell along an edge of this size."""
        return max(math.ceil(size / self.cell) - 1, 0)


def _corners(*quads: str) -> list[Column]:
    return [F.get(F.col(q), F.lit(k)) for q in quads for k in range(4)]


def meet_samples(outlines: DataFrame, samples: DataFrame, frame: Frame, points: Sequence[Column], reach: float) -> DataFrame:
    """Each row with the samples of its photo in the cells that the box around ``points``, ``reach`` wider, touches; adds ``x, y, gray, sat``.

    The rows are spread over cells, many times what Spark expects of them from the files they come from, so they must not be broadcast.
    """
    corners = {axis: [p[axis] for p in points] for axis in ("x", "y")}
    whole = F.lit(True)
    for c in corners["x"] + corners["y"]:
        whole = whole & c.isNotNull()

    def cell(value: Column, size: float) -> Column:
        """The last cell holds the edge of the frame."""
        return F.least(F.floor(value / frame.cell), F.lit(frame.last(size)))

    def cells(axis: str, size: float) -> Column:
        lo = F.greatest(F.lit(0.0), F.least(*corners[axis]) - reach)
        hi = F.least(F.lit(size), F.greatest(*corners[axis]) + reach)
        first, last = cell(lo, size), cell(hi, size)
        return F.explode(F.when(lo <= hi, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))

    spread = outlines.filter(whole).withColumn("_cx", cells("x", frame.width)).withColumn("_cy", cells("y", frame.height))
    x, y = F.col("x"), F.col("y")
    placed = samples.filter(x.isNotNull() & y.isNotNull()).select(
        frame.photo, cell(x, frame.width).alias("_cx"), cell(y, frame.height).alias("_cy"),
        *[F.coalesce(F.col(axis).cast("double"), F.lit(0.0)).alias(axis) for axis in "xy"], "gray", "sat",
    )
    return spread.hint("merge").join(placed, [frame.photo, "_cx", "_cy"]).drop("_cx", "_cy")


def _flat(**quads: str) -> list[Column]:
    """The corners of each named quad as plain numbers ``<name>_x0 .. <name>_y3``, never null, for rows whose corners are none."""
    return [
        F.coalesce(F.get(F.col(of), F.lit(k))[a].cast("double"), F.lit(0.0)).alias(f"{name}_{a}{k}") for name, of in quads.items() for k in range(4) for a in "xy"
    ]


def _with_sides(met: DataFrame, name: str) -> DataFrame:
    """Points ``x, y`` beside the flat corners of a named quad, with their depth ``<name>`` in it, and of each side i: ``<name>_sq<i>`` (its
    length squared), ``<name>_dot<i>`` (how far along) and ``<name>_turn<i>`` (how far inside), both times its length.

    Plain numbers that are never null, in steps: few objects are made, and the code of a step stays small enough to be compiled.
    """
    columns, one = met.columns, F.lit(1.0)
    c = lambda k, i: F.col(f"{name}_{k}{i % 4}")

    def step(frame: DataFrame, **values) -> DataFrame:
        return frame.select("*", *[value(i).alias(f"{name}_{k}{i}") for k, value in values.items() for i in range(4)])

    met = step(
        met, px=lambda i: F.col("x") - c("x", i), py=lambda i: F.col("y") - c("y", i), dx=lambda i: c("x", i + 1) - c("x", i), dy=lambda i: c("y", i + 1) - c("y", i)
    )
    twice = sum((c("x", i) * c("y", i + 1) - c("x", i + 1) * c("y", i) for i in range(4)), F.lit(0.0))
    met = met.select("*", F.when(twice < 0, -1.0).otherwise(1.0).alias(f"{name}_way"))
    met = step(
        met, sq=lambda i: c("dx", i) * c("dx", i) + c("dy", i) * c("dy", i), dot=lambda i: c("px", i) * c("dx", i) + c("py", i) * c("dy", i),
        turn=lambda i: (c("dx", i) * c("py", i) - c("dy", i) * c("px", i)) * F.col(f"{name}_way"),
    )
    met = step(met, t=lambda i: F.greatest(F.lit(0.0), F.least(one, c("dot", i) * F.coalesce(one / (c("sq", i) + 1e-9), F.lit(0.0)))))
    met = step(met, ex=lambda i: c("px", i) - c("dx", i) * c("t", i), ey=lambda i: c("py", i) - c("dy", i) * c("t", i))
    depth = F.sqrt(F.least(*[c("ex", i) * c("ex", i) + c("ey", i) * c("ey", i) for i in range(4)]))
    depth = depth * F.when(F.least(*[c("turn", i) for i in range(4)]) >= 0, 1.0).otherwise(-1.0)
    sides = [f"{name}_{k}{i}" for k in ("sq", "dot", "turn", "dx", "dy", "t") for i in range(4)]
    return met.select(*columns, *sides, F.coalesce(depth, F.lit(0.0)).alias(name))


def _with_both(met: DataFrame) -> DataFrame:
    """:func:`_with_sides` of the larger outline ``o``, of which only the depth is kept, and of the panel ``i``, each in code of its own."""
    deep = _with_sides(met, "o").select(*met.columns, "o")
    return _with_sides(computed_once(deep.withColumnRenamed("o", "_o"), o=F.col("_o")).drop("_o", *[f"o_{a}{k}" for a in "xy" for k in range(4)]), "i")


def _strips(met: DataFrame, name: str, ends: float, frame: Frame, both: bool = False) -> tuple[DataFrame, list[Column]]:
    """Mean gray ``inside<i>, outside<i>`` of the strips along each side of a quad, as aggregates of the rows with ``beside<i>`` added.

    With ``both`` only those samples count where both strips lie on the photo.
    """
    c, beside = F.col, []
    for i in range(4):
        sq, dot, turn, dx, dy, t = [c(f"{name}_{k}{i}") for k in ("sq", "dot", "turn", "dx", "dy", "t")]
        off, size = F.abs(turn), F.sqrt(sq)
        near = (off >= NEAR * size) & (off <= FAR * size) & (dot >= ends * sq) & (dot <= (1 - ends) * sq)
        if both:
            for a, long, reach, across in (("x", dx, frame.width, dy), ("y", dy, frame.height, dx)):
                foot, out = c(f"{name}_{a}{i}") + long * t, F.abs(F.try_divide(FAR * across, size))
                near = near & F.coalesce((foot >= out) & (foot + out <= reach), F.lit(False))
        beside.append(near.alias(f"beside{i}"))
    met = met.select("*", *beside)
    means = []
    for i in range(4):
        near, turn = c(f"beside{i}"), c(f"{name}_turn{i}")
        means += [F.avg(F.when(near & (turn > 0), c("gray"))).alias(f"inside{i}"), F.avg(F.when(near & (turn < 0), c("gray"))).alias(f"outside{i}")]
    return met, means


def _shared(df: DataFrame) -> DataFrame:
    """The same rows behind a one-row generator: no reader drops columns from what lies below, so Spark shuffles that once for all its readers."""
    return computed_once(df, _row=F.struct("*")).select("_row.*")


def _counted(bands: dict[str, Column], means: Sequence[str]) -> list[Column]:
    """Aggregates: ``n_<band>`` of each band, ``gray_<band>`` and ``sat_<band>`` of those named."""
    counts = [F.count(F.when(where, 1)).alias(f"n_{b}") for b, where in bands.items()]
    return counts + [F.avg(F.when(bands[b], F.col(v))).alias(f"{v}_{b}") for b in means for v in ("gray", "sat")]


def with_terms(outlines: DataFrame, **quads: str) -> DataFrame:
    """Outlines with the terms of each named quad, each step in code of its own."""
    flat = computed_once(outlines, **{f"{name}_flat": g.flat_corners(F.col(of)) for name, of in quads.items()})
    return computed_once(flat, **{name: g.quad_terms(F.col(f"{name}_flat")) for name in quads}).drop(*[f"{name}_flat" for name in quads])


def with_depths(met: DataFrame, x: Column, y: Column, **terms: str) -> DataFrame:
    """Points with their depth in each named quad.

    Side by side: the compiler of the machine leaves methods above some size uncompiled, which a quad in one expression exceeds.
    """
    columns = met.columns
    for name, of in terms.items():
        for i in range(4):
            met = computed_once(met, **{f"{name}{i}": g.side_offset(x, y, F.col(of), i)})
        met = computed_once(met, **{name: g.quad_depth([F.col(f"{name}{i}") for i in range(4)])})
    return met.select(*columns, *terms)


def pair_evidence(pairs: DataFrame, samples: DataFrame, frame: Frame, inner: str = "inner", outer: str = "outer") -> DataFrame:
    """Add ``corners_on, print_inside, extra_paper`` and ``accepted`` to pairs ``photo, pick_idx, cand_idx`` of two outlines.

    ``print_inside``: beyond every side of the panel that is not on the larger outline lies blank margin, brighter than within, and there is
    such a side; sides without samples on them are not judged. ``extra_paper``: what the larger outline adds is paper like the panel's
    margin, and little of it looks like the surroundings. A pair is accepted if its larger outline holds the panel's corners or blank margin
    around it, and adds paper.

    Pairs meet the samples once for all means. Only those still open meet them again, with the means of their surroundings.
    """
    keys = [frame.photo, *PAIR]
    pairs = settle(corners_on_outline(pairs, inner, outer).withColumnRenamed("on_outline", "corners_on"), "pairs")
    c, points = F.col, _corners(inner, outer)
    flat = pairs.select(*keys, inner, outer, *_flat(i=inner, o=outer))
    bands = {
        "in": (c("i") >= 0) & (c("i") < BAND),
        "extra": (c("o") >= 0) & (c("o") < BAND) & (c("i") < 0),
        "out": (c("o") < 0) & (c("o") >= -BAND),
        "added": (c("o") >= BAND) & (c("i") <= -BAND),
    }
    met, strips = _strips(_with_both(meet_samples(flat, samples, frame, points, BAND).drop(inner, outer)), "i", PRINT_ENDS, frame)
    means = _shared(met.groupBy(*keys).agg(*_counted(bands, ("in", "extra", "out")), *strips))

    o = _corners(outer)
    diagonal = F.greatest(g.distance(o[0], o[2]), g.distance(o[1], o[3]))
    asked = with_terms(pairs.select(*keys, inner, outer, diagonal.alias("_diagonal")), _o=outer)
    for k in range(4):
        a, b = F.get(F.col(inner), F.lit(k)), F.get(F.col(inner), F.lit((k + 1) % 4))
        asked = with_depths(asked, (a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2, **{f"_off{k}": "_o"})
    off = [(F.abs(f"_off{k}") > ON_OUTLINE * F.col("_diagonal")).alias(f"_off{k}") for k in range(4)]
    judged = asked.select(*keys, *off).hint("merge").join(means, keys)
    brighter = [F.when(c(f"_off{k}"), c(f"outside{k}") >= c(f"inside{k}") + MARGIN_LIFT) for k in range(4)]
    margin = F.coalesce(*brighter).isNotNull()
    for b in brighter:
        margin = margin & F.coalesce(b, F.lit(True))
    by_means, by_added = extra_paper_tests()
    judged = judged.select(*keys, margin.alias("print_inside"), by_means.alias("_open"), "n_out", "n_added")

    asking = means.filter(by_means & (c("n_out") > MIN_BAND) & (c("n_added") > MIN_BAND)).select(*keys, "gray_out", "sat_out")
    again = flat.hint("merge").join(asking, keys)
    met = _with_both(meet_samples(again, samples, frame, points, BAND).drop(inner, outer))
    like = bands["added"] & like_colour(c("gray"), c("sat"), c("gray_out"), c("sat_out"))
    like = met.groupBy(*keys).agg(F.count(F.when(like, 1)).alias("n_like"))  # counted, as a filter would make other samples of those shuffled already
    paper = judged.join(like, keys, "left").select(*keys, "print_inside", (c("_open") & by_added).alias("extra_paper"))
    out = pairs.join(paper, keys, "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in ("corners_on", "print_inside", "extra_paper")})
    return out.withColumn("accepted", (c("corners_on") | c("print_inside")) & c("extra_paper"))


def grow_by_evidence(cands: DataFrame, samples: DataFrame, frame: Frame, corners: str = "corners", rounds: int = 3) -> DataFrame:
    """The rule-based pick of each photo: start at the best score and grow to the whole sheet, at most ``rounds`` times.

    A round takes the largest candidate that scores near the top, is clearly larger, contains the pick and is accepted by the samples.
    Only pairs that pass the first three tests meet samples. Each round starts from tables in the shared folder.
    """
    photo = frame.photo
    fields = ["cand_idx", "score", "area", "source", corners]
    own = F.struct(*fields)
    pick = cands.groupBy(photo).agg(F.max_by(own, F.struct("score", (-F.col("cand_idx")).alias("o"))).alias("best"))
    pick = settle(pick.select(photo, "best.*", F.col("best.score").alias("top_score")), "pick")
    for _ in range(rounds):
        now = pick.select(photo, F.col("cand_idx").alias("pick_idx"), F.col(corners).alias("inner"), F.col("area").alias("_area"), "top_score")
        near = cands.select(photo, *fields).hint("merge").join(now, photo)  # several candidates came of one row: larger than expected
        near = near.filter((F.col("score") >= F.col("top_score") - GROW_MARGIN) & (F.col("area") >= GROW_AREA * F.col("_area")))
        near = quad_overlap(near.withColumnRenamed(corners, "outer"), "inner", "outer")
        near = computed_once(near, _shared=F.col("overlap")).filter(F.col("_shared") >= GROW_CONTAINS * F.col("_area"))
        near = near.select(photo, *PAIR, "inner", "outer", "score", "area", "source")
        judged = pair_evidence(near, samples, frame).filter("accepted")
        found = F.struct("cand_idx", "score", "area", "source", F.col("outer").alias(corners))
        order = F.struct("area", "score", (-F.col("cand_idx")).alias("o"))
        grown = judged.groupBy(photo).agg(F.max_by(found, order).alias("grown"))
        grown = settle(grown, "grown")
        if grown.isEmpty():
            break
        merged = pick.join(grown, photo, "left")
        got = F.col("grown").isNotNull()
        values = {f: F.when(got, F.col("grown")[f]).otherwise(F.col(f)) for f in fields}
        values["score"] = F.when(got, F.greatest("grown.score", "score")).otherwise(F.col("score"))
        values["source"] = F.when(got, F.concat("grown.source", F.lit("+grown"))).otherwise(F.col("source"))
        pick = settle(merged.select(photo, *[values[f].alias(f) for f in fields], "top_score"), "pick")
    return pick.drop("top_score")


APPEARANCE = ("in_gray", "in_sat", "out_gray", "out_sat", "interior_bg", "outband_paper", "side_lift_max", "side_lift_min")


def appearance(cands: DataFrame, samples: DataFrame, frame: Frame, corners: str = "corners", idx: str = "cand_idx") -> DataFrame:
    """``photo, cand_idx`` and ``APPEARANCE``: the bands on both sides of the outline, how alike they are to the other side, and how much
    brighter it is beyond a side. 0 where nothing was sampled. A side counts where its strips lie on the photo."""
    keys, c = [frame.photo, idx], F.col
    own = cands.select(*keys, corners, *_flat(d=corners))
    bands = {"in": (c("d") >= 0) & (c("d") < BAND), "core": c("d") >= BAND, "out": (c("d") < 0) & (c("d") >= -BAND)}

    def met(outlines: DataFrame) -> DataFrame:
        return _with_sides(meet_samples(outlines, samples, frame, _corners(corners), BAND).drop(corners), "d")

    rows, strips = _strips(met(own), "d", LIFT_ENDS, frame, both=True)
    means = _shared(rows.groupBy(*keys).agg(*_counted(bands, ("in", "out")), *strips)).select("*", *band_means())
    lifts = [c(f"outside{i}") - c(f"inside{i}") for i in range(4)]
    looks = means.select(*keys, "n_core", "n_out", *APPEARANCE[:4], F.greatest(*lifts).alias("side_lift_max"), F.least(*lifts).alias("side_lift_min"))

    # the means go back to their outlines, which are few, and not to the samples that met them
    again = own.hint("merge").join(means.filter("_has_out").select(*keys, *APPEARANCE[:4]), keys)
    like_out, like_in = [like_colour(c("gray"), c("sat"), c(f"{side}_gray"), c(f"{side}_sat")) for side in ("out", "in")]
    like = met(again).groupBy(*keys).agg(F.count(F.when(bands["core"] & like_out, 1)).alias("_core"), F.count(F.when(bands["out"] & like_in, 1)).alias("_out"))
    shares = [F.try_divide(c("_core"), c("n_core")).alias("interior_bg"), F.try_divide(c("_out"), c("n_out")).alias("outband_paper")]
    looks = looks.join(like, keys, "left").select("*", *shares)
    return own.select(*keys).hint("merge").join(looks, keys, "left").select(*keys, *[F.coalesce(name, F.lit(0.0)).alias(name) for name in APPEARANCE])
