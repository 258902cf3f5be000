"""Page outlines: expanding, repairing, measuring, flattening and comparing them.

An outline is one row per photo (four corners and four edges of at most 257 points), so most of
these are projections without a shuffle. Point tables ``(photo, side, pos, x, y)`` are folded with
aggregates only.

Arrays built here are never empty and are flattened with the ``outer`` generators: the inner ones
make Spark add a size filter that repeats the whole array expression below.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import geometry as g

MIN_OUTLINE_AREA = 0.0004
STRAIGHT_RMS = 1.2


def outline_points(outlines: DataFrame, outline: str, width: Column, height: Column, photo: str = "photo_id") -> DataFrame:
    """One row per ring point in pixels: ``photo, pos, x, y``."""
    ring = outlines.select(photo, width.alias("_w"), height.alias("_h"), F.posexplode_outer(g.outline_ring(F.col(outline))).alias("pos", "p"))
    return ring.select(photo, "pos", (F.col("p.x") * F.col("_w")).alias("x"), (F.col("p.y") * F.col("_h")).alias("y"))


def default_outlines(photos: DataFrame, found: DataFrame, photo: str = "photo_id", corners: str = "corners") -> DataFrame:
    """An outline for every photo: straight edges through its corners, or the inset frame, not confident.

    ``found`` holds ``photo, corners, confident`` for the photos where a page was found.
    """
    joined = photos.join(found.select(photo, corners, "confident"), photo, "left")
    quad = F.coalesce(F.col(corners), g.full_frame())
    return joined.withColumn("_quad", quad).withColumn(
        "outline", g.straight_outline(F.col("_quad"), F.coalesce(F.col("confident"), F.lit(False)))
    ).drop("_quad", corners, "confident")


def edge_table(outlines: DataFrame, outline: str, photo: str = "photo_id") -> DataFrame:
    """Long form of the four edges: ``photo, edge, pos, x, y``."""
    o = F.col(outline)
    edges = F.array(*[
        F.struct(F.lit(name).alias("edge"), o[name].alias("points")) for name in ("top", "right", "bottom", "left")
    ])
    flat = outlines.select(photo, F.inline_outer(edges)).select(photo, "edge", F.posexplode_outer("points").alias("pos", "p"))
    return flat.select(photo, "edge", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def sanitize_outlines(received: DataFrame, outline: str = "outline") -> DataFrame:
    """Repair outlines that came over the network; add ``clean`` (null where it cannot be repaired).

    The received outline holds number pairs: ``corners, top, right, bottom, left`` as arrays of arrays.
    """
    o = F.col(outline)
    corners = o["corners"]
    sound = F.coalesce((F.size(corners) == 4) & F.forall(corners, g.valid_pair), F.lit(False))
    frame = received.withColumn("_quad", F.when(sound, F.transform(corners, g.pair_point)))
    quad = F.col("_quad")
    tl, tr, br, bl = g.quad_points(quad)
    clean = F.struct(
        quad.alias("corners"),
        g.clean_edge(o["top"], tl, tr).alias("top"), g.clean_edge(o["right"], tr, br).alias("right"),
        g.clean_edge(o["bottom"], bl, br).alias("bottom"), g.clean_edge(o["left"], tl, bl).alias("left"),
        F.lit(True).alias("confident"),
    )
    keep = quad.isNotNull() & (F.abs(g.quad_signed_area(quad)) > MIN_OUTLINE_AREA)
    return frame.withColumn("clean", F.when(keep, clean)).drop("_quad")


def polygon_stats(quads: DataFrame, quad: str = "corners") -> DataFrame:
    """Add signed and absolute area, centroid of the corners, convexity and corner angles."""
    q = F.col(quad)
    centre = g.mean_corner(q)
    return quads.select(
        "*",
        g.quad_signed_area(q).alias("signed_area"),
        F.abs(g.quad_signed_area(q)).alias("area"),
        centre["x"].alias("cx"),
        centre["y"].alias("cy"),
        g.quad_is_convex(q).alias("convex"),
        F.array(*g.quad_angles(q)).alias("angles"),
    )


def ring_stats(points: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Area and centroid of rings given as point tables, folded without gathering the ring.

    Each point meets its successor through :func:`~sheetwise.operators.ordered.ordered`.
    """
    from sheetwise.operators.ordered import first_of_group, following, ordered

    p = F.struct("x", "y")
    linked = ordered(points, keys, [pos], {"_next": following(p), "_first": first_of_group(p)})
    nxt = F.coalesce(F.col("_next"), F.col("_first"))
    cross = F.col("x") * nxt["y"] - nxt["x"] * F.col("y")
    return linked.groupBy(*keys).agg(
        (F.sum(cross) / 2).alias("signed_area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n")
    )


def nearest_side(points: DataFrame, quads: DataFrame, photo: str = "photo_id", quad: str = "corners") -> DataFrame:
    """Distance of each point (``x, y``) to the nearest side of its photo's quad: one row met per point."""
    joined = points.join(quads.select(photo, F.col(quad).alias("_quad")), photo)
    return joined.withColumn("distance", g.quad_distance(F.struct("x", "y"), F.col("_quad"))).drop("_quad")


def resample_by_arc_length(curves: DataFrame, n: int, points: str = "points", out: str = "resampled") -> DataFrame:
    """``n`` points evenly spaced along each polyline; a point-like run repeats its first point."""
    p, cum = F.col(points), F.col("_cum")
    last = F.size(p) - 1
    total = F.element_at(cum, -1)

    def at(i: Column) -> Column:
        target = total * i / F.lit(float(n - 1))
        segment = F.size(F.filter(F.slice(cum, F.lit(2), F.greatest(last - 1, F.lit(0))), lambda c: c < target))
        start, length = F.get(cum, segment), F.get(cum, segment + 1) - F.get(cum, segment)
        f = F.when(length < 1e-12, F.lit(0.0)).otherwise(F.try_divide(target - start, length))
        a, b = F.get(p, segment), F.get(p, segment + 1)
        return g.point(a["x"] + (b["x"] - a["x"]) * f, a["y"] + (b["y"] - a["y"]) * f)

    steps = F.sequence(F.lit(0), F.lit(n - 1))
    frame = curves.withColumn("_cum", g.arc_lengths(p))
    flat = (F.size(p) < 2) | (total < 1e-9)
    first = F.transform(steps, lambda i: g.point(F.get(p, F.lit(0))["x"], F.get(p, F.lit(0))["y"]))
    return frame.withColumn(out, F.when(F.size(p) == 0, None).when(flat, first).otherwise(F.transform(steps, at))).drop("_cum")


def chord_deviation(curves: DataFrame, points: str = "points") -> DataFrame:
    """Add ``deviation``: how far each polyline leaves its chord."""
    return curves.withColumn("deviation", g.chord_deviation(F.col(points)))


def rectify_points(
    points: DataFrame, quads: DataFrame, width: Column, height: Column, photo: str = "photo_id", quad: str = "corners",
    inverse: bool = False,
) -> DataFrame:
    """Add ``u, v``: each point in its page's flat ``width x height`` coordinates (``inverse``: back to the photo)."""
    joined = points.join(quads.select(photo, F.col(quad).alias("_quad")), photo)
    forward = g.square_to_quad(F.col("_quad"))
    if inverse:
        at = g.project(forward, F.col("x") / width, F.col("y") / height)
        u, v = at["x"], at["y"]
    else:
        at = g.project(g.adjugate(forward), F.col("x"), F.col("y"))
        u, v = at["x"] * width, at["y"] * height
    return joined.withColumn("u", u).withColumn("v", v).drop("_quad")


def order_corners(quads: DataFrame, quad: str = "corners") -> DataFrame:
    """Turn each quad's corners clockwise, starting with the side that points most to the right."""
    c, q = g.mean_corner(F.col(quad)), g.quad_points(F.col(quad))
    frame = quads.withColumn("_ring", F.sort_array(F.array(*[
        F.struct(F.atan2(q[i]["y"] - c["y"], q[i]["x"] - c["x"]).alias("angle"), F.lit(i).alias("i"), q[i]["x"].alias("x"), q[i]["y"].alias("y"))
        for i in range(4)
    ])))
    p = [F.col("_ring")[k] for k in range(4)]

    def rightward(i: int) -> Column:
        a, b = p[i], p[(i + 1) % 4]
        length = g.distance(a, b)
        score = F.when(length < 1e-9, F.lit(float("-inf"))).otherwise(F.try_divide(b["x"] - a["x"], length))
        return F.struct(score.alias("s"), F.lit(-i).alias("i"))

    frame = frame.withColumn("_start", -F.greatest(*[rightward(i) for i in range(4)])["i"])
    ring, start = F.col("_ring"), F.col("_start")
    turned = [F.get(ring, (F.lit(k) + start) % 4) for k in range(4)]
    return frame.withColumn(quad, F.array(*[g.point(t["x"], t["y"]) for t in turned])).drop("_ring", "_start")


def fit_lines(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Orthogonal least-squares line per group: mean point, direction angle, RMS distance, ``straight``."""
    sums = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("x").alias("px"), F.avg("y").alias("py"),
        F.var_pop("x").alias("_xx"), F.var_pop("y").alias("_yy"), F.covar_pop("x", "y").alias("_xy"),
    )
    half = (F.col("_xx") - F.col("_yy")) / 2
    spread = F.sqrt(half * half + F.col("_xy") * F.col("_xy"))
    least = F.greatest(F.lit(0.0), (F.col("_xx") + F.col("_yy")) / 2 - spread)
    return (
        sums.withColumn("angle", 0.5 * F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy")))
        .withColumn("rms", F.sqrt(least))
        .withColumn("straight", F.col("rms") < STRAIGHT_RMS)
        .drop("_xx", "_yy", "_xy")
    )


def corners_from_sides(
    points: DataFrame, rough: DataFrame, photo: str = "photo_id", quad: str = "corners", start: float = 0.2, stop: float = 0.8,
    parallel: float = 1e-6, max_shift: float = 0.12,
) -> DataFrame:
    """Corners where lines fitted to the middle of each side meet; a doubtful corner keeps the rough one.

    ``points`` holds ``photo, side, pos, n, x, y`` (``n`` = points of that side); corner ``i`` is where
    side ``i - 1`` meets side ``i``.
    """
    n = F.col("n")
    middle = points.filter((F.col("pos") >= F.floor(n * start)) & (F.col("pos") <= F.floor(n * stop)))
    lines = fit_lines(middle, [photo, "side"]).select(
        photo, "side", F.struct("px", "py", F.cos("angle").alias("dx"), F.sin("angle").alias("dy")).alias("line")
    )
    wide = lines.groupBy(photo).agg(*[F.max(F.when(F.col("side") == s, F.col("line"))).alias(f"_s{s}") for s in range(4)])
    joined = rough.join(wide, photo, "left")
    q = g.quad_points(F.col(quad))
    diagonal = g.distance(q[0], q[2])

    def corner(i: int) -> Column:
        a, b = F.col(f"_s{(i + 3) % 4}"), F.col(f"_s{i}")
        den = a["dx"] * b["dy"] - a["dy"] * b["dx"]
        t = F.try_divide((b["px"] - a["px"]) * b["dy"] - (b["py"] - a["py"]) * b["dx"], den)
        met = g.point(a["px"] + a["dx"] * t, a["py"] + a["dy"] * t)
        usable = (F.abs(den) >= parallel) & (g.distance(met, q[i]) <= max_shift * diagonal)
        return F.when(F.coalesce(usable, F.lit(False)), met).otherwise(q[i])

    return joined.withColumn("fitted", F.array(*[corner(i) for i in range(4)])).drop(*[f"_s{s}" for s in range(4)])


def best_four(hulls: DataFrame, points: str = "points", max_points: int = 14) -> DataFrame:
    """Of each photo's corners the four that enclose most area, first found on ties.

    The choices per row are bounded (1001 for 14 corners). A photo with more corners than ``max_points`` has to be simplified
    first: it is ``rejected`` and gets no area and no corners.
    """
    p = F.col(points)
    choices = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip("abcd", pick)], F.lit(-i).alias("o"))
        for i, pick in enumerate(sorted(combinations(range(max_points), 4)))
    ])

    def weigh(c: Column) -> Column:
        four = [F.get(p, c[n]) for n in "abcd"]
        area = F.abs(sum((g.cross_at(four[i], four[(i + 1) % 4]) for i in range(1, 4)), g.cross_at(four[0], four[1])) / 2)
        return F.struct(area.alias("area"), c["o"].alias("o"), *[c[n].alias(n) for n in "abcd"])

    usable = F.filter(choices, lambda c: c["d"] < F.size(p))
    rejected = F.coalesce(F.size(p) > max_points, F.lit(False))
    frame = hulls.withColumn("_best", F.when(~rejected, F.array_max(F.transform(usable, weigh))))
    corners = F.array(*[F.get(p, F.col(f"_best.{n}")) for n in "abcd"])
    return (
        frame.withColumn("best_area", F.col("_best.area"))
        .withColumn("best_corners", F.when(~rejected, corners))
        .withColumn("rejected", rejected)
        .drop("_best")
    )


def page_sizes(quads: DataFrame, width: Column, height: Column, quad: str = "corners") -> DataFrame:
    """Add the page's true ``ratio``, the ``paper`` it snaps to and the output ``out_width, out_height``.

    ``quad`` is in pixels of a ``width x height`` photo whose principal point is its centre.
    """
    q = g.quad_points(F.col(quad))
    frame = quads.select(
        "*",
        g.distance(q[0], q[1]).alias("_top"), g.distance(q[1], q[2]).alias("_right"),
        g.distance(q[3], q[2]).alias("_bottom"), g.distance(q[0], q[3]).alias("_left"),
        *[(q[i]["x"] - width / 2).alias(f"_x{i}") for i in range(4)],
        *[(q[i]["y"] - height / 2).alias(f"_y{i}") for i in range(4)],
        F.greatest(width, height).cast("double").alias("_long"),
    )
    c = F.col
    chord = (c("_top") + c("_bottom")) / F.greatest(c("_left") + c("_right"), F.lit(1e-6))

    def triple(i: int, j: int, k: int) -> Column:
        """Determinant of three homogeneous corners."""
        return (
            c(f"_x{i}") * (c(f"_y{j}") - c(f"_y{k}")) - c(f"_y{i}") * (c(f"_x{j}") - c(f"_x{k}"))
            + (c(f"_x{j}") * c(f"_y{k}") - c(f"_y{j}") * c(f"_x{k}"))
        )

    # Corner order TL TR BR BL; the two vanishing directions start at TL towards TR and BL.
    den2, den3 = triple(1, 2, 3), triple(3, 2, 1)
    frame = frame.select("*", chord.alias("_chord"), den2.alias("_d2"), den3.alias("_d3"),
                         F.try_divide(triple(0, 2, 3), den2).alias("_k2"), F.try_divide(triple(0, 2, 1), den3).alias("_k3"))
    frame = frame.select(
        "*",
        (c("_k2") * c("_x1") - c("_x0")).alias("_a2"), (c("_k2") * c("_y1") - c("_y0")).alias("_b2"), (c("_k2") - 1).alias("_c2"),
        (c("_k3") * c("_x3") - c("_x0")).alias("_a3"), (c("_k3") * c("_y3") - c("_y0")).alias("_b3"), (c("_k3") - 1).alias("_c3"),
    )
    ok2, ok3 = F.abs(c("_c2")) >= 0.04, F.abs(c("_c3")) >= 0.04
    focal = F.try_divide(-(c("_a2") * c("_a3") + c("_b2") * c("_b3")), c("_c2") * c("_c3"))
    in_range = F.coalesce(focal, F.lit(0.0)) > 0.0
    in_range = in_range & (focal > 0.35 * 0.35 * c("_long") * c("_long")) & (focal < 4.0 * c("_long") * c("_long"))
    frame = frame.withColumn("_f2", F.when(ok2 & ok3 & in_range, focal).otherwise(0.75 * 0.75 * c("_long") * c("_long")))
    across = (c("_a2") * c("_a2") + c("_b2") * c("_b2")) / c("_f2") + c("_c2") * c("_c2")
    down = (c("_a3") * c("_a3") + c("_b3") * c("_b3")) / c("_f2") + c("_c3") * c("_c3")
    raw = F.sqrt(F.try_divide(across, down))
    sane = (
        (F.abs(c("_d2")) >= 1e-9) & (F.abs(c("_d3")) >= 1e-9) & (ok2 | ok3) & (across > 0) & (down > 0)
        & (F.try_divide(raw, c("_chord")) > 0.5) & (F.try_divide(raw, c("_chord")) < 2.0)
    )
    frame = frame.withColumn("_ratio", F.when(F.coalesce(sane, F.lit(False)), raw).otherwise(c("_chord")))
    a4, letter = g.STANDARD_RATIOS
    ratio, paper = F.when(F.lit(False), F.lit(0.0)), F.when(F.lit(False), F.lit(""))
    for name, standard in (("a4", a4), ("letter", letter)):
        across_fit, down_fit = F.abs(c("_ratio") / standard - 1) < 0.03, F.abs(c("_ratio") * standard - 1) < 0.03
        ratio = ratio.when(across_fit, F.lit(standard)).when(down_fit, F.lit(1 / standard))
        paper = paper.when(across_fit, f"{name} landscape").when(down_fit, f"{name} portrait")
    frame = frame.withColumn("ratio", ratio.otherwise(c("_ratio"))).withColumn("paper", paper.otherwise("other"))
    scale = F.greatest(F.try_divide(F.greatest("_top", "_bottom"), c("ratio")), F.greatest("_left", "_right"))
    frame = frame.withColumn("_scale", scale)
    w, h = c("_scale") * c("ratio"), c("_scale")
    shrink = F.least(
        F.lit(1.0), F.try_divide(F.lit(g.MAX_LONG_EDGE), F.greatest(w, h)), F.sqrt(F.try_divide(F.lit(g.MAX_OUTPUT_PIXELS), w * h))
    )
    frame = frame.withColumn("out_width", F.greatest(F.lit(g.MIN_OUTPUT_SIDE), F.rint(w * shrink).cast("int"))).withColumn(
        "out_height", F.greatest(F.lit(g.MIN_OUTPUT_SIDE), F.rint(h * shrink).cast("int"))
    )
    return frame.drop(*[n for n in frame.columns if n.startswith("_")])


def page_size_report(sized: DataFrame) -> DataFrame:
    """Pages and mean ratio per paper size."""
    return sized.groupBy("paper").agg(F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("mean_ratio"))


def corner_error(pairs: DataFrame, found: str = "corners", truth: str = "truth") -> DataFrame:
    """Add ``corner``: least mean corner distance over both directions and four starts, % of the truth's diagonal."""
    def gap(i: int, j: int) -> str:
        dx, dy = f"({found}[{i}].x - {truth}[{j}].x)", f"({found}[{i}].y - {truth}[{j}].y)"
        return f"sqrt({dx} * {dx} + {dy} * {dy})"

    means = [
        "(" + " + ".join(gap(order[(i - k) % 4], i) for i in range(4)) + ") / 4" for order in ((0, 1, 2, 3), (3, 2, 1, 0)) for k in range(4)
    ]
    spans = [
        f"greatest({', '.join(f'{truth}[{i}].{a}' for i in range(4))}) - least({', '.join(f'{truth}[{i}].{a}' for i in range(4))})" for a in ("x", "y")
    ]
    diagonal = f"sqrt(({spans[0]}) * ({spans[0]}) + ({spans[1]}) * ({spans[1]}))"
    return pairs.withColumn("corner", F.expr(f"try_divide(least({', '.join(means)}), {diagonal}) * 100"))


def quad_overlap(pairs: DataFrame, a: str = "corners", b: str = "truth") -> DataFrame:
    """Add the shared ``overlap`` area of two convex quads per row, ``contained`` (share of a) and ``iou``.

    Exact: the boundary of the shared part is what each quad's sides have inside the other, and its
    area is the sum of the cross products of those pieces. Everything is unrolled scalar arithmetic.
    """
    frame = pairs.selectExpr("*", f"{_area_text(a)} AS _sa", f"{_area_text(b)} AS _sb")
    frame = frame.selectExpr("*", *_oriented(a, "a"), *_oriented(b, "b"))
    frame = frame.selectExpr("*", *_side_distances("a", "b"), *_side_distances("b", "a"))
    pieces = [_piece_inside("a", "b", i, True) for i in range(4)] + [_piece_inside("b", "a", i, False) for i in range(4)]
    frame = frame.selectExpr("*", f"({' + '.join(pieces)}) / 2 AS _total")
    shared = "coalesce(greatest(0.0D, least(_total, abs(_sa), abs(_sb))), 0.0D)"
    frame = frame.selectExpr(*pairs.columns, "_sa", "_sb", f"{shared} AS overlap")
    union = "abs(_sa) + abs(_sb) - overlap"
    return frame.selectExpr(
        *pairs.columns, "overlap", "try_divide(overlap, abs(_sa)) AS contained",
        f"CASE WHEN {union} > 0 THEN try_divide(overlap, {union}) ELSE 0.0D END AS iou"
    )


# The pieces are written as SQL text: some two hundred small terms, parsed in one go.
_ON_LINE = "1e-9D"


def _area_text(quad: str) -> str:
    turns = [f"({quad}[{i}].x * {quad}[{j}].y - {quad}[{j}].x * {quad}[{i}].y)" for i, j in ((0, 1), (1, 2), (2, 3), (3, 0))]
    return f"({' + '.join(turns)}) / 2"


def _oriented(quad: str, name: str) -> list[str]:
    """Corner columns ``_<name>x0.. _<name>y3``, turned clockwise on screen."""
    return [
        f"CASE WHEN _s{name} >= 0 THEN {quad}[{k}].{axis} ELSE {quad}[{3 - k}].{axis} END AS _{name}{axis}{k}"
        for k in range(4)
        for axis in ("x", "y")
    ]


def _side_distances(p: str, q: str) -> list[str]:
    """``_<p><q><i><j>``: signed distance of corner i of ``p`` from side j of ``q``, positive inside."""
    out = []
    for j in range(4):
        a, b = (f"_{q}x{j}", f"_{q}y{j}"), (f"_{q}x{(j + 1) % 4}", f"_{q}y{(j + 1) % 4}")
        dx, dy = f"({b[0]} - {a[0]})", f"({b[1]} - {a[1]})"
        length = f"greatest(sqrt({dx} * {dx} + {dy} * {dy}), 1e-300D)"
        out += [f"({dx} * (_{p}y{i} - {a[1]}) - {dy} * (_{p}x{i} - {a[0]})) / {length} AS _{p}{q}{i}{j}" for i in range(4)]
    return out


def _piece_inside(p: str, q: str, i: int, closed: bool) -> str:
    """Cross product of the part of side i of ``p`` inside ``q``; a shared side counts once, for the closed quad."""
    n = (i + 1) % 4
    ax, ay = f"_{p}x{i}", f"_{p}y{i}"
    ex, ey = f"(_{p}x{n} - {ax})", f"(_{p}y{n} - {ay})"
    lows, highs = ["0.0D"], ["1.0D"]
    for j in range(4):
        s, t = f"_{p}{q}{i}{j}", f"_{p}{q}{n}{j}"
        fx, fy = f"(_{q}x{(j + 1) % 4} - _{q}x{j})", f"(_{q}y{(j + 1) % 4} - _{q}y{j})"
        along = f"abs({s}) <= {_ON_LINE} AND abs({t}) <= {_ON_LINE}"
        kept = f"{ex} * {fx} + {ey} * {fy} > 0" if closed else "false"
        lows.append(
            f"CASE WHEN {along} THEN CASE WHEN {kept} THEN 0.0D ELSE 2.0D END "
            f"WHEN {s} < 0 AND {t} < 0 THEN 2.0D WHEN {s} < 0 THEN try_divide({s}, {s} - {t}) ELSE 0.0D END"
        )
        highs.append(f"CASE WHEN {along} THEN 1.0D WHEN {s} >= 0 AND {t} < 0 THEN try_divide({s}, {s} - {t}) ELSE 1.0D END")
    span = f"greatest(0.0D, least({', '.join(highs)}) - greatest({', '.join(lows)}))"
    # relative to the first corner, so that far-off coordinates cost no digits
    return f"{span} * (({ax} - _ax0) * {ey} - ({ay} - _ay0) * {ex})"


def corners_on_outline(
    pairs: DataFrame, inner: str, outer: str, near: float = 0.035, on_outline: float = 0.025, fold_depth: float = 0.10
) -> DataFrame:
    """Add ``on_outline``: the panel's corners lie on the larger outline and its other sides are folds well inside."""
    p, q = g.quad_points(F.col(inner)), g.quad_points(F.col(outer))
    diagonal = F.greatest(g.distance(q[0], q[2]), g.distance(q[1], q[3]))

    def between(a: Column, b: Column, t: float) -> Column:
        return g.point(a["x"] * (1 - t) + b["x"] * t, a["y"] * (1 - t) + b["y"] * t)

    # the probes as an array: sixteen times four distances written out are more than one compiled method may hold
    probes = F.array(*p, *[between(p[i], p[(i + 1) % 4], t) for i in range(4) for t in (0.25, 0.5, 0.75)])
    frame = pairs.withColumns({"_diag": diagonal, "_probes": probes, "_ring": F.array(*q)})
    frame = frame.withColumn("_off", F.transform("_probes", lambda c: g.polygon_distance(c, F.col("_ring"))))
    frame = frame.withColumn("_corner", F.array_max(F.slice("_off", 1, 4)))
    frame = frame.withColumn("_gaps", F.array(*[F.array_max(F.slice("_off", 5 + 3 * i, 3)) for i in range(4)]))
    d = F.col("_diag")
    beside = F.exists("_gaps", lambda gap: (gap > on_outline * d) & (gap < fold_depth * d))
    folded = F.exists("_gaps", lambda gap: gap >= fold_depth * d)
    verdict = (F.col("_corner") <= near * d) & ~beside & folded
    return frame.withColumn("on_outline", verdict).drop("_diag", "_probes", "_ring", "_off", "_corner", "_gaps")
