"""Outline geometry bound to the embeddings (see ``views.quads`` and ``views.curves``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query, table
from bindings.views import CURVES, QUADS, curves, quads
from sheetwise.functions import geometry as g
from sheetwise.operators import outlines as ops

LONG = "ql AS (" + " UNION ALL ".join(f"SELECT photo_id, {k} AS k, x{k} AS x, y{k} AS y FROM quads" for k in range(4)) + ")"


def rounded(*names):
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]


def points_of_curves(spark, d):
    flat = curves(spark, d).select("photo_id", F.posexplode_outer("points").alias("pos", "p"))
    return flat.select("photo_id", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def r6(e: str) -> str:
    return f"round({e}, 6) + 0.0"


EDGES = (("top", 0, 1), ("right", 1, 2), ("bottom", 3, 2), ("left", 0, 3))


def sql_edges(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT photo_id, '{name}' AS edge, p AS pos, x{a} + (x{b} - x{a}) * (p / 32) AS x, y{a} + (y{b} - y{a}) * (p / 32) AS y FROM {source}, (SELECT unnest(range(33))::INT AS p)"
        for name, a, b in EDGES
    )


@query("geo01_outline_points", f"""WITH {QUADS}, e AS ({sql_edges('quads')})
    SELECT photo_id, (CASE edge WHEN 'top' THEN pos WHEN 'right' THEN 33 + pos WHEN 'bottom' THEN 66 + 32 - pos ELSE 99 + 32 - pos END)::INT AS pos,
    {r6('x * 1600')} AS x, {r6('y * 1200')} AS y FROM e""")
def _(spark, d):
    outlines = quads(spark, d).select("photo_id", g.straight_outline(F.col("corners"), F.lit(True)).alias("outline"))
    return ops.outline_points(outlines, "outline", F.lit(1600), F.lit(1200)).select("photo_id", "pos", *rounded("x", "y"))


@query("geo02_default_outlines", f"""WITH {QUADS}, f AS (SELECT photo_id, family % 2 = 0 AS hit, {', '.join(f"CASE WHEN family % 2 = 0 THEN {a}{k} ELSE {v} END AS {a}{k}"
    for k, pair in enumerate(((0.03, 0.03), (0.97, 0.03), (0.97, 0.97), (0.03, 0.97))) for a, v in zip('xy', pair))} FROM quads), e AS ({sql_edges('f')})
    SELECT e.photo_id, f.hit AS confident, edge, pos, {r6('x')} AS x, {r6('y')} AS y FROM e JOIN f USING (photo_id)""")
def _(spark, d):
    all_quads = quads(spark, d)
    found = all_quads.filter(F.col("family") % 2 == 0).select("photo_id", "corners", F.lit(True).alias("confident"))
    out = ops.default_outlines(table(spark, d, "embeddings").select(F.col("vec_id").alias("photo_id")), found)
    out = out.select("photo_id", "outline", F.col("outline.confident").alias("confident"))
    edges = ops.edge_table(out.withColumn("key", F.struct("photo_id", "confident")), "outline", "key")
    return edges.select("key.photo_id", "key.confident", "edge", "pos", *rounded("x", "y"))


def _pairs(points):
    return F.transform(points, lambda p: F.array(p["x"], p["y"]))


@query("geo03_sanitize_outlines", f"""WITH {QUADS}, {CURVES}, top AS (SELECT photo_id, list(x ORDER BY pos) AS xs, list(y ORDER BY pos) AS ys FROM curves WHERE pos < 17 GROUP BY 1),
    j AS (SELECT q.*, xs, ys FROM quads q JOIN top USING (photo_id)),
    s AS (SELECT *, photo_id % 5 <> 1 AND photo_id % 5 <> 2 AND photo_id % 5 <> 3 AND abs(x0*y1-x1*y0 + x1*y2-x2*y1 + x2*y3-x3*y2 + x3*y0-x0*y3) / 2 > 0.0004 AS ok FROM j),
    i AS (SELECT unnest(range(33))::INT AS i), p AS (SELECT *, i / 32 * 16 AS place, floor(i / 32 * 16)::INT AS lo FROM s, i WHERE ok)
    SELECT photo_id, i AS pos,
      {r6("CASE i WHEN 0 THEN x0 WHEN 32 THEN x1 ELSE xs[lo + 1] + (xs[least(lo + 1, 16) + 1] - xs[lo + 1]) * (place - lo) END")} AS top_x,
      {r6("CASE i WHEN 0 THEN y0 WHEN 32 THEN y1 ELSE ys[lo + 1] + (ys[least(lo + 1, 16) + 1] - ys[lo + 1]) * (place - lo) END")} AS top_y,
      {r6("x1 + (x2 - x1) * (i / 32)")} AS right_x, {r6("x3 + (x2 - x3) * (i / 32)")} AS bottom_x, {r6("y0 + (y3 - y0) * (i / 32)")} AS left_y FROM p""")
def _(spark, d):
    turn = F.col("photo_id") % 5
    both = quads(spark, d).join(curves(spark, d).select("photo_id", "points"), "photo_id")
    corner = _pairs(F.col("corners"))
    broken = (
        F.when(turn == 1, F.slice(corner, 1, 3))  # three corners
        .when(turn == 2, F.concat(F.slice(corner, 1, 3), F.array(F.array(F.lit(float("nan")), F.lit(0.5)))))
        .when(turn == 3, F.concat(F.slice(corner, 1, 3), F.array(F.array(F.lit(0.5), F.lit(1.5)))))  # on the bound
        .otherwise(corner)
    )
    curve = _pairs(F.col("points"))
    received = both.select("photo_id", F.struct(
        broken.alias("corners"), F.slice(curve, 1, 17).alias("top"), F.lit(None).cast("array<array<double>>").alias("right"),
        F.slice(curve, 1, 1).alias("bottom"), F.array_repeat(F.array(F.lit(0.5), F.lit(0.5)), 258).alias("left"),
    ).alias("outline"))
    clean = ops.sanitize_outlines(received).filter(F.col("clean").isNotNull())
    zipped = F.arrays_zip("clean.top", "clean.right", "clean.bottom", "clean.left")
    flat = clean.select("photo_id", F.posexplode_outer(zipped).alias("pos", "z"))
    return flat.select(
        "photo_id", "pos", F.col("z.top.x").alias("top_x"), F.col("z.top.y").alias("top_y"), F.col("z.right.x").alias("right_x"),
        F.col("z.bottom.x").alias("bottom_x"), F.col("z.left.y").alias("left_y"),
    ).select("photo_id", "pos", *rounded("top_x", "top_y", "right_x", "bottom_x", "left_y"))


def sql_angle(a, b, c):
    ax, ay, bx, by = f"(x{a}-x{b})", f"(y{a}-y{b})", f"(x{c}-x{b})", f"(y{c}-y{b})"
    return f"degrees(acos(greatest(-1, least(1, ({ax}*{bx}+{ay}*{by})/(sqrt({ax}*{ax}+{ay}*{ay})*sqrt({bx}*{bx}+{by}*{by})+1e-9)))))"


def sql_turn(a, b, c):
    return f"((x{b}-x{a})*(y{c}-y{b})-(y{b}-y{a})*(x{c}-x{b}))"


SHOELACE = "(x0*y1-x1*y0 + x1*y2-x2*y1 + x2*y3-x3*y2 + x3*y0-x0*y3) / 2"
TURNS = [sql_turn(i, (i + 1) % 4, (i + 2) % 4) for i in range(4)]


@query("geo04_polygon_stats", f"""WITH {QUADS} SELECT photo_id, {r6(SHOELACE)} AS signed_area, {r6(f'abs({SHOELACE})')} AS area,
    {r6('(x0+x1+x2+x3)/4')} AS cx, {r6('(y0+y1+y2+y3)/4')} AS cy, ({' AND '.join(f'{t} >= 0' for t in TURNS)}) OR ({' AND '.join(f'{t} <= 0' for t in TURNS)}) AS convex,
    {r6('least(' + ', '.join(sql_angle((i + 3) % 4, i, (i + 1) % 4) for i in range(4)) + ')')} AS sharpest FROM quads""")
def _(spark, d):
    out = ops.polygon_stats(quads(spark, d).select("photo_id", "corners")).withColumn("sharpest", F.array_min("angles"))
    return out.select("photo_id", *rounded("signed_area", "area", "cx", "cy"), "convex", *rounded("sharpest"))


@query("geo04_ring_stats", f"""WITH {CURVES}, n AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM curves WINDOW w AS (PARTITION BY photo_id ORDER BY pos))
    SELECT photo_id, {r6('sum(x * ny - nx * y) / 2')} AS signed_area, {r6('avg(x)')} AS cx, {r6('avg(y)')} AS cy, count(*) AS n FROM n GROUP BY photo_id""")
def _(spark, d):
    return ops.ring_stats(points_of_curves(spark, d), ["photo_id"]).select("photo_id", *rounded("signed_area", "cx", "cy"), "n")


def sql_seg(px, py, a, b):
    t = f"greatest(0, least(1, (({px}-x{a})*(x{b}-x{a})+({py}-y{a})*(y{b}-y{a}))/((x{b}-x{a})*(x{b}-x{a})+(y{b}-y{a})*(y{b}-y{a})+1e-9)))"
    return f"sqrt(power({px}-(x{a}+(x{b}-x{a})*{t}),2)+power({py}-(y{a}+(y{b}-y{a})*{t}),2))"


def sql_ring_distance(px, py):
    return "least(" + ", ".join(sql_seg(px, py, i, (i + 1) % 4) for i in range(4)) + ")"


@query("geo05_nearest_side", f"WITH {QUADS}, {CURVES} SELECT photo_id, pos, {r6(sql_ring_distance('c.x', 'c.y'))} AS distance FROM curves c JOIN quads USING (photo_id)")
def _(spark, d):
    out = ops.nearest_side(points_of_curves(spark, d), quads(spark, d))
    return out.select("photo_id", "pos", *rounded("distance"))


@query("geo06_resample_by_arc_length", f"""WITH {CURVES}, s AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS step FROM curves WINDOW w AS (PARTITION BY photo_id ORDER BY pos)),
    c AS (SELECT *, sum(step) OVER (PARTITION BY photo_id ORDER BY pos) AS cum FROM s), l AS (SELECT *, lead(cum) OVER w AS cum2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, max(cum) OVER (PARTITION BY photo_id) AS total FROM c WINDOW w AS (PARTITION BY photo_id ORDER BY pos)),
    t AS (SELECT photo_id, i AS pos, total * i / 16 AS target FROM (SELECT DISTINCT photo_id, total FROM l), (SELECT unnest(range(17))::INT AS i)),
    m AS (SELECT t.photo_id, t.pos, t.target, arg_max(l.pos, l.pos) AS seg FROM t JOIN l ON l.photo_id = t.photo_id AND l.pos <= 31 AND (l.cum < t.target OR l.pos = 0) GROUP BY ALL)
    SELECT m.photo_id, m.pos, {r6('l.x + (l.x2 - l.x) * (m.target - l.cum) / (l.cum2 - l.cum)')} AS x, {r6('l.y + (l.y2 - l.y) * (m.target - l.cum) / (l.cum2 - l.cum)')} AS y FROM m JOIN l ON l.photo_id = m.photo_id AND l.pos = m.seg""")
def _(spark, d):
    out = ops.resample_by_arc_length(curves(spark, d).select("photo_id", "points"), 17)
    flat = out.select("photo_id", F.posexplode_outer("resampled").alias("pos", "p"))
    return flat.select("photo_id", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y")).select("photo_id", "pos", *rounded("x", "y"))


@query("geo07_chord_deviation", f"""WITH {CURVES}, e AS (SELECT *, first(x) OVER w AS ax, first(y) OVER w AS ay, last(x) OVER w AS bx, last(y) OVER w AS by_ FROM curves
    WINDOW w AS (PARTITION BY photo_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT photo_id, {r6('max(abs((x - ax) * (by_ - ay) - (y - ay) * (bx - ax)) / sqrt(power(bx - ax, 2) + power(by_ - ay, 2)))')} AS deviation FROM e GROUP BY photo_id""")
def _(spark, d):
    return ops.chord_deviation(curves(spark, d).select("photo_id", "points")).select("photo_id", *rounded("deviation"))


MAP = """m AS (SELECT *, (sx * dy2 - dx2 * sy) / den AS g, (dx1 * sy - sx * dy1) / den AS h FROM (SELECT *, dx1 * dy2 - dx2 * dy1 AS den FROM
    (SELECT *, x0-x1+x2-x3 AS sx, y0-y1+y2-y3 AS sy, x1-x2 AS dx1, x3-x2 AS dx2, y1-y2 AS dy1, y3-y2 AS dy2 FROM quads))),
    h AS (SELECT photo_id, x1-x0+g*x1 AS a, x3-x0+h*x3 AS b, x0 AS c, y1-y0+g*y1 AS d, y3-y0+h*y3 AS e, y0 AS f, g, h FROM m)"""


@query("geo08_rectify_points", f"""WITH {QUADS}, {CURVES}, {MAP}, z AS (SELECT c.photo_id, c.pos, (e - f*h)*x + (c.c_*h - b)*y + (b*f - c.c_*e) AS u,
        (f*g - d)*x + (a - c.c_*g)*y + (c.c_*d - a*f) AS v, (d*h - e*g)*x + (b*g - a*h)*y + (a*e - b*d) AS w
        FROM (SELECT curves.*, a, b, c AS c_, d, e, f, g, h FROM curves JOIN h USING (photo_id)) c)
    SELECT photo_id, pos, {r6('u / w * 210')} AS u, {r6('v / w * 297')} AS v FROM z""")
def _(spark, d):
    out = ops.rectify_points(points_of_curves(spark, d), quads(spark, d), F.lit(210.0), F.lit(297.0))
    return out.select("photo_id", "pos", *rounded("u", "v"))


@query("geo08_back_to_photo", f"""WITH {QUADS}, {CURVES}, {MAP} SELECT photo_id, pos, {r6('(a*c_.x + b*c_.y + h.c) / (g*c_.x + h.h*c_.y + 1)')} AS u,
    {r6('(d*c_.x + e*c_.y + f) / (g*c_.x + h.h*c_.y + 1)')} AS v FROM curves c_ JOIN h USING (photo_id)""")
def _(spark, d):
    out = ops.rectify_points(points_of_curves(spark, d), quads(spark, d), F.lit(1.0), F.lit(1.0), inverse=True)
    return out.select("photo_id", "pos", *rounded("u", "v"))


@query("geo09_order_corners", f"""WITH {QUADS}, {LONG}, c AS (SELECT *, (k * 3 + photo_id) % 4 AS i, avg(x) OVER (PARTITION BY photo_id) AS mx, avg(y) OVER (PARTITION BY photo_id) AS my FROM ql),
    o AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY atan2(y - my, x - mx), i) - 1 AS r FROM c),
    n AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM o WINDOW w AS (PARTITION BY photo_id ORDER BY r)),
    s AS (SELECT photo_id, r AS start FROM n QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY (nx - x) / sqrt(power(nx - x, 2) + power(ny - y, 2)) DESC, r) = 1)
    SELECT photo_id, ((r - start + 4) % 4)::INT AS k, {r6('x')} AS x, {r6('y')} AS y FROM o JOIN s USING (photo_id)""")
def _(spark, d):
    q = F.col("corners")
    # corner k goes to place (3k + photo_id) % 4
    shuffled = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(q, (((i - F.col("photo_id")) * 3 % 4 + 4) % 4).cast("int")))
    out = ops.order_corners(quads(spark, d).select("photo_id", shuffled.alias("corners")))
    flat = out.select("photo_id", F.posexplode_outer("corners").alias("k", "p"))
    return flat.select("photo_id", "k", F.col("p.x").alias("x"), F.col("p.y").alias("y")).select("photo_id", "k", *rounded("x", "y"))


SQL_FIT = """avg(x) AS px, avg(y) AS py, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS angle,
    sqrt(greatest(0, (var_pop(x) + var_pop(y)) / 2 - sqrt(power((var_pop(x) - var_pop(y)) / 2, 2) + power(covar_pop(x, y), 2)))) AS rms"""


@query("geo10_fit_lines", f"""WITH {CURVES}, f AS (SELECT photo_id, count(*) AS n, {SQL_FIT} FROM (SELECT photo_id, x * 100 AS x, y * 100 AS y FROM curves) GROUP BY photo_id)
    SELECT photo_id, n, {r6('px')} AS px, {r6('py')} AS py, {r6('angle')} AS angle, {r6('rms')} AS rms, rms < 1.2 AS straight FROM f""")
def _(spark, d):
    points = points_of_curves(spark, d).select("photo_id", (F.col("x") * 100).alias("x"), (F.col("y") * 100).alias("y"))
    return ops.fit_lines(points, ["photo_id"]).select("photo_id", "n", *rounded("px", "py", "angle", "rms"), "straight")


@query("geo11_corners_from_sides", f"""WITH {QUADS}, {CURVES}, sides AS (SELECT c.photo_id, s AS side, pos, [x0,x1,x2,x3][s+1] + ([x1,x2,x3,x0][s+1] - [x0,x1,x2,x3][s+1]) * (pos / 32) + c.y AS x,
        [y0,y1,y2,y3][s+1] + ([y1,y2,y3,y0][s+1] - [y0,y1,y2,y3][s+1]) * (pos / 32) + c.y AS y FROM curves c JOIN quads USING (photo_id), (SELECT unnest(range(4))::INT AS s)),
    l AS (SELECT photo_id, side, px, py, cos(angle) AS dx, sin(angle) AS dy FROM (SELECT photo_id, side, {SQL_FIT} FROM sides WHERE pos >= floor(33 * 0.2) AND pos <= floor(33 * 0.8) GROUP BY ALL)),
    p AS (SELECT b.photo_id, b.side AS k, a.dx * b.dy - a.dy * b.dx AS den, a.px + a.dx * (((b.px-a.px)*b.dy - (b.py-a.py)*b.dx) / (a.dx*b.dy - a.dy*b.dx)) AS mx,
        a.py + a.dy * (((b.px-a.px)*b.dy - (b.py-a.py)*b.dx) / (a.dx*b.dy - a.dy*b.dx)) AS my FROM l a JOIN l b ON a.photo_id = b.photo_id AND a.side = (b.side + 3) % 4),
    {LONG}, w AS (SELECT p.*, ql.x, ql.y, sqrt(power(x0-x2,2)+power(y0-y2,2)) AS diag FROM p JOIN ql USING (photo_id, k) JOIN quads USING (photo_id))
    SELECT photo_id, k, {r6('CASE WHEN abs(den) >= 1e-6 AND sqrt(power(mx-x,2)+power(my-y,2)) <= 0.12::DOUBLE * diag THEN mx ELSE x END')} AS x,
        {r6('CASE WHEN abs(den) >= 1e-6 AND sqrt(power(mx-x,2)+power(my-y,2)) <= 0.12::DOUBLE * diag THEN my ELSE y END')} AS y FROM w""")
def _(spark, d):
    rough = quads(spark, d).select("photo_id", "corners")
    bow = rough.join(curves(spark, d).select("photo_id", "points"), "photo_id")
    flat = bow.select("photo_id", "corners", F.posexplode_outer("points").alias("pos", "p")).select(
        "*", F.explode(F.array(*[F.lit(s) for s in range(4)])).alias("side")
    )
    a, b = F.get("corners", F.col("side")), F.get("corners", (F.col("side") + 1) % 4)
    sides = flat.select(
        "photo_id", "side", "pos", F.lit(33).alias("n"),
        (a["x"] + (b["x"] - a["x"]) * (F.col("pos") / 32) + F.col("p.y")).alias("x"),
        (a["y"] + (b["y"] - a["y"]) * (F.col("pos") / 32) + F.col("p.y")).alias("y"),
    )
    out = ops.corners_from_sides(sides, rough).select("photo_id", F.posexplode_outer("fitted").alias("k", "p"))
    return out.select("photo_id", "k", F.col("p.x").alias("x"), F.col("p.y").alias("y")).select("photo_id", "k", *rounded("x", "y"))


@query("geo12_best_four", f"""WITH pts AS (SELECT vec_id AS photo_id, k, embedding[2*k+1]::DOUBLE AS x, embedding[2*k+2]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(8))::INT AS k)),
    q AS (SELECT a.photo_id, a.k AS a, b.k AS b, c.k AS c, d.k AS d, abs(a.x*b.y-b.x*a.y + b.x*c.y-c.x*b.y + c.x*d.y-d.x*c.y + d.x*a.y-a.x*d.y) / 2 AS area
        FROM pts a JOIN pts b ON a.photo_id = b.photo_id AND a.k < b.k JOIN pts c ON a.photo_id = c.photo_id AND b.k < c.k JOIN pts d ON a.photo_id = d.photo_id AND c.k < d.k)
    SELECT photo_id, {r6('max(area)')} AS best_area FROM q GROUP BY photo_id""")
def _(spark, d):
    e = F.col("embedding")
    hull = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: g.point(F.get(e, 2 * k).cast("double"), F.get(e, 2 * k + 1).cast("double")))
    hulls = table(spark, d, "embeddings").select(F.col("vec_id").alias("photo_id"), hull.alias("points"))
    return ops.best_four(hulls, max_points=8).select("photo_id", *rounded("best_area"))


SCALED = ", ".join(f"x{k} * 1600 AS x{k}, y{k} * 1200 AS y{k}" for k in range(4))


def _tri(i, j, k):
    return f"(u{i}*(v{j}-v{k}) - v{i}*(u{j}-u{k}) + (u{j}*v{k}-v{j}*u{k}))"


PAGES = f"""s AS (SELECT photo_id, {SCALED} FROM quads), l AS (SELECT *, sqrt(power(x0-x1,2)+power(y0-y1,2)) AS tp, sqrt(power(x1-x2,2)+power(y1-y2,2)) AS rt,
        sqrt(power(x3-x2,2)+power(y3-y2,2)) AS bt, sqrt(power(x0-x3,2)+power(y0-y3,2)) AS lf, {', '.join(f'x{k}-800 AS u{k}, y{k}-600 AS v{k}' for k in range(4))} FROM s),
    k AS (SELECT *, (tp+bt)/greatest(lf+rt,1e-6) AS chord, {_tri(0,2,3)}/{_tri(1,2,3)} AS k2, {_tri(0,2,1)}/{_tri(3,2,1)} AS k3, {_tri(1,2,3)} AS d2, {_tri(3,2,1)} AS d3 FROM l),
    n AS (SELECT *, k2*u1-u0 AS a2, k2*v1-v0 AS b2, k2-1 AS c2, k3*u3-u0 AS a3, k3*v3-v0 AS b3, k3-1 AS c3 FROM k),
    f AS (SELECT *, CASE WHEN abs(c2) >= 0.04 AND abs(c3) >= 0.04 AND -(a2*a3+b2*b3)/(c2*c3) > 0.1225*1600*1600 AND -(a2*a3+b2*b3)/(c2*c3) < 4.0*1600*1600 THEN -(a2*a3+b2*b3)/(c2*c3) ELSE 0.5625*1600*1600 END AS f2 FROM n),
    r AS (SELECT *, sqrt(((a2*a2+b2*b2)/f2 + c2*c2) / ((a3*a3+b3*b3)/f2 + c3*c3)) AS raw FROM f),
    q AS (SELECT *, CASE WHEN abs(d2) >= 1e-9 AND abs(d3) >= 1e-9 AND (abs(c2) >= 0.04 OR abs(c3) >= 0.04) AND raw/chord > 0.5 AND raw/chord < 2 THEN raw ELSE chord END AS r0 FROM r),
    p AS (SELECT *, CASE WHEN abs(r0/(297.0::DOUBLE/210)-1) < 0.03 THEN 'a4 landscape' WHEN abs(r0*(297.0::DOUBLE/210)-1) < 0.03 THEN 'a4 portrait'
        WHEN abs(r0/(11.0::DOUBLE/8.5)-1) < 0.03 THEN 'letter landscape' WHEN abs(r0*(11.0::DOUBLE/8.5)-1) < 0.03 THEN 'letter portrait' ELSE 'other' END AS paper FROM q),
    t AS (SELECT *, CASE paper WHEN 'a4 landscape' THEN 297.0::DOUBLE/210 WHEN 'a4 portrait' THEN 210.0::DOUBLE/297 WHEN 'letter landscape' THEN 11.0::DOUBLE/8.5 WHEN 'letter portrait' THEN 8.5::DOUBLE/11 ELSE r0 END AS ratio FROM p),
    z AS (SELECT *, greatest(greatest(tp, bt)/ratio, greatest(lf, rt)) AS sc FROM t),
    y AS (SELECT *, least(1, 6000/greatest(sc*ratio, sc), sqrt(24000000/(sc*ratio*sc))) AS sh FROM z)"""


@query("geo13_page_sizes", f"""WITH {QUADS}, {PAGES} SELECT photo_id, paper, {r6('ratio')} AS ratio, greatest(64, round_even(sc*ratio*sh, 0)::INT) AS out_width, greatest(64, round_even(sc*sh, 0)::INT) AS out_height FROM y""")
def _(spark, d):
    pixels = F.transform("corners", lambda p: g.point(p["x"] * 1600, p["y"] * 1200))
    out = ops.page_sizes(quads(spark, d).select("photo_id", pixels.alias("corners")), F.lit(1600), F.lit(1200))
    return out.select("photo_id", "paper", *rounded("ratio"), "out_width", "out_height")


@query("geo13_page_size_report", f"WITH {QUADS}, {PAGES} SELECT paper, count(*) AS n, {r6('avg(ratio)')} AS mean_ratio FROM y GROUP BY paper")
def _(spark, d):
    pixels = F.transform("corners", lambda p: g.point(p["x"] * 1600, p["y"] * 1200))
    out = ops.page_sizes(quads(spark, d).select("photo_id", pixels.alias("corners")), F.lit(1600), F.lit(1200))
    return ops.page_size_report(out).select("paper", "n", *rounded("mean_ratio"))


def sql_corner_error(scale_x="1", scale_y="1"):
    means = []
    for order in ((0, 1, 2, 3), (3, 2, 1, 0)):
        for k in range(4):
            terms = " + ".join(
                f"sqrt(power((x{order[(i - k) % 4]}-tx{i})*{scale_x},2)+power((y{order[(i - k) % 4]}-ty{i})*{scale_y},2))" for i in range(4)
            )
            means.append(f"({terms}) / 4")
    span = [f"(greatest({','.join(f't{a}{i}' for i in range(4))})-least({','.join(f't{a}{i}' for i in range(4))}))*{s}" for a, s in (("x", scale_x), ("y", scale_y))]
    return f"least({', '.join(means)}) / sqrt(power({span[0]},2)+power({span[1]},2)) * 100"


@query("geo14_corner_error", f"WITH {QUADS} SELECT photo_id, {r6(sql_corner_error())} AS corner FROM quads")
def _(spark, d):
    return ops.corner_error(quads(spark, d)).select("photo_id", *rounded("corner"))


def sql_clipped(p, q):
    """Shoelace share of each side of quad ``p`` inside quad ``q`` (prefixes of the corner columns)."""
    parts = []
    for i in range(4):
        ax, ay, bx, by = f"{p}x{i}", f"{p}y{i}", f"{p}x{(i + 1) % 4}", f"{p}y{(i + 1) % 4}"
        lows, highs = ["0.0"], ["1.0"]
        for j in range(4):
            cx, cy, dx, dy = f"{q}x{j}", f"{q}y{j}", f"{q}x{(j + 1) % 4}", f"{q}y{(j + 1) % 4}"
            sp = f"(({dx}-{cx})*({ay}-{cy})-({dy}-{cy})*({ax}-{cx}))"
            sq = f"(({dx}-{cx})*({by}-{cy})-({dy}-{cy})*({bx}-{cx}))"
            lows.append(f"(CASE WHEN {sp} < 0 AND {sq} < 0 THEN 2.0 WHEN {sp} < 0 THEN {sp}/({sp}-{sq}) ELSE 0.0 END)")
            highs.append(f"(CASE WHEN {sp} >= 0 AND {sq} < 0 THEN {sp}/({sp}-{sq}) ELSE 1.0 END)")
        lo, hi = f"greatest({', '.join(lows)})", f"least({', '.join(highs)})"
        ex, ey = f"({bx}-{ax})", f"({by}-{ay})"
        # cross of the clipped ends: (a + e*lo) x (a + e*hi) = (hi - lo) * (a x e)
        parts.append(f"(greatest(0.0, {hi} - {lo}) * ({ax}*{ey} - {ay}*{ex}))")
    return " + ".join(parts)


OVERLAP = f"""ov AS (SELECT *, ({sql_clipped('', 't')} + {sql_clipped('t', '')}) / 2 AS shared, abs({SHOELACE}) AS aa,
    abs((tx0*ty1-tx1*ty0 + tx1*ty2-tx2*ty1 + tx2*ty3-tx3*ty2 + tx3*ty0-tx0*ty3) / 2) AS ab FROM quads)"""


@query("geo15_quad_overlap", f"WITH {QUADS}, {OVERLAP} SELECT photo_id, {r6('shared')} AS overlap, {r6('shared / aa')} AS contained, {r6('shared / (aa + ab - shared)')} AS iou FROM ov")
def _(spark, d):
    return ops.quad_overlap(quads(spark, d)).select("photo_id", *rounded("overlap", "contained", "iou"))


PANEL = [(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.0, 0.5)]  # the upper half of a page folded across


def _sql_probe(i, t):
    j = (i + 1) % 4
    return f"(px{i}*{1 - t}::DOUBLE+px{j}*{t}::DOUBLE)", f"(py{i}*{1 - t}::DOUBLE+py{j}*{t}::DOUBLE)"


@query("geo16_corners_on_outline", f"""WITH {QUADS}, p AS (SELECT *, x0 AS px0, y0 AS py0, x1 AS px1, y1 AS py1, x1+(x2-x1)*f AS px2, y1+(y2-y1)*f AS py2, x0+(x3-x0)*f+0.02::DOUBLE*(photo_id%3) AS px3, y0+(y3-y0)*f AS py3,
        greatest(sqrt(power(x0-x2,2)+power(y0-y2,2)), sqrt(power(x1-x3,2)+power(y1-y3,2))) AS diag FROM (SELECT *, 0.5::DOUBLE + (photo_id % 6) / 12 AS f FROM quads)),
    c AS (SELECT photo_id, diag, greatest({', '.join(sql_ring_distance(f'px{i}', f'py{i}') for i in range(4))}) AS corner,
        {', '.join('greatest(' + ', '.join(sql_ring_distance(*_sql_probe(i, t)) for t in (0.25, 0.5, 0.75)) + f') AS g{i}' for i in range(4))} FROM p)
    SELECT photo_id, corner <= 0.035::DOUBLE * diag AND NOT ({' OR '.join(f'(g{i} > 0.025::DOUBLE * diag AND g{i} < 0.1::DOUBLE * diag)' for i in range(4))})
        AND ({' OR '.join(f'g{i} >= 0.1::DOUBLE * diag' for i in range(4))}) AS on_outline FROM c""")
def _(spark, d):
    tl, tr, br, bl = g.quad_points(F.col("corners"))
    share = 0.5 + F.col("photo_id") % 6 / 12

    def down(a, b, push):
        return g.point(a["x"] + (b["x"] - a["x"]) * share + push, a["y"] + (b["y"] - a["y"]) * share)

    panel = F.array(tl, tr, down(tr, br, F.lit(0.0)), down(tl, bl, 0.02 * (F.col("photo_id") % 3)))
    pairs = quads(spark, d).select("photo_id", "corners", panel.alias("panel"))
    return ops.corners_on_outline(pairs, "panel", "corners").select("photo_id", "on_outline")
