import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.operators import outlines

NAN = float("nan")
SQUARE = [[0.1, 0.1], [0.9, 0.1], [0.9, 0.9], [0.1, 0.9]]


def quad_frame(spark, rows, names=("corners", "truth")):
    schema = "id int, " + ", ".join(f"{n} array<struct<x: double, y: double>>" for n in names)
    return spark.createDataFrame([(i, *[[tuple(map(float, p)) for p in q] for q in r]) for i, r in enumerate(rows)], schema)


def raster(q, n=800):
    ys, xs = np.mgrid[0:n, 0:n] / n + 0.5 / n
    inside = np.ones((n, n), bool)
    area = sum(q[i][0] * q[(i + 1) % 4][1] - q[(i + 1) % 4][0] * q[i][1] for i in range(4))
    for i in range(4):
        (ax, ay), (bx, by) = q[i], q[(i + 1) % 4]
        inside &= np.sign(area) * ((bx - ax) * (ys - ay) - (by - ay) * (xs - ax)) >= 0
    return inside


def test_overlap_equals_counted_cells(spark):
    rng = random.Random(1)

    def quad():
        return [[bx + rng.uniform(-0.15, 0.15), by + rng.uniform(-0.15, 0.15)] for bx, by in ((0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75))]

    pairs = [(quad(), quad()[:: rng.choice([1, -1])]) for _ in range(25)]
    for r in outlines.quad_overlap(quad_frame(spark, pairs)).collect():
        a, b = (raster(q) for q in pairs[r.id])
        assert r.iou == pytest.approx((a & b).sum() / (a | b).sum(), abs=0.01)


def test_overlap_of_touching_quads(spark):
    unit = [[0, 0], [1, 0], [1, 1], [0, 1]]
    right = [[1, 0], [2, 0], [2, 1], [1, 1]]
    half = [[0, 0], [0.5, 0], [0.5, 1], [0, 1]]
    inner = [[0.25, 0.25], [0.75, 0.25], [0.75, 0.75], [0.25, 0.75]]
    far = [[5, 5], [6, 5], [6, 6], [5, 6]]
    pairs = [(unit, unit), (unit, right), (unit, half), (half, unit), (unit, inner), (inner, unit), (unit, far), (unit, unit[::-1])]
    got = [r.overlap for r in outlines.quad_overlap(quad_frame(spark, pairs)).orderBy("id").collect()]
    assert got == pytest.approx([1, 0, 0.5, 0.5, 0.25, 0.25, 0, 1], abs=1e-9)


def test_sanitize(spark):
    bowed = [[0.1, 0.1], [0.5, 0.05], [0.9, 0.1]]
    cases = {
        "good": (SQUARE, bowed), "nan": ([[NAN, 0.1], *SQUARE[1:]], bowed), "flat": ([[0.5, 0.5]] * 4, bowed), "far": ([[9.0, 9.0]] * 4, bowed),
        "three": (SQUARE[:3], bowed), "bound": ([[-0.5, 0.1], *SQUARE[1:]], bowed), "long": (SQUARE, [[0.5, 0.5]] * 258), "none": (None, None),
    }
    edge = "array<array<double>>"
    frame = spark.createDataFrame(
        [(k, (c, t, None, None, None)) for k, (c, t) in cases.items()],
        f"name string, outline struct<corners: {edge}, top: {edge}, right: {edge}, bottom: {edge}, left: {edge}>",
    )
    got = {r.name: r.clean for r in outlines.sanitize_outlines(frame).collect()}
    assert {k for k, v in got.items() if v is not None} == {"good", "long"}
    top = got["good"].top
    assert len(top) == 33 and top[16].y == pytest.approx(0.05) and (top[0].x, top[32].x) == (0.1, 0.9) and got["good"].confident
    assert all(p.y == pytest.approx(0.1) for p in got["long"].top)


def test_page_size_of_a_photographed_sheet(spark):
    # a sheet of 210 x 297 mm tilted by 25 degrees, seen with a focal length of 1200 px
    tilt, focal, away = math.radians(25), 1200.0, 600.0
    corners = []
    for x, y in ((-105, -148.5), (105, -148.5), (105, 148.5), (-105, 148.5)):
        depth = away - y * math.sin(tilt)
        corners.append([800 + focal * x / depth, 600 + focal * y * math.cos(tilt) / depth])
    r = outlines.page_sizes(quad_frame(spark, [(corners,)], ("corners",)), F.lit(1600), F.lit(1200)).first()
    assert r.paper == "a4 portrait" and r.ratio == pytest.approx(210 / 297)
    assert r.out_height > r.out_width >= 64


def test_order_corners_and_best_four(spark):
    shuffled = [SQUARE[i] for i in (2, 0, 3, 1)]
    r = outlines.order_corners(quad_frame(spark, [(shuffled,)], ("corners",))).first()
    assert [[p.x, p.y] for p in r.corners] == SQUARE
    hull = [[0, 0], [0.5, -0.1], [1, 0], [1, 1], [0.4, 1.05], [0, 1]]
    best = outlines.best_four(quad_frame(spark, [(hull,)], ("points",))).first()
    assert best.best_area == pytest.approx(1.0)


def test_resample_degenerate_runs(spark):
    rows = [([[1, 2]],), ([[1, 1], [1, 1]],), ([[0, 0], [1, 0], [1, 3]],)]
    got = outlines.resample_by_arc_length(quad_frame(spark, rows, ("points",)), 5).orderBy("id").collect()
    assert [(p.x, p.y) for p in got[0].resampled] == [(1, 2)] * 5
    assert [(p.x, p.y) for p in got[1].resampled] == [(1, 1)] * 5
    assert [(p.x, p.y) for p in got[2].resampled] == [(0, 0), (1, 0), (1, 1), (1, 2), (1, 3)]


def test_geometry_stays_in_one_stage(spark):
    plan = outlines.quad_overlap(quad_frame(spark, [(SQUARE, SQUARE)]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
