"""Outlines against samples: what must not grow on the driver, and the corner test by hand."""

import random

from pyspark.sql import functions as F

from sheetwise.operators import evidence, outlines


def quad(x0, y0, x1, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


CORNERS = "array<struct<x: double, y: double>>"


def test_spread_outlines_are_not_broadcast(spark, tmp_path):
    """A file of few rows becomes very many: one for each cell and side. Spark's estimate does not tell, so the join must not rely on it."""
    path = str(tmp_path / "outlines")
    spark.createDataFrame([(1, 0, quad(8, 8, 150, 150))], f"photo_id long, cand_idx long, corners {CORNERS}").write.parquet(path)
    few = spark.read.parquet(path)
    samples = spark.range(400).select(
        F.lit(1).cast("long").alias("photo_id"), (F.col("id") % 20 * 8 + 4.0).alias("x"), (F.floor(F.col("id") / 20) * 8 + 4.0).alias("y"),
        F.lit(100).alias("gray"), F.lit(20).alias("sat"),
    )
    frame = evidence.Frame(160, 160, cells=4)
    met = evidence.meet_samples(few, samples, frame, [F.col("corners")[k] for k in range(4)], evidence.BAND)
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 400


def test_corner_test_agrees_with_a_plain_computation(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        outer = quad(10, 10, 110, 150)
        inner = quad(10 + rnd.uniform(-4, 4), 10 + rnd.uniform(-4, 4), 110 + rnd.uniform(-4, 4), rnd.choice((70, 148)) + rnd.uniform(-4, 4))
        rows.append((i, inner if i % 9 else inner[:3] + [None], outer))
    pairs = spark.createDataFrame(rows, f"photo_id long, a {CORNERS}, b {CORNERS}").repartition(1)
    judged = outlines.corners_on_outline(pairs, "a", "b")

    def near(p, ring):
        best = None
        for i in range(4):
            a, b = ring[i], ring[(i + 1) % 4]
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            t = max(0.0, min(1.0, ((p[0] - a["x"]) * dx + (p[1] - a["y"]) * dy) / (dx * dx + dy * dy + 1e-9)))
            d = ((p[0] - a["x"] - dx * t) ** 2 + (p[1] - a["y"] - dy * t) ** 2) ** 0.5
            best = d if best is None else min(best, d)
        return best

    got = {r["photo_id"]: r["on_outline"] for r in judged.collect()}
    for i, inner, outer in rows:
        if None in inner:
            continue
        diagonal = (100**2 + 140**2) ** 0.5
        corner = max(near((p["x"], p["y"]), outer) for p in inner)
        gaps = []
        for k in range(4):
            a, b = inner[k], inner[(k + 1) % 4]
            gaps.append(max(near((a["x"] * (1 - t) + b["x"] * t, a["y"] * (1 - t) + b["y"] * t), outer) for t in (0.25, 0.5, 0.75)))
        want = corner <= 0.035 * diagonal and not any(0.025 * diagonal < x < 0.1 * diagonal for x in gaps) and any(x >= 0.1 * diagonal for x in gaps)
        assert got[i] == want, i
    assert {True, False} <= set(got.values())


def _shuffled(spark, action):
    """Rows that an action writes to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        stages = store.stageList(None, False, False, gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = total()
    result = action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return result, sum(n for stage, n in total().items() if stage not in before)


def test_samples_are_shuffled_once(spark):
    """Samples that met outlines, several of each, stay where they met: only the samples themselves and rows per outline and cell are dealt out."""
    photos, side = 60, 40
    samples = spark.range(photos * side * side).select(
        (F.col("id") % photos).alias("photo_id"), (F.floor(F.col("id") / photos) % side * 4 + 2.0).alias("x"),
        (F.floor(F.col("id") / (photos * side)) * 4 + 2.0).alias("y"), (F.col("id") % 97 + 100).cast("int").alias("gray"), (F.col("id") % 13).cast("int").alias("sat"),
    )
    quads = [quad(24, 24, 136, 86), quad(24, 24, 136, 155), quad(10, 12, 150, 150)]
    cands = spark.createDataFrame([(p, k, q) for p in range(photos) for k, q in enumerate(quads)], f"photo_id long, cand_idx long, corners {CORNERS}")
    pairs = spark.createDataFrame([(p, 0, k, quads[0], quads[k]) for p in range(photos) for k in (1, 2)], f"photo_id long, pick_idx long, cand_idx long, inner {CORNERS}, outer {CORNERS}")
    frame = evidence.Frame(160, 160, cells=4)
    looks, moved = _shuffled(spark, lambda: evidence.appearance(cands, samples, frame).collect())
    assert len(looks) == 3 * photos and moved < 1.5 * photos * side * side
    judged, moved = _shuffled(spark, lambda: evidence.pair_evidence(pairs, samples, frame).collect())
    assert len(judged) == 2 * photos and moved < 1.5 * photos * side * side


def test_samples_on_and_beyond_the_edge_are_met(spark):
    samples = spark.createDataFrame([(1, 80.0, 160.0, 100, 20), (1, 160.0, 80.0, 100, 20), (1, 161.0, 80.0, 100, 20), (1, None, 80.0, 100, 20)], "photo_id long, x double, y double, gray int, sat int")
    outline = spark.createDataFrame([(1, 0, quad(8, 8, 158, 158)), (2, 0, quad(8, 8, 158, 158))], f"photo_id long, cand_idx long, corners {CORNERS}")
    got = {r["photo_id"]: r for r in evidence.appearance(outline, samples, evidence.Frame(160, 160, cells=4)).collect()}
    met = evidence.meet_samples(outline, samples, evidence.Frame(160, 160, cells=4), [F.col("corners")[k] for k in range(4)], evidence.BAND)
    assert met.count() == 3 and len(got) == 2 and got[2]["in_gray"] == 0.0
