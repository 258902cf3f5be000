import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.operators import candidates, matching, scoring, series, sessions, stats


def test_cheapest_path_against_all_paths():
    rng = np.random.default_rng(0)
    for reach, center in ((12, 1), (1, None), (2, 3)):
        table = rng.random((5, 4)).round(3)
        pull = 0.0 if center is None else 0.02 * np.abs(np.arange(4) - center)
        ends = np.zeros(4) + pull

        def cost(path):
            moves = sum(0.04 * abs(b - a) + 0.02 * (b - a) ** 2 for a, b in zip(path, path[1:]))
            return sum(table[i][s] for i, s in enumerate(path)) + moves + ends[path[0]] + ends[path[-1]]

        legal = [p for p in itertools.product(range(4), repeat=5) if all(abs(b - a) <= reach for a, b in zip(p, p[1:]))]
        best = min(cost(p) for p in legal)
        found = series.cheapest_path(table, pull, reach, 0.04, 0.02)
        assert cost(tuple(found)) == pytest.approx(best)


def test_track_per_group(spark):
    rows = [("s", i, j, 0.0 if j == 2 else 1.0) for i in range(6) for j in range(5)] + [("t", i, j, float(j)) for i in range(3) for j in range(3)]
    got = series.min_cost_track(spark.createDataFrame(rows, "k string, i int, j int, c double"), ["k"], "i", "j", "c").collect()
    assert {(r.k, r.i, r.j) for r in got} == {("s", i, 2) for i in range(6)} | {("t", i, 0) for i in range(3)}


def test_tracks_side_by_side_are_those_of_one_side():
    rng = np.random.default_rng(3)
    tables = [rng.integers(0, 4, (n, w)) / 4 for n, w in ((1, 4), (9, 6), (4, 1), (7, 24), (30, 24), (1, 1))]
    tables[1][3, :5] = np.inf
    for reach, center in ((12, 1), (1, None), (2, 3)):
        pulls = [0.0 if center is None else 0.02 * np.abs(np.arange(t.shape[1]) - center) for t in tables]
        got = series.cheapest_paths(tables, pulls, reach, 0.04, 0.02)
        for table, pull, path in zip(tables, pulls, got, strict=True):
            assert path.tolist() == series.cheapest_path(table, pull, reach, 0.04, 0.02).tolist()


def test_track_fills_cells_in_the_task(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_CELLS", 40)
    rows = [(k, i, (k + i * i) % 6, float(i % 3) - 2) for k in range(40) for i in range(k % 9 + 1)]
    rows += [(None, 3, 1, -1.0), (None, 5, 2, None), (7, 2, 9, -4.0)]
    lines = spark.createDataFrame(rows, "k long, i int, j int, c double").repartition(3)
    grid = lines.select("k", "i").distinct().select("k", "i", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"), F.lit(0.0).alias("c"))
    want = series.min_cost_track(lines.unionByName(grid), ["k"], "i", "j", "c", center=2).collect()
    got = series.min_cost_track(lines, ["k"], "i", "j", "c", center=2, fill=(0, 5, 0.0))
    assert "Generate" not in got._jdf.queryExecution().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == lines.select("k", "i").distinct().count()


@pytest.mark.parametrize("hot", [None, 5])
def test_runs_from_edge(spark, hot):
    lines = {"a": "1100011110000111", "b": "0000", "c": "00011", "d": "1", "e": "00001"}
    rows = [(k, i, v == "1") for k, s in lines.items() for i, v in enumerate(s)]
    frame = spark.createDataFrame(rows, "k string, i int, h boolean")
    got = {r.k: r.depth for r in series.runs_from_edge(frame, ["k"], ["i"], F.col("h"), hot_rows=hot).collect()}
    assert got == {"a": 9, "b": 0, "c": 5, "d": 1, "e": 0}


def test_stalled_transfers(spark):
    rows = [("exact", 0.0, "sending"), ("exact", 30.0, "done"), ("late", 0.0, "sending"), ("late", 31.0, "done"), ("answer", 0.0, "processing"), ("answer", 91.0, "done"), ("silent", 5.0, "sending")]
    frame = spark.createDataFrame(rows, "k string, at double, phase string")
    got = sessions.stalled_transfers(frame, ["k"], ["at"], "at", "phase", F.lit(1000.0)).collect()
    assert {r.k: r.timed_out_at for r in got} == {"late": 30.0, "answer": 90.0, "silent": 35.0}


def test_session_rules(spark):
    rows = [
        ("a", 1, "create", "x.jpg", "auto", 0), ("a", 2, "update", None, "bw", None), ("a", 3, "delete", None, None, None), ("a", 4, "update", None, "gray", 90),
        ("b", 1, "update", None, "bw", None), ("b", 2, "create", "y.jpg", "auto", 0), ("b", 3, "update", None, None, 180), ("c", 9, "update", None, "bw", None),
    ]
    frame = spark.createDataFrame(rows, "s string, t int, op string, name string, filter string, rotate int")
    got = {r.s: r for r in sessions.session_fold(frame, ["s"], ["t"]).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].filter, got["a"].rotate, got["a"].version, got["a"].deleted, got["a"].rejected) == ("bw", 0, 1, True, 1)
    assert (got["b"].filter, got["b"].rotate, got["b"].version, got["b"].deleted, got["b"].rejected) == ("auto", 180, 1, False, 1)


def test_thirty_one_creates(spark):
    rows = spark.range(31).select(F.col("id"), F.col("id").alias("created"))
    assert {r.id for r in sessions.keep_recent(rows).collect()} == set(range(1, 31))


def test_renames_move_every_holder_in_order(spark):
    held = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "z")], "session int, name string")
    log = spark.createDataFrame(
        [(1, "rename", "a", "b"), (2, "rename", "a", "q"), (3, "rename", "b", "c"), (4, "remove", "z", None), (5, "rename", "c", "a")],
        "seq long, kind string, name string, new_name string",
    )
    got = {r.session: r.name for r in matching.apply_inbox_events(held, log).collect()}
    assert got == {1: "a", 2: "a", 3: "a"}


def test_growth_takes_the_first_of_equals(spark):
    rows = [(1, 0, 0.9, 10.0, "lines", 0.0, 1.0), (1, 1, 0.85, 20.0, "edges", 0.0, 2.0), (1, 2, 0.85, 20.0, "bright", 0.0, 2.0), (1, 3, 0.5, 90.0, "bright", 0.0, 9.0), (2, 0, 0.4, 5.0, "lines", 0.0, 1.0)]
    frame = spark.createDataFrame(rows, "photo_id int, cand_idx int, score double, area double, source string, lo double, hi double")
    got = {r.photo_id: r for r in candidates.grow_to_whole(frame, lambda a, b: F.least(a["hi"], b["hi"]) * 10, lambda a, b: F.lit(True), ["lo", "hi"]).collect()}
    assert (got[1].cand_idx, got[1].score, got[1].source) == (1, 0.9, "edges+grown")
    assert (got[2].cand_idx, got[2].source) == (0, "lines")


def test_score_ties_and_missing_choice(spark):
    rows = [(1, i, "f", 0.5, lab, -1) for i, lab in enumerate((0.2, 0.9, 0.4))]
    got = {r.family: r for r in scoring.evaluate_pickers(spark.createDataFrame(rows, "photo_id int, cand_idx int, family string, pred double, label double, chosen int")).collect()}
    assert (got["f"].model_mean, got["f"].rules_mean, got["f"].oracle_mean) == (0.2, 0.2, 0.9)


def test_summary_skips_nan_and_counts_all(spark):
    rows = [("a", 0.9, float("nan")), ("a", 0.95, None), ("b", 0.8, 0.25)]
    frame = spark.createDataFrame(rows, "family string, iou double, cer double").withColumn("good", F.col("iou") > 0.9)
    out = scoring.groups_all_last(scoring.summary(frame, ["iou", "cer", "good"])).collect()
    assert [(r.family, r.n, r.cer_mean, r.good_mean) for r in out] == [("a", 2, None, 0.5), ("b", 1, 0.25, 0.0), ("ALL", 3, 0.25, pytest.approx(1 / 3))]
    lines = [r.line for r in scoring.summary_lines(scoring.summary(frame, ["iou", "cer"]), ["iou", "cer"]).orderBy("place").collect()]
    assert lines == ["| family | n | iou | cer |", "|---|---|---|---|", "| a | 2 | 0.925 | - |", "| b | 1 | 0.800 | 0.250 |", "| ALL | 3 | 0.883 | 0.250 |"]


def test_cer_edges(spark):
    rows = [("a  b\n", "a b"), ("", "x"), ("ab", "wxyz123"), ("abc", "abd")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(scoring.character_error_rate(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0 and got[1] != got[1] and got[2] == 1 and got[3] == pytest.approx(1 / 3)


@pytest.mark.parametrize("hot", [None, 10])
def test_partners_against_brute_force(spark, hot):
    rng = random.Random(2)
    blobs = [(rng.choice("ab"), i, rng.randrange(60) * 1.0, rng.randrange(60) * 1.0, rng.randrange(1, 9) * 1.0, rng.choice([0.7, 0.9])) for i in range(70)]
    frame = spark.createDataFrame(blobs, "photo_id string, blob_idx int, x double, y double, radius double, circularity double")
    got = {r.blob_idx for r in matching.partnered(frame, 100.0, hot_rows=hot).collect()}
    want = {
        h[1] for h in blobs
        if h[5] >= 0.85 or any(
            o[0] == h[0] and o[1] != h[1] and abs(o[4] - h[4]) < 0.25 * h[4] and (abs(o[2] - h[2]) < 3 or abs(o[3] - h[3]) < 3) for o in blobs
        )
    }
    assert got == want


def test_hot_medians(spark):
    rng = random.Random(4)
    rows = [("h" if i % 2 else f"k{i % 7}", i, float(rng.randrange(30))) for i in range(120)]
    frame = spark.createDataFrame(rows, "k string, i int, v double")
    got = {r.k: r.v for r in stats.upper_median(frame, ["k"], ["v"], hot_rows=10).collect()}
    for key in got:
        values = sorted(v for k, _, v in rows if k == key)
        assert got[key] == values[len(values) // 2]


def test_segments_and_status(spark):
    rows = [("a", 0.0, 4.0), ("a", 1.0, 2.0), ("a", 4.5, 5.0), ("a", 9.0, 9.5)]
    got = series.coalesce_segments(spark.createDataFrame(rows, "k string, s double, e double"), ["k"], "s", "e", 1.0, hot_rows=2).collect()
    assert sorted((r.start, r.end, r.pieces) for r in got) == [(0.0, 5.0, 3), (9.0, 9.5, 1)]
