"""Inputs beyond what the operators once allowed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.operators import candidates, matching, outlines, scoring, stats, training
from sheetwise.sources import files


def test_rename_chains_of_any_length(spark):
    n = 300
    log = [(i, "rename", f"f{i}", f"f{i + 1}") for i in range(n)] + [(n, "rename", "g0", "g1"), (n + 1, "remove", "g1", None), (n + 2, "rename", "a", "b"), (n + 3, "rename", "b", "a")]
    events = spark.createDataFrame(log, "seq long, kind string, name string, new_name string")
    held = spark.createDataFrame([("s0", "f0"), ("s1", f"f{n - 1}"), ("s2", "g0"), ("s3", "other"), ("s4", "a"), ("s5", "b")], "session string, name string")
    got = {r.session: r.name for r in matching.apply_inbox_events(held, events).collect()}
    assert got == {"s0": f"f{n}", "s1": f"f{n}", "s3": "other", "s4": "a", "s5": "a"}


def test_claimed_names_settle(spark):
    names = ["a.txt"] * 6 + ["a (1).txt"] * 4 + ["a (1) (1).txt"] * 3
    batch = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    taken = spark.createDataFrame([("a (2).txt",)], "name string")
    got = [r.final_name for r in matching.assign_unique_names(batch, taken, "id").collect()]
    assert len(set(got)) == len(names) and "a (2).txt" not in got


def test_too_many_corners_are_rejected(spark):
    circle = [(float(np.cos(a)), float(np.sin(a))) for a in np.linspace(0, 2 * np.pi, 20, endpoint=False)]
    rows = spark.createDataFrame([(1, circle), (2, circle[::5])], "photo_id int, points array<struct<x:double,y:double>>")
    got = {r.photo_id: r for r in outlines.best_four(rows).collect()}
    assert got[1].rejected and got[1].best_area is None and got[1].best_corners is None
    assert not got[2].rejected and got[2].best_area == pytest.approx(2.0)


def test_levels_outside_a_byte_count_at_the_ends(spark):
    rows = spark.createDataFrame([(1, -5), (1, 0), (1, 300), (1, 7)], "k int, level int")
    got = {r.level: r.n for r in stats.histogram256(rows, ["k"], "level").collect() if r.n}
    assert got == {0: 2, 7: 1, 255: 1}


def test_long_listings_get_one_signature(spark):
    rows = spark.range(200).select(F.lit(1).alias("k"), "id").unionByName(spark.range(3).select(F.lit(2).alias("k"), "id"))
    tags = scoring.listing_signature(rows, ["k"], ["id"], F.col("id").cast("string"), chunk=3).collect()
    assert sorted(r.k for r in tags) == [1, 2]
    alone = scoring.listing_signature(rows.where("k = 2"), ["k"], ["id"], F.col("id").cast("string"), chunk=3).first()
    assert alone.signature == next(r.signature for r in tags if r.k == 2)
    changed = scoring.listing_signature(rows.where("k = 1"), ["k"], [-F.col("id")], F.col("id").cast("string"), chunk=3).first()
    assert changed.signature != next(r.signature for r in tags if r.k == 1)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    values = [float(x) for x in rng.integers(0, 40, 501)]
    rows = spark.createDataFrame([(1, x) for x in values] + [(2, None), (2, 3.0)], "k int, v double")
    got = {r.k: r.q for r in stats.counted_quantile(rows, ["k"], "v", 0.95, "q", hot_rows=50).collect()}
    assert got == {1: sorted(values)[int(np.ceil(0.95 * 501)) - 1], 2: 3.0}


def test_outlines_without_samples_score_zero(spark):
    square = [(100.0, 100.0), (900.0, 100.0), (900.0, 900.0), (100.0, 900.0)]
    quads = spark.createDataFrame([(1, square), (2, square)], "photo_id int, corners array<struct<x:double,y:double>>")
    samples = spark.createDataFrame([(1, 10.0, 150.0, 50.0, 10.0, True)] * 30, "photo_id int, d double, inside double, outside double, sat double, in_frame boolean")
    bands = samples.groupBy("photo_id").agg(F.avg("inside").alias("mean_in"), F.avg("sat").alias("sat_in"), F.avg("outside").alias("mean_out"))
    got = {r.photo_id: r.total for r in stats.perimeter_score(samples, quads, bands, ["photo_id"], F.lit(1000.0), F.lit(1000.0)).collect()}
    assert got[1] > 0.5 and got[2] == 0


def test_prediction_of_250_trees(spark):
    rng = np.random.default_rng(3)
    nodes = []
    for tree in range(250):
        for node in range(31):
            inner = node < 15
            nodes.append((tree, node, int(rng.integers(0, 5)), float(np.float32(rng.normal())), 2 * node + 1 if inner else -1, 2 * node + 2 if inner else -1, float(rng.normal())))
    frame = spark.createDataFrame([(i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(200)] + [(200, None), (201, [0.5])], "id int, features array<float>")
    table = spark.createDataFrame(nodes, training.NODE_COLUMNS)
    stored = {(r.tree, r.node): r for r in table.collect()}
    for row in training.predict_overlap(frame, table, bias=0.5).collect():
        want = 0.5
        for tree in range(250):
            at = stored[tree, 0]
            while at.left >= 0:
                x = row.features[at.feature] if row.features is not None and at.feature < len(row.features) else None
                at = stored[tree, at.left if x is not None and x <= at.threshold else at.right]
            want += 0.05 * at.value
        assert row.pred == pytest.approx(want)


def test_labels_are_kept_over_two_passes(spark):
    recs = spark.createDataFrame([("a", 1), ("b", 5)], "path string, mtime int")
    store = spark.createDataFrame([("a", 3, 7.0)], "path string, labelled_at int, label double")
    _, made = training.incremental_labels(recs, store, F.lit(9.0), F.lit(6))
    assert [tuple(r) for r in made.collect()] == [("b", 6, 9.0)]
    everything, none = training.incremental_labels(recs, store.unionByName(made), F.lit(8.0), F.lit(7))
    assert none.isEmpty() and {r.path: r.label for r in everything.collect()} == {"a": 7.0, "b": 9.0}


def test_null_groups_are_split_too(spark):
    rows = spark.createDataFrame([(None,), ("a",), ("b",), ("c",), (None,)], "g string")
    got = sorted((r.g or "", r.held_out) for r in training.holdout_split(rows, "g").collect())
    assert got == [("", False), ("", False), ("a", True), ("b", False), ("c", True)]


def test_photos_without_candidates_have_no_rows(spark):
    photos = spark.createDataFrame([(1, [], []), (2, [1], [0.5]), (3, None, None)], "photo_id int, c array<int>, l array<double>")
    assert [r.photo_id for r in candidates.attach_labels(photos, "c", "l").collect()] == [2]


def test_inbox_lists_guarded_names(spark, tmp_path):
    for name in ("_con.txt", "plain.txt", ".hidden", "up-1.part"):
        (tmp_path / name).write_text("x")
    assert sorted(r.name for r in files.list_inbox(spark, str(tmp_path), "up-").collect()) == ["_con.txt", "plain.txt"]


def test_frames_are_keyed_below_their_root(spark, tmp_path):
    root = tmp_path / "fr" / "x" / "fr"
    (root / "bg").mkdir(parents=True)
    (root / "bg" / "f.jpeg").write_bytes(b"1")
    assert [r.image_path for r in files.read_frames(spark, str(root)).collect()] == ["bg/f.jpeg"]


def test_blobs_of_one_index_are_judged_each_by_its_own_row(spark):
    # index 1 stands for two blobs: one has a partner (index 2), the other is far from both; index 3 stands for two that find each other
    rows = [(7, 1, 10.0, 10.0, 2.0, 0.1), (7, 1, 500.0, 700.0, 2.0, 0.2), (7, 2, 11.0, 90.0, 2.1, 0.3), (7, 3, 300.0, 200.0, 9.0, 0.4), (7, 3, 301.0, 400.0, 9.0, 0.5), (7, 4, 900.0, 950.0, 50.0, 0.6)]
    blobs = spark.createDataFrame(rows, "photo_id long, blob_idx long, x double, y double, radius double, circularity double")
    assert sorted(r.circularity for r in matching.partnered(blobs, 100.0).collect()) == [0.1, 0.3, 0.4, 0.5]


def test_ties_of_score_and_index_go_by_source(spark):
    a = spark.createDataFrame([(1, 5, 0.5, "neutral"), (1, 5, 0.5, "bright"), (1, 2, 0.4, "lines")], "photo_id long, cand_idx long, score double, source string").coalesce(1)
    b = spark.createDataFrame([(1, 5, 0.5, "bright+extended")], a.schema)
    got = {r.source: r["rank"] for r in candidates.concat_sorted(a, b).collect()}
    assert got == {"bright": 0, "bright+extended": 1, "neutral": 2, "lines": 3}


def test_sql_of_names_knows_the_last_number(spark, tmp_path):
    """The names of ``assign_unique_names`` end in numbers up to 9999 only, and so do those of its SQL twins."""
    import bindings
    from check import compare

    duckdb = pytest.importorskip("duckdb")
    bindings.load_all()
    n = 10_003
    spark.range(n).selectExpr("id AS p_partkey", "'hot ring' AS p_name", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(5 * n).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "'TOYS' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for table in ("part", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    for name in ("nam03_assign_unique_names", "joi10_resolve_collisions", "nam06_rename_plan", "str06_unique_names_stream"):
        assert compare(bindings.QUERIES[name](spark, str(tmp_path)), con, bindings.SQL[name]) == "", name
