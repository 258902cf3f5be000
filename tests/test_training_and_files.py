import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from sheetwise.operators import scoring, training
from sheetwise.sources import files


def test_threshold_equal_goes_left(spark):
    nodes = spark.createDataFrame(
        [(0, 0, 0, 0.1, 1, 2, 0.0), (0, 1, 0, 0.0, -1, -1, 1.0), (0, 2, 0, 0.0, -1, -1, 5.0)], training.NODE_COLUMNS
    )
    rows = spark.createDataFrame([([0.1],), ([0.10001],)], "features array<double>")
    assert [r.pred for r in training.predict_overlap(rows, nodes, bias=1.0, rate=0.5).collect()] == [1.5, 3.5]


def test_tree_table_predicts_like_the_model(spark, tmp_path):
    rows = spark.range(400).select(
        F.array((F.col("id") % 20 / 20).cast("float"), (F.col("id") % 7 / 7).cast("float")).alias("features"),
        (F.col("id") % 20 / 20 * 0.8 + 0.1).alias("label"),
    )
    model = training.train_ranker(rows, trees=15, rate=0.2)
    nodes = training.tree_table(model, spark)
    from pyspark.ml.functions import array_to_vector

    native = model.transform(rows.withColumn("features", array_to_vector(F.transform("features", lambda v: v.cast("double")))))
    want = [r.prediction for r in native.collect()]
    got = [r.pred for r in training.predict_overlap(rows, nodes, rate=0.2).collect()]
    assert got == pytest.approx(want, abs=1e-4)
    error = sum(abs(p - r.label) for p, r in zip(got, rows.collect())) / len(got)
    assert error < 0.05
    names = ["a", "b"]
    training.write_tree_table(nodes, str(tmp_path / "nodes"), names, 0.0, 0.2)
    assert training.read_tree_table(spark, str(tmp_path / "nodes"), names).count() == nodes.count()
    with pytest.raises(ValueError):
        training.read_tree_table(spark, str(tmp_path / "nodes"), ["b", "a"])
    top = training.top_importances(model, names, spark, 1).collect()
    assert len(top) == 1 and top[0].feature == "a"


def test_photo_folders(spark, tmp_path):
    for sample in ("s1", "s2"):
        (tmp_path / "set" / sample).mkdir(parents=True)
        (tmp_path / "set" / sample / "photo.jpg").write_bytes(b"x" * 5)
        (tmp_path / "set" / sample / "meta.json").write_text(json.dumps(
            {"family": "crease", "image": [4000, 3000], "params": {"a": "1"}, "corners_virtual": [[1, 2], [3, 4]], "doc": None}, indent=1))
    (tmp_path / "set" / "s1" / "other.png").write_bytes(b"y")
    got = {r.name for r in files.read_photo_folder(spark, str(tmp_path / "set")).collect()}
    assert got == {"s1", "s2"}
    meta = files.read_sample_meta(spark, str(tmp_path / "set")).collect()
    assert {r.name for r in meta} == {"s1", "s2"} and meta[0].corners_virtual == [[1, 2], [3, 4]] and meta[0].image == [4000, 3000]
    loose = tmp_path / "loose"
    (loose / "bg" / "m").mkdir(parents=True)
    for name in ("a.JPG", "b.jpeg", "c.Png", "d.gif"):
        (loose / name).write_bytes(b"z")
    (loose / "bg" / "m" / "frame_1.jpeg").write_bytes(b"zz")
    assert {r.name for r in files.read_photo_folder(spark, str(loose)).collect()} == {"a", "b", "c"}
    assert {r.image_path for r in files.read_frames(spark, str(loose)).collect()} == {"b.jpeg", "bg/m/frame_1.jpeg"}


def test_inbox_listing(spark, tmp_path):
    for name in ("a.txt", "up-1.part", "up-notes.txt", ".hidden"):
        (tmp_path / name).write_text("hello")
    os.makedirs(tmp_path / "scans")
    (tmp_path / "scans" / "s.txt").write_text("deep")
    got = files.list_inbox(spark, str(tmp_path), "up-")
    assert {(r.name, r.length) for r in got.collect()} == {("a.txt", 5), ("up-notes.txt", 5)}
    assert "content" not in got._jdf.queryExecution().optimizedPlan().toString().split("Project")[-1].split("\n")[0]


def test_truth_keeps_the_last_row(spark, tmp_path):
    head = files.TRUTH_SCHEMA.replace(",", "").split()[::2]
    rows = [{"image_path": "f.jpeg", "bg_name": "one", "tl_x": "1"}, {"image_path": "f.jpeg", "bg_name": "two", "tl_x": "2"}]
    with gzip.open(tmp_path / "metadata.csv.gz", "wt") as out:
        out.write(",".join(head) + "\n")
        for r in rows:
            out.write(",".join(r.get(c, "") for c in head) + "\n")
    got = files.read_truth_csv(spark, str(tmp_path / "metadata.csv.gz")).collect()
    assert [(r.bg_name, r.tl_x) for r in got] == [("two", 2.0)]


def test_markdown_and_rows_files(spark, tmp_path):
    from sheetwise.operators.scoring import summary

    rows = spark.createDataFrame([("a", 0.5), ("b", 0.75)], "family string, iou double")
    files.write_summary_markdown(summary(rows, ["iou"]), ["iou"], str(tmp_path / "md"))
    text = [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert text == ["| family | n | iou |", "|---|---|---|", "| a | 1 | 0.500 |", "| b | 1 | 0.750 |", "| ALL | 2 | 0.625 |"]
    files.write_rows_csv(str(tmp_path / "csv"), rows, spark.createDataFrame([(1,)], "cer int"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["cer", "family", "iou"]


def test_blank_candidate_lines_are_skipped(spark, tmp_path):
    line = json.dumps({"path": "p", "w": 10, "h": 5, "chosen": -1, "cands": [{"c": [[0, 0], [1, 0], [1, 1], [0, 1]], "f": [1, 2]}]})
    (tmp_path / "c.jsonl").write_text(line + "\n\n" + line.replace('"p"', '"q"') + "\n")
    photos = files.read_candidates(spark, str(tmp_path / "c.jsonl"))
    assert photos.count() == 2
    assert [r.features for r in files.explode_candidates(photos).collect()] == [[1.0, 2.0]] * 2


def test_large_matrix_is_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(training, "TASK_ROWS", 100)
    sizes = {}
    fit = training.GBTRegressor.fit
    monkeypatch.setattr(training.GBTRegressor, "fit", lambda self, ready: sizes.setdefault("parts", ready.rdd.glom().map(len).collect()) and fit(self, ready))
    rows = spark.range(2000, numPartitions=1).selectExpr("array(id % 7, id % 11) AS features", "id % 7 AS label")
    model = training.train_ranker(rows, trees=2)
    assert model.getNumTrees == 2 and sum(sizes["parts"]) == 2000
    assert max(sizes["parts"]) <= 120  # 2,000 in one task before


def test_results_are_one_row_per_key_before_the_join(spark):
    samples = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    results = spark.range(3000).selectExpr("IF(id = 0, NULL, 1L) AS k")
    have, lack = scoring.with_results(samples, results, "k")
    assert [r.k for r in have.collect()] == [1] and {r.k for r in lack.collect()} == {2, None}
    assert "Aggregate" in have._jdf.queryExecution().optimizedPlan().toString()


def test_missing_features_go_right(spark):
    nodes = spark.createDataFrame(
        [(0, 0, 1, 0.5, 1, 2, 0.0), (0, 1, 0, 0.0, -1, -1, 1.0), (0, 2, 0, 0.0, -1, -1, 5.0)], training.NODE_COLUMNS
    )
    rows = spark.createDataFrame([([1.0, 0.1, 9.0],), ([1.0],), (None,), ([0.0, None],), ([0.0, 0.5],), ([],)], "features array<double>").coalesce(1)
    assert [r.pred for r in training.predict_overlap(rows, nodes, rate=1.0).collect()] == [1.0, 5.0, 5.0, 5.0, 1.0, 5.0]


def _smooth(spark, n):
    """Features and labels by hashes: numbers of ``rand`` may be the very ones by which the booster draws rows."""
    u, v, e = (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1_000_003)) / 1_000_003 for i in range(3))
    rows = spark.range(n, numPartitions=3).select(u.cast("float").alias("u"), (v * v).cast("float").alias("v"), (F.col("id") % 7).cast("float").alias("w"), e.alias("e"))
    label = F.sin(3 * F.col("u")) + F.col("v") * F.col("w") / 7 + 0.3 * F.col("e")
    return rows.select(F.array("u", "v", "w", F.lit(1.0).cast("float")).alias("features"), label.alias("label")).persist()


def test_trees_of_a_large_matrix_grow_on_its_ranges(spark, monkeypatch):
    """Every row of the matrix is in the weights, and the booster is given less than the rows."""
    rows = _smooth(spark, 60_000)

    def error(model):
        found = training.predict_overlap(rows, training.tree_table(model, spark), rate=0.2)
        return found.agg(F.avg((F.col("pred") - F.col("label")) ** 2)).first()[0]

    plain = error(training.train_ranker(rows, trees=20, rate=0.2))
    monkeypatch.setattr(training, "RANGED_ROWS", 10_000)
    given = {}
    fit = training.GBTRegressor.fit

    def seen(self, ready):
        given.update(ready.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("rows"), F.sum(F.col("weight") * F.col("label")).alias("labels")).first().asDict())
        return fit(self, ready)

    monkeypatch.setattr(training.GBTRegressor, "fit", seen)
    model = training.train_ranker(rows, trees=20, rate=0.2)
    assert given["rows"] == 60_000 and given["n"] < 60_000
    assert given["labels"] == pytest.approx(rows.agg(F.sum("label")).first()[0])
    assert error(model) == pytest.approx(plain, rel=0.1)
    from pyspark.ml.functions import array_to_vector

    native = model.transform(rows.withColumn("own", F.col("features")).withColumn("features", array_to_vector(F.transform("own", lambda v: v.cast("double")))))
    mine = training.predict_overlap(native, training.tree_table(model, spark), "own", rate=0.2)
    assert mine.filter(F.abs(F.col("pred") - F.col("prediction")) > 1e-4).isEmpty()
    splits = [r for r in training.tree_table(model, spark).collect() if r["left"] >= 0]
    assert {r["threshold"] for r in splits if r["feature"] == 2} <= {0.0, 1.0, 2.0, 3.0, 4.0, 5.0} and 3 not in {r["feature"] for r in splits}
    assert model.getOrDefault("stepSize") == 0.2 and model.getNumTrees == 20


def test_few_values_are_all_told_apart():
    assert training._cuts([0.0] * 900 + [1.0] * 100 + [2.0]) == [0.0, 1.0]
    assert training._cuts([4.0] * 1001) == [0.0] and training._cuts([]) == [0.0]
    cuts = training._cuts([float(i) for i in range(1001)])
    assert len(cuts) == training.RANGES - 1 and cuts[0] == 31 and max(cuts) < 1000


def test_a_large_matrix_must_be_whole(spark, monkeypatch):
    monkeypatch.setattr(training, "RANGED_ROWS", 2)
    for features, label in (("array(id, id)", "IF(id = 3, NULL, id)"), ("IF(id = 4, array(id), array(id, id))", "id"), ("IF(id = 4, NULL, array(id, id))", "id")):
        rows = spark.range(9).selectExpr(f"{features} AS features", f"{label} AS label")
        with pytest.raises(ValueError):
            training.train_ranker(rows, trees=1)


def test_importances_of_ranges_are_those_of_rows(spark, monkeypatch):
    rows, names = _smooth(spark, 30_000), ["u", "v", "w", "one"]
    plain = training.top_importances(training.train_ranker(rows, trees=8, rate=0.3), names, spark).collect()
    monkeypatch.setattr(training, "RANGED_ROWS", 10_000)
    grouped = []
    in_ranges = training.in_ranges
    monkeypatch.setattr(training, "in_ranges", lambda *given: grouped.append(in_ranges(*given)) or grouped[0])
    ranged = training.top_importances(training.train_ranker(rows, trees=8, rate=0.3), names, spark).collect()
    assert grouped[0][0].agg(F.sum("weight")).first()[0] == 30_000
    want = {r["feature"]: r["importance"] for r in plain}
    assert want["one"] == 0 and {r["feature"]: r["importance"] for r in ranged} == pytest.approx(want, abs=0.1)
