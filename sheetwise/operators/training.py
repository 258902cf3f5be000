"""Training and serving the page ranker: labels, split, fit, tree table, prediction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetwise.session import scratch_path, settle, shared_folder

# The candidate features, in the order a trained model expects them.
FEATURES = (
    "total", "support", "strength", "contrast", "paper", "shape", "size", "border", "brighter", "aspect",
    "area", "score_rel", "area_rel", "contains_top", "inside_top", "corners_on", "print_inside", "extra_paper",
    "in_gray", "in_sat", "out_gray", "out_sat", "interior_bg", "outband_paper", "side_lift_max", "side_lift_min",
    "src_lines", "src_edges", "src_weak", "src_bright", "src_neutral", "rank", "n_larger_close", "n_smaller_close",
    "rules_pick",
)

# A model is data, but small data: trees x nodes. Larger tables are refused rather than collected.
MAX_NODES = 200_000

#: Rows of the training set that one task holds while trees are grown.
TASK_ROWS = 500_000
#: A training set of more rows is put into ranges before trees are grown.
RANGED_ROWS = 2_000_000
#: Ranges of a feature, as many as the booster tells apart, found on a grid of quantiles.
RANGES, GRID = 32, 1000
#: Rows alike in all ranges are kept as at most so many; a tree draws each or leaves it out.
SHARES = 16


def holdout_split(rows: DataFrame, group: str) -> DataFrame:
    """Add ``held_out``: every second group of the sorted distinct groups, from the second on; null sorts first.

    The groups are sorted by range; each range is numbered on its own and the ranges' sizes give the offsets.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.select(group).distinct().repartitionByRange(parts, group).withColumn("_part", F.spark_partition_id())
    ranges = settle(ranges, "groups")
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(F.col(group).asc_nulls_first()))
    held = ranges.join(offsets, "_part").select(F.col(group).alias("_group"), ((F.col("_before") + inside) % 2 == 0).alias("held_out"))
    return rows.join(held, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def train_union(synthetic: DataFrame, real: DataFrame, group: str) -> DataFrame:
    """All synthetic rows and the real rows that are not held out."""
    kept = holdout_split(real, group).filter(~F.col("held_out")).drop("held_out")
    return synthetic.unionByName(kept, allowMissingColumns=True)


def training_matrix(photos: DataFrame, cands: str = "cands", labels: str = "labels", power: float = 1.0) -> DataFrame:
    """One row per candidate of the nested form: ``features`` (array) and ``label ** power``."""
    both = F.arrays_zip(F.col(cands).alias("cand"), F.col(labels).alias("label"))
    rows = photos.select(F.explode_outer(both).alias("z")).filter(F.col("z.label").isNotNull())
    return rows.select(F.col("z.cand.f").alias("features"), F.pow(F.col("z.label").cast("double"), F.lit(power)).alias("label"))


def train_ranker(
    matrix: DataFrame, features: str = "features", label: str = "label", trees: int = 250, depth: int = 4, rate: float = 0.05,
    subsample: float = 0.6, min_leaf: int = 20, seed: int = 0,
) -> GBTRegressionModel:
    """Gradient-boosted regression of the overlap; ``features`` is an array column.

    The booster keeps its rows as they are dealt, at several hundred bytes each, so a large matrix is dealt to more tasks first. More than
    ``RANGED_ROWS`` rows are put into ranges and added up before (see :func:`in_ranges`): the trees then grow on what can differ, with every row
    in the weights, and ``min_leaf`` counts rows by them.
    """
    spark = matrix.sparkSession
    shared_folder(spark)  # the booster writes checkpoints there
    matrix = matrix.select(F.col(features).alias(features), F.col(label).cast("double").alias(label))
    rows, cuts = matrix.count(), None
    leaf = {"minInstancesPerNode": min_leaf}
    if rows > RANGED_ROWS:
        matrix, cuts = in_ranges(matrix, features, label, seed)
        leaf = {"weightCol": "weight", "minInstancesPerNode": 1, "minWeightFractionPerNode": min_leaf / rows, "maxBins": RANGES + 1}  # and one for 0
        rows = matrix.count()
    parts = -(-rows // TASK_ROWS)
    if parts > 1:
        matrix = matrix.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    vector = array_to_vector(F.transform(features, lambda v: v.cast("double")))
    ready = matrix.select(vector.alias("features"), F.col(label).alias("label"), *(["weight"] if cuts else []))
    booster = GBTRegressor(
        maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed,
        featuresCol="features", labelCol="label", checkpointInterval=10, **leaf,
    )
    model = booster.fit(ready)
    return model if cuts is None else _on_values(model, cuts, spark)


def in_ranges(matrix: DataFrame, features: str, label: str, seed: int) -> tuple[DataFrame, list[list[float]]]:
    """``features`` as numbers of ranges, from 1, with the mean ``label`` and the ``weight`` of the rows that lie in the same ones; and the cuts.

    The k-th range of a feature ends at its k-th cut, included; what is missing lies in the last one. The booster splits between
    ``RANGES`` ranges a feature at most, and squared errors from a mean differ from those of its rows by a constant, so sums over these rows are
    sums over all. The rows of a cell are dealt to ``SHARES`` at random, so that a tree draws some of each. No range has the number 0, which the
    booster guesses at instead of counting it when it looks for splits.
    """
    whole, size = F.when(F.col(label).isNotNull() & F.col(features).isNotNull(), 1), F.size(features)
    sizes = matrix.agg((F.count(whole) == F.count(F.lit(1))).alias("whole"), F.min(size).alias("least"), F.max(size).alias("most")).first()
    if not sizes["whole"] or sizes["least"] != sizes["most"]:
        raise ValueError("rows of the training set lack a label or features")
    names = [f"f{i}" for i in range(sizes["most"])]
    wide = matrix.select(label, *[F.coalesce(F.get(features, F.lit(i)).cast("double"), F.lit(float("nan"))).alias(n) for i, n in enumerate(names)])
    cuts = [_cuts(grid) for grid in wide.approxQuantile(names, [i / GRID for i in range(GRID + 1)], 1 / GRID)]
    # a bucket begins with its split: the next number after the cut
    splits = [[-np.inf, *np.nextafter(c, np.inf).tolist(), np.inf] for c in cuts]
    numbers = [f"r{i}" for i in range(len(names))]
    ranged = Bucketizer(splitsArray=splits, inputCols=names, outputCols=numbers, handleInvalid="keep").transform(wide)
    ranged = ranged.select(label, *[(F.least(F.col(n), F.lit(float(len(c)))) + 1).alias(n) for n, c in zip(numbers, cuts)])
    share = F.floor(F.rand(seed) * SHARES).cast("int").alias("_share")
    cells = ranged.groupBy(*numbers, share).agg(F.avg(label).alias(label), F.count(F.lit(1)).cast("double").alias("weight"))
    return settle(cells.select(F.array(*numbers).alias(features), label, "weight"), "cells"), cuts


def _cuts(grid: list[float]) -> list[float]:
    """Where a feature is cut, given its quantiles: after every value where they are few, else at every ``RANGES``-th part of the rows."""
    values = sorted(set(grid))
    if len(values) > RANGES:
        values = sorted({grid[round(k * GRID / RANGES)] for k in range(1, RANGES)} - {values[-1]}) + values[-1:]
    return values[:-1] or [0.0]


def _on_values(model: GBTRegressionModel, cuts: list[list[float]], spark) -> GBTRegressionModel:
    """The model of numbers of ranges as one of values: a threshold between two ranges becomes the cut between them."""
    ranged, valued = scratch_path(spark, "ranged"), scratch_path(spark, "valued")
    model.write().save(ranged)
    table = spark.createDataFrame([(i, k, float(c)) for i, own in enumerate(cuts) for k, c in enumerate(own, 1)], "_feature int, _range long, _cut double")
    nodes = spark.read.parquet(f"{ranged}/data")
    split = F.col("nodeData.split")
    at = F.floor(F.get(split["leftCategoriesOrThreshold"], F.lit(0)))
    named = nodes.join(F.broadcast(table), (split["featureIndex"] == F.col("_feature")) & (at == F.col("_range")), "left")
    threshold = F.when(F.col("_cut").isNull(), split["leftCategoriesOrThreshold"]).otherwise(F.array("_cut"))
    node = F.col("nodeData").withField("split", split.withField("leftCategoriesOrThreshold", threshold)).alias("nodeData")
    named.select(*[node if c == "nodeData" else F.col(c) for c in nodes.columns]).write.parquet(f"{valued}/data")
    spark.read.parquet(f"{ranged}/treesMetadata").write.parquet(f"{valued}/treesMetadata")
    spark.read.text(f"{ranged}/metadata").coalesce(1).write.text(f"{valued}/metadata")
    return GBTRegressionModel.load(valued)


def top_importances(model: GBTRegressionModel, names: Sequence[str], spark, k: int = 14) -> DataFrame:
    """The ``k`` most important features, name descending on ties."""
    values = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]
    table = spark.createDataFrame(values, "feature string, importance double")
    return table.orderBy(F.desc("importance"), F.desc("feature")).limit(k)


NODE_COLUMNS = "tree int, node int, feature int, threshold float, left int, right int, value float"


def tree_table(model: GBTRegressionModel, spark, rate: float | None = None) -> DataFrame:
    """The model as one row per node (``NODE_COLUMNS``; a leaf has ``left < 0``), read from its saved form.

    Values are scaled so that ``rate * sum`` of the leaves is the prediction (bias 0).
    """
    step = model.getOrDefault("stepSize") if rate is None else rate
    path = scratch_path(spark, "ranker")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.treeWeights)], "treeID int, weight double")
    node = F.col("nodeData")
    return saved.join(weights, "treeID").select(
        F.col("treeID").cast("int").alias("tree"), node["id"].cast("int").alias("node"),
        F.greatest(node["split"]["featureIndex"], F.lit(0)).cast("int").alias("feature"),
        F.coalesce(F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).cast("float").alias("threshold"),
        node["leftChild"].cast("int").alias("left"), node["rightChild"].cast("int").alias("right"),
        (node["prediction"] * F.col("weight") / step).cast("float").alias("value"),
    )


def write_tree_table(nodes: DataFrame, path: str, names: Sequence[str], bias: float, rate: float) -> None:
    """Store the nodes with the model's feature names, bias and rate."""
    nodes.select(
        "*", F.array(*[F.lit(n) for n in names]).alias("features"), F.lit(bias).cast("float").alias("bias"), F.lit(rate).alias("rate")
    ).write.parquet(path)


def read_tree_table(spark, path: str, names: Sequence[str]) -> DataFrame:
    """The stored nodes; refuses a model trained on other features."""
    nodes = spark.read.parquet(path)
    stored = nodes.select("features").first()
    if stored is None or list(stored["features"]) != list(names):
        raise ValueError("the ranker was trained on different features")
    return nodes.drop("features")


def predict_overlap(cands: DataFrame, nodes: DataFrame, features: str = "features", out: str = "pred", bias: float = 0.0, rate: float = 0.05) -> DataFrame:
    """Add the predicted overlap: ``bias + rate * sum of leaf values``.

    The node table is checked for size and goes to the tasks as arrays; each Arrow batch walks all trees at once, level by level,
    so a model of any depth and number of trees runs the same way. Values at most the threshold go left; a missing value goes right. Both
    sides are 32-bit floats.
    """
    rows = nodes.limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} tree nodes")
    place = {(r["tree"], r["node"]): i for i, r in enumerate(rows)}
    feature = np.array([r["feature"] for r in rows], np.int64)
    threshold = np.array([r["threshold"] for r in rows], np.float32)
    value = np.array([r["value"] for r in rows], np.float64)
    leaf = np.array([r["left"] < 0 for r in rows], bool)
    left, right = (np.array([i if r["left"] < 0 else place[r["tree"], r[c]] for i, r in enumerate(rows)], np.int64) for c in ("left", "right"))
    roots = [place[tree, 0] for tree in sorted({r["tree"] for r in rows})]
    width = int(feature.max(initial=0)) + 1

    def matrix_of(lists: pa.Array) -> np.ndarray:
        """The features of a batch side by side; what is missing is NaN."""
        n = len(lists)
        values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float32)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        if n and sizes[0] >= width and (sizes == sizes[0]).all():
            return values.reshape(n, -1)[:, :width]
        x = np.full((n, width), np.nan, np.float32)
        row = np.repeat(np.arange(n), sizes)
        column = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = column < width
        x[row[kept], column[kept]] = values[kept]
        return x

    def walk(batch: pa.Array) -> pa.Array:
        x = matrix_of(batch)
        row = np.arange(len(batch))
        total = np.full(len(batch), float(bias))
        for root in roots:
            at = np.full(len(batch), root)
            while not leaf[at].all():
                at = np.where(x[row, feature[at]] <= threshold[at], left[at], right[at])
            total = total + float(rate) * value[at]
        return pa.array(total)

    return cands.withColumn(out, F.arrow_udf(walk, "double")(F.transform(features, lambda v: v.cast("float"))))


def incremental_labels(
    recs: DataFrame, store: DataFrame, label: Column, now: Column, key: str = "path", mtime: str = "mtime"
) -> tuple[DataFrame, DataFrame]:
    """Labels for ``recs``: stored ones while newer than their input, the rest computed as of ``now``.

    ``store`` holds ``key, labelled_at, label``, several per key after some passes; the newest counts. Returns (all labels, the
    newly computed rows to append); an anti join finds what is missing, so unchanged photos are not labelled again.
    """
    newest = store.groupBy(key).agg(F.max_by(F.struct("labelled_at", "label"), "labelled_at").alias("_s")).select(key, "_s.*")
    fresh = recs.join(newest, key).filter(F.col("labelled_at") > F.col(mtime)).select(key, "labelled_at", "label")
    stale = recs.join(fresh.select(key), key, "left_anti")
    made = stale.select(key, now.cast(store.schema["labelled_at"].dataType).alias("labelled_at"), label.alias("label"))
    return fresh.unionByName(made), made
