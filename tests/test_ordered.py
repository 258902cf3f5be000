"""Cutting hot groups must not change a single value."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetwise.operators import ordered as o
from sheetwise.operators.counting import dominance_counts


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        data.append((key, i, rng.choice([None, *range(9)]), rng.random() * 50, rng.choice("abcdef") * rng.randrange(1, 4)))
    return spark.createDataFrame(data, "k string, id int, v int, t double, s string").cache()


def specs():
    return {
        "pos": o.position(), "total": o.group_sum("v"), "n": o.group_size(), "run": o.running_sum("v"), "top": o.running_max("v"),
        "last": o.last_seen("v"), "prev": o.previous("v"), "next": o.following("v"), "first": o.first_of_group("v"),
        "final": o.last_of_group("v"), "peak": o.group_max("v"),
    }


@pytest.mark.parametrize("order", [["t", "id"], ["s", "id"], ["id"]])
def test_cut_groups_equal_plain_windows(rows, order):
    plain = o.ordered(rows, ["k"], order, specs(), None).select("id", *specs())
    cut = o.ordered(rows, ["k"], order, specs(), 20).select("id", *specs())
    assert sorted(plain.collect(), key=lambda r: r.id) == sorted(cut.collect(), key=lambda r: r.id)


def test_later_stages_equal_plain_windows(rows):
    then = [lambda f: f.withColumn("step", F.col("pos") * 2), {"sum2": o.running_sum("step"), "back": o.previous("step")}]
    plain = o.ordered(rows, ["k"], ["t", "id"], {"pos": o.position()}, None, then=then)
    cut = o.ordered(rows, ["k"], ["t", "id"], {"pos": o.position()}, 20, then=then)
    assert sorted(plain.collect(), key=lambda r: r.id) == sorted(cut.select(*plain.columns).collect(), key=lambda r: r.id)


def test_hot_group_is_really_cut(rows):
    celled, hot = o.with_cells(rows, ["k"], [F.col("t")], 100)
    assert hot.count() == 200
    assert celled.filter("k = 'hot'").select("_cell").distinct().count() > 20
    assert celled.filter("k <> 'hot'").select("_cell").distinct().count() == 1


def test_no_hot_group_reads_once(rows):
    frame, hot = o.with_cells(rows, ["k"], [F.col("t")], 1000)
    assert hot is None and frame is rows


@pytest.mark.parametrize(
    "value", [lambda i: F.when(i == 7, 1e12).otherwise(i.cast("double")), lambda i: F.format_string("same start of a name %08d", i), lambda i: F.lit(1.0)],
    ids=["outlier", "common start", "tied first column"])
def test_cells_are_even(spark, value):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id"), value(F.col("id")).alias("v"))
    celled, _ = o.with_cells(rows, ["k"], [F.col("v"), F.col("id")], 1000)
    sizes = [r["count"] for r in celled.groupBy("_cell").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 2000
    ends = celled.groupBy("_cell").agg(F.min(F.struct("v", "id")).alias("a"), F.max(F.struct("v", "id")).alias("b")).orderBy("_cell").collect()
    assert all(tuple(x.b) < tuple(y.a) for x, y in zip(ends, ends[1:]))


def test_null_keys_do_no_harm(spark):
    rows = spark.range(300).select(F.when(F.col("id") % 2 == 0, "x").alias("k"), F.col("id"))
    plain = o.ordered(rows, ["k"], ["id"], {"pos": o.position()}, None)
    cut = o.ordered(rows, ["k"], ["id"], {"pos": o.position()}, 50)
    assert sorted(plain.select("id", "pos").collect()) == sorted(cut.select("id", "pos").collect())


def test_no_second_shuffle_for_stages(spark, rows):
    then = [{"back": o.previous("pos")}]
    plan = o.ordered(rows, ["k"], ["t", "id"], {"pos": o.position()}, None, then=then)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sliding_blocks_equal_one_window(rows):
    placed = o.ordered(rows, ["k"], ["t", "id"], {"pos": o.position()}, None)
    stages = [{"m": lambda w: F.max("v").over(w.rowsBetween(-3, 3))}, {"a": lambda w: F.avg("m").over(w.rowsBetween(-2, 2))}]
    small = o.sliding(placed, ["k"], "pos", stages, 5, block_rows=7)
    w = W.partitionBy("k").orderBy("pos")
    whole = placed.withColumn("m", F.max("v").over(w.rowsBetween(-3, 3))).withColumn("a", F.avg("m").over(w.rowsBetween(-2, 2)))
    assert sorted(small.select("id", "m", "a").collect()) == sorted(whole.select("id", "m", "a").collect())


@pytest.mark.parametrize("hot", [None, 15])
def test_dominance_counts_against_brute_force(spark, hot):
    rng = random.Random(3)
    points = [(rng.choice("ab"), rng.randrange(12), rng.randrange(12)) for _ in range(90)] + [("c", 1, 1)]
    asks = [
        (rng.choice("abcz"), i, float(rng.randrange(14)), rng.random() < 0.5, float(rng.randrange(14)), rng.random() < 0.5, rng.choice([1, -1]), rng.choice([0, 1]))
        for i in range(80)
    ]
    p = spark.createDataFrame(points, "k string, x int, y int")
    q = spark.createDataFrame(asks, "k string, id int, x double, x_closed boolean, y double, y_closed boolean, weight int, base int")
    got = {r.id: r["count"] for r in dominance_counts(p, q, ["k"], ["id"], hot).collect()}
    for k, i, x, xc, y, yc, w, base in asks:
        left = [py for kk, px, py in points if kk == k and (px <= x if xc else px < x)]
        assert got[i] == base * len(left) + w * sum(1 for py in left if (py <= y if yc else py < y))
