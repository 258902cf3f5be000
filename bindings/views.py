"""Derived views of the driver tables, the same in Spark and in SQL.

``cands``: the lines of an order as candidate outlines of a photo. ``cand_idx`` is built from the
line itself, so the view is a projection: no window, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import table

CANDS = """cands AS (SELECT l_orderkey AS photo_id, l_linenumber * 100000000 + round(l_extendedprice * 100)::BIGINT AS cand_idx,
    CASE l_returnflag WHEN 'N' THEN 'lines' WHEN 'R' THEN 'edges' ELSE 'bright' END AS source, l_linestatus AS family,
    l_quantity AS area, l_extendedprice / 105000 AS score, abs(l_discount) * 10 AS label, l_tax * 10 AS pred,
    l_linenumber::DOUBLE AS lo, l_linenumber + l_quantity / 10 AS hi FROM lineitem)"""


def cands(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("photo_id"),
        (F.col("l_linenumber") * F.lit(100000000).cast("long") + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cand_idx"),
        F.when(flag == "N", "lines").when(flag == "R", "edges").otherwise("bright").alias("source"),
        F.col("l_linestatus").alias("family"),
        F.col("l_quantity").alias("area"),
        (F.col("l_extendedprice") / 105000).alias("score"),
        (F.abs("l_discount") * 10).alias("label"),
        (F.col("l_tax") * 10).alias("pred"),
        F.col("l_linenumber").cast("double").alias("lo"),
        (F.col("l_linenumber") + F.col("l_quantity") / 10).alias("hi"),
    )


def interval_overlap(a, b):
    """Stand-in for the shared area of two outlines: the shared length of [lo, hi), times ten."""
    return F.greatest(F.lit(0.0), F.least(a["hi"], b["hi"]) - F.greatest(a["lo"], b["lo"])) * 10


# Embeddings as page outlines: corner k of a quad is a base corner (0.1 or 0.9) moved by two elements.
BASE = ((0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9))


def _sql_corner(k: int, axis: int, first: int) -> str:
    return f"{BASE[k][axis]}::DOUBLE + 0.15::DOUBLE * embedding[{first + 2 * k + axis}]::DOUBLE"


QUADS = "quads AS (SELECT vec_id AS photo_id, label AS family, " + ", ".join(
    f"{_sql_corner(k, axis, first)} AS {name}{'xy'[axis]}{k}"
    for first, name in ((1, ""), (9, "t"))
    for k in range(4)
    for axis in range(2)
) + " FROM embeddings)"

_EMB = "embedding"


def quads(spark: SparkSession, d: str) -> DataFrame:
    """photo_id, family, detected ``corners`` and true ``truth``: arrays of four ``struct<x, y>``."""

    def corner(k: int, first: int):
        x, y = (
            F.lit(BASE[k][axis]) + F.lit(0.15) * F.col(_EMB)[first - 1 + 2 * k + axis].cast("double") for axis in range(2)
        )
        return F.struct(x.alias("x"), y.alias("y"))

    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("photo_id"),
        F.col("label").alias("family"),
        F.array(*[corner(k, 1) for k in range(4)]).alias("corners"),
        F.array(*[corner(k, 9) for k in range(4)]).alias("truth"),
    )


# Embeddings as 33-point curves: x runs 0..1, y is a twentieth of an element.
CURVES = """curves AS (SELECT vec_id AS photo_id, p AS pos, p / 32.0::DOUBLE AS x, 0.05::DOUBLE * embedding[p + 1]::DOUBLE AS y
    FROM embeddings, (SELECT unnest(range(33))::INT AS p))"""


def curves(spark: SparkSession, d: str) -> DataFrame:
    """photo_id and ``points``: an array of 33 ``struct<x, y>``."""
    points = F.transform(
        F.slice(_EMB, 1, 33),
        lambda v, i: F.struct((i / F.lit(32.0)).alias("x"), (F.lit(0.05) * v.cast("double")).alias("y")),
    )
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("photo_id"), F.col("label").alias("family"), points.alias("points"))


# Events as grey levels of a photo.
LEVELS = "levels AS (SELECT user_id AS photo_id, event_type AS family, least(255, floor(value))::INT AS level FROM events)"


def levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("photo_id"),
        F.col("event_type").alias("family"),
        F.least(F.lit(255), F.floor("value").cast("int")).alias("level"),
    )


# Line items as brightness samples along the four sides of a photo's outline.
SAMPLES = """samples AS (SELECT l_suppkey AS photo_id, l_linenumber % 4 AS side, l_orderkey AS t,
    l_linenumber * 100000000 + round(l_extendedprice * 100)::BIGINT AS t2,
    l_quantity * 5 AS inside, abs(l_discount) * 2500 AS outside, l_tax * 1000 AS sat,
    CASE l_returnflag WHEN 'N' THEN 'in' WHEN 'R' THEN 'extra' ELSE 'out' END AS band FROM lineitem)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("photo_id"),
        (F.col("l_linenumber") % 4).alias("side"),
        F.col("l_orderkey").alias("t"),
        (F.col("l_linenumber") * F.lit(100000000).cast("long") + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("t2"),
        (F.col("l_quantity") * 5).alias("inside"),
        (F.abs("l_discount") * 2500).alias("outside"),
        (F.col("l_tax") * 1000).alias("sat"),
        F.when(flag == "N", "in").when(flag == "R", "extra").otherwise("out").alias("band"),
    )
