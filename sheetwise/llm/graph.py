"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import written


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex hangs on one other that hangs on none."""
    ends = edges.select(F.col("u").alias("k"), "v").unionByName(edges.select(F.col("v").alias("k"), F.lit(None).cast(edges.schema["v"].dataType).alias("v")))
    seen = ends.groupBy("k").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.when(F.col("v").isNull(), 1)).alias("hung_on"))
    return seen.where("least != most or (least is not null and hung_on > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` edges as ``key, root``: every vertex with the least vertex of its component, itself included.

    Large-star and small-star steps alternate until nothing changes; each round starts from a table. A vertex with very many
    neighbours is met by partial minima and by joins that Spark can split, never gathered. Loops and repeated
    edges do no harm; an edge with a null end is none. No edges give no rows.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = written(edges.distinct(), "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        edges = written(small.distinct(), "edges")
    roots = edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(roots)
