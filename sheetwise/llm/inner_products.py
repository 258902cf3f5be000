"""Exact top-k inner products over norm-sorted vectors with rotated partial sums.

Candidates are sorted by descending length and packed into blocks. All vectors are also rotated onto the corpus' principal directions
(from its second-moment matrix, so an SVD of the data), where the first quarter of the coordinates carries most of a product. For a query
and a candidate, the partial product over those plus the product of the two residual lengths bounds the score
(Cauchy-Schwarz). The longest blocks are scored first and give every query a threshold; then block pairs whose lengths cannot reach
the threshold are never joined, and inside a pair only candidates whose bound reaches it are scored. Scores are whole numbers and
exact as long as they stay below 2^53.

Components become floor(256 x). Vectors that are null, or hold a null or a component that is not finite, take no part, nor do rows with a
null id. A vector shorter than another counts as padded with zeros. Rows that share a query's id are all its own; an identical query
row is asked once, two different vectors under one id are both asked. Repeated candidates count each. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import written
from sheetwise.session import ship_package

TOP, SCALE, EVERY = 5, 256, 50
#: Candidates in a block, queries in a block, and blocks that give the first thresholds.
BLOCK, QUERIES, SEEDS = 2048, 512, 4


def whole_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v, norm``: the vectors that take part, as whole numbers, with their lengths."""
    value = F.col("embedding")
    usable = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(value, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    kept = table.where(F.col("vec_id").isNotNull() & value.isNotNull() & usable)
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return kept.withColumn("norm", F.sqrt(squares))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal directions as columns, the strongest first. Only ``width`` squared sums reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch["v"], width).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["i", "x"])

    sums = vectors.select("v").mapInArrow(moments, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(width * width)
    for row in sums:
        total[row["i"]] = row["x"]
    total = total.reshape(width, width)
    _, directions = np.linalg.eigh((total + total.T) / 2)
    return directions[:, ::-1]


_BLOCK = "block long, top double, ids binary, data binary"


def _blocks(vectors: DataFrame, width: int, size: int) -> DataFrame:
    """Candidates by descending length, ``size`` to a row."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = vectors.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, norms = part["vec_id"].to_numpy(), part["norm"].to_numpy()
                row = [[int(ids[0])], [float(norms[0])], [ids.tobytes()], [_matrix(part["v"], width).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["block", "top", "ids", "data"])

    packed = ordered.mapInArrow(pack, _BLOCK)
    return packed.withColumn("block", F.xxhash64("block", "ids"))


def _query_blocks(queries: DataFrame, width: int, blocks: int) -> DataFrame:
    """Distinct queries, about ``QUERIES`` to a row."""
    import pandas as pd

    def pack(key, frame: pd.DataFrame) -> pd.DataFrame:
        data = np.zeros((len(frame), width), np.int64)
        for i, v in enumerate(frame["v"]):
            data[i, : len(v)] = v
        ids = frame["vec_id"].to_numpy(np.int64)
        return pd.DataFrame({"lane": [int(key[0])], "reach": [float(frame["norm"].max())], "qids": [ids.tobytes()], "qdata": [data.tobytes()]})

    lanes = queries.distinct().withColumn("lane", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))
    return lanes.groupBy("lane").applyInPandas(pack, "lane long, reach double, qids binary, qdata binary")


_FOUND = "lane long, q int, query_id long, vec_id long, score long"


def _scored(pairs: DataFrame, directions: np.ndarray, top: int) -> DataFrame:
    """The best of each block for each query of the lane, leaving out what cannot reach the query's threshold."""
    width = len(directions)
    lead = max(1, width // 4)
    names = [part.split()[0] for part in _FOUND.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes: dict[int, list] = {}  # what this task knows of the lane at hand
        for batch in batches:
            for row in batch.to_pylist():
                if row["lane"] not in lanes:
                    q = np.frombuffer(row["qdata"], np.int64).reshape(-1, width)
                    least = np.frombuffer(row["least"], float) if row["least"] else np.full(len(q), -np.inf)
                    lanes = {row["lane"]: [q, np.frombuffer(row["qids"], np.int64), q @ directions, least.copy()]}
                q, qids, q_turned, least = lanes[row["lane"]]
                c, ids = np.frombuffer(row["data"], np.int64).reshape(-1, width), np.frombuffer(row["ids"], np.int64)
                turned = c @ directions
                bound = q_turned[:, :lead] @ turned[:, :lead].T
                bound += np.linalg.norm(q_turned[:, lead:], axis=1)[:, None] * np.linalg.norm(turned[:, lead:], axis=1)
                slack = 1e-9 * (1 + np.abs(bound).max(initial=0))
                open_ = (bound >= least[:, None] - slack) & (qids[:, None] != ids)
                exact = float(np.abs(q).sum(axis=1).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2**53
                out = []
                for i in np.flatnonzero(open_.any(axis=1)):
                    at = np.flatnonzero(open_[i])
                    scores = (c[at].astype(float) @ q[i].astype(float)).astype(np.int64) if exact else c[at] @ q[i]
                    if len(at) > top:
                        kth = np.partition(scores, len(at) - top)[len(at) - top]
                        least[i] = max(least[i], kth)
                        at, scores = at[scores >= kth], scores[scores >= kth]
                    best = np.lexsort((ids[at], -scores))[:top]
                    out.extend((row["lane"], i, qids[i], ids[at[b]], scores[b]) for b in best)
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=k.to_pandas_dtype())) for x, k in zip(columns, kinds, strict=True)], names)

    return pairs.mapInArrow(score, _FOUND)


def _paired(blocks: DataFrame, lanes: DataFrame, n_lanes: int) -> DataFrame:
    """Every block with every block of queries whose lengths can reach a threshold there."""
    known = lanes.select("lane", "reach", "floor")
    meet = blocks.select("block", "top").withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_lanes - 1).cast("long"))))
    meet = meet.join(known, "lane").where(F.col("top") * F.col("reach") * (1 + 1e-9) >= F.col("floor")).select("block", "lane")
    pairs = meet.join(blocks, "block").join(lanes.drop("reach", "floor"), "lane")
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts, "lane", "block").sortWithinPartitions("lane", F.desc("top"))


def top_products(table: DataFrame, every: int = EVERY, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, the best of all other rows."""
    spark = table.sparkSession
    ship_package(spark)
    vectors = written(whole_vectors(table, scale), "vectors")
    width, n_queries = vectors.agg(F.max(F.size("v")), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    directions = rotation(vectors, width)
    blocks = written(_blocks(vectors, width, BLOCK), "blocks")
    n_lanes = -(-n_queries // QUERIES)
    queries = vectors.where(F.col("vec_id") % every == 0)
    lanes = written(_query_blocks(queries, width, n_lanes), "queries")
    plain = lanes.withColumns({"least": F.lit(None).cast("binary"), "floor": F.lit(float("-inf"))})
    longest = blocks.orderBy(F.desc("top"), "block").limit(SEEDS)  # a few blocks, whatever the table
    seeds = _scored(_paired(longest, plain, n_lanes), directions, top)
    lanes = written(_with_thresholds(plain, seeds, top), "thresholds")
    found = _scored(_paired(blocks, lanes, n_lanes), directions, top)
    order = Window.partitionBy("lane", "q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _with_thresholds(lanes: DataFrame, found: DataFrame, top: int) -> DataFrame:
    """``lanes`` with each query's ``top``-th score so far, where it has that many."""
    import pandas as pd

    order = Window.partitionBy("lane", "q").orderBy(F.desc("score"), "vec_id")
    kth = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == top).select("lane", "q", "score")

    def fill(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        least = np.full(len(left["qids"].iloc[0]) // 8 if len(left) else 0, -np.inf)
        least[right["q"].to_numpy(int)] = right["score"].to_numpy(float)
        left["least"], left["floor"] = [least.tobytes()] * len(left), least.min(initial=np.inf)
        return left

    schema = "lane long, reach double, qids binary, qdata binary, least binary, floor double"
    return lanes.select("lane", "reach", "qids", "qdata", "least", "floor").groupBy("lane").cogroup(kth.groupBy("lane")).applyInPandas(fill, schema)
