"""Hard negatives by score bounds along spanning trees of anchors.

For every anchor, the rows of its label that score highest with it are its positives; the rows of other labels that score within a window below
a positive are its hard negatives. Anchors are dealt into groups of near ones, and each group gets a spanning tree: a minimum spanning tree over
small lanes of anchors, whose roots hang in a minimum spanning tree of their own. A task meets one group with one share of the candidates.
Only the group's root is scored with all of them. A child's score is its parent's plus the product with the edge between them, so it lies within
parent's bounds plus or minus edge length times candidate length (Cauchy-Schwarz). Candidates whose bounds overlap the child's window are scored
exactly, which tightens the bounds for the children below; all others are passed over. Windows shrink while a task runs: for positives to what beats the
best so far, for negatives to what beats those found within the window.

Groups and lanes decide only what can be passed over; results are exact, as long as scores stay below 2^63. Candidates are sent once to each group of
``GROUP`` anchors, never paired with single anchors; what leaves a task is bounded by anchors, positives and ``top``.

Rows with a null id, a null label, a null vector, or any null or non-finite component take no part. A vector shorter than another counts as padded
with zeros. Rows that share an anchor's id are all its own; a repeated anchor row is asked once, two different rows under one anchor id are both
asked. Repeated candidates count each, as positives and as negatives. Positives with negative scores have empty windows. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import written
from sheetwise.session import ship_package

SCALE, EVERY, POSITIVES, TOP = 256, 100, 5, 10
#: The window, in hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Anchors of a group and of a lane, candidates of a task and of a step, centres at most (they only deal anchors into groups).
GROUP, LANE, SHARE, STEP, CENTRES = 16384, 256, 16384, 2048, 256


def whole_rows(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, components as whole numbers."""
    value = F.col("embedding")
    usable = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & value.isNotNull() & usable)
    whole = F.transform(value, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


# spanning trees


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and edge length of every point in a minimum spanning tree from point 0, whose parent is -1."""
    n = len(points)
    parent, edge, near = np.full(n, -1), np.zeros(n), np.full(n, np.inf)
    inside = np.zeros(n, bool)
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        far = np.linalg.norm(points - points[at], axis=1)
        closer = ~inside & (far < near)
        near[closer], parent[closer] = far[closer], at
        at = int(np.argmin(np.where(inside, np.inf, near)))
        edge[at] = near[at]
    return parent, edge


def lanes_of(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Indices in lanes of at most ``size`` near points: halves along the direction between two far ones."""
    todo, out = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        here = points[own]
        a = np.argmax(np.linalg.norm(here - here[0], axis=1))
        b = np.argmax(np.linalg.norm(here - here[a], axis=1))
        along = np.argsort(here @ (here[b] - here[a]), kind="stable")
        todo += [own[along[len(own) // 2 :]], own[along[: len(own) // 2]]]
    return out


def planted(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lane, depth in its lane, parent and edge length of each point, one tree over all of them.

    The root of a lane has depth 0 and the root of another lane as its parent; lanes are numbered parents first.
    """
    lanes = lanes_of(points, size)
    above, far = spanning_tree(points[[own[0] for own in lanes]])
    rank = np.argsort(_depths(above), kind="stable")
    lane, depth, parent, edge = (np.zeros(len(points), int) for _ in range(4))
    edge = edge.astype(float)
    for number, k in enumerate(rank):
        own = lanes[k]
        up, length = spanning_tree(points[own])
        lane[own], depth[own], edge[own] = number, _depths(up), length
        parent[own] = np.where(up >= 0, own[up], -1)
        if above[k] >= 0:
            parent[own[0]], edge[own[0]] = lanes[above[k]][0], far[k]
    return lane, depth, parent, edge


def _depths(parent: np.ndarray) -> np.ndarray:
    depth, up = np.zeros(len(parent), int), parent
    while (up >= 0).any():
        depth += up >= 0
        up = np.where(up >= 0, parent[up], -1)
    return depth


_TREE = "grp int, place int, a long, vec_id long, label long, v array<long>, lane int, depth int, parent int, edge double"


def anchor_trees(anchors: DataFrame, group: int = GROUP, lane: int = LANE) -> tuple[DataFrame, int]:
    """The anchors ``a, vec_id, label, v`` in groups, with their place in the tree of their group; and the number of groups."""
    n = anchors.count()
    centres = anchors.orderBy(F.xxhash64("a"), "a").limit(min(CENTRES, -(-n // group))).toArrow()  # a few rows
    points = _matrix(centres["v"]).astype(float)

    def nearest(batches):
        for batch in batches:
            own = _matrix(pa.chunked_array([batch["v"]])).astype(float)
            far = (own**2).sum(axis=1)[:, None] - 2 * own @ points.T + (points**2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(axis=1).astype(np.int32))], [*batch.schema.names, "centre"])

    dealt = anchors.mapInArrow(nearest, "a long, vec_id long, label long, v array<long>, centre int") if len(points) > 1 else anchors.withColumn("centre", F.lit(0))
    dealt = written(dealt, "anchors")
    first, begins, parts = 0, {}, {}
    for row in dealt.groupBy("centre").count().orderBy("centre").collect():  # a row for each centre
        begins[row["centre"]], parts[row["centre"]] = first, -(-row["count"] // group)
        first += parts[row["centre"]]
    look = lambda known: F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("centre"))
    dealt = dealt.withColumn("grp", (look(begins) + F.pmod(F.xxhash64("a"), look(parts))).cast("int"))

    def plant(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        own = own.sort_by([("a", "ascending")])
        of, depth, parent, edge = planted(_matrix(own["v"]).astype(float), lane)
        count = len(of)
        ints = [pa.array(x.astype(np.int32)) for x in (np.full(count, key[0].as_py()), np.arange(count), of, depth, parent)]
        return pa.table({
            "grp": ints[0], "place": ints[1], "a": own["a"], "vec_id": own["vec_id"], "label": own["label"], "v": own["v"],
            "lane": ints[2], "depth": ints[3], "parent": ints[4], "edge": pa.array(edge),
        })

    return dealt.groupBy("grp").applyInArrow(plant, _TREE), first


# scanning


def best_of(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Which entries are among the ``top`` of their key, by score and then the smaller id; in the order of key and rank."""
    order = np.lexsort((ids, -scores, keys))
    sorted_keys = keys[order]
    starts = np.flatnonzero(np.diff(sorted_keys, prepend=sorted_keys[:1] - 1)) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[rank < top]


class Kept:
    """The best entries so far of a lane's windows: for each slot (an anchor's window) scores between ``low`` and ``high``."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, top: int):
        self.anchor, self.low, self.high, self.top = anchor, low.astype(float), high.astype(float), top
        self.by_anchor = np.argsort(anchor, kind="stable")
        self.first = np.searchsorted(anchor[self.by_anchor], np.arange(n + 1))
        self.n, self.slot = n, np.zeros(0, int)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """What scores an anchor's windows still take, from and to."""
        low, high = np.full(self.n, np.inf), np.full(self.n, -np.inf)
        np.minimum.at(low, self.anchor, self.low)
        np.maximum.at(high, self.anchor, self.high)
        return low, high

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        many = np.diff(self.first)[anchor]
        at = np.repeat(self.first[anchor] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        slot = self.by_anchor[at]
        score, ids = np.repeat(score, many), np.repeat(ids, many)
        fits = (score >= self.low[slot]) & (score <= self.high[slot])
        slot, score, ids = (np.concatenate([x, y[fits]]) for x, y in ((self.slot, slot), (self.score, score), (self.id, ids)))
        keep = best_of(slot, score, ids, self.top)
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = np.bincount(self.slot, minlength=len(self.low)) == self.top
        ends = np.searchsorted(self.slot, np.flatnonzero(full), "right") - 1
        self.low[full] = np.maximum(self.low[full], self.score[ends])


def scan(tree: dict[str, np.ndarray], cands: dict[str, np.ndarray], lanes: list[Kept], alike: bool, step: int = STEP) -> int:
    """Every lane's windows over the candidates with the anchor's label (``alike``) or with another one. Returns how many scores were computed.

    ``lanes`` hold windows over the places of their lane, in the order of the rows of ``tree``.
    """
    v, norm = tree["v"], np.linalg.norm(cands["v"].astype(float), axis=1)
    rows = [np.flatnonzero(tree["lane"] == k) for k in range(len(lanes))]
    whole = float(np.abs(v).sum(axis=1, dtype=float).max(initial=0)) * float(np.abs(cands["v"]).max(initial=0)) >= 2**53
    kind = np.int64 if whole else float
    slack = 1e-9 * (1 + float(np.linalg.norm(v.astype(float), axis=1).max(initial=0)) * float(norm.max(initial=0)))
    computed = 0
    for start in range(0, len(norm), step):
        c, length = cands["v"][start : start + step].astype(kind), norm[start : start + step]
        ids, label = cands["vec_id"][start : start + step], cands["label"][start : start + step]
        roots: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # bounds of each lane's root, by its place
        for own, kept in zip(rows, lanes, strict=True):
            inner = np.full(len(v), -1)
            inner[own] = np.arange(len(own))
            low, high = kept.reach()
            least, most = np.full((len(own), len(c)), -np.inf), np.full((len(own), len(c)), np.inf)
            wanted = (tree["label"][own][:, None] == label) == alike
            wanted &= tree["vec_id"][own][:, None] != ids
            found = []
            for depth in range(int(tree["depth"][own].max(initial=-1)) + 1):
                level = np.flatnonzero(tree["depth"][own] == depth)
                up, edge = tree["parent"][own[level]], tree["edge"][own[level]][:, None] * length
                if depth:
                    least[level], most[level] = least[inner[up]] - edge, most[inner[up]] + edge
                elif up[0] >= 0:
                    least[level], most[level] = roots[int(up[0])][0] - edge, roots[int(up[0])][1] + edge
                open_ = (most[level] >= low[level][:, None] - slack) & (least[level] <= high[level][:, None] + slack) & wanted[level]
                if depth == 0 and up[0] < 0 or open_.mean() > 0.25:
                    scores = v[own[level]].astype(kind) @ c.T
                    computed += scores.size
                    least[level] = most[level] = scores
                    i, j = np.nonzero(open_)
                    score = scores[i, j]
                else:
                    i, j = np.nonzero(open_)
                    score = np.einsum("ij,ij->i", v[own[level[i]]].astype(kind), c[j])
                    computed += len(score)
                    least[level[i], j] = most[level[i], j] = score
                hit = (score >= low[level[i]]) & (score <= high[level[i]])
                found.append((level[i[hit]], score[hit].astype(np.int64), ids[j[hit]]))
            if len(own):
                top = np.flatnonzero(tree["depth"][own] == 0)[0]
                roots[int(own[top])] = least[top], most[top]
                kept.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return computed


def _arrays(table: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {"v": _matrix(table["v"]), **{name: _column(table, name) for name in names}}


def _met(trees: DataFrame, vectors: DataFrame, groups: int, shares: int):
    """Every group of anchors with every share of the candidates."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = trees.withColumn("share", every(shares)).groupBy("grp", "share")
    share = F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int")
    right = vectors.select("vec_id", "label", "v", share.alias("share"), every(groups).alias("grp")).groupBy("grp", "share")
    return left.cogroup(right)


def _positives(trees: DataFrame, vectors: DataFrame, groups: int, shares: int, top: int) -> DataFrame:
    """``a, p, positive_id, positive_score``: the first rows of each anchor's label."""

    def mine(anchors: pa.Table, cands: pa.Table) -> pa.Table:
        anchors = anchors.sort_by([("place", "ascending")])
        tree = _arrays(anchors, ("vec_id", "label", "lane", "depth", "parent", "edge"))
        sizes = np.bincount(tree["lane"]) if len(anchors) else []
        lanes = [Kept(np.arange(n), np.full(n, -np.inf), np.full(n, np.inf), n, top) for n in sizes]
        if len(anchors) and len(cands):
            scan(tree, _arrays(cands, ("vec_id", "label")), lanes, True)
        a = [tree_rows[k.slot] for tree_rows, k in zip(_lane_rows(tree, len(lanes), _column(anchors, "a")), lanes, strict=True)]
        return _result(["a", "positive_id", "positive_score"], [a, [k.id for k in lanes], [k.score for k in lanes]])

    found = _met(trees, vectors, groups, shares).applyInArrow(mine, "a long, positive_id long, positive_score long")
    order = Window.partitionBy("a").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("p", F.row_number().over(order)).where(F.col("p") <= top)


def _lane_rows(tree: dict[str, np.ndarray], lanes: int, values: np.ndarray) -> list[np.ndarray]:
    return [values[tree["lane"] == k] for k in range(lanes)]


def _result(names: list[str], columns: list[list[np.ndarray]]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for n, x in zip(names, columns, strict=True)})


def window_of(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The whole scores s with ``low * score <= 100 * s <= high * score``, from and to."""
    return -(-low * score // 100), high * score // 100


def _negatives(trees: DataFrame, vectors: DataFrame, groups: int, shares: int, top: int, low: int, high: int) -> DataFrame:
    """``a, p, negative_id, negative_score, rank``; ``trees`` also holds each anchor's ``positives`` (p, score)."""

    def mine(anchors: pa.Table, cands: pa.Table) -> pa.Table:
        anchors = anchors.sort_by([("place", "ascending")])
        tree = _arrays(anchors, ("vec_id", "label", "lane", "depth", "parent", "edge"))
        count = int(tree["lane"].max(initial=-1)) + 1
        windows = [[(x["p"], *window_of(x["score"], low, high)) for x in own or []] for own in anchors["positives"].to_pylist()]
        lanes, ranks = [], []
        for own in _lane_rows(tree, count, np.arange(len(anchors))):
            slots = [(i, *w) for i, at in enumerate(own) for w in windows[at] if w[1] <= w[2]]
            i, p, least, most = (np.array(x) for x in zip(*slots, strict=True)) if slots else (np.zeros(0, int),) * 4
            lanes.append(Kept(i, least, most, len(own), top))
            ranks.append((p, i))
        if len(anchors) and len(cands):
            scan(tree, _arrays(cands, ("vec_id", "label")), lanes, False)
        names = _lane_rows(tree, count, _column(anchors, "a"))
        a = [of[i[k.slot]] for of, (_, i), k in zip(names, ranks, lanes, strict=True)]
        p = [p[k.slot] for (p, _), k in zip(ranks, lanes, strict=True)]
        return _result(["a", "p", "negative_id", "negative_score"], [a, p, [k.id for k in lanes], [k.score for k in lanes]])

    found = _met(trees, vectors, groups, shares).applyInArrow(mine, "a long, p long, negative_id long, negative_score long")
    order = Window.partitionBy("a", "p").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def hard_negatives(
    table: DataFrame, every: int = EVERY, positives: int = POSITIVES, top: int = TOP, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    group: int = GROUP, lane: int = LANE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for anchors whose id ``every`` divides."""
    spark = table.sparkSession
    ship_package(spark)
    vectors = written(whole_rows(table, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, width, asked = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    if not asked:
        kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], kinds)
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(max(width, 1)) - F.size("v"))
    vectors = vectors.withColumn("v", F.concat("v", zeros))
    anchors = vectors.where(F.col("vec_id") % every == 0).select("vec_id", "label", "v").distinct()
    anchors = written(anchors.select(F.monotonically_increasing_id().alias("a"), "vec_id", "label", "v"), "anchors")
    trees, groups = anchor_trees(anchors, group, lane)
    trees = written(trees, "trees")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = max(-(-n // SHARE), min(parts, -(-n // 512)))
    best = written(_positives(trees, vectors, groups, shares, positives), "positives")
    listed = best.groupBy("a").agg(F.collect_list(F.struct("p", F.col("positive_score").alias("score"))).alias("positives"))  # a few each
    found = _negatives(trees.join(listed, "a", "left"), vectors, groups, shares, top, low, high)
    named = anchors.select("a", F.col("vec_id").alias("anchor_id")).join(best, "a")
    out = found.join(named, ["a", "p"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
