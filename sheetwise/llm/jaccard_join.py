"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles. Documents with equal sets are one class; one of them stands for it. Every class
gets a MinHash sketch. Each run starts all classes in one bucket and splits buckets recursively: a bucket draws
``BRANCH`` sketch coordinates, and every member goes to the bucket of its token at each of them. Pairs at the wanted similarity stay
together on some path of a run with probability ``path_recall``; runs are repeated until the target recall.
Small buckets are finished by brute force. In a larger one all members are held against one of them, the pivot: members close to it
are linked and, if very close, leave the bucket; the others split further. So far sketches decide, with a wide
margin; the components of those links are then compared set by set, which decides every link exactly.

Null and blank texts have no shingles, no links and a class of their own. Texts of one to four words have one shingle. Copies count as
one text: ``n_links`` counts linked different texts, ``n_copies`` the other rows with the same set. A null doc_id orders
last and is never the id of a class that has another. An empty table gives an empty result. Extra columns are kept by
``one_of_each`` and ignored by ``near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import last_id, written
from sheetwise.llm.graph import components
from sheetwise.llm.hashing import U64, chunks, mix, odd_numbers, parts, shingles, word_hashes
from sheetwise.session import ship_package

WIDTH = 5
#: The similarity wanted, as a fraction.
WANTED = (4, 5)
SKETCH, BRANCH, RECALL = 64, 2, 0.9999
#: Sketch agreement from which two classes are compared exactly, and from which a member leaves with its pivot.
LINK, LEAVE = 0.40, 0.70
#: Buckets up to this size are finished by brute force.
SMALL = 1000
#: Bits of the filter that passes sets of texts with a candidate over before they are dealt out (8 MB, whatever the input).
FILTER_BITS = 1 << 26
#: A task of the exact comparison holds two blocks of about this many sets and bytes.
BLOCK_SETS, BLOCK_BYTES = 256, 4 << 20


def path_recall(similarity: float, branch: int = BRANCH) -> float:
    """How likely a pair of this similarity stays together on some path, however deep the recursion goes."""
    s = 1.0
    for _ in range(200):
        s = 1 - (1 - similarity * s) ** branch
    return s


def runs_for(recall: float, similarity: float, branch: int = BRANCH) -> int:
    """Runs until a pair of the wanted similarity is found with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - path_recall(similarity, branch))))


def set_key(own: np.ndarray) -> bytes:
    """128 bits for a set given as sorted distinct hashes."""
    a, b = mix(own).sum(dtype=U64), mix(own ^ U64(0x9E3779B97F4A7C15)).sum(dtype=U64)
    return int(a).to_bytes(8, "big") + int(b + U64(len(own))).to_bytes(8, "big")


def _sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The set of each text: sorted distinct shingle hashes."""
    for _, run in chunks(texts):
        found, sizes = shingles(*word_hashes(run), width)
        ends = np.cumsum(sizes)
        for a, b in zip(ends - sizes, ends, strict=True):
            yield np.unique(found[a:b])


def _places(keys: list[bytes], oids: np.ndarray) -> np.ndarray:
    """The bit of the filter that a set and its id have."""
    return mix(np.frombuffer(b"".join(key[:8] for key in keys), "<u8") + mix(oids.astype(np.int64).view(U64))) % U64(FILTER_BITS)


def _filter(members: DataFrame) -> np.ndarray:
    """Bits of all ``key, oid``, put together by pages of 4 KB; the driver gets 8 MB at most."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch["key"].to_pylist(), batch["oid"].to_numpy(zero_copy_only=False)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], ["page", "bit"])

    bits = members.select("key", "oid").mapInArrow(emit, "page long, bit long")
    pages = bits.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for page, found in pages.collect():
        out[page] = np.frombuffer(found, np.uint8)
    return out.reshape(-1)


def _set_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``oid, key, set`` of rows with ``oid, text``, some texts at a time."""
    for batch in (part for whole in batches for part in parts(whole)):
        own = list(_sets(batch["text"].to_pylist(), width))
        keys = [set_key(s) if len(s) else None for s in own]
        data = [s.astype("<u8").tobytes() for s in own]
        yield pa.RecordBatch.from_arrays([batch["oid"], pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["oid", "key", "set"])


def _places(batch: pa.RecordBatch) -> np.ndarray:
    """The bit of the filter that each ``key, oid`` has; keys are hashes."""
    keys = np.frombuffer(b"".join(key[:8] for key in batch["key"].to_pylist()), "<u8")
    return (mix(keys ^ mix(batch["oid"].to_numpy(zero_copy_only=False).view(U64))) % U64(FILTER_BITS)).astype(np.int64)


def _filter(members: DataFrame) -> np.ndarray:
    """The bits of all ``key, oid``, in bytes. They come to the driver in pages of 4 KB, 2,048 at most."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], ["page", "bit"])

    bits = members.select("key", "oid").mapInArrow(emit, "page long, bit long").repartition("page")
    out = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for page, found in bits.groupBy("page").agg(F.bitmap_construct_agg("bit")).collect():
        out[page] = np.frombuffer(found, np.uint8)
    return out.reshape(-1)


def _passing(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose ``key, oid`` the filter has; few others."""
    for batch in batches:
        some = batch.filter(pc.is_valid(batch["key"]))
        at = _places(some)
        yield some.filter(pa.array((wanted[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without its text, with ``key`` (null without shingles), ``n`` (set size) and ``sketch``."""
    factors = odd_numbers(SKETCH, 11)
    ship_package(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            rest = batch.drop_columns(["text"])
            keys, sizes, marks = [], [], []
            for own in _sets(batch["text"].to_pylist(), width):
                sizes.append(len(own))
                keys.append(set_key(own) if len(own) else None)
                if not len(own):
                    marks.append(None)
                    continue
                best = np.full(SKETCH, U64(0xFFFFFFFFFFFFFFFF))
                for at in range(0, len(own), 4096):  # a long text takes no more memory than a short one
                    best = np.minimum(best, (own[at : at + 4096, None] * factors).min(axis=0))
                marks.append((best >> U64(32)).astype("<u4").tobytes())
            extra = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays([*rest.columns, *extra], [*rest.schema.names, "key", "n", "sketch"])

    others = ", ".join(f"{name} {kind}" for name, kind in docs.dtypes if name != "text")
    return docs.mapInArrow(scan, f"{others}, key binary, n long, sketch binary")


def _tokens(batch: pa.RecordBatch, name: str = "sketch") -> np.ndarray:
    return np.frombuffer(b"".join(batch[name].to_pylist()), "<u4").reshape(-1, SKETCH)


def _children(nodes: np.ndarray, tokens: np.ndarray) -> Iterator[np.ndarray]:
    """The next bucket of each row along each path its bucket draws."""
    for b in range(BRANCH):
        drawn = mix(nodes * U64(2 * BRANCH + 1) + U64(b + 1))
        coordinate = (drawn % U64(SKETCH)).astype(np.int64)
        token = tokens[np.arange(len(nodes)), coordinate].astype(U64)
        yield mix(mix(drawn + U64(1)) + mix(token * U64(SKETCH) + coordinate.astype(U64)))


def _roots(classes: DataFrame, runs: int) -> DataFrame:
    """Every class in the first buckets of every run."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(batch)
            for run in range(runs):
                # a run's root draws its coordinates without replacement over all runs, while there are enough
                for b in range(BRANCH):
                    c = (run * BRANCH + b) % SKETCH
                    node = mix(tokens[:, c].astype(U64) + U64(((run + 1) * SKETCH + c) << 32))
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch["key"]], ["node", "key"])

    return classes.select("key", "sketch").mapInArrow(emit, "node long, key binary")


def _split(rows: DataFrame) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch["node"].to_numpy(zero_copy_only=False).view(U64)
            for node in _children(nodes, _tokens(batch)):
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch["key"]], ["node", "key"])

    return rows.select("node", "key", "sketch").mapInArrow(emit, "node long, key binary")


def _agreement(rows: DataFrame) -> DataFrame:
    """``same``: the share of coordinates on which the sketches of a row and its pivot agree."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_tokens(batch) == _tokens(batch, "pivot_sketch")).mean(axis=1)
            kept = batch.drop_columns(["pivot_sketch"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(same)], [*kept.schema.names, "same"])

    return rows.mapInArrow(emit, "node long, key binary, sketch binary, pivot binary, same double")


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least row it is joined to."""
    m = len(linked)
    root = np.arange(m)
    while True:
        lower = np.minimum(root, np.where(linked, root[None, :], m).min(axis=1, initial=m))
        lower = lower[lower]
        if (lower == root).all():
            return root
        root = lower


def _brute_force(rows: DataFrame) -> DataFrame:
    """Compare all sketches inside buckets of at most ``SMALL`` rows; every member is linked to the least key it is joined to."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple[bytes, bytes]] = []
        for _, group in groupby(members, key=lambda r: r[0]):
            own = sorted((key, sketch) for _, key, sketch in group)
            tokens = np.frombuffer(b"".join(sketch for _, sketch in own), "<u4").reshape(-1, SKETCH)
            if len(own) == 2:
                if (tokens[0] == tokens[1]).mean() >= LINK:
                    out.append((own[1][0], own[0][0]))
                continue
            same = np.zeros((len(own), len(own)), np.uint8)
            for c in range(SKETCH):
                same += tokens[:, c, None] == tokens[None, :, c]
            root = _local_roots(same >= LINK * SKETCH)
            out.extend((own[i][0], own[r][0]) for i, r in enumerate(root) if i != r)
            if len(out) > 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    dealt = rows.select("node", "key", "sketch").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(link, "u binary, v binary")


def _links(out: list) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["u", "v"])


def candidate_links(classes: DataFrame, recall: float = RECALL) -> DataFrame:
    """``u, v``: links that join all pairs of classes worth an exact comparison into components."""
    live, links = _roots(classes, runs_for(recall, WANTED[0] / WANTED[1])), None
    sketch_of = classes.select("key", "sketch")
    while True:
        sizes = live.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
        held = written(live.join(sizes, "node").join(sketch_of, "key").select("node", "key", "m", "sketch"), "buckets")
        near = _brute_force(held.where(F.col("m") <= SMALL))
        links = near if links is None else links.unionByName(near)
        large = held.where(F.col("m") > SMALL).drop("m")
        if large.isEmpty():
            return links
        pivots = large.groupBy("node").agg(F.min("key").alias("pivot"), F.min_by("sketch", "key").alias("pivot_sketch"))
        met = large.join(pivots, "node").where("key != pivot").select("node", "key", "sketch", "pivot", "pivot_sketch")
        met = written(_agreement(met), "pivots")
        links = links.unionByName(met.where(F.col("same") >= LINK).select(F.col("key").alias("u"), F.col("pivot").alias("v")))
        live = _split(met.where(F.col("same") < LEAVE))


def _exact(rows: list[tuple[bytes, int, bytes]], lo: int, hi: int) -> Iterator[tuple[bytes, int, bytes]]:
    """Compare the sets of two blocks (or of one with itself): each key with its links here and the least key it is joined to."""
    seen = {key: (block, np.frombuffer(data, "<u8")) for key, block, data in rows}  # repeated rows once
    keys = sorted(seen)
    blocks = np.array([seen[k][0] for k in keys])
    sets = [seen[k][1] for k in keys]
    sizes = np.array([len(s) for s in sets])
    m = len(keys)
    common = np.zeros((m, m), np.float32)
    owner = np.repeat(np.arange(m), sizes)
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for first in range(0, len(tokens), 4096):  # sizes of intersections, some tokens at a time
        a, b = np.searchsorted(column, [first, first + 4096])
        has = np.zeros((m, min(4096, len(tokens) - first)), np.float32)
        has[owner[a:b], column[a:b] - first] = 1
        common += has @ has.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common * WANTED[1] >= union * WANTED[0]
    np.fill_diagonal(linked, False)
    if lo != hi:
        linked &= blocks[:, None] != blocks[None, :]
    root = _local_roots(linked)
    for i in np.flatnonzero(linked.any(axis=1)):
        yield keys[i], int(linked[i].sum()), keys[root[i]]


def exact_links(members: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """``key, comp, n, set`` as ``key, links, root, whole``: pairs inside a component, compared block by block.

    A large component is dealt to blocks, and every pair of blocks is a task's work; each pair of sets meets in exactly one of them.
    ``comps`` holds the members without their sets, where that is at hand; otherwise ``members`` is read twice.
    """
    bounds = (members if comps is None else comps).groupBy("comp").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("tokens") * 8 / BLOCK_BYTES)).cast("int")
    bounds = bounds.select("comp", F.greatest(blocks, F.lit(1)).alias("blocks"))
    dealt = members.join(bounds, "comp").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "blocks", "key", "block", "set"
    )
    tiles = tiles.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (part for batch in batches for part in parts(batch, "set"))
        rows = (row for batch in some for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out = []
        for (_, lo, hi, blocks), group in groupby(rows, key=lambda r: r[:4]):
            out.extend((*found, blocks == 1) for found in _exact([r[4:] for r in group], lo, hi))
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return tiles.mapInArrow(compare, "key binary, links long, root binary, whole boolean")


def _batch(out: list) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[]] * 4
    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "links", "root", "whole"])


def set_classes(docs: DataFrame, rows: DataFrame, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """``key, root, class_id, n_links, n_rows``: every set with its class; ``rows`` are the sketches of ``docs``.

    ``root`` is the class's own key. ``class_id`` is a label: classes without an id, or with documents of one id, share it.
    """
    classes = rows.where("key is not null").groupBy("key").agg(
        F.min("oid").alias("oid"), F.count("*").alias("n_rows"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = written(classes, "set-classes")
    comps = components(candidate_links(classes, recall)).select("key", F.col("root").alias("comp"))
    comps = written(classes.select("key", "oid", "n").join(comps, "key"), "members")

    # only sets with a candidate are dealt out, and the join confirms them; the sets of all texts are twice the input
    bits = docs.sparkSession.sparkContext.broadcast(_filter(comps))
    texts = docs.select(last_id().alias("oid"), "text")
    sets = texts.mapInArrow(lambda batches: _passing(_set_rows(batches, width), bits.value), "oid long, key binary, set binary")
    # by key and id: the copies of one text are dealt out; of those that share the id, or have none, one row stands for all
    members = comps.join(sets, ["key", "oid"]).dropDuplicates(["key", "oid"]).select("key", "comp", "n", "set")
    links = written(exact_links(members, comps), "links")  # the sets are never a table: they do not pack, and would lie beside all later steps
    found = links.groupBy("key").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"))
    dealt = links.where("not whole")  # components of several blocks are put together from their parts
    if not dealt.isEmpty():
        joined = components(dealt.select(F.col("key").alias("u"), F.col("root").alias("v"))).withColumnRenamed("root", "joined")
        found = found.join(joined, "key", "left").select("key", "n_links", F.coalesce("joined", "root").alias("root"))
    labelled = classes.select("key", "oid", "n_rows").join(found, "key", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "key"))
    ids = labelled.groupBy("root").agg(F.min("oid").alias("class_id"))
    return labelled.join(ids, "root").select("key", "root", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_rows")


def _id(column: str) -> Column:
    return F.when(F.col(column) != (1 << 63) - 1, F.col(column))


def near_duplicates(docs: DataFrame, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """One row per document: its class (the least doc_id among linked documents), its links and its copies.

    Unlinked documents that share an id, or have none, can bear the same class id; ``set_classes`` tells them apart by ``root``.
    """
    slim = docs.select("doc_id", last_id().alias("oid"), "text")
    rows = written(sketches(slim, width), "sketches")
    classes = set_classes(docs.select("doc_id", "text"), rows, width, recall)
    joined = rows.select("doc_id", "oid", "key").join(classes, "key", "left")
    return joined.select(
        "doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(_id("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("n_rows") - 1, F.lit(0)).alias("n_copies"),
    )


def one_of_each(docs: DataFrame, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the least doc_id stays, once.

    Unlinked rows all stay, whether they have an id of their own or not, and so do rows without shingles. Rows are written with a
    number first, so columns of any type may come along and equal rows are told apart. Of rows that tie one stays, whichever it is.
    """
    whole = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid")), "numbered")
    slim = whole.select("row.doc_id", "rid", "row.text").withColumn("oid", last_id())
    rows = written(sketches(slim, width), "sketches")
    classes = set_classes(slim.select("doc_id", "text"), rows, width, recall)
    best = rows.join(classes.select("key", "root"), "key").groupBy("root").agg(F.min(F.struct("oid", "rid")).alias("keep"))
    keep = best.select("keep.rid").unionByName(rows.where("key is null").select("rid"))
    return whole.join(keep, "rid", "left_semi").select("row.*")
