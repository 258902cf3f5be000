"""Best-fit packing of documents into sequences, planned on the histogram of their lengths.

Documents longer than a sequence are cut into whole sequences, the first piece taking the rest; no other document is cut.
How many pieces there are of each length is a table of at most ``capacity`` rows. Best fit, longest first, runs over those counts:
it fills ranges of sequences at a time and yields runs, "the pieces of this length with these ranks stand in these sequences at
this offset". A piece finds its place by its length and its rank among the pieces of that length.

Null texts are empty; an empty text is the end token alone. Repeated rows are packed one by one. Pieces of equal rows may take
each other's places. An empty table gives an empty plan. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import written
from sheetwise.session import ship_package

CAPACITY, END = 1024, 2
PARTS = 4096


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, end: int = END, folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the checksum of its ids."""
    stop = end.to_bytes(4, "little")
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sheetwise.llm.tokens import encoder

        encode = encoder(folder=folder)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py() or "") + stop
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    size = min((n - at - 1) % capacity + 1, n - at)
                    rows.append((doc, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, piece = at + size, piece + 1
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return wanted.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Best fit, longest first, over counts per length: runs of (length, first rank, first sequence, offset).

    A run ends where the next run of its length begins. Sequences with the same room left are ranges; each step fills whole
    ranges, so the work depends on the lengths, not on the pieces.
    """
    runs: list[tuple[int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: ranges (first sequence, how many)
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            best = min((r for r in room if r >= length and room[r]), default=capacity)
            fits = best // length
            if room[best]:
                first, many = room[best].pop()
            else:
                first, many = opened, max(1, left // fits)
                opened += many
            full = min(many, left // fits)
            if not full:  # the last few pieces share one sequence
                full, fits = 1, left
            for i in range(fits):
                runs.append((length, rank, first, capacity - best + i * length))
                rank += full
            left -= full * fits
            room[best - fits * length].append((first, full))
            if many > full:
                room[best].append((first + full, many - full))
        room.pop(0, None)
    return runs


def packed(docs: DataFrame, capacity: int = CAPACITY, end: int = END, folder: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    spark = docs.sparkSession
    # with the row's number, so that equal pieces are dealt out too; the written table settles it
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(PARTS)).cast("int")
    pieces = written(pieces_of(docs, capacity, end, folder).withColumn("part", part), "pieces")
    parts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = defaultdict(list)
    for length, *run in plan_best_fit(counts, capacity):
        runs[length].append(tuple(run))
    slots = spark.createDataFrame(
        list(runs.items()), "length long, runs array<struct<rank:bigint,sequence:bigint,offset:bigint>>"
    )
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("ahead") + F.row_number().over(own) - 1)
    # at most capacity rows, each with the runs of one length
    placed = ranked.join(F.broadcast(slots), "length").withColumn(
        "run", F.element_at(F.filter("runs", lambda r: r["rank"] <= F.col("rank")), -1)
    )
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.sequence") + F.col("rank") - F.col("run.rank")).alias("sequence_id"), F.col("run.offset").alias("offset"),
    )
