"""Substring dedup with prefix-partitioned suffix trees.

Every window of ``WINDOW`` words is a suffix of its document, cut at that depth. The suffixes are dealt to groups by a prefix of variable
length, and each group's subtree is built on its own. The first partition goes by a five-word phrase: the one with the least hash in
the window, so neighbouring suffixes mostly share it and travel as one stretch of text, and equal windows always agree on it. Groups
with a single stretch hold no repeat and are dropped before any text moves. The next, longer prefix is the whole stretch: equal
stretches are one branch, all but the first of them repeat it, and Spark finds the first without gathering them. A group of
different stretches that fits memory has its suffixes sorted; the common prefixes of neighbours make the subtree, and its
internal nodes at full depth are the repeats. A larger group is split once more by the whole window of each suffix; such a group is a
deep node already, and all it needs is its first suffix.

In each node the suffix that starts earliest (least doc_id, then least start) stays; words under any other are removed. Windows are judged
on the input. Words are compared by 64-bit hashes, whole stretches and windows of a split group by 128 bits.

Null and blank texts have no words. Texts under ``WINDOW`` words lose nothing. A null doc_id comes last; rows without id count as
one document, as do rows of equal id, so equal starts there remove nothing. Repeated rows get equal results. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import last_id, written
from sheetwise.llm.hashing import U64, chunks, mix, odd_numbers, word_hashes, word_places
from sheetwise.session import ship_package

WINDOW, PHRASE = 20, 5
#: A group of more different stretches than this (about 10 MB of text) is split by longer prefixes.
GROUP = 50_000
#: A stretch holds at most this many suffixes, however repetitive a text is.
STRETCH = 64
#: Suffixes that a task sorts at a time.
SORTED = 60_000


class Stretches:
    """Runs of neighbouring suffixes with one phrase, for a run of texts."""

    def __init__(self, texts: list[bytes], window: int):
        self.words, self.counts = word_hashes(texts)
        ends = np.cumsum(self.counts)
        self.begins = ends - self.counts
        n, width = len(self.words), window - PHRASE + 1
        self.key = self.text = self.lo = self.size = self.inner = np.zeros(0, np.int64)
        if n < window:
            return
        factors = odd_numbers(PHRASE, 7)
        phrase = sum((factors[j] * self.words[j : n - PHRASE + 1 + j] for j in range(1, PHRASE)), factors[0] * self.words[: n - PHRASE + 1])
        phrase = mix(phrase)
        least, reach = phrase, 1
        while reach < width:  # minimum over `width` phrases, by doubling
            step = min(reach, width - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        at = np.flatnonzero(np.repeat(np.maximum(self.counts - window + 1, 0), self.counts) > np.arange(n) - np.repeat(self.begins, self.counts))
        if not len(at):
            return
        of = np.repeat(np.arange(len(texts)), self.counts)[at]
        key, start = least[at], at - self.begins[of]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        first = np.flatnonzero(fresh | (since % STRETCH == 0))
        self.key, self.text, self.lo = key[first].view(np.int64), of[first], start[first]
        self.size = np.diff(np.append(first, len(at)))
        again = np.zeros(len(phrase) + 1, np.int64)  # does a phrase come again within a window's reach?
        for k in range(1, width + 1):  # neighbouring windows share a phrase up to a gap of ``width``
            again[1 : len(phrase) - k + 1] |= phrase[k:] == phrase[:-k]
        again = np.cumsum(again)
        begin = self.begins[self.text] + self.lo
        self.inner = (again[np.minimum(begin + self.size + width - 2, len(phrase))] > again[begin]).astype(np.int64)


def _phrases(docs: DataFrame, window: int) -> DataFrame:
    """``rid, key, c``: the groups that each text's stretches belong to, and how often (2 stands for more)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch["rid"].to_numpy(zero_copy_only=False)
            for first, run in chunks(batch["text"].to_pylist()):
                s = Stretches(run, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids[first + s.text] if len(s.key) else s.key), pa.array(s.key), pa.array(s.inner + 1)], ["rid", "key", "c"]
                )

    return docs.mapInArrow(scan, "rid long, key long, c long")


_ROW = "key long, one long, two long, oid long, rid long, lo int, size int, words binary"


def _suffixes(docs: DataFrame, window: int) -> DataFrame:
    """Stretches of shared groups: their words, a checksum of those, and the starts they hold."""
    names = [part.split()[0] for part in _ROW.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            oids, rids = (batch[c].to_numpy(zero_copy_only=False) for c in ("oid", "rid"))
            keys = batch["keys"].to_pylist()
            for first, run in chunks(batch["text"].to_pylist()):
                s = Stretches(run, window)
                bounds = np.searchsorted(s.text, np.arange(len(run) + 1))
                shared = np.zeros(len(s.key), bool)
                for i in range(len(run)):
                    a, b = bounds[i], bounds[i + 1]
                    if b > a:
                        shared[a:b] = np.isin(s.key[a:b], keys[first + i])
                at = np.flatnonzero(shared)
                if not len(at):
                    continue
                begin = s.begins[s.text[at]] + s.lo[at]
                length = s.size[at] + window - 1
                data, starts, ends, _ = word_places(run)
                data = data.tobytes()
                cut = [data[a:b] for a, b in zip(starts[begin].tolist(), ends[begin + length - 1].tolist(), strict=True)]
                inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                word = s.words[np.repeat(begin, length) + inside]
                opens = np.cumsum(length) - length
                sums = [np.add.reduceat(mix(word + U64(seed) * mix(inside.astype(U64) + U64(seed))), opens) for seed in (1, 3)]
                of = first + s.text[at]
                columns = [s.key[at], *(x.view(np.int64) for x in sums), oids[of], rids[of], s.lo[at].astype(np.int32), s.size[at].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(cut, pa.binary())], names)

    return docs.mapInArrow(scan, _ROW)


def _windows(stretches: DataFrame, window: int) -> DataFrame:
    """Every suffix of a stretch by its whole window."""
    factors = odd_numbers(window, 8), odd_numbers(window, 9)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = word_hashes(batch["words"].to_pylist())
            sizes = counts - window + 1
            row = np.repeat(np.arange(len(sizes)), sizes)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = (np.cumsum(counts) - counts)[row] + inside
            sums = [mix(sum((f[j] * words[at + j] for j in range(1, window)), f[0] * words[at])).view(np.int64) for f in factors]
            oid, rid, lo = (batch[c].to_numpy(zero_copy_only=False)[row] for c in ("oid", "rid", "lo"))
            columns = [*sums, oid, rid, (lo + inside).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["one", "two", "oid", "rid", "lo"])

    return stretches.select("oid", "rid", "lo", "words").mapInArrow(scan, "one long, two long, oid long, rid long, lo int")


def _subtrees(stretches: DataFrame, window: int) -> DataFrame:
    """Build the subtree of every group and report the suffixes under deep nodes that are not the first, as ranges of starts."""

    def repeats(rows: pa.Table) -> pa.RecordBatch:
        hashed, counts = word_hashes(rows["words"].to_pylist())
        begins = np.cumsum(counts) - counts
        sizes = counts - window + 1
        row = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        oid, rid, lo = (rows[c].to_numpy() for c in ("oid", "rid", "lo"))
        group, start = rows["key"].to_numpy()[row], lo[row] + inside
        suffix = np.stack([hashed[begins[row] + inside + j] for j in range(window)])
        order = np.lexsort((start, oid[row], *suffix[::-1], group))  # leaves of the subtrees, left to right
        group, suffix = group[order], suffix[:, order]
        shared = np.cumprod((suffix[:, 1:] == suffix[:, :-1]) & (group[1:] == group[:-1]), axis=0).sum(axis=0)  # depth of the node between two leaves
        deep = np.concatenate([[False], shared >= window])
        head = np.maximum.accumulate(np.where(deep, 0, np.arange(len(order))))  # a deep node's first leaf
        own, first = order, order[head]
        later = (oid[row[own]] > oid[row[first]]) | ((oid[row[own]] == oid[row[first]]) & (start[own] > start[first]))
        marked = np.zeros(len(order) + 1, bool)
        marked[own[later]] = True
        marked = marked[:-1]
        opens = marked & np.concatenate([[True], ~marked[:-1] | (row[1:] != row[:-1])])
        closes = marked & np.concatenate([~marked[1:] | (row[1:] != row[:-1]), [True]])
        a, b = np.flatnonzero(opens), np.flatnonzero(closes)
        columns = [oid[row[a]], rid[row[a]], start[a].astype(np.int32), start[b].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["oid", "rid", "lo", "hi"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many * 8 < SORTED:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows["key"].to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            for part in _cuts(keys[:whole]):
                yield repeats(rows.slice(*part))
            rest = rows.slice(whole)
            held, many = rest.combine_chunks().to_batches(), rest.num_rows
        if many:
            rows = pa.Table.from_batches(held)
            for part in _cuts(rows["key"].to_numpy()):
                yield repeats(rows.slice(*part))

    dealt = stretches.select("key", "oid", "rid", "lo", "words").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(build, "oid long, rid long, lo int, hi int")


def _cuts(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of whole groups, of about ``SORTED`` suffixes each."""
    at, step = 0, SORTED // 8
    while at < len(keys):
        end = min(at + step, len(keys))
        if end < len(keys):
            end = int(np.searchsorted(keys, keys[end - 1], "right"))
        yield at, end - at
        at = end


def repeated_ranges(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``oid, rid, lo, hi``: starts of windows that came earlier. ``docs`` has ``oid``, ``rid`` and ``text``."""
    ship_package(docs.sparkSession)
    phrases = written(_phrases(docs.select("rid", "text"), window), "phrases")
    shared = phrases.groupBy("key").agg(F.sum("c").alias("many")).where("many > 1").select("key")
    keys = phrases.select("rid", "key").join(shared, "key").groupBy("rid").agg(F.collect_set("key").alias("keys"))
    keys = written(keys, "shared-phrases")
    found = written(_suffixes(docs.join(keys, "rid").select("oid", "rid", "text", "keys"), window), "stretches")
    branch = ["key", "one", "two"]
    firsts = found.groupBy(*branch).agg(F.min(F.struct("oid", "lo")).alias("first"), F.count("*").alias("leaves"))
    firsts = written(firsts, "branches")
    place = F.struct("oid", "lo")
    slim = found.select(*branch, "oid", "rid", "lo", "size").join(firsts.where("leaves > 1"), branch).where(place > F.col("first"))
    copies = slim.select("oid", "rid", "lo", (F.col("lo") + F.col("size") - 1).alias("hi"))
    heads = found.join(firsts.drop("leaves"), branch).where(place == F.col("first"))
    # rows without an id stand at one place: one head for each text of a branch, however many copies it has
    heads = heads.dropDuplicates([*branch, "rid"]).select("key", "oid", "rid", "lo", "words")
    heads = written(heads, "heads")  # texts are dealt out twice, by branch and by group; so one shuffle is gone before the next
    wide = written(firsts.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > group).select("key"), "wide-groups")
    if wide.isEmpty():
        return copies.unionByName(_subtrees(heads, window))
    small = _subtrees(heads.join(wide, "key", "left_anti"), window)
    nodes = _windows(heads.join(wide, "key", "left_semi"), window)
    least = nodes.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("leaves")).where("leaves > 1")
    late = nodes.join(least, ["one", "two"]).where(place > F.col("first"))
    return copies.unionByName(small).unionByName(late.select("oid", "rid", "lo", F.col("lo").alias("hi")))


def _identified(docs: DataFrame) -> DataFrame:
    oid = last_id()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), oid.alias("oid"), F.xxhash64(oid, "text").alias("rid"), "text")


def without_repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: every document without the words that repeat earlier text, kept words joined by a space."""
    named = _identified(docs)
    ranges = repeated_ranges(named, window, group).groupBy("oid", "rid").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    ranges = written(ranges, "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch["ranges"].to_pylist()
            ids = batch["doc_id"]
            for first, run in chunks(batch["text"].to_pylist()):
                data, starts, ends, counts = word_places(run)
                data, begins = data.tobytes(), np.cumsum(counts) - counts
                removed, texts = [], []
                for i, n in enumerate(counts):
                    change = np.zeros(n + 1, np.int64)
                    for r in ranges[first + i] or ():
                        change[r["lo"]] += 1
                        change[r["hi"] + window] -= 1
                    keep = np.cumsum(change)[:-1] == 0
                    at = begins[i] + np.flatnonzero(keep)
                    removed.append(int(n) - len(at))
                    texts.append(b" ".join([data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
                columns = [ids.slice(first, len(run)), pa.array(counts.astype(np.int64)), pa.array(removed, pa.int64())]
                whole = pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, whole], ["doc_id", "n_words", "n_removed", "text"])

    joined = named.join(ranges, ["oid", "rid"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string")


def repeat_digests(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """The same with a checksum for the text."""
    return without_repeats(docs, window, group).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )
