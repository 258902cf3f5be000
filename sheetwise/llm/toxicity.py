"""Toxicity by a character n-gram linear classifier on naive Bayes log-count ratios.

A document's features are its distinct character n-grams (three to five characters, lower case, hashed to ``BINS``). Each
feature's value is its naive Bayes log-count ratio, the log of how much likelier toxic training documents are to have it; the features
whose ratios stand furthest from chance enter a logistic regression, which weighs them together.

Training takes at most ``SAMPLE`` labelled documents of each label, in the order of a hash of their ids, and none of those held out
(crc32 of the id as text, modulo 5, is 0). The feature counts are one Spark aggregate; the chosen features of the
sample, bounded by ``SAMPLE`` and ``FEATURES``, are fitted on the driver. Every document is then scored whole, inside tasks.

Null and empty texts have no features and score the intercept. A null doc_id counts as the empty text, so it is held out. A document
labelled twice takes the larger label; null labels are none. Repeated rows are scored one by one and trained on once. Without labels of both kinds all
scores are the share of toxic labels (1/4 if there are none). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import written
from sheetwise.llm.hashing import U64, odd_numbers
from sheetwise.session import ship_package

ORDERS = (3, 4, 5)
BINS = 1 << 20
#: Training documents of each label at most, and features kept.
SAMPLE, FEATURES = 4000, 6000
#: A feature is known from this many training documents on.
LEAST = 4
PENALTY, STEPS = 2e-3, 400
CHUNK = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts: index of the first, how many, the text of every n-gram and its bin."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and size < CHUNK:
            size += len(texts[last] or "") + 4
            last += 1
        run = [(t or "").lower() for t in texts[first:last]]
        codes = np.frombuffer(("\0\0\0\0".join(run) + "\0\0\0\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        ends = np.cumsum([len(t) + 4 for t in run])
        inside = np.flatnonzero(codes)  # an n-gram starts at a character; what follows a text is blank
        of = np.searchsorted(ends, inside, "right")
        padded = np.concatenate([codes, np.zeros(8, np.uint64)])
        for n in ORDERS:
            factors = odd_numbers(n, 20 + n)
            total = np.zeros(len(codes), U64)
            for j in range(n):
                total += factors[j] * padded[j : j + len(codes)]
            yield first, len(run), of, (total[inside] * factors[0] >> U64(64 - BINS.bit_length() + 1)).astype(np.int64)
        first = last


def _distinct(texts: list[str | None], wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Each text's distinct features, as two arrays (text, bin); only those whose ``wanted`` entry is set."""
    held: list = []
    for first, many, of, bins in _grams(texts):
        if wanted is not None:
            keep = wanted[bins]
            of, bins = of[keep], bins[keep]
        held.append(np.unique(of * BINS + bins))
        if len(held) == len(ORDERS):
            both = np.unique(np.concatenate(held))
            held = []
            yield first, many, both // BINS, both % BINS


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of the sample, each document once."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("order", F.md5(F.col("doc_id").cast("string")))
    chosen = [known.where(F.col("toxic") == t).orderBy("order", "doc_id").limit(sample) for t in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).select("doc_id", "toxic")  # at most twice `sample` ids
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return joined.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"))


def _counts(rows: DataFrame) -> DataFrame:
    """``bin, clean, toxic``: training documents that have each feature, summed in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BINS), np.int64)
        for batch in batches:
            label = batch["toxic"].to_numpy(zero_copy_only=False)
            for first, _, of, bins in _distinct(batch["text"].to_pylist()):
                for t in (0, 1):
                    seen[t] += np.bincount(bins[label[first + of] == t], minlength=BINS)
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["bin", "clean", "toxic"])

    counted = rows.select("text", "toxic").mapInArrow(count, "bin long, clean long, toxic long")
    return counted.groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_count_ratios(counts: DataFrame, n_clean: int, n_toxic: int, features: int = FEATURES) -> DataFrame:
    """``bin, ratio`` of the features furthest from chance: the log ratio of their shares, over its standard error to choose by."""
    p, q = (F.col("toxic") + 0.5) / (n_toxic + 1.0), (F.col("clean") + 0.5) / (n_clean + 1.0)
    ratio = F.log(p / q)
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    known = counts.where(F.col("toxic") + F.col("clean") >= LEAST)
    return known.select("bin", ratio.alias("ratio"), F.abs(ratio / error).alias("z")).orderBy(F.desc("z"), "bin").limit(features)


def _fit(rows: list, ratios: np.ndarray, n: tuple[int, int]) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps on (features of a document, label) rows; both labels weigh the same."""
    label = np.array([r["toxic"] for r in rows], float)
    sizes = np.array([len(r["at"]) // 4 for r in rows])
    doc = np.repeat(np.arange(len(rows)), sizes)
    at = np.frombuffer(b"".join(r["at"] for r in rows), "<i4").astype(np.int64)
    value = ratios[at]
    weight = np.where(label == 1, 0.5 / max(n[1], 1), 0.5 / max(n[0], 1))
    w, b = np.zeros(len(ratios)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = b + np.bincount(doc, w[at] * value, len(rows))
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
        g, gb = np.bincount(at, slope[doc] * value, len(ratios)) + PENALTY * w, slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        pace = 0.02 * min(1.0, (STEPS - step) / (STEPS / 2))
        w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= pace * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """Bins, their weights (ratio times coefficient) and the intercept."""
    ship_package(docs.sparkSession)
    rows = written(training_rows(docs, labels, sample), "training")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    if not n_clean or not n_toxic:
        share = (n_toxic + 0.5) / (n_clean + n_toxic + 2)
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share)))
    chosen = log_count_ratios(_counts(rows), n_clean, n_toxic, features).collect()  # at most `features` rows
    bins = np.array([r["bin"] for r in chosen], np.int64)
    ratios = np.array([r["ratio"] for r in chosen])
    index = np.full(BINS, -1)
    index[bins] = np.arange(len(bins))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b""] * batch.num_rows
            for first, many, of, at in _distinct(batch["text"].to_pylist(), index >= 0):
                bounds = np.searchsorted(of, np.arange(many + 1))
                for i in range(many):
                    found[first + i] = index[at[bounds[i] : bounds[i + 1]]].astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(found, pa.binary())], ["doc_id", "toxic", "at"])

    picked = rows.select("doc_id", "text", "toxic").mapInArrow(pick, "doc_id long, toxic int, at binary")
    w, b = _fit(sorted(picked.collect(), key=lambda r: r["doc_id"]), ratios, (n_clean, n_toxic))
    return bins, w * ratios, b


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    bins, weights, intercept = model
    ship_package(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BINS)
        table[bins] = weights
        wanted = table != 0
        for batch in batches:
            z = np.full(batch.num_rows, intercept)
            for first, many, of, at in _distinct(batch["text"].to_pylist(), wanted):
                z[first : first + many] += np.bincount(of, table[at], many)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels and score all documents."""
    return scored(docs, train(docs, labels))
