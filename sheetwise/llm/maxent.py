"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class given what stands before it, times that of the token within its class. The ``HEAD`` most frequent tokens
form classes of ``WIDTH`` by frequency; all others form classes by their last bytes. Log-linear features of the history, hashed into the rows of
two weight tables, speak for each class and for each head word of a class: the token before, the one before that, the one before that (skips), and the
last two together. Rare tokens are told apart within their class by their counts, add-one-half, each class keeping one share for tokens never seen;
so probabilities sum to one over all tokens.

Weights start at the smoothed counts' logarithms and are trained in ``ROUNDS`` rounds over all training texts, each text in one round. In a round every
task takes adaptive gradient steps over its texts from the same weights; what it changed is averaged over tasks, each row by how
many tokens touched it, in Spark, and the new weights (of fixed size) go out for the next round. Texts are then scored in batches of sparse rows.

Counts cover all training tokens. The ``TABLE`` most frequent tokens' counts are sent to the tasks; all others are looked up by a join, so every count is
exact. Tokens are told apart by 64-bit hashes.

Null and empty texts hold only the end token. A null doc_id counts as the empty text, so its text is trained on. Repeated rows are trained on and scored one by
one. With no training rows every count is zero. An empty table gives an empty result. Other columns are ignored. How texts are dealt to
tasks decides the order of steps; on the same files the scores agree from run to run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import written
from sheetwise.llm.hashing import U64, chunks, mix, word_hashes, word_places
from sheetwise.session import ship_package

HEAD, WIDTH, ENDINGS = 2048, 64, 32
CLASSES = HEAD // WIDTH + ENDINGS
#: Rows of each weight table, and tokens whose counts every task holds.
ROWS, TABLE = 1 << 15, 1 << 20
ROUNDS, BATCH, PACE = 2, 8192, 0.35
#: Training tasks at most, and the tokens of one at least; each sends its share of changed weights.
TASKS, SHARE = 4096, 1 << 22
END = U64(0xE4D0F7E4)
EDGE = HEAD + ENDINGS  # stands before a text
SPREAD = [U64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def tokens(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: index of the first, tokens of each text, and hash and ending class of every token, the end last."""
    for first, run in chunks(texts):
        run = [t.lower() for t in run]  # of bytes: A to Z only
        data, starts, ends, counts = word_places(run)
        hashes, _ = word_hashes(run)
        last = data[ends - 1].astype(np.int64)
        for back in (2, 3):
            last = last * 256 + np.where(ends - back >= starts, data[ends - back], 0)
        ending = ((last * 0x9E3779B1 >> 12) % ENDINGS).astype(np.int32)
        at = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)
        token, kind = np.full(len(hashes) + len(counts), END), np.zeros(len(hashes) + len(counts), np.int32)
        token[at], kind[at] = hashes, ending
        yield first, counts + 1, token, kind


def token_counts(docs: DataFrame) -> DataFrame:
    """``token, kind, n`` over all texts, summed in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def summed() -> tuple:
            token, kind, n = (np.concatenate(x) for x in zip(*held, strict=True))
            token, at, of = np.unique(token, return_index=True, return_inverse=True)
            return token, kind[at], np.bincount(of, n, len(token)).astype(np.int64)

        def sent() -> pa.RecordBatch:
            token, kind, n = summed()
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(kind), pa.array(n)], ["token", "kind", "n"])

        for batch in batches:
            for _, _, token, kind in tokens(batch["text"].to_pylist()):
                own, at, n = np.unique(token, return_index=True, return_counts=True)
                held.append((own, kind[at], n))
                if sum(len(x[0]) for x in held) > 1 << 21:
                    held = [summed()]
                    if len(held[0][0]) > 1 << 20:
                        yield sent()
                        held = []
        if held:
            yield sent()

    counted = docs.select("text").mapInArrow(count, "token long, kind int, n long")
    return counted.groupBy("token").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))


class Frequent:
    """The counts of the most frequent tokens, found by hash."""

    def __init__(self, token: np.ndarray, n: np.ndarray):
        order = np.argsort(token)
        self.token, self.n = token[order], n[order]
        self.bits = max(1, min(20, len(token).bit_length()))
        self.first = np.searchsorted(self.token, np.arange((1 << self.bits) + 1, dtype=U64) << U64(64 - self.bits)).astype(np.int32)
        self.first[-1] = len(token)
        self.most = int(np.diff(self.first).max(initial=0))

    def places(self, token: np.ndarray) -> np.ndarray:
        """Where each token stands, -1 for those that are not held."""
        bucket = (token >> U64(64 - self.bits)).astype(np.int64)
        at, end = self.first[bucket].astype(np.int64), self.first[bucket + 1]
        out = np.full(len(token), -1)
        if not len(self.token):
            return out
        for _ in range(self.most):
            inside = np.minimum(at, len(self.token) - 1)
            out = np.where((self.token[inside] == token) & (at < end), at, out)
            at += 1
        return out


class Model:
    """Weights and the fixed shares they start from."""

    def __init__(self, head: np.ndarray, head_n: np.ndarray, head_kind: np.ndarray, sums: dict[int, tuple[int, int]]):
        """``head`` in order of frequency; ``sums`` holds the occurrences and the number of all tokens of each ending."""
        self.head = Frequent(head, np.arange(len(head)))
        spare = WIDTH * (HEAD // WIDTH) - len(head)
        weight = np.concatenate([head_n + 0.5, np.zeros(spare)]).reshape(-1, WIDTH)
        left = np.array([sums.get(k, (0, 0)) for k in range(ENDINGS)], float)
        left[:, 0] -= np.bincount(head_kind, head_n, ENDINGS)
        left[:, 1] -= np.bincount(head_kind, minlength=ENDINGS)
        self.rare_log = np.log10(left[:, 0] + 0.5 * (left[:, 1] + 1))  # to be taken from log10(count + 0.5)
        mass = np.concatenate([weight.sum(axis=1), left[:, 0] + 0.5 * (left[:, 1] + 1)])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.class_prior = np.maximum(np.log(mass / mass.sum()), -60).astype(np.float32)
            self.word_prior = np.where(weight > 0, np.log(weight / mass[: HEAD // WIDTH, None]), -60).astype(np.float32)
        self.tables = [np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, WIDTH), np.float32)]

    def symbols(self, token: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Place in the head, or what ending a rare token has."""
        at = self.head.places(token)
        return np.where(at >= 0, self.head.n[at] if len(self.head.n) else 0, HEAD + kind).astype(np.int64)


def _histories(symbol: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """What stands one, two and three places before each token of its text."""
    place = np.arange(len(symbol)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = []
    for back in (1, 2, 3):
        before = np.full(len(symbol), EDGE)
        before[back:] = symbol[:-back]
        out.append(np.where(place >= back, before, EDGE).astype(U64))
    return out


def _row(code: np.ndarray, kind: int) -> np.ndarray:
    return ((code * SPREAD[kind] + SPREAD[kind - 1]) >> U64(64 - ROWS.bit_length() + 1)).astype(np.uint16)


def features(symbol: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, slot in the class (-1 for rare tokens), rows of the class table and rows of the word table of every token."""
    one, two, three = _histories(symbol, counts)
    of = np.where(symbol < HEAD, symbol // WIDTH, HEAD // WIDTH + symbol - HEAD).astype(np.int32)
    slot = np.where(symbol < HEAD, symbol % WIDTH, -1).astype(np.int32)
    pair = one * U64(EDGE + 1) + two
    rows = np.stack([_row(one, 0), _row(two, 1), _row(three, 2), _row(mix(pair), 3)])
    own = of.astype(U64) * U64(EDGE + 1)
    return of, slot, rows, np.stack([_row(mix(own + one), 0), _row(mix(own + two + U64(1 << 40)), 1)])


def _logits(table: np.ndarray, rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
    z = np.take(table, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(table, r, axis=0)
    z += prior
    return z


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares in place, and the logarithm of what was divided by."""
    top = z.max(axis=1, keepdims=True)
    z -= top
    np.exp(z, out=z)
    total = z.sum(axis=1, keepdims=True)
    z /= total
    return z, (top + np.log(total))[:, 0]


def _step(table: np.ndarray, grown: np.ndarray, touched: np.ndarray, rows: np.ndarray, slope: np.ndarray) -> None:
    """One adaptive gradient step on the rows that a batch has, feature by feature."""
    for own in rows:
        order = np.argsort(own, kind="stable")
        ordered = own[order]
        starts = np.flatnonzero(np.diff(ordered, prepend=ordered[0] + 1))
        # two numbers at a time
        sums = np.add.reduceat(np.take(slope, order, axis=0).view(np.complex64), starts, axis=0).view(np.float32)
        own = ordered[starts]
        touched[own] += np.diff(starts, append=len(order))
        grown[own] += np.einsum("ij,ij->i", sums, sums)
        sums *= (PACE / np.sqrt(grown[own] + 1.0))[:, None]
        table[own] -= sums


def train_on(model: Model, state: tuple, texts: list[str | None]) -> None:
    """Gradient steps over all tokens of ``texts``; ``state`` holds the tables and their records, changed in place."""
    (classes, words), grown, touched = state
    for _, counts, token, kind in tokens(texts):
        of, slot, rows, inner = features(model.symbols(token, kind), counts)
        for a in range(0, len(of), BATCH):
            b = slice(a, a + BATCH)
            target = of[b]
            p, _ = _softmax(_logits(classes, rows[:, b], model.class_prior))
            p[np.arange(len(target)), target] -= 1
            _step(classes, grown[0], touched[0], rows[:, b], p)
            known = np.flatnonzero(slot[b] >= 0)
            if len(known):
                at = inner[:, b][:, known]
                p, _ = _softmax(_logits(words, at, model.word_prior[target[known]]))
                p[np.arange(len(known)), slot[b][known]] -= 1
                _step(words, grown[1], touched[1], at, p)


BLOCK = 1024


def trained_round(docs: DataFrame, model: Model, tasks: int) -> Model:
    """``model`` after one round over ``docs``, in ``tasks`` tasks at most."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        tables = [t.copy() for t in own.tables]
        grown, touched = [np.zeros(ROWS, np.float32) for _ in tables], [np.zeros(ROWS, np.int64) for _ in tables]
        for batch in batches:
            train_on(own, (tables, grown, touched), batch["text"].to_pylist())
        for k, t in enumerate(tables):
            t = (t - own.tables[k]) * touched[k][:, None].astype(np.float32)
            for block in range(ROWS // BLOCK):
                part = slice(block * BLOCK, (block + 1) * BLOCK)
                if touched[k][part].any():
                    row = [[k * (ROWS // BLOCK) + block], [t[part].tobytes()], [touched[k][part].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["block", "moved", "touched"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}  # the model's size at most
        for batch in batches:
            for row in batch.to_pylist():
                new = [np.frombuffer(row["moved"], np.float32).astype(float), np.frombuffer(row["touched"], np.int64).copy()]
                old = held.setdefault(row["block"], new)
                if old is not new:
                    old[0] += new[0]
                    old[1] += new[1]
        for block, (moved, touched) in held.items():
            row = [[block], [moved.astype(np.float32).tobytes()], [touched.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["block", "moved", "touched"])

    schema = "block long, moved binary, touched binary"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    moved = docs.select("text").coalesce(tasks).mapInArrow(work, schema).repartition(parts, "block").mapInArrow(add, schema)
    for row in moved.collect():  # the model's size
        k, block = divmod(row["block"], ROWS // BLOCK)
        part = slice(block * BLOCK, (block + 1) * BLOCK)
        times = np.frombuffer(row["touched"], np.int64)
        change = np.frombuffer(row["moved"], np.float32).reshape(BLOCK, -1)
        model.tables[k][part] += change / np.maximum(times, 1)[:, None]
    return model


def train(docs: DataFrame, counts: DataFrame, frequent: pa.Table, rounds: int = ROUNDS) -> Model:
    """The model of the texts of ``docs``, whose ``counts`` are known."""
    sums = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    token, n, kind = (frequent[c].to_numpy() for c in ("token", "n", "kind"))
    head = np.lexsort((token, -n))[:HEAD]
    model = Model(token.view(U64)[head], n[head], kind[head], sums)
    tasks = max(1, min(TASKS, sum(x for x, _ in sums.values()) // rounds // SHARE))
    for k in range(rounds):
        model = trained_round(docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k), model, tasks)
    return model


def frequent_tokens(counts: DataFrame, most: int = TABLE) -> pa.Table:
    """The tokens of the highest counts, ``most`` of them at most; equal counts, or nearly equal ones, are in together or out together."""
    level = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred rows
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return counts.where(level >= least if least is not None else F.lit(False)).toArrow()


_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double, rest array<long>, times array<long>"


def score_texts(model: Model, frequent: Frequent, total: float, texts: list[str | None]) -> Iterator[tuple[int, list]]:
    """Runs of texts: index of the first, and columns as in ``_SCORED`` without ids. Tokens not in ``frequent`` are left to a join:
    the scores lack the logarithm of their count and one half."""
    for first, counts, token, kind in tokens(texts):
        n_texts, bounds = len(counts), np.cumsum(counts)
        text = np.repeat(np.arange(n_texts), counts)
        place = frequent.places(token)
        here = place >= 0
        n = np.where(here, frequent.n[place] if len(frequent.n) else 0, 0)
        count_log = np.where(here, np.log10(n + 0.5), 0.0)
        base = np.bincount(text, count_log, n_texts) - counts * np.log10(total)
        symbol = model.symbols(token, kind)
        of, slot, rows, inner = features(symbol, counts)
        logp = np.zeros(len(of))
        for a in range(0, len(of), BATCH):
            b = slice(a, a + BATCH)
            z = _logits(model.tables[0], rows[:, b], model.class_prior)
            chosen = z[np.arange(len(z)), of[b]]
            _, norm = _softmax(z)
            logp[b] = chosen - norm
            known = np.flatnonzero(slot[b] >= 0)
            z = _logits(model.tables[1], inner[:, b][:, known], model.word_prior[of[b][known]])
            chosen = z[np.arange(len(z)), slot[b][known]]
            _, norm = _softmax(z)
            logp[a + known] += chosen - norm
        logp /= np.log(10)
        rare = slot < 0
        logp[rare] += count_log[rare] - model.rare_log[kind[rare]]
        rest = np.flatnonzero(~here)
        left, times = np.unique(np.stack([text[rest], token[rest].view(np.int64)]), axis=1, return_counts=True) if len(rest) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        offsets = np.searchsorted(left[0], np.arange(n_texts + 1))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int64())) for x in (left[1], times)]
        yield first, [counts, np.diff(np.cumsum(here)[bounds - 1], prepend=0), base, np.bincount(text, logp, n_texts), *lists]


def scored(docs: DataFrame, counts: DataFrame, frequent: pa.Table, model: Model) -> DataFrame:
    """All rows of ``docs`` with their scores under ``counts`` and ``model``."""
    spark = docs.sparkSession
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total = n + 0.5 * (v + 1)
    sent = spark.sparkContext.broadcast((model, Frequent(frequent["token"].to_numpy().view(U64), frequent["n"].to_numpy())))  # bounded by TABLE

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = sent.value
        names = [part.split()[0] for part in _SCORED.split(", ")]
        for batch in batches:
            for first, columns in score_texts(own, known, total, batch["text"].to_pylist()):
                ids = batch["doc_id"].slice(first, len(columns[0]))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c) if isinstance(c, np.ndarray) else c for c in columns]], names)

    local = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, _SCORED)
    local = written(local.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = local.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("token"), F.col("x.times").alias("times"))
    met = rest.join(counts.select("token", "n"), "token", "left")
    logs = F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5))
    met = met.groupBy("row").agg(logs.alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = local.join(met, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def language_scores(docs: DataFrame, most: int = TABLE, rounds: int = ROUNDS) -> DataFrame:
    """Learn from the texts that are not held out and score all."""
    ship_package(docs.sparkSession)
    learnt = docs.where(~held_out(F.col("doc_id")))
    counts = written(token_counts(learnt), "counts")
    frequent = frequent_tokens(counts, most)
    return scored(docs, counts, frequent, train(learnt, counts, frequent, rounds))
