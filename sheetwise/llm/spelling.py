"""Spelling variants, grouped by a dictionary of trie-node pairs.

Words are the letter runs of all texts, heard at least ``LEAST`` times. They are put into a trie from the front and one from the back, whose
nodes are numbered; a word cut at any place is then a pair of whole numbers (prefix node, suffix node). Two words that differ in one letter share the pair
that skips this letter; a word with one letter more than another shares, skipping it, the pair that the other has where it is cut. So one grouping
by pairs finds exactly the words at one inserted, deleted or replaced letter. Of equal letters in a row only the first is skipped for
an insertion, which makes every pair of near words meet once. A group holds one word cut there and the words that
differ in one letter of one place: never more than the alphabet has letters, so nothing grows with the corpus in it.

The nodes are numbered in parts of the sorted dictionary. A node that several parts share is owned by the first of them; which part owns it follows
from the first and last word of every part, all that reaches the driver.

A null text has no words. A null doc_id counts as the empty text where runs are marked for a deletion. Repeated rows count each. Words of any length
are taken; an empty table, or one without a word heard often enough, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import written
from sheetwise.session import ship_package

RUN = r"[A-Za-zÀ-ÿ]+"
SHORTEST, LEAST, RATIO, EVERY = 5, 3, 2, 97
#: About how many letters of the dictionary one task numbers.
LETTERS = 2_000_000
BITS = 40


def heard(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """``word, n``: the words of all texts; a run whose checksum ``every`` divides loses one letter first (0: none does)."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    word = F.col("run")
    if every:
        each = each.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = F.pmod("h", F.length("run").cast("long")).cast("int")
        less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
        word = F.when(F.col("h") % every == 0, less).otherwise(word)
    each = each.select(word.alias("word")).where(F.length("word") >= shortest)
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _shared(a: str, b: str) -> int:
    """How many letters two words have in common from the front."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def owners(ends: list[tuple[int, str, str]]) -> dict[int, list[tuple[int, int]]]:
    """For each part, as (last depth, owner) runs, who numbered the prefixes of its first word that earlier parts hold.

    ``ends`` holds part, first and last word, in order. Only these prefixes can be shared with earlier parts, as words are sorted.
    """
    found, path, before = {}, [], ""  # path: runs over the prefixes of the last word so far

    def upto(runs: list[tuple[int, int]], depth: int) -> list[tuple[int, int]]:
        kept = [r for r in runs if r[0] <= depth]
        rest = runs[len(kept) : len(kept) + 1]
        return kept + [(depth, r[1]) for r in rest if depth > (kept[-1][0] if kept else 0)]

    for part, first, last in ends:
        known = _shared(before, first)
        found[part] = upto(path, known)
        stays = min(known, _shared(first, last))
        path = upto(path, stays)
        if len(last) > stays:
            path = [*path, (len(last), part)]
        before = last
    return found


def number(part: int, words: list[str], known: list[tuple[int, int]]) -> list[list[int]]:
    """The node numbers of every prefix of each of the sorted ``words``, the empty one first.

    Prefixes of the last word are numbered by their depth, so that later parts know them; all others follow.
    """
    mine, last = (part + 1) << BITS, words[-1]
    fresh = len(last)
    path, before, out = [0], "", []
    for i, word in enumerate(words):
        del path[_shared(before, word) + 1 :]
        if i == 0:
            for depth, owner in known:
                path.extend(((owner + 1) << BITS) + d for d in range(len(path), depth + 1))
        border = _shared(word, last)
        for depth in range(len(path), len(word) + 1):
            if depth > border:
                fresh += 1
            path.append(mine + (depth if depth <= border else fresh))
        out.append(path.copy())
        before = word
    return out


def trie_paths(words: DataFrame, text: Column, letters: int = LETTERS) -> DataFrame:
    """``word, place, nodes``: the numbers of the trie nodes that ``text`` of each word passes; ``place`` rises with ``text``."""
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    dealt = words.select("word", text.alias("t")).repartitionByRange(max(1, total // letters), "t")
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "trie")
    ends = dealt.groupBy("part").agg(F.min("t").alias("a"), F.max("t").alias("b")).collect()  # two words of each part
    known = owners(sorted((r["part"], r["a"], r["b"]) for r in ends))

    def walk(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        part = key[0].as_py()
        rows = sorted(zip(group["t"].to_pylist(), group["word"].to_pylist(), strict=True))
        nodes = number(part, [t for t, _ in rows], known[part])
        return pa.table({
            "word": pa.array([w for _, w in rows], pa.string()),
            "place": pa.array([(part << BITS) + i for i in range(len(rows))], pa.int64()),
            "nodes": pa.array(nodes, pa.list_(pa.int64())),
        })

    return dealt.groupBy("part").applyInArrow(walk, "word string, place long, nodes array<long>")


#: What a word is to a pair: its letter is skipped (and equals the one before it), skipped and new, or the word is only cut.
AGAIN, NEW, CUT = 0, 1, 2


def node_pairs(paths: DataFrame) -> DataFrame:
    """``p, s, id, n, kind``: the pairs of every word, ``paths`` holding ``id, n, word, front, back``."""
    size = F.length("word")
    chars = paths.withColumns({"size": size, "c": F.split("word", "")})
    at = F.col("at")
    cut = chars.select("id", "n", "size", "back", F.posexplode("front").alias("at", "p"))
    cut = cut.select("p", F.get("back", F.col("size") - at).alias("s"), "id", "n", F.lit(CUT).alias("kind"))
    inner = F.slice("front", F.lit(1), F.col("size"))  # a pair for every letter
    skip = chars.select("id", "n", "size", "back", "c", F.posexplode(inner).alias("at", "p"))
    new = (at == 0) | (F.get("c", at) != F.get("c", at - 1))
    skip = skip.select("p", F.get("back", F.col("size") - 1 - at).alias("s"), "id", "n", F.when(new, NEW).otherwise(AGAIN).alias("kind"))
    return cut.unionByName(skip)


def near_words(pairs: DataFrame) -> DataFrame:
    """``id, n_near, best``: how many near words each word has, and ``n`` and ``id`` of the most frequent one; only words that have any."""
    member = F.struct("n", (-F.col("id")).alias("less"), "kind")
    met = pairs.groupBy("p", "s").agg(F.collect_list(member).alias("m")).where(F.size("m") > 1)  # the alphabet and one at most
    one = met.select("m", F.explode("m").alias("x"))
    x = F.col("x")

    def near(y: Column) -> Column:
        both = (x["kind"] != CUT) & (y["kind"] != CUT) & (x["less"] != y["less"])
        return both | ((x["kind"] == NEW) & (y["kind"] == CUT)) | ((x["kind"] == CUT) & (y["kind"] == NEW))

    one = one.select((-x["less"]).alias("id"), F.filter("m", near).alias("near")).where(F.size("near") > 0)
    best = F.array_max(F.transform("near", lambda y: F.struct(y["n"].alias("n"), y["less"].alias("less"))))
    one = one.select("id", F.size("near").cast("long").alias("k"), best.alias("best"))
    return one.groupBy("id").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))


def last_forms(links: DataFrame) -> DataFrame:
    """``id, to`` links as ``id, root``, each followed to its end. Frequencies double along a chain, so six doublings reach any end."""
    links = written(links, "forms")
    while True:
        onward = links.select(F.col("id").alias("to"), F.col("to").alias("next"))
        longer = links.join(onward, "to", "left")
        if longer.where("next is not null").isEmpty():
            return links.select("id", F.col("to").alias("root"))
        links = written(longer.select("id", F.coalesce("next", "to").alias("to")), "forms")


def grouped_variants(words: DataFrame, ratio: int = RATIO, letters: int = LETTERS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a dictionary ``word, n`` without repeated words."""
    ship_package(words.sparkSession)
    words = written(words, "words")
    front = trie_paths(words, F.col("word"), letters).select("word", F.col("place").alias("id"), F.col("nodes").alias("front"))
    back = trie_paths(words, F.reverse("word"), letters).select("word", F.col("nodes").alias("back"))
    paths = written(words.join(front, "word").join(back, "word"), "paths")
    near = near_words(node_pairs(paths))
    found = paths.select("id", "word", "n").join(near, "id", "left")
    fits = F.col("best.n") >= ratio * F.col("n")
    found = found.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("to"), F.when(fits, F.col("best.n")).alias("form_n"),
    )
    found = written(found, "near")
    roots = last_forms(found.where("to is not null").select("id", "to"))
    name = lambda key, column: found.select(F.col("id").alias(key), F.col("word").alias(column))
    out = found.join(roots, "id", "left").join(name("to", "form"), "to", "left").join(name("root", "root_word"), "root", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Every word of the texts with its more frequent near word and the last of this chain."""
    return grouped_variants(heard(docs))
