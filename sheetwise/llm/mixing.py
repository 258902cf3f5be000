"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, served twice over at most. A document's virtual finish time is the
number of words its source has handed out up to its end, divided by the source's weight. Serving all queues in the order
of finish times gives every source words in proportion to its weight; queues that run dry leave their share to the others.
The budget ends at one virtual time. Documents that finish by then are taken whole, a document in service then is taken up to there,
so every source meets its target to the word, and the total meets the budget.

Sources are numbered by code point, null last, and weigh 5, 2, 1, repeating. Null and blank texts have size 0 and are never
taken. Rows that agree in doc_id and text may stand in any order; repeated rows count as documents of their own.
An empty table gives an empty mix. Extra columns are kept by ``mixed`` and ignored by ``mix_plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import GAP, count_words, written

WEIGHTS = (5, 2, 1)
#: The budget as a share of all words, and how often one document may be taken.
SHARE, PASSES = 1.5, 2
SEED = "mix"
#: Documents of one id and size that one task unfolds at a time, and lanes that such documents are dealt to.
BLOCK, LANES = 100_000, 4096


def _rows(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` as ``row`` with the source key, the size and the place in the shuffle.

    The shuffle is an md5 of the id; its first three digits cut a source into 4,096 even parts.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))))
    return docs.select(F.struct("*").alias("row")).select(
        "row",
        F.coalesce(F.concat(F.lit("="), F.col("row.source")), F.lit("")).alias("src"),
        count_words(F.col("row.text")).alias("size"),
        key.alias("key"),
        F.substring(key, 1, 3).alias("part"),
    )


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``src, source_size`` with ``weight`` and ``target``: the budget dealt out by weight, no source above ``passes`` times its size.

    Sources fill up in the order of cap / weight. The virtual end is where the rest of the budget, dealt to the sources not yet
    full, fills none of them. One row per source is all that the unpartitioned windows see.
    """
    every = Window.partitionBy()
    weight = F.array(*map(F.lit, weights))
    ranked = totals.withColumn("n", F.row_number().over(Window.orderBy(F.col("src") == "", "src")) - 1)
    ranked = ranked.withColumn("weight", F.get(weight, F.col("n") % len(weights))).withColumns(
        {"cap": passes * F.col("source_size"), "full_at": passes * F.col("source_size") / F.col("weight")}
    )
    order = Window.orderBy("full_at", "n")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ends = ranked.withColumn(
        "end",
        (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after),
    ).withColumn("pos", F.row_number().over(order))
    end = F.min_by("end", F.when(F.col("end") <= F.col("full_at"), F.col("pos"))).over(every)
    return ends.withColumn("end", end).select(
        "src", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("end")).alias("target")
    )


def _placed(groups: DataFrame, *order: str, **how) -> DataFrame:
    """``groups`` with their source's figures and ``start``, the words of their source ahead of them in the shuffle.

    A group is ``n`` documents of one size that stand side by side (``src, part, key, size, n``), so any number of rows without an
    id, or of one id, is a few rows for the window.
    """
    words = F.col("size") * F.col("n")
    parts = written(groups.groupBy("src", "part").agg(F.sum(words).alias("part_size")), "mix-parts")
    targets = source_targets(parts.groupBy("src").agg(F.sum("part_size").alias("source_size")), **how)
    ahead = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("src", "part", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("ahead"))
    starts = starts.join(targets, "src")  # at most 4,096 rows of a source
    own = Window.partitionBy("src", "part").orderBy("key", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return groups.join(starts, ["src", "part"]).withColumn("start", F.col("ahead") + F.sum(words).over(own) - words)


def _taken(start: Column) -> Column:
    """Words of a document that starts at ``start`` which its source's target still covers."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start)).cast("long")


def _each(placed: DataFrame, block: int) -> DataFrame:
    """One row per document of every group, with its own ``start``; groups above ``block`` are dealt to tasks first."""

    def unfolded(groups: DataFrame, low: Column, many: Column) -> DataFrame:
        return groups.withColumn("copy", F.explode(F.sequence(low, low + many - 1)))

    few = unfolded(placed.where(F.col("n") <= block), F.lit(0).cast("long"), F.col("n"))
    wide = placed.where(F.col("n") > block).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))))
    wide = unfolded(wide.repartition("key", "size", "low"), F.col("low"), F.least(F.lit(block), F.col("n") - F.col("low"))).drop("low")
    return few.unionByName(wide).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))


def mix_plan(docs: DataFrame, block: int = BLOCK, **how) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    slim = _rows(docs.select("doc_id", "source", "text")).select("src", "part", "key", F.col("row.doc_id").alias("doc_id"), "size")
    groups = written(slim.groupBy(*slim.columns).agg(F.count("*").alias("n")), "mix-groups")
    placed = _placed(groups, "doc_id", "size", **how)
    if groups.where(F.col("n") > block).isEmpty():
        each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        each = each.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    else:
        each = _each(written(placed, "mix-placed"), block)
    taken = [_taken(F.col("start") + p * F.col("source_size")) for p in range(how.get("passes", PASSES))]
    return each.select(
        "doc_id", "size", "source_size", "target", sum(taken[1:], taken[0]).alias("taken"),
        ((F.col("start") + F.col("size")) / F.col("weight")).alias("finish"),
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, in the order of virtual finish times.

    A row that is taken in part keeps that many words of its text. Rows of one id and size are dealt to ``LANES`` lanes by
    the number they are written with, and take their places lane by lane.
    """
    lane = F.pmod(F.monotonically_increasing_id(), F.lit(LANES)).alias("lane")
    rows = written(_rows(docs).select("*", lane), "mix-rows")
    group = ["src", "part", "key", "size", "lane"]
    placed = _placed(rows.groupBy(*group).agg(F.count("*").alias("n")), "size", "lane", **how)
    place = F.row_number().over(Window.partitionBy(*group).orderBy("start")) - 1
    rows = rows.join(placed.drop("n"), group).withColumn("start", F.col("start") + place * F.col("size"))
    passes = F.array(*[F.struct(_taken(F.col("start") + p * F.col("source_size")).alias("taken"), F.lit(p).alias("p")) for p in range(how.get("passes", PASSES))])
    served = rows.select("row", "size", "weight", "start", "source_size", F.explode(F.filter(passes, lambda x: x["taken"] > 0)).alias("pass"))
    words = F.slice(F.split(F.regexp_replace("row.text", f"^{GAP}", ""), GAP), 1, F.col("pass.taken").cast("int"))
    text = F.when(F.col("pass.taken") < F.col("size"), F.concat_ws(" ", words)).otherwise(F.col("row.text"))
    finish = (F.col("start") + F.col("pass.p") * F.col("source_size") + F.col("size")) / F.col("weight")
    served = served.select(F.col("row").withField("text", text).alias("row"), finish.alias("finish"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = served.repartitionByRange(parts, "finish", "row.doc_id").sortWithinPartitions("finish", "row.doc_id")
    return ordered.select("row.*")
