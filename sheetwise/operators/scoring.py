"""Scoring results against ground truth and reporting per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.operators.ordered import HOT_ROWS, ordered, position

GOOD_IOU = 0.9
UNFOLDED_FAMILIES = ("dogear", "mixed")
CALIBRATION_STEPS = (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9)

# How each metric is shown: see metric_text.
PERCENT_OF_ONE, PERCENT, WHOLE_PERCENT, WHOLE, PLAIN = "share", "percent", "whole percent", "whole", "plain"
STYLES = {
    "confident": WHOLE_PERCENT, "missing": PERCENT_OF_ONE, "foreign": PERCENT_OF_ONE, "corner": PERCENT, "ms": WHOLE,
}


def score_join(results: DataFrame, truth: DataFrame, key: str = "image_path") -> DataFrame:
    """Results with their truth; results without truth drop out.

    The planner broadcasts the truth when its statistics allow, and splits a skewed key otherwise.
    """
    return results.join(truth, key)


#: Samples that one task of the join in :func:`with_results` sorts.
TASK_ROWS = 500_000


def with_results(samples: DataFrame, results: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The samples that have a result, and those that have none.

    Results are counted to one row per key before they meet samples, and both are dealt by the number of samples: keys pack so well
    that the size of a shuffle says little about the rows in it.
    """
    parts = max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-samples.count() // TASK_ROWS))
    keys = results.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0").select(key).repartition(parts, key)
    samples = samples.repartition(parts, key)
    return samples.join(keys, key, "left_semi"), samples.join(keys, key, "left_anti")


def nanmean(value: Column) -> Column:
    """Mean over present values that are not NaN; null when there is none."""
    return F.avg(_present(value))


def _present(value: Column) -> Column:
    real = value.cast("double")
    return F.when(~F.isnan(real), real)


def worst(value: Column) -> Column:
    """Largest present value that is not NaN."""
    return F.max(_present(value))


def share(flag: Column) -> Column:
    """Mean of a flag."""
    return F.avg(flag.cast("double"))


def summary(rows: DataFrame, keys: Sequence[str], group: str = "family", all_name: str = "ALL") -> DataFrame:
    """Per group and for all rows together: ``n``, and mean and worst of each metric.

    ``n`` counts every row; means skip nulls and NaN. ``is_all`` marks the ALL row.
    """
    stats = [F.count(F.lit(1)).alias("n")]
    for k in keys:
        stats += [nanmean(F.col(k)).alias(f"{k}_mean"), worst(F.col(k)).alias(f"{k}_worst")]
    rolled = rows.rollup(group).agg(F.grouping(group).cast("int").alias("is_all"), *stats)
    named = F.when(F.col("is_all") == 1, all_name).otherwise(F.col(group).cast("string"))
    return rolled.withColumn(group, named)


def groups_all_last(summarised: DataFrame, group: str = "family") -> DataFrame:
    """Groups in order, the ALL row at the end."""
    return summarised.orderBy("is_all", group)


def metric_text(key: str, mean: Column, top: Column, styles: Mapping[str, str] = STYLES) -> Column:
    """A metric's cell: ``-`` without values, otherwise in the style of its key."""
    style = styles.get(key, PLAIN)
    if style == WHOLE_PERCENT:
        text = F.concat(_fixed(mean * 100, 0), F.lit("%"))
    elif style in (PERCENT_OF_ONE, PERCENT):
        scale = 100 if style == PERCENT_OF_ONE else 1
        text = F.concat(_fixed(mean * scale, 2), F.lit("% (worst "), _fixed(top * scale, 1), F.lit("%)"))
    elif style == WHOLE:
        text = _fixed(mean, 0)
    else:
        text = _fixed(mean, 3)
    return F.when(mean.isNull(), "-").otherwise(text)


def _fixed(value: Column, digits: int) -> Column:
    """A fixed number of digits, rounding the exact binary value (halves to even)."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def summary_lines(summarised: DataFrame, keys: Sequence[str], group: str = "family") -> DataFrame:
    """The summary as lines of a pipe table: ``place, line`` (header, rule, groups, ALL)."""
    cells = [metric_text(k, F.col(f"{k}_mean"), F.col(f"{k}_worst")) for k in keys]
    body = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(group), F.col("n").cast("string"), *cells), F.lit(" |"))
    rows = summarised.select(
        F.struct((F.col("is_all") + 1).alias("part"), F.col(group).alias("name")).alias("place"), body.alias("line")
    )
    head = "| " + " | ".join([group, "n", *keys]) + " |"
    rule = "|" + "---|" * (len(keys) + 2)
    spark = summarised.sparkSession
    top = spark.range(2).select(
        F.struct(F.lit(0).alias("part"), F.col("id").cast("string").alias("name")).alias("place"),
        F.when(F.col("id") == 0, head).otherwise(rule).alias("line"),
    )
    return top.unionByName(rows)


def overlap_metrics(
    truth_cells: DataFrame, found_cells: DataFrame, photo: str, cell: str, unfolded: DataFrame | None = None,
    families: Sequence[str] = UNFOLDED_FAMILIES,
) -> DataFrame:
    """``iou, missing, foreign`` per photo from the cells each outline covers.

    ``unfolded`` (``photo, cell, family``) adds the unfolded corner to the truth of the given families.
    One union and one aggregate on (photo, cell): a photo of any size spreads over the cluster.
    """
    truth = truth_cells.select(photo, cell)
    if unfolded is not None:
        truth = truth.unionByName(unfolded.filter(F.col("family").isin(*families)).select(photo, cell))
    sides = truth.withColumn("_t", F.lit(1)).withColumn("_d", F.lit(0)).unionByName(
        found_cells.select(photo, cell).withColumn("_t", F.lit(0)).withColumn("_d", F.lit(1))
    )
    cells = sides.groupBy(photo, cell).agg(F.max("_t").alias("_t"), F.max("_d").alias("_d"))
    counts = cells.groupBy(photo).agg(
        F.sum("_t").alias("_t"), F.sum("_d").alias("_d"), F.sum(F.col("_t") * F.col("_d")).alias("_both"), F.count(F.lit(1)).alias("_any")
    )
    one = F.lit(1)
    return counts.select(
        photo,
        (F.col("_both") / F.greatest(F.col("_any"), one)).alias("iou"),
        (1 - F.col("_both") / F.greatest(F.col("_t"), one)).alias("missing"),
        (1 - F.col("_both") / F.greatest(F.col("_d"), one)).alias("foreign"),
    )


def evaluate_pickers(cands: DataFrame, photo: str = "photo_id", group: str = "family") -> DataFrame:
    """Mean label per group and overall of four pickers: model, rules, first candidate, best possible.

    ``cands`` holds ``cand_idx`` (place from 0), ``pred``, ``label`` and the photo's ``chosen`` place (-1 = none).
    """
    picked = cands.groupBy(group, photo).agg(
        F.max_by("label", F.struct(F.col("pred"), (-F.col("cand_idx")).alias("o"))).alias("model"),
        F.max(F.when(F.col("cand_idx") == F.greatest(F.col("chosen"), F.lit(0)), F.col("label"))).alias("rules"),
        F.max(F.when(F.col("cand_idx") == 0, F.col("label"))).alias("top"),
        F.max("label").alias("oracle"),
    )
    return summary(picked, ["top", "rules", "model", "oracle"], group)


def calibration(picks: DataFrame, predicted: str = "pred", label: str = "label", steps: Sequence[float] = CALIBRATION_STEPS) -> DataFrame:
    """Per threshold: share of good photos among those predicted at least that, and share of photos.

    The last row (``threshold`` null) is about the photos predicted below 0.3. One pass over the picks.
    """
    p, good = F.col(predicted), F.col(label) >= GOOD_IOU
    sums = [F.count(F.lit(1)).alias("_n")]
    for i, t in enumerate(steps):
        sums += [F.count(F.when(p >= t, 1)).alias(f"_a{i}"), F.count(F.when((p >= t) & good, 1)).alias(f"_g{i}")]
    low = p < 0.3
    sums += [F.count(F.when(low, 1)).alias("_low"), F.avg(F.when(low, F.col(label))).alias("_low_mean")]

    def row(threshold, n, good_share, photo_share, mean) -> Column:
        return F.struct(
            threshold.cast("double").alias("threshold"), n.alias("n"), good_share.cast("double").alias("good_share"),
            photo_share.cast("double").alias("photo_share"), mean.cast("double").alias("mean_label"),
        )

    none = F.lit(None)
    rows = [
        row(F.lit(t), F.col(f"_a{i}"), F.try_divide(f"_g{i}", f"_a{i}"), F.try_divide(f"_a{i}", "_n"), none)
        for i, t in enumerate(steps)
    ]
    rows.append(row(none, F.col("_low"), none, F.try_divide("_low", "_n"), F.col("_low_mean")))
    out = picks.agg(*sums).select(F.inline_outer(F.array(*rows)))
    return out.filter(F.col("threshold").isNull() | (F.col("n") > 0))


def character_error_rate(reference: Column, read: Column) -> Column:
    """Edit distance over reference length after white-space folding, at most 1; NaN for an empty reference."""
    ref, hyp = _folded(reference), _folded(read)
    rate = F.try_divide(F.levenshtein(ref, hyp), F.length(ref))
    return F.when(F.length(ref) == 0, F.lit(float("nan"))).otherwise(F.least(rate, F.lit(1.0)))


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def transfer_counters(jobs: DataFrame, keys: Sequence[str], state: str = "state") -> DataFrame:
    """Per owner: files under way, sent and failed, and the line that says so."""

    def count(*states: str) -> Column:
        return F.count(F.when(F.col(state).isin(*states), 1))

    counted = jobs.groupBy(*keys).agg(
        count("queued", "sending").alias("sending"), count("sent").alias("sent"), count("failed").alias("failed")
    )
    parts = [F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {n}"))) for n in ("sending", "sent", "failed")]
    return counted.withColumn("text", F.concat_ws(" · ", *parts))


SIGNATURE_CHUNK = 4096


def listing_signature(
    listing: DataFrame, keys: Sequence[str], order: Sequence[Column | str], line: Column, chunk: int = SIGNATURE_CHUNK,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """A tag per listing that changes when its lines or their order change.

    Lines are hashed in chunks of ``chunk`` in list order, then the chunk tags the same way until one is left, so no task
    holds more than ``chunk`` lines of a listing and a listing's tag depends on its own lines only. The longest listing sets the number of
    rounds; listings that have one tag already keep it.
    """
    keys = list(keys)
    placed = ordered(listing.withColumn("_line", line), keys, order, {"_pos": position()}, hot_rows)
    counts = listing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_left"))
    tags = placed.select(*keys, (F.col("_pos") - 1).alias("_pos"), F.col("_line")).join(counts, keys)
    longest = counts.agg(F.max("_left")).first()[0] or 0
    first = True
    while first or longest > 1:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_line"))), lambda r: r["_line"]), "\n")
        tag = F.sha2(joined, 256) if first else F.when(F.max("_left") == 1, F.max("_line")).otherwise(F.sha2(joined, 256))
        tags = tags.groupBy(*keys, F.floor(F.col("_pos") / chunk).alias("_chunk")).agg(
            tag.alias("_line"), F.ceil(F.max("_left") / chunk).alias("_left")
        ).withColumnRenamed("_chunk", "_pos")
        longest, first = -(-longest // chunk), False
    return tags.select(*keys, F.col("_line").alias("signature"))
