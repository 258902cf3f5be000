"""Statistics of sample groups: histograms, medians, bands, sides, scores.

Everything is an aggregate with partial sums before the shuffle, or an ``ordered`` pass over
pre-aggregated values, so one huge group does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheetwise.functions import geometry as g
from sheetwise.operators.ordered import HOT_ROWS, best_rows, group_size, group_sum, ordered, position, running_sum

LIKE_TOLERANCE = 18.0
#: How much brighter a blank margin is; samples that a band of added paper, or of a strip, must exceed.
MARGIN_LIFT = 4.0
MIN_BAND, MIN_STRIP = 20, 10


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def histogram(df: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """``keys, level, n`` for the 8-bit levels that occur; a level outside 0-255 counts as the nearer end."""
    bounded = F.greatest(F.lit(0), F.least(F.lit(255), F.col(level).cast("int")))
    return df.groupBy(*keys, F.when(F.col(level).isNotNull(), bounded).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def histogram256(df: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """``keys, level, n`` for all 256 levels of each group, zeros included."""
    counts = histogram(df, keys, level)
    grid = counts.select(*keys).distinct().withColumn("level", F.explode_outer(F.sequence(F.lit(0), F.lit(255))))
    return grid.join(counts, [*keys, "level"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hist_percentile(df: DataFrame, keys: Sequence[str], level: str, fractions: Mapping[str, float]) -> DataFrame:
    """Per group and named fraction: the smallest 8-bit level whose running count reaches it, else 255.

    The windows run over at most 256 counted levels per group.
    """
    line = W.partitionBy(*keys).orderBy("level")
    running = histogram(df, keys, level).select(
        *keys, "level",
        F.sum("n").over(line.rowsBetween(W.unboundedPreceding, 0)).alias("_upto"),
        F.sum("n").over(W.partitionBy(*keys)).alias("_all"),
    )
    return running.groupBy(*keys).agg(*[
        F.coalesce(F.min(F.when(F.col("_upto") >= f * F.col("_all"), F.col("level"))), F.lit(255)).alias(name)
        for name, f in fractions.items()
    ])


def otsu_split(df: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """Per group the ``threshold`` that parts its 256-level histogram best, the first on ties; 0 if one level."""
    line = W.partitionBy(*keys).orderBy("level")
    upto = line.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    mass = F.col("n") * F.col("level")
    moments = histogram(df, keys, level).select(
        *keys, "level",
        F.sum("n").over(upto).alias("n1"), F.sum(mass).over(upto).alias("s1"),
        F.sum("n").over(whole).alias("n"), F.sum(mass).over(whole).alias("s"),
    )
    lean = F.col("s1").cast("double") * F.col("n") - F.col("s").cast("double") * F.col("n1")
    between = F.try_divide(lean * lean, F.col("n1").cast("double") * (F.col("n") - F.col("n1")))
    rated = F.when(F.col("n1") < F.col("n"), F.struct(between.alias("b"), (-F.col("level")).alias("o")))
    return moments.groupBy(*keys).agg(F.coalesce(F.max_by("level", rated), F.lit(0)).alias("threshold"))


def upper_median(df: DataFrame, keys: Sequence[str], values: Sequence[str], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``sorted[n / 2]`` of each column per group (upper of two middles, nothing interpolated)."""
    keys = list(keys)
    tall = df.select(*keys, F.inline_outer(F.array(*[
        F.struct(F.lit(v).alias("_name"), F.col(v).cast("double").alias("_value")) for v in values
    ])))
    counted = tall.groupBy(*keys, "_name", "_value").agg(F.count(F.lit(1)).alias("_n"))
    running = ordered(
        counted, [*keys, "_name"], ["_value"], {"_upto": running_sum("_n"), "_all": group_sum("_n")}, hot_rows
    )
    reached = F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col("_value"))
    return running.groupBy(*keys).agg(*[F.min(F.when(F.col("_name") == v, reached)).alias(v) for v in values])


def pop_spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Population standard deviation per group."""
    return df.groupBy(*keys).agg(F.stddev_pop(value).alias("spread"))


def bright_half_median(
    df: DataFrame, keys: Sequence[str], lightness: str, channels: Sequence[str], idx: Sequence[str], hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Median of each channel over the brighter half of each group; null below ten samples."""
    keys = list(keys)
    ranked = ordered(df, keys, [-F.col(lightness), *idx], {"_pos": position(), "_n": group_size()}, hot_rows)
    bright = ranked.filter((F.col("_pos") <= F.floor(F.col("_n") / 2)) & (F.col("_n") >= 10))
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.join(upper_median(bright, keys, channels, hot_rows), keys, "left")


def polarity(samples: DataFrame, keys: Sequence[str], inside: str = "inside", outside: str = "outside") -> DataFrame:
    """+1 where the paper side is at least as bright as the outside, else -1."""
    return samples.groupBy(*keys).agg(F.when(F.sum(inside) >= F.sum(outside), 1).otherwise(-1).alias("polarity"))


def perimeter_sums(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edge evidence around each outline from samples ``d, inside, outside, in_frame``."""
    here = F.col("in_frame")
    d, lift = F.abs("d"), F.col("inside") - F.col("outside")

    def count(condition: Column) -> Column:
        return F.count(F.when(here & condition, 1))

    return samples.groupBy(*keys).agg(
        F.count(F.when(here, 1)).alias("samples"),
        F.count(F.when(~here, 1)).alias("on_border"),
        count(d > 4.5).alias("supported"),
        F.coalesce(F.sum(F.when(here, F.least(d, F.lit(30.0)))), F.lit(0.0)).alias("strength_sum"),
        count(lift > 6).alias("brighter_inside"),
        count(lift < -6).alias("darker_inside"),
    )


def perimeter_score(
    samples: DataFrame, quads: DataFrame, bands: DataFrame, keys: Sequence[str], width: Column, height: Column
) -> DataFrame:
    """How much each outline looks like a sheet, 0-1, with its parts.

    ``quads`` holds ``keys, corners``; ``bands`` holds ``keys, mean_in, sat_in, mean_out`` of the strips
    either side of the outline. Implausible outlines score 0, and so do those without samples or band.
    """
    keys = list(keys)
    sums = perimeter_sums(samples, keys)
    frame = quads.join(sums, keys, "left").join(bands, keys, "left").fillna(0, [c for c in sums.columns if c not in keys])
    q = F.col("corners")
    p = g.quad_points(q)
    share = F.abs(g.quad_signed_area(q)) / (width * height)
    side1 = (g.distance(p[0], p[1]) + g.distance(p[2], p[3])) / 2
    side2 = (g.distance(p[1], p[2]) + g.distance(p[3], p[0])) / 2
    off = F.greatest(F.lit(0.0), *[F.greatest(45 - a, a - 135) for a in g.quad_angles(q)])
    frame = frame.select(
        *keys, "samples", "mean_in", "sat_in", "mean_out",
        share.alias("_share"), g.quad_is_convex(q).alias("_convex"), off.alias("_off"),
        (F.greatest(side1, side2) / F.greatest(F.least(side1, side2), F.lit(1.0))).alias("aspect"),
        (F.col("on_border") / F.greatest(F.col("samples") + F.col("on_border"), F.lit(1))).alias("border"),
        F.try_divide("supported", "samples").alias("support"),
        clamp(F.try_divide("strength_sum", "samples") / 18.0).alias("strength"),
        F.try_divide(F.greatest("brighter_inside", "darker_inside"), F.col("samples")).alias("contrast"),
        F.when(F.col("brighter_inside") >= F.col("darker_inside"), 1.0).otherwise(0.75).alias("_polarity"),
        (F.col("brighter_inside") / F.greatest(F.lit(1), F.col("brighter_inside") + F.col("darker_inside"))).alias("brighter"),
    )
    margin = clamp((F.col("mean_in") - 90) / 110.0) * clamp(1 - (F.col("sat_in") - 40) / 120.0)
    paper = 0.7 * margin + 0.3 * clamp((F.col("mean_in") - F.col("mean_out") + 10) / 50.0)
    shape = clamp(1 - F.col("_off") / 25) * F.when(F.col("aspect") > 6, 0.3).otherwise(1.0)
    size = clamp((F.col("_share") - 0.02) / 0.25) * F.when(F.col("_share") > 0.93, 0.5).otherwise(1.0)
    frame = frame.withColumn("paper", paper).withColumn("shape", shape).withColumn("size", size)
    total = (
        0.30 * F.col("support") + 0.12 * F.col("strength") + 0.16 * F.col("contrast") * F.col("_polarity")
        + 0.17 * F.col("paper") + 0.10 * F.col("shape") + 0.15 * F.col("size")
    ) * (1 - clamp((F.col("border") - 0.25) * 1.2, 0.0, 0.6))
    sound = (F.col("_share") >= 0.02) & (F.col("_share") <= 0.99) & F.col("_convex") & (F.col("samples") >= 20)
    parts = ["support", "strength", "contrast", "paper", "shape", "size", "border", "brighter", "aspect"]
    return frame.select(
        *keys, *[F.when(sound, v).otherwise(0.0).alias(n) for n, v in [("total", total), *[(c, F.col(c)) for c in parts]]]
    )


def _band_means(samples: DataFrame, keys: Sequence[str], bands: Sequence[str], gray: str, sat: str) -> DataFrame:
    aggs = []
    for band in bands:
        here = F.col("band") == band
        aggs += [
            F.count(F.when(here, 1)).alias(f"n_{band}"),
            F.avg(F.when(here, F.col(gray))).alias(f"gray_{band}"),
            F.avg(F.when(here, F.col(sat))).alias(f"sat_{band}"),
        ]
    return samples.groupBy(*keys).agg(*aggs)


def like_colour(gray: Column, sat: Column, gray_ref: Column, sat_ref: Column) -> Column:
    """Whether a sample looks like the mean of a band."""
    return F.abs(gray - gray_ref) + F.abs(sat - sat_ref) <= LIKE_TOLERANCE


def extra_paper_tests(max_share: float = 0.2) -> tuple[Column, Column]:
    """What the bands' means say, and what the added area itself says, of whether a larger outline adds paper.

    The second asks ``n_like``, how many samples of the added area look like the surroundings, only where there are enough of both.
    """
    c = F.col
    to_paper = F.abs(c("gray_extra") - c("gray_in")) + F.abs(c("sat_extra") - c("sat_in"))
    to_outside = F.abs(c("gray_extra") - c("gray_out")) + F.abs(c("sat_extra") - c("sat_out"))
    few = c("n_out") <= MIN_BAND
    by_means = (
        (c("n_extra") >= MIN_BAND) & (c("n_in") >= MIN_BAND)
        & (c("sat_extra") <= c("sat_in") + 25) & (c("gray_extra") >= 0.6 * c("gray_in")) & (few | ~(to_outside < to_paper))
    )
    background = (c("n_added") > MIN_BAND) & (F.coalesce("n_like", F.lit(0)) > max_share * c("n_added"))
    return by_means, few | ~F.coalesce(background, F.lit(False))


def extra_is_like(
    samples: DataFrame, keys: Sequence[str], gray: str = "gray", sat: str = "sat", added: str = "extra", max_share: float = 0.2
) -> DataFrame:
    """``keys, accepted``: the area a larger outline adds is paper like the panel's margin.

    ``band`` is ``in`` (the panel's margin), ``extra`` (the larger outline's margin beyond the panel),
    ``out`` (just outside) or another name for the ``added`` area itself.
    """
    keys = list(keys)
    means = _band_means(samples, keys, ["in", "extra", "out"], gray, sat)
    met = samples.filter(F.col("band") == added).join(means.select(*keys, "gray_out", "sat_out"), keys)
    like = like_colour(F.col(gray), F.col(sat), F.col("gray_out"), F.col("sat_out"))
    alike = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_added"), F.count(F.when(like, 1)).alias("n_like"))
    by_means, by_added = extra_paper_tests(max_share)
    return means.join(alike, keys, "left").select(*keys, F.coalesce(by_means & by_added, F.lit(False)).alias("accepted"))


def margin_brighter(samples: DataFrame, keys: Sequence[str], lift: float = MARGIN_LIFT, interior: str = "interior") -> DataFrame:
    """``keys, margin``: outside every interior side it is brighter by ``lift``, and there is such a side."""
    inside, outside = [F.avg(F.when(F.col(interior), F.col(n))) for n in ("inside", "outside")]
    sides = samples.groupBy(*keys, "side").agg((outside >= inside + lift).alias("_brighter"))
    return sides.groupBy(*keys).agg(F.coalesce(F.bool_and("_brighter"), F.lit(False)).alias("margin"))


def band_means(min_px: int = MIN_STRIP) -> list[Column]:
    """Of the means inside and outside: whether there is an outside, and the four means that stand for them."""
    c = F.col
    has_in, has_out = c("n_in") > min_px, c("n_out") > min_px
    ins = {v: F.when(has_in, c(f"{v}_in")).otherwise(0.0) for v in ("gray", "sat")}
    outs = {v: F.coalesce(F.when(has_out, c(f"{v}_out")), ins[v]) for v in ins}
    return [has_out.alias("_has_out"), *[m.alias(f"in_{v}") for v, m in ins.items()], *[m.alias(f"out_{v}") for v, m in outs.items()]]


def band_stats(samples: DataFrame, keys: Sequence[str], gray: str = "gray", sat: str = "sat", core: str = "core", min_px: int = MIN_STRIP) -> DataFrame:
    """Mean gray and saturation of the strips, share of the core like the outside, share of the outside like the margin."""
    keys = list(keys)
    means = _band_means(samples, keys, ["in", "out"], gray, sat)
    c = F.col
    means = means.select(*keys, *band_means(min_px))
    met = samples.join(means, keys)
    in_core, in_out = c("band") == core, c("band") == "out"
    like_out = like_colour(c(gray), c(sat), c("out_gray"), c("out_sat"))
    like_in = like_colour(c(gray), c(sat), c("in_gray"), c("in_sat"))

    def share(part: Column, like: Column) -> Column:
        counted = F.try_divide(F.count(F.when(part & like, 1)), F.count(F.when(part, 1)))
        return F.when(F.any_value("_has_out") & (F.count(F.when(part, 1)) > 0), counted).otherwise(0.0)

    # the four means are the same on every row of a photo
    return met.groupBy(*keys).agg(
        *[F.any_value(n).alias(n) for n in ("in_gray", "in_sat", "out_gray", "out_sat")],
        share(in_core, like_out).alias("interior_bg"), share(in_out, like_in).alias("outband_paper"),
    )


def side_lift(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest and smallest mean ``outside - inside`` over the sampled sides; 0 when none is sampled."""
    sides = samples.groupBy(*keys, "side").agg(F.avg(F.col("outside") - F.col("inside")).alias("_lift"))
    return sides.groupBy(*keys).agg(
        F.coalesce(F.max("_lift"), F.lit(0.0)).alias("side_lift_max"), F.coalesce(F.min("_lift"), F.lit(0.0)).alias("side_lift_min")
    )


def counted_quantile(rows: DataFrame, keys: Sequence[str], value: str, fraction: float, out: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Per group the smallest value that at least ``fraction`` of its values do not exceed, exactly.

    Equal values are counted first; the running count survives a huge group. Nulls do not count.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    running = ordered(counts, list(keys), [value], {"_upto": running_sum(F.col("_n"))}, hot_rows)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    reached = running.join(totals, list(keys)).filter(F.col("_upto") >= fraction * F.col("_all"))
    return reached.groupBy(*keys).agg(F.min(value).alias(out))


def stage_latency(rows: DataFrame, group: Sequence[str], decode: str = "decode", detect: str = "detect", render: str = "render") -> DataFrame:
    """Mean time per stage, mean and 95th percentile of ``ms = detect + render``."""
    timed = rows.withColumn("_ms", F.col(detect) + F.col(render))
    means = timed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(decode).alias("decode"), F.avg(detect).alias("detect"), F.avg(render).alias("render"),
        F.avg("_ms").alias("ms"),
    )
    return means.join(counted_quantile(timed, group, "_ms", 0.95, "p95"), list(group), "left")


def weighted_center(
    rows: DataFrame, keys: Sequence[str], slice_col: str, weight: str, y: str, height: Column, expected: Column, min_slices: int = 6
) -> DataFrame:
    """Per group: mean offset of the slices' weighted centres from ``expected`` and their spread; NaN below six slices."""
    slices = rows.groupBy(*keys, slice_col).agg(F.sum(weight).alias("_w"), F.sum(F.col(weight) * F.col(y)).alias("_m"))
    centres = slices.filter(F.col("_w") > 0).withColumn("_c", F.try_divide("_m", "_w") / height)
    enough = F.count(F.lit(1)) >= min_slices
    nan = F.lit(float("nan"))
    return centres.groupBy(*keys).agg(
        F.when(enough, F.avg("_c") - expected).otherwise(nan).alias("offset"),
        F.when(enough, F.max("_c") - F.min("_c")).otherwise(nan).alias("spread"),
    )


def best_match(series: DataFrame, keys: Sequence[str], variant: str, reference: str, value: str) -> DataFrame:
    """Of each key's variants the one that correlates best with the reference, first on ties."""
    rated = series.groupBy(*keys, variant).agg(F.corr(reference, value).alias("correlation"))
    return best_rows(rated, keys, [F.col("correlation").desc_nulls_last(), F.col(variant)])
