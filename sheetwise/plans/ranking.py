"""From scored candidates to one picked page per photo."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheetwise.operators.candidates import (
    argmax_pick, counted_rivals, gate, grow_to_whole, joined_growth, split_crowded, with_close_rivals, with_grown,
)
from sheetwise.operators.evidence import PAIR, Frame, appearance, grow_by_evidence, pair_evidence
from sheetwise.operators.ordered import HOT_ROWS, computed_once, first_of_group, group_size, ordered, position
from sheetwise.operators.outlines import quad_overlap
from sheetwise.operators.scoring import summary
from sheetwise.operators.training import FEATURES, predict_overlap
from sheetwise.session import settle

Relation = Callable[[Column, Column], Column]
MEASURED = (
    "total", "support", "strength", "contrast", "paper", "shape", "size", "border", "brighter", "aspect",
    "in_gray", "in_sat", "out_gray", "out_sat", "interior_bg", "outband_paper", "side_lift_max", "side_lift_min",
)


def never(top: Column, own: Column) -> Column:
    return F.lit(False)


def candidate_features(
    cands: DataFrame,
    frame_area: Column,
    shape: Sequence[str],
    overlap: Relation,
    accept: Relation,
    corners_on: Relation = never,
    print_inside: Relation = never,
    extra_paper: Relation = never,
    photo: str = "photo_id",
    hot_rows: int | None = HOT_ROWS,
    rules: DataFrame | None = None,
) -> DataFrame:
    """Add ``features``: the 35 numbers of every candidate, as 32-bit floats in the fixed order.

    ``cands`` holds ``photo, cand_idx, score, area, source``, the ``shape`` columns and the ``MEASURED``
    ones. The relations compare the photo's top candidate with another as structs of ``area`` and shape. ``rules`` holds
    each photo's rule-based pick (``photo, cand_idx``), if it is known already.
    """
    few, many = split_crowded(cands, photo, hot_rows)
    picks = None if rules is None else rules.select(photo, F.col("cand_idx").alias("_rule"))
    own, order = F.struct(F.col("area"), *[F.col(c) for c in shape]), [-F.col("score"), "cand_idx"]
    ranks = {"_pos": position(), "_n": group_size(), "_top": first_of_group(F.struct("cand_idx", "score", "area", *shape))}
    # few candidates: all is found in the window that ranks them
    joined = ordered(few.withColumn("_order", order[0]), [photo], ["_order", "cand_idx"], ranks, None)
    line = W.partitionBy(photo).orderBy("_order", "cand_idx")
    told = ["cand_idx", "score", "area", *([] if picks is not None else ["source", *shape])]
    others = F.collect_list(F.struct(*told)).over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    joined = with_close_rivals(joined.withColumn("_others", others), "_others")
    if picks is None:
        joined = with_grown(joined, "_others", overlap, accept, where=F.col("_pos") == 1)
        joined = joined.withColumn("_rule", F.first("_grown.cand_idx").over(line.rowsBetween(W.unboundedPreceding, 0))).drop("_grown")
    joined = joined.drop("_others", "_order")
    if many is not None:
        ranked = ordered(many, [photo], order, ranks, hot_rows)
        crowded = ranked.join(counted_rivals(many.select(photo, "cand_idx", "score", "area"), photo, hot_rows=hot_rows), [photo, "cand_idx"])
        if picks is None:
            chosen = joined_growth(many, overlap, accept, shape, photo).select(photo, F.col("cand_idx").alias("_rule"))
            crowded = crowded.join(chosen, photo)
        joined = joined.unionByName(crowded)
    if picks is not None:
        joined = joined.join(picks, photo)
    top = F.col("_top")
    one = F.lit(1.0)
    joined = joined.withColumn("_shared", overlap(top, own))
    grows = (F.col("_pos") > 1) & (F.col("area") > 1.05 * top["area"])
    kind = F.element_at(F.split("source", r"\+"), 1)
    value = {name: F.col(name) for name in MEASURED}
    value |= {
        "aspect": F.least(F.col("aspect"), F.lit(10.0)),
        "area": F.col("area") / frame_area,
        "score_rel": F.col("score") - top["score"],
        "area_rel": F.log(F.greatest(F.col("area"), one) / F.greatest(top["area"], one)),
        "contains_top": F.col("_shared") / F.greatest(top["area"], one),
        "inside_top": F.col("_shared") / F.greatest(F.col("area"), one),
        "corners_on": grows & corners_on(top, own),
        "print_inside": grows & print_inside(top, own),
        "extra_paper": grows & extra_paper(top, own),
        "src_lines": kind == "lines", "src_edges": kind == "edges", "src_weak": kind == "weak-edges",
        "src_bright": kind == "bright", "src_neutral": kind == "neutral",
        "rank": (F.col("_pos") - 1) / F.col("_n"),
        "n_larger_close": F.col("n_larger_close"), "n_smaller_close": F.col("n_smaller_close"),
        "rules_pick": F.col("cand_idx") == F.col("_rule"),
    }
    vector = F.array(*[value[name].cast("float") for name in FEATURES])
    return joined.withColumn("features", vector).select(*cands.columns, "features")


EVIDENCE = ("_corners_on", "_print_inside", "_extra_paper", "_overlap")


def features_from_samples(
    cands: DataFrame, samples: DataFrame, frame: Frame, corners: str = "corners", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """``cands`` with their ``features``, appearance and acceptance measured on the photos' samples.

    ``cands`` holds ``photo, cand_idx, score, area, source``, the outline and the ``MEASURED`` columns that are not appearance.
    """
    photo, columns = frame.photo, cands.columns
    cands = settle(cands, "cands")
    picks = settle(grow_by_evidence(cands, samples, frame, corners), "picks")
    ranked = ordered(
        cands, [photo], [-F.col("score"), "cand_idx"], {"_top": first_of_group(F.struct("cand_idx", "area", corners))}, hot_rows
    )
    pairs = ranked.select(
        photo, F.col("_top.cand_idx").alias("pick_idx"), "cand_idx", F.col(f"_top.{corners}").alias("inner"), F.col(corners).alias("outer"),
        ((F.col("cand_idx") != F.col("_top.cand_idx")) & (F.col("area") > 1.05 * F.col("_top.area"))).alias("_grows"),
    )
    lapped = computed_once(quad_overlap(settle(pairs, "tops"), "inner", "outer"), _overlap=F.col("overlap"))
    pairs = settle(lapped.select(photo, *PAIR, "inner", "outer", "_grows", "_overlap"), "pairs")
    judged = pair_evidence(pairs.filter("_grows"), samples, frame)
    judged = judged.select(photo, "cand_idx", *[F.col(n[1:]).alias(n) for n in EVIDENCE[:3]])
    known = settle(pairs.select(photo, "cand_idx", "_overlap").join(judged, [photo, "cand_idx"], "left"), "known")
    full = cands.join(appearance(cands, samples, frame, corners), [photo, "cand_idx"]).join(known, [photo, "cand_idx"])
    flag = {n: (lambda top, own, n=n: F.coalesce(n, F.lit(False))) for n in EVIDENCE[:3]}
    out = candidate_features(
        settle(full, "measured"), F.lit(frame.width * frame.height), [corners, *EVIDENCE], lambda top, own: own["_overlap"], never,
        flag["_corners_on"], flag["_print_inside"], flag["_extra_paper"], photo, hot_rows, picks,
    )
    return out.select(*columns, "features")


def rank_pages_by_evidence(
    cands: DataFrame, samples: DataFrame, frame: Frame, nodes: DataFrame | None, bias: float = 0.0, rate: float = 0.05, corners: str = "corners"
) -> DataFrame:
    """The picked page of each photo with ``accepted`` and ``confident``, from candidates and samples.

    With a tree table the features are measured and the best prediction is gated. Without one the growing rules pick.
    """
    if nodes is None:
        return gate(grow_by_evidence(cands, samples, frame, corners))
    measured = features_from_samples(cands, samples, frame, corners)
    predicted = predict_overlap(measured, nodes, "features", "_pred", bias, rate)
    return gate(argmax_pick(predicted, "_pred", frame.photo).drop("_pred"))


def rank_pages(
    cands: DataFrame, nodes: DataFrame | None, shape: Sequence[str], overlap: Relation, accept: Relation, photo: str = "photo_id",
    bias: float = 0.0, rate: float = 0.05, features: str = "features",
) -> DataFrame:
    """The picked page of each photo with ``accepted`` and ``confident``.

    With a tree table: predict, take the best, gate. Without one the growing rules pick.
    """
    if nodes is None:
        return gate(grow_to_whole(cands, overlap, accept, shape, photo))
    predicted = predict_overlap(cands, nodes, features, "_pred", bias, rate)
    return gate(argmax_pick(predicted, "_pred", photo).drop("_pred"))


def ablate(cands: DataFrame, variants: dict[str, Callable[[DataFrame], DataFrame]], label: str = "label", group: str = "family", photo: str = "photo_id") -> DataFrame:
    """Summaries of several ways to pick, side by side: ``group, variant, n, label_mean, label_worst``.

    Each variant maps the candidates to one pick per photo (``photo, cand_idx``).
    """
    out = None
    labels = cands.select(photo, "cand_idx", label, group)
    for name, pick in variants.items():
        rows = pick(cands).select(photo, "cand_idx").join(labels, [photo, "cand_idx"])
        part = summary(rows, [label], group).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
