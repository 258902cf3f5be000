"""The benchmark report: results against truth, per family and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.operators.outlines import corner_error, quad_overlap
from sheetwise.operators.scoring import GOOD_IOU, groups_all_last, score_join, summary, summary_lines

METRICS = ["iou", "good", "corner", "confident", "ms"]


def scored_rows(found: DataFrame, truth: DataFrame, key: str = "image_path") -> DataFrame:
    """Per photo: overlap, corner error and whether it is good. One equi-join, the rest is arithmetic."""
    rows = corner_error(quad_overlap(score_join(found, truth, key)))
    return rows.withColumn("good", F.col("iou") > GOOD_IOU)


def benchmark_report(found: DataFrame, truth: DataFrame, group: str = "family", key: str = "image_path") -> DataFrame:
    """Summary per group, the ALL row last.

    ``found`` holds ``key, corners, confident, ms``; ``truth`` holds ``key, truth`` and the group.
    """
    return groups_all_last(summary(scored_rows(found, truth, key), METRICS, group), group)


def benchmark_markdown(found: DataFrame, truth: DataFrame, group: str = "family", key: str = "image_path") -> DataFrame:
    """The report as lines of a pipe table (``place, line``)."""
    return summary_lines(summary(scored_rows(found, truth, key), METRICS, group), METRICS, group)
