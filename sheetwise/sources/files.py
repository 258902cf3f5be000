"""Readers and writers of the benchmark's and the inbox's file layouts.

Listings never read file contents: the binary source leaves the content column out unless a caller
selects it. CSV and JSON come with fixed schemas, so nothing is inferred.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.functions.names import IN_FLIGHT_PREFIX, stem_before_dot
from sheetwise.operators.ordered import best_rows, union_all
from sheetwise.operators.scoring import summary_lines

POINTS = "array<array<double>>"
TRUTH_SCHEMA = (
    "bg_name string, bg_id int, model_name string, model_id int, modeltype_name string, modeltype_id int, "
    "modelsub_name string, modelsub_id int, image_path string, frame_index int, model_width double, model_height double, "
    "tl_x double, tl_y double, bl_x double, bl_y double, br_x double, br_y double, tr_x double, tr_y double"
)
TRUTH_COLUMNS = ["image_path", "bg_name", "model_name", "tl_x", "tl_y", "tr_x", "tr_y", "br_x", "br_y", "bl_x", "bl_y"]
DETECTIONS_SCHEMA = (
    "image_path string, confident string, ms long, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, "
    "x3 double, y3 double, width int, height int"
)
CANDS_SCHEMA = f"path string, w int, h int, chosen int, cands array<struct<c: {POINTS}, f: array<float>>>"
META_SCHEMA = (
    "family string, page_mm array<double>, image array<int>, focal_px double, pose_deg array<double>, params map<string, string>, "
    f"corners_actual {POINTS}, corners_virtual {POINTS}, finger struct<edge: int, tip: array<double>>, "
    f"extra_sheets array<{POINTS}>, doc string"
)
OUTLINE_SCHEMA = (
    f"Corners {POINTS}, Top {POINTS}, Right {POINTS}, Bottom {POINTS}, Left {POINTS}, Confident boolean, image array<int>, "
    "ms struct<decode: bigint, detect: bigint, render: bigint>"
)
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png")


def _listing(spark: SparkSession, path: str, recursive: bool, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), "length", "content")


def _qualified(spark: SparkSession, path: str):
    """The file system of a path and the path as Spark's readers spell it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(place)


def _below(spark: SparkSession, root: str) -> Column:
    """A file's path relative to the folder that was read."""
    start = _qualified(spark, root)[1].toString().rstrip("/") + "/"
    return F.substring(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), F.lit(len(start) + 1), F.lit(1 << 20))


def read_photo_folder(spark: SparkSession, path: str, extensions: Sequence[str] = PHOTO_EXTENSIONS, sample_file: str = "photo.jpg") -> DataFrame:
    """Photos of a folder as ``name, path, mtime, length, content``.

    A folder of samples holds ``<sample>/photo.jpg`` and is keyed by the sample; otherwise the photos
    lie loose and are keyed by their stem. Extensions match whatever their letter case.
    """
    files = _listing(spark, path, recursive=True)
    parts = F.split(_below(spark, path), "/")
    file = F.element_at(parts, -1)
    is_sample = (file == sample_file) & (F.size(parts) == 2)
    loose = (F.size(parts) == 1) & F.lower(file).rlike(r"\.(" + "|".join(extensions) + ")$")
    named = files.withColumn("name", F.when(is_sample, F.get(parts, F.lit(0))).when(loose, stem_before_dot(file)))
    return named.filter(F.col("name").isNotNull()).select("name", "path", "mtime", "length", "content")


def read_frames(spark: SparkSession, root: str, pattern: str = "*.jpeg") -> DataFrame:
    """All frames below ``root``: ``image_path`` relative to it, ``mtime, length, content``."""
    files = _listing(spark, root, recursive=True, pattern=pattern)
    return files.select(_below(spark, root).alias("image_path"), "mtime", "length", "content")


def read_truth_csv(spark: SparkSession, path: str, schema: str = TRUTH_SCHEMA) -> DataFrame:
    """Ground truth by ``image_path`` (gzip is transparent); of a repeated key the last row of the file counts."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    place = rows.select(
        *TRUTH_COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"),
    )
    last = [F.col(c).desc() for c in ("_file", "_block", "_row")]
    return best_rows(place, ["image_path"], last).drop("_file", "_block", "_row")


def read_detections_csv(spark: SparkSession, path: str) -> DataFrame:
    """Detections with ``confident`` as a boolean: true exactly for the text ``True``."""
    rows = spark.read.schema(DETECTIONS_SCHEMA).option("header", True).csv(path)
    return rows.withColumn("confident", F.col("confident") == "True")


def write_detections_csv(detections: DataFrame, path: str, single_file: bool = False) -> None:
    """Detections sorted by path, one CSV with header per range (or one file for small results)."""
    names = [f.split()[0] for f in DETECTIONS_SCHEMA.split(", ")]
    rows = detections.withColumn("confident", F.when(F.col("confident"), "True").otherwise("False")).select(*names).orderBy("image_path")
    (rows.coalesce(1) if single_file else rows).write.option("header", True).csv(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate dumps, one photo per line; blank lines are skipped."""
    return spark.read.schema(CANDS_SCHEMA).json(path).filter(F.col("path").isNotNull())


def write_candidates(photos: DataFrame, path: str) -> None:
    """Candidate dumps as JSON lines in path order."""
    photos.select("path", "w", "h", "chosen", "cands").orderBy("path").write.json(path)


def explode_candidates(photos: DataFrame) -> DataFrame:
    """One row per candidate: ``path, w, h, chosen, cand_idx, corners, features``."""
    rows = photos.select("path", "w", "h", "chosen", F.posexplode("cands").alias("cand_idx", "z"))
    return rows.select("path", "w", "h", "chosen", "cand_idx", F.col("z.c").alias("corners"), F.col("z.f").alias("features"))


def read_sample_json(spark: SparkSession, root: str, file: str, schema: str) -> DataFrame:
    """One JSON document per sample folder, keyed by the folder's ``name``."""
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
    docs = reader.option("pathGlobFilter", file).json(root)
    return docs.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("name"), "*")


def read_sample_meta(spark: SparkSession, root: str) -> DataFrame:
    return read_sample_json(spark, root, "meta.json", META_SCHEMA)


def read_outlines(spark: SparkSession, root: str) -> DataFrame:
    return read_sample_json(spark, root, "outline.json", OUTLINE_SCHEMA)


def write_summary_markdown(summarised: DataFrame, keys: Sequence[str], path: str | None = None, group: str = "family") -> DataFrame:
    """The summary as ordered lines of a pipe table; saved as one text file when ``path`` is given."""
    lines = summary_lines(summarised, keys, group).orderBy("place").select("line")
    if path is not None:
        lines.coalesce(1).write.text(path)
    return lines


def rows_with_all_columns(*frames: DataFrame) -> DataFrame:
    """Bag union whose columns are the sorted union of all columns; absent ones are null."""
    both = union_all(frames, allow_missing=True)
    return both.select(*sorted(both.columns))


def write_rows_csv(path: str, *frames: DataFrame) -> None:
    """Row-level export with the sorted union of columns; absent values are empty cells."""
    rows_with_all_columns(*frames).write.option("header", True).csv(path)


def list_inbox(spark: SparkSession, path: str, in_flight_prefix: str = IN_FLIGHT_PREFIX) -> DataFrame:
    """Top-level files as ``name, length, mtime``, without those still being received and those whose name starts with a dot.

    The folder is listed through its file system, because Spark's readers pass over names that start with ``_``.
    """
    system, place = _qualified(spark, path)
    found = [
        (s.getPath().getName(), s.getLen(), datetime.datetime.fromtimestamp(s.getModificationTime() / 1000, datetime.timezone.utc))
        for s in system.listStatus(place) if s.isFile()
    ]
    files = spark.createDataFrame(found, "name string, length long, mtime timestamp")
    receiving = F.col("name").startswith(in_flight_prefix) & F.col("name").endswith(".part")
    return files.filter(~receiving & ~F.col("name").startswith("."))
