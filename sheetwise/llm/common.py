"""What several operators of this subpackage share: words, hashes, and tables written between jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.session import settle

#: White space between words, as a Java class; a word is a longest run of anything else.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the given folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder; the shuffle files that made it are released.

    Later jobs start from these files, so a lost executor costs only the tasks it ran. They lie beside the shuffles of the steps after
    them, many with texts, so they are packed more tightly than Spark does by itself.
    """
    conf = df.sparkSession.conf
    before = conf.get(RELEASE, None)
    conf.set(RELEASE, "true")
    try:
        return settle(df, label, compression="zstd")
    finally:
        conf.unset(RELEASE) if before is None else conf.set(RELEASE, before)


def words_of(text: Column) -> Column:
    """The words of a text, in order; empty for null and for blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def count_words(text: Column) -> Column:
    """How many words a text has, without keeping them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """Equal for equal texts only (128 bits)."""
    return F.md5(F.coalesce(F.concat(F.lit("="), text), F.lit("")))


def last_id(column: str = "doc_id") -> Column:
    """The id as a number to order by; null comes last."""
    return F.coalesce(F.col(column).cast("long"), F.lit((1 << 63) - 1))
