"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that the next stage gets as ``docs``, written as Parquet
between them. All but the last return the columns of ``documents``:

- quality: documents that the rules reject go;
- near_duplicates: of each group of near copies the one with the least doc_id stays;
- secrets: found secrets are overwritten in the text;
- mix: every document stands as often as the mix takes it, a document at the budget's end in part;
- pack: one row per piece with its sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetwise.llm import jaccard_join, mixing, packing, quality, secrets
from sheetwise.llm.common import table, written

STAGES = [
    ("quality", lambda spark, docs, sf_dir: quality.keep_good(docs)),
    ("near_duplicates", lambda spark, docs, sf_dir: jaccard_join.one_of_each(docs)),
    ("secrets", lambda spark, docs, sf_dir: secrets.masked(docs)),
    ("mix", lambda spark, docs, sf_dir: mixing.mixed(docs)),
    ("pack", lambda spark, docs, sf_dir: packing.packed(docs)),
]

#: Tokens are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
