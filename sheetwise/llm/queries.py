"""The dealt operators bound to the driver's tables, with the same question in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm import feistel, hard_negatives, inner_products, jaccard_join, maxent, mixing, packing, page_text, quality, repeats, secrets, spelling, toxicity
from sheetwise.llm.common import table
from sheetwise.llm.sql import SQL  # noqa: F401  what __spark_entry__ hands on


def _moved_labels(vectors: DataFrame) -> DataFrame:
    """Every seventh id goes to the next label, so that some rows of another label are as near as positives."""
    label = F.col("label")
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chosen_path_join": lambda spark, sf: jaccard_join.near_duplicates(table(spark, sf, "documents")),
    "op2_feistel_pseudonyms": lambda spark, sf: feistel.pseudonymised(table(spark, sf, "documents")),
    "op3_norm_sorted_search": lambda spark, sf: inner_products.top_products(table(spark, sf, "embeddings")),
    "op4_distribution_divergence": lambda spark, sf: quality.quality_verdicts(table(spark, sf, "documents")),
    "op5_suffix_tree_repeats": lambda spark, sf: repeats.repeat_digests(table(spark, sf, "documents")),
    "op6_fair_queue_mix": lambda spark, sf: mixing.mix_plan(table(spark, sf, "documents")),
    "op7_nearest_url_difference": lambda spark, sf: page_text.main_text(table(spark, sf, "pages")),
    "op8_histogram_packing": lambda spark, sf: packing.packed(table(spark, sf, "documents")),
    "op9_naive_bayes_ngrams": lambda spark, sf: toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op10_secret_ownership": lambda spark, sf: secrets.secret_spans(table(spark, sf, "documents")),
    "op11_trie_pair_variants": lambda spark, sf: spelling.spelling_variants(table(spark, sf, "documents")),
    "op12_hashed_maxent_scores": lambda spark, sf: maxent.language_scores(table(spark, sf, "documents")),
    "op13_anchor_tree_negatives": lambda spark, sf: hard_negatives.hard_negatives(_moved_labels(table(spark, sf, "embeddings"))),
}
