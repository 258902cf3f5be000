"""Quality rules: length and repetition rules, then the distance of a document from its language.

Every document becomes two histograms: its characters by class, and its use of the most common words of its language.
Both are compared with the mean histogram of all documents of that language by Jensen-Shannon distance (base 2, 0 to 1).
Distances are judged only where there is enough text to tell, and only against languages with enough documents.

Null texts are empty. Languages may be null: those documents form a language of their own, without common words.
Repeated rows are judged one by one. An empty table gives an empty result. Extra columns are kept by
``keep_good`` and ignored by ``quality_verdicts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import BLANKS, GAP, words_of, written

# Common words per language, and the classes that characters are sorted into, in the order of removal.
COMMON_WORDS = {
    "de": ("der", "die", "und", "das", "mit", "den", "zu", "von", "ein", "nicht"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "on"),
    "es": ("de", "la", "el", "que", "en", "los", "y", "del", "para", "por"),
    "fr": ("de", "la", "le", "et", "les", "des", "que", "un", "en", "une"),
}
CLASSES = (
    ("lower", "[a-z]+"), ("blank", GAP), ("upper", "[A-Z]+"), ("letter", r"[\p{L}\p{M}]+"), ("digit", r"\p{N}+"),
    ("mark", r"[.,;:?'\"()\-]+"),
)
SYMBOLS = "[^#*$%&|<>]+"
BASE_WORDS, BASE_REPEATS = 50, 50

#: Texts shorter than this many characters or words are not judged by the histogram in question.
MIN_CHARS, MIN_WORDS = 200, 80
#: A language is a reference from this many documents on.
MIN_DOCS = 30
#: Largest distances that are accepted.
CLASS_DISTANCE, WORD_DISTANCE = 0.30, 0.26


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words inside a three-word window that the text has at least twice; both given as columns that are computed already."""
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(n >= 3, F.sort_array(windows)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def quality_features(docs: DataFrame, common: dict[str, tuple[str, ...]] = COMMON_WORDS) -> DataFrame:
    """``docs`` as ``row`` (a struct of its columns) with counts, ``classes`` and ``commons`` (arrays of counts)."""
    out = docs.select(F.struct("*").alias("row")).withColumns(
        {"text": F.coalesce(F.col("row.text"), F.lit("")), "lang": F.coalesce(F.concat(F.lit("="), F.col("row.lang")), F.lit(""))}
    )
    out = out.withColumn("words", words_of(F.col("text"))).withColumn("rest_text", F.col("text"))
    sizes = {}
    for name, pattern in CLASSES:  # each class is taken out of what the ones before it left
        out = out.withColumn("left", F.regexp_replace("rest_text", pattern, ""))
        sizes[name] = (F.length("rest_text") - F.length("left")).cast("long")
        out = out.withColumn(f"n_{name}", sizes[name]).drop("rest_text").withColumnRenamed("left", "rest_text")
    out = out.withColumns(
        {
            "n_other": F.length("rest_text").cast("long"),
            "n_symbols": F.length(F.regexp_replace("rest_text", SYMBOLS, "")).cast("long"),
            "n_chars": F.length("text").cast("long"),
            "n_words": F.size("words").cast("long"),
        }
    )
    known = F.lit(None).cast("array<string>")
    for lang, listed in sorted(common.items()):
        known = F.when(F.col("lang") == f"={lang}", F.array(*map(F.lit, listed))).otherwise(known)
    listed = sorted({w for words in common.values() for w in words})
    out = out.withColumns(
        {
            "classes": F.array(*[F.col(f"n_{name}") for name, _ in CLASSES], F.col("n_other")),
            "listed": known,
            "seen": F.filter("words", lambda w: w.isin(listed)),
            "hashes": F.transform("words", lambda w: F.xxhash64(w)),
            "lines": F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0),
        }
    )
    out = out.withColumns(
        {
            "commons": F.transform("listed", lambda w: F.size(F.filter("seen", lambda x: x == w)).cast("long")),
            "windows": _repeat_words(F.col("hashes"), F.size("hashes")),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "word_chars": F.col("n_chars") - F.col("n_blank"),
        }
    )
    found = F.filter(
        "windows",
        lambda x, j: (x["h"] == F.get("windows", j - 1)["h"]) | (x["h"] == F.get("windows", j + 1)["h"]),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(found, lambda x: x["i"])),
        F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    out = out.withColumn("n_repeat_words", covered)
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))
    keep = ("row", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "classes", "commons")
    return out.select(*keep, failed.alias("base_failed"), F.monotonically_increasing_id().alias("at"))


def language_references(features: DataFrame, n_common: int = 10) -> DataFrame:
    """One row per language: how many documents it has, and the sum of their shares per class and per common word.

    Shares are whole parts per million, so the sums do not depend on the order of adding.
    """
    def sums(counts: str, total: str, n: int) -> list[Column]:
        share = lambda i: F.floor(F.get(counts, F.lit(i)) * 1_000_000 / F.col(total)).cast("long")
        return [F.coalesce(F.sum(share(i)), F.lit(0)).alias(f"{counts}{i}") for i in range(n)]

    n_classes = len(CLASSES) + 1
    long_enough = features.where((F.col("n_words") >= MIN_WORDS) & (F.col("n_chars") >= MIN_CHARS))
    found = long_enough.groupBy("lang").agg(
        F.count("*").alias("n_docs"), *sums("classes", "n_chars", n_classes), *sums("commons", "n_words", n_common)
    )
    mean = lambda name, n: F.array(*[F.col(f"{name}{i}") / (F.col("n_docs") * 1e6) for i in range(n)])
    return found.where(F.col("n_docs") >= MIN_DOCS).select(
        "lang", "n_docs", mean("classes", n_classes).alias("class_means"), mean("commons", n_common).alias("common_means")
    )


def _distance(own: Column, ref: Column) -> Column:
    """Jensen-Shannon distance of two histograms whose shares add up to one."""
    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / ((p + q) / 2))).otherwise(F.lit(0.0))

    terms = F.zip_with(own, ref, lambda p, q: part(p, q) + part(q, p))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _with_rest(shares: Column) -> Column:
    """The shares of the listed words, and of all others."""
    rest = F.greatest(1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    return F.concat(shares, F.array(rest))


def judge(features: DataFrame, references: DataFrame, small: bool = True) -> DataFrame:
    """``features`` with ``class_distance``, ``word_distance`` (null where not judged) and ``kept``."""
    joined = features.join(F.broadcast(references) if small else references, "lang", "left")
    classes = F.transform("classes", lambda x: x / F.col("n_chars"))
    commons = F.transform("commons", lambda x: x / F.col("n_words"))
    judged = joined.withColumns(
        {
            "class_distance": F.when(
                F.col("n_docs").isNotNull() & (F.col("n_chars") >= MIN_CHARS), _distance(classes, F.col("class_means"))
            ),
            "word_distance": F.when(
                F.col("n_docs").isNotNull() & (F.col("n_words") >= MIN_WORDS) & F.col("commons").isNotNull(),
                _distance(_with_rest(commons), _with_rest(F.col("common_means"))),
            ),
        }
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_DISTANCE)
    return judged.withColumn("kept", ~F.col("base_failed") & near)


def _judged(features: DataFrame, source: DataFrame) -> DataFrame:
    """References from ``features``; ``source`` judged by them. They are broadcast while they are few."""
    references = written(language_references(features), "languages")
    return judge(source, references, small=references.count() <= 10_000)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, verdict and distances (in parts per million)."""
    features = quality_features(docs.select("doc_id", "text", "lang"))
    features = written(features.withColumn("row", F.struct("row.doc_id")), "quality")
    return _judged(features, features).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.floor(F.col("class_distance") * 1e6).alias("class_ppm"), F.floor(F.col("word_distance") * 1e6).alias("word_ppm"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    features = quality_features(docs)
    # the row number holds the filter above the features, or they would be computed again for each of its terms
    return _judged(features, features).where(F.col("kept") & (F.col("at") >= 0)).select("row.*")
