"""Secret scan with corpus-wide ownership.

Base patterns and a wider one (long mixed tokens) give candidate strings. Every candidate is hashed, and the hashes are counted over
the corpus: in how many repositories (documents) and under how many owners (sources) each stands. A string that many owners have
copied is an example; one that only few owners hold and that looks drawn at random is taken for live. Wide candidates enter the
result as spans of kind ``owned`` only if they are live and meet no base span; base spans always stay.

Null texts are empty. A null source is an owner of its own. Repeated rows count once per document. Documents without a
candidate have no spans. An empty table gives an empty result. Extra columns are kept by ``masked`` and ignored by ``secret_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import text_key, written

# Kinds in their order, each with the pattern, the group that holds the value, and its least length.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = (
    ("assign", ASSIGN, 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("owned", r"[A-Za-z0-9+/_-]{20,}", 0, 20),
)
BASE = 3  # kinds before this one are base kinds
HINTS = ("passw", "secret", "token", "api")

#: A string under at least this many owners and in this many repositories is an example.
MANY_OWNERS, MANY_REPOS = 4, 8
#: A live-looking string has at least this many different characters, and both digits and letters.
LEAST_VARIETY = 10

#: Overwriting asks for more: beside UUIDs, some part between / + _ - of at least this length changes between small letters, capitals and
#: digits at least so often, and at every so many characters (a capital that opens a word is no change after it); or all parts
#: together do, more densely or without a word's run of small letters. Words, paths, dates and identifiers do not.
UUID = r"(?i)(?<![0-9a-f])[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-f])"
CHANGE = r"(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[0-9]|(?<=[0-9])[A-Za-z]"
LEAST_PART, LEAST_CHANGES, EVERY, MANY_CHANGES, DENSE = 10, 4, 5, 8, 2


def _drawn(value: Column) -> Column:
    """Whether a string shows signs of having been drawn at random, not only variety."""
    rest = F.regexp_replace(value, UUID, "-")
    changes = lambda x: F.regexp_count(x, F.lit(CHANGE))
    part = F.exists(
        F.split(rest, "[/+_-]+"),
        lambda x: (F.length(x) >= LEAST_PART) & (changes(x) >= LEAST_CHANGES) & (changes(x) * EVERY >= F.length(x) - 1),
    )
    dense = (changes(rest) * DENSE >= F.length(rest)) | (changes(rest) * EVERY >= F.length(rest)) & ~rest.rlike("[a-z]{5}")
    return part | (changes(rest) >= MANY_CHANGES) & dense


def _may_hold(text: Column, kind: int) -> Column:
    """Cheap and never wrong when it says no."""
    if kind == 0:
        low = F.lower(text)
        return F.contains(low, F.lit(HINTS[0])) | F.contains(low, F.lit(HINTS[1])) | F.contains(low, F.lit(HINTS[2])) | F.contains(low, F.lit(HINTS[3]))
    return F.contains(text, F.lit("AKIA")) if kind == 1 else text.rlike(KINDS[kind][1])


def _found(text: Column, kind: int) -> Column:
    """All matches of a kind in order: the gap before each, the match and its value.

    What stands between the matches is the text split at them, so offsets are sums of lengths.
    """
    _, pattern, group, _ = KINDS[kind]
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,hit:string,value:string>>")
    gaps, hits = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    parts = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("gap"), hits.alias("hit"), values.alias("value"))
    listed = F.transform(
        parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["hit"].alias("hit"), x["value"].alias("value"))
    )
    return F.when(_may_hold(text, kind), F.filter(listed, lambda x: x["hit"].isNotNull())).otherwise(none)


def _candidates(docs: DataFrame, *keep: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, F.concat(*[_found(text, k) for k in range(len(KINDS))]).alias("found"))


def _spans(found: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """One row per candidate: where it stands in its text (code points, end exclusive) and its hash. The value itself is not kept.

    ``strict`` asks live strings for signs of randomness as well.
    """
    each = found.select(key, F.explode("found").alias("c")).select(key, "c.*")
    so_far = Window.partitionBy(key, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(so_far))
    least = F.get(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind"))
    letters = F.array_remove(F.array_distinct(F.split("value", "")), "")
    live = (F.size(letters) >= LEAST_VARIETY) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    if strict:
        live &= _drawn(F.col("value"))
    return placed.where(F.length("value") >= least).select(
        key, "kind", (F.col("end") - F.length("hit")).alias("start"), "end", F.sha2("value", 256).alias("hash"), live.alias("random")
    )


def ownership(spans: DataFrame) -> DataFrame:
    """``hash, repo, owner`` rows as one row per hash: its repositories and owners, each counted once."""
    by_repo = spans.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def _judged(spans: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    """Every span with ``example`` and ``live``; wide candidates stay only if live and clear of base spans."""
    counted = spans.join(owned, "hash")
    example = (F.col("n_owners") >= MANY_OWNERS) & (F.col("n_repos") >= MANY_REPOS)
    counted = counted.withColumns({"example": example, "live": ~example & F.col("random")})
    place = Window.partitionBy(key).orderBy("start", "end", "kind")
    base_end = F.when(F.col("kind") < BASE, F.col("end"))
    base_start = F.when(F.col("kind") < BASE, F.col("start"))
    near = counted.withColumns(
        {
            "base_before": F.max(base_end).over(place.rowsBetween(Window.unboundedPreceding, -1)),
            "base_after": F.min(base_start).over(place.rowsBetween(1, Window.unboundedFollowing)),
        }
    )
    clear = (F.coalesce("base_before", F.lit(0)) <= F.col("start")) & (F.coalesce("base_after", F.col("end")) >= F.col("end"))
    return near.where((F.col("kind") < BASE) | (F.col("live") & clear))


def secret_spans(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """One row per document: how many base spans of each kind, a checksum of them, and all spans as text."""
    found = _candidates(docs, F.monotonically_increasing_id().alias("uid"), F.col(owner).alias("owner"), F.col(repo).alias("repo"), F.col("doc_id").alias("doc_id"))
    found = written(found, "secret-candidates")  # ids are those of this table from here on
    who = found.select("uid", "owner", "repo")
    spans = written(_spans(found, "uid").join(who, "uid"), "secret-spans")
    judged = _judged(spans.drop("owner", "repo"), ownership(spans), "uid")
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    listed = judged.groupBy("uid").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k][0]}") for k in range(len(KINDS))],
        F.count(F.when(F.col("example"), 1)).alias("n_example"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("at"),
    )

    def text(at: Column) -> Column:
        return F.array_join(F.transform(at, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")

    at = F.coalesce("at", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select("uid", "doc_id").join(listed, "uid", "left").select(
        "doc_id", count("n_assign"), count("n_access"), count("n_hex"),
        F.sha2(text(F.filter(at, lambda x: x["kind"] < BASE)), 256).alias("base_sha256"), text(at).alias("spans"),
        count("n_owned"), count("n_example"), count("n_live"),
    )


def masked(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """``docs`` with every secret overwritten: ``[secret]``, or ``[example secret]`` for a widely copied one.

    Wide candidates are overwritten only with signs of randomness, so that paths, UUIDs and hyphenated words stay; ``secret_spans`` lists all.

    Only texts with a candidate are joined with their spans; equal texts share one list of them.
    """
    rows = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    some = _may_hold(text, 0) | _may_hold(text, 1) | _may_hold(text, 2) | _may_hold(text, 3)
    found = _candidates(docs, text_key(F.col("text")).alias("tkey"), F.col(owner).alias("owner"), F.col(repo).alias("repo"))
    found = written(found.where(F.size("found") > 0), "secret-candidates")
    spans = _spans(found.groupBy("tkey").agg(F.first("found").alias("found")), "tkey", strict=True)
    spans = written(spans, "secret-spans")
    holders = spans.select("tkey", "hash").distinct().join(found.select("tkey", "owner", "repo"), "tkey")
    judged = _judged(spans, ownership(holders), "tkey")
    listed = judged.groupBy("tkey").agg(F.sort_array(F.collect_list(F.struct("start", "end", "example"))).alias("at"))
    mark = lambda x: F.when(x["example"], "[example secret]").otherwise("[secret]")

    def step(a: Column, x: Column) -> Column:
        fresh = x["start"] >= a["at"]
        before = F.substring(F.col("row.text"), (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
        return F.struct(
            F.greatest(a["at"], x["end"]).alias("at"), F.when(fresh, F.concat(a["out"], F.array(before, mark(x)))).otherwise(a["out"]).alias("out")
        )

    new = F.aggregate(
        "at", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), step,
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("row.text"), (a["at"] + 1).cast("int"), F.length("row.text"))),
    )
    touched = rows.where(some).withColumn("tkey", text_key(F.col("row.text"))).join(listed, "tkey", "left")
    touched = touched.select(F.when(F.col("at").isNull(), F.col("row")).otherwise(F.col("row").withField("text", new)).alias("row"))
    return rows.where(~some).unionByName(touched).select("row.*")
