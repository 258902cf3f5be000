"""Edit sessions and inbox listings: folding events into state, keeping, expiring and purging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.operators.ordered import HOT_ROWS, best_rows, following, ordered, running_sum

MAX_SESSIONS = 30
HIGHLIGHT_SECONDS = 3.5
STALL_SECONDS, ANSWER_SECONDS = 30, 90


def judge_events(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Add ``status`` to each event: 201 create, 200 accepted, 404 before the create or after the delete."""
    is_create, is_delete = F.when(F.col(op) == "create", 1).otherwise(0), F.when(F.col(op) == "delete", 1).otherwise(0)
    marked = ordered(
        events.withColumn("_create", is_create).withColumn("_delete", is_delete), keys, order,
        {"_made": running_sum("_create"), "_gone": running_sum("_delete")}, hot_rows,
    )
    alive = (F.col("_made") > 0) & (F.col("_gone") - F.col("_delete") == 0)
    status = F.when(~alive, 404).when(F.col("_create") == 1, 201).otherwise(200)
    return marked.withColumn("status", status).drop("_create", "_delete", "_made", "_gone")


def session_fold(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str] = ("name", "filter", "rotate"),
    op: str = "op", hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Current state of every session that was created.

    Per session: ``created`` (first ordering column of the create), the latest non-null value of each field,
    ``version`` (accepted updates), ``deleted`` and ``rejected`` (events that met no live session).
    """
    keys = list(keys)
    judged = judge_events(events, keys, order, op, hot_rows)
    place = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    good = F.col("status") < 400
    folded = judged.groupBy(*keys).agg(
        F.min(F.when(F.col("status") == 201, F.col(order[0]))).alias("created"),
        *[F.max_by(f, F.when(good & F.col(f).isNotNull(), place)).alias(f) for f in fields],
        F.count(F.when(good & (F.col(op) == "update"), 1)).alias("version"),
        (F.count(F.when(good & (F.col(op) == "delete"), 1)) > 0).alias("deleted"),
        F.count(F.when(~good, 1)).alias("rejected"),
    )
    return folded.filter(F.col("created").isNotNull())


def describe_sessions(sessions: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``answer``: the JSON description a client receives for a session."""
    i = F.col(id_col)
    preview = F.concat(F.lit("/api/scan/"), i, F.lit("/preview?v="), F.col("version").cast("string"))
    known = [c for c in ("name", "width", "height", "size", "confident", "filter", "rotate", "version", "outline") if c in sessions.columns]
    body = F.struct(
        i.alias("id"), *[F.col(c) for c in known], preview.alias("previewUrl"),
        F.concat(F.lit("/api/scan/"), i, F.lit("/source")).alias("sourceUrl"),
    )
    return sessions.withColumn("answer", F.to_json(body))


def keep_recent(sessions: DataFrame, created: str = "created", tie: str = "id", k: int = MAX_SESSIONS, owner: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most recently created sessions, overall or per owner."""
    order = [F.col(created).desc(), F.col(tie).desc()]
    if not owner:
        return sessions.orderBy(*order).limit(k)
    return best_rows(sessions, owner, order, k)


def inbox_order(listing: DataFrame, mtime: str = "mtime", name: str = "name") -> DataFrame:
    """Newest first, then by name."""
    return listing.orderBy(F.col(mtime).desc(), F.col(name))


def recent_flags(seen: DataFrame, now: Column, arrived: str = "arrived", seconds: float = HIGHLIGHT_SECONDS) -> DataFrame:
    """The names still highlighted at ``now`` (seconds): arrived less than ``seconds`` ago."""
    return seen.filter((F.col(arrived) <= now) & (F.col(arrived) + seconds > now))


def expire_known(recent: DataFrame, known: DataFrame, now: Column, until: str = "until", name: str = "name") -> DataFrame:
    """Highlights that have not run out and whose name is still listed, whatever its letter case."""
    listed = known.select(F.lower(name).alias("_name"))
    alive = recent.filter(F.col(until) > now).withColumn("_name", F.lower(name))
    return alive.join(listed, "_name", "left_semi").drop("_name")


def stalled_transfers(
    progress: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, phase: str, end: Column | None = None,
    stall: float = STALL_SECONDS, answer: float = ANSWER_SECONDS, done: str = "done", hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """The progress rows after which a transfer timed out: ``at`` in seconds, ``phase`` sending, processing or done.

    A transfer stalls when its next row comes more than ``stall`` seconds later (``answer`` once all bytes
    are sent), or when none comes before ``end``.
    """
    linked = ordered(progress, keys, order, {"_next": following(at)}, hot_rows)
    limit = F.when(F.col(phase) == "processing", answer).otherwise(stall)
    until = F.col("_next") if end is None else F.coalesce(F.col("_next"), end)
    gap = until - F.col(at)
    return linked.filter((F.col(phase) != done) & (gap > limit)).withColumn("timed_out_at", F.col(at) + limit).drop("_next")


def upload_throughput(uploads: DataFrame, at: str = "ts", size: str = "size", state: str = "state", window: str = "1 hour", *by: str) -> DataFrame:
    """Counters, bytes and speed per time window; works on a table or, with a watermark, on a stream."""
    width = F.window(at, window)
    sent = F.col(state) == "sent"
    sums = uploads.groupBy(width.alias("window"), *by).agg(
        F.count(F.when(sent, 1)).alias("sent"), F.count(F.when(F.col(state) == "failed", 1)).alias("failed"),
        F.sum(F.when(sent, F.col(size)).otherwise(0)).alias("bytes"),
    )
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return sums.select(F.col("window.start").alias("start"), *by, "sent", "failed", "bytes", (F.col("bytes") / seconds).alias("speed"))


def purge_sessions(folders: DataFrame, live: DataFrame, root: str, prefix: str, owner: str = "owner", path: str = "path") -> DataFrame:
    """Add ``purge``: the owner has ended and the folder lies directly under ``root`` with the right prefix."""
    parent = F.regexp_replace(path, r"/[^/]*$", "")
    name = F.regexp_extract(path, r"[^/]*$", 0)
    ours = (parent == root.rstrip("/")) & name.startswith(prefix)
    gone = folders.join(live.select(owner).distinct().withColumn("_live", F.lit(True)), owner, "left")
    return gone.withColumn("purge", ours & F.col("_live").isNull()).drop("_live")
