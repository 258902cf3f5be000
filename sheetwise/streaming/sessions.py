"""Edit sessions as keyed state, and the cap on how many stay editable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sheetwise.operators.sessions import MAX_SESSIONS, judge_events, keep_recent

FIELDS = {"name": "string", "filter": "string", "rotate": "int"}
_PLACE = "struct<at:double,seq:bigint>"
STATE = f"session string, made {_PLACE}, gone {_PLACE}, version bigint, " + ", ".join(
    f"{name} struct<at:double,seq:bigint,value:{kind}>" for name, kind in FIELDS.items()
)


#: A batch in this many writes all sessions anew; the others write those they touch.
SNAPSHOT_EVERY = 16


def scan_sessions(
    events: DataFrame, table: str, checkpoint: str, session: str = "session", at: str = "ts", seq: str = "seq", forget: float | None = None,
    every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Answer a stream of edit events (``session, ts, seq, op, name, filter, rotate``) batch by batch, then stop.

    Each batch is judged in time order together with the create and the delete that earlier batches saw, so answers depend neither on how
    rows are chunked nor, for events that come in order, on how they are cut into batches. Answers (``session, seq, status``) go to
    ``<table>/answers/batch=<n>``. The sessions that a batch touches, with the latest write of each field, go to ``<table>/state/after=<n>``;
    the row of the latest batch is a session's state. A late event does not overwrite a newer one. One batch in ``every`` also writes the
    untouched sessions, and what came before it is removed once a later batch runs. A deleted session is dropped ``forget`` seconds
    after its delete, by event time; without it sessions are kept for ever.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(
            F.col(session).cast("string").alias("session"), (F.unix_micros(at) / 1e6).alias("at"), F.col(seq).cast("long").alias("seq"),
            "op", *[F.col(c).cast(kind).alias(c) for c, kind in FIELDS.items()],
        )
        state = _state_before(spark, table, batch_id, every, forget)
        touched = state.join(rows.select("session").distinct(), "session", "left_semi")
        before = touched.select("session", F.inline(F.array(
            F.struct(F.col("made.at").alias("at"), F.col("made.seq").alias("seq"), F.lit("create").alias("op")),
            F.struct(F.col("gone.at").alias("at"), F.col("gone.seq").alias("seq"), F.lit("delete").alias("op")),
        ))).filter(F.col("at").isNotNull()).withColumn("_known", F.lit(True))
        judged = judge_events(rows.unionByName(before, allowMissingColumns=True), ["session"], ["at", "seq"]).filter(F.col("_known").isNull())
        # judged once: the answers and the state read the same rows, and nothing is joined back
        judged = judged.drop("_known")
        judged.write.mode("overwrite").parquet(f"{table}/judged")
        judged = spark.read.schema(judged.schema).parquet(f"{table}/judged")
        judged.select("session", "seq", "status").write.mode("overwrite").parquet(f"{table}/answers/batch={batch_id}")
        place, good = F.struct("at", "seq"), F.col("status") < 400
        fresh = judged.groupBy("session").agg(
            F.min(F.when(F.col("op") == "create", place)).alias("made"), F.min(F.when(F.col("op") == "delete", place)).alias("gone"),
            F.count(F.when(good & (F.col("op") == "update"), 1)).alias("version"),
            *[F.max(F.when(good & F.col(c).isNotNull(), F.struct("at", "seq", F.col(c).alias("value")))).alias(c) for c in FIELDS],
        )
        known = state if _is_snapshot(batch_id, every) else touched
        merged = known.unionByName(fresh).groupBy("session").agg(
            F.min("made").alias("made"), F.min("gone").alias("gone"), F.sum("version").alias("version"), *[F.max(c).alias(c) for c in FIELDS]
        )
        rows.agg(F.max("at").alias("now")).write.mode("overwrite").parquet(f"{table}/clock/after={batch_id}")
        merged.write.mode("overwrite").parquet(f"{table}/state/after={batch_id}")
        _remove(spark, f"{table}/judged")
        for old in range(max(0, batch_id - 2 * every), _snapshot_before(batch_id, every)):
            _remove(spark, f"{table}/state/after={old}")

    return events.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _is_snapshot(batch_id: int, every: int) -> bool:
    return (batch_id + 1) % every == 0


def _snapshot_before(batch_id: int, every: int) -> int:
    """The latest batch before this one that wrote all sessions; 0, the first batch, where there is none."""
    return max(0, batch_id // every * every - 1)


def _state_before(spark: SparkSession, table: str, batch_id: int, every: int, forget: float | None) -> DataFrame:
    """All sessions as the batches before ``batch_id`` left them: the latest row of each, from the last snapshot on."""
    if batch_id == 0:
        return spark.createDataFrame([], STATE)
    paths = [f"{table}/state/after={n}" for n in range(_snapshot_before(batch_id, every), batch_id)]
    kept = spark.read.option("basePath", f"{table}/state").schema(f"{STATE}, after bigint").parquet(*paths)
    columns = [c for c in kept.columns if c != "session"]
    latest = kept.groupBy("session").agg(F.max_by(F.struct(*columns), "after").alias("_s")).select("session", "_s.*")
    if forget is not None:
        # the event time each batch reached, and so what is forgotten after it
        times = spark.read.schema("now double, after bigint").parquet(f"{table}/clock").filter(F.col("after") < batch_id)
        clock = {r["after"]: r["now"] for r in times.filter(F.col("after") >= _snapshot_before(batch_id, every)).collect()}
        reached, latest_time = [], None
        for after in sorted(clock, reverse=True):  # at most ``every`` batches
            latest_time = max((t for t in (latest_time, clock[after]) if t is not None), default=None)
            reached += [F.lit(after).cast("long"), F.lit(latest_time).cast("double")]
        now = F.create_map(*reached)[F.col("after")]
        latest = latest.filter(F.col("gone").isNull() | now.isNull() | (F.col("gone.at") > now - forget))
    return latest.drop("after")


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def session_answers(spark: SparkSession, table: str) -> DataFrame:
    """All answers of :func:`scan_sessions`: ``session, seq, status``."""
    return spark.read.parquet(f"{table}/answers").drop("batch")


def current_sessions(spark: SparkSession, table: str, forget: float | None = None, every: int = SNAPSHOT_EVERY) -> DataFrame:
    """The sessions after the latest batch of :func:`scan_sessions`; give ``forget`` and ``every`` as there."""
    ids = spark.read.schema("now double, after bigint").parquet(f"{table}/clock").agg(F.max("after")).first()[0]
    made = _state_before(spark, table, ids + 1, every, forget).filter(F.col("made").isNotNull())
    return made.select(
        "session", F.col("made.at").alias("created"), *[F.col(f"{c}.value").alias(c) for c in FIELDS], "version", F.col("gone").isNotNull().alias("deleted")
    )


def evicting_sessions(creates: DataFrame, table: str, checkpoint: str, k: int = MAX_SESSIONS) -> StreamingQuery:
    """Keep the ``k`` newest sessions after each batch of creates (``id, created``), in ``<table>/after=<batch>``.

    Only those ``k`` rows carry over from batch to batch.
    """

    def evict(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("id", "created")
        if batch_id > 0:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{table}/after={batch_id - 1}"))
        keep_recent(rows, k=k).write.mode("overwrite").parquet(f"{table}/after={batch_id}")

    return creates.writeStream.foreachBatch(evict).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_sessions(spark: SparkSession, table: str) -> DataFrame:
    """The rows of the latest batch of :func:`evicting_sessions`."""
    rows = spark.read.parquet(table)
    latest = rows.agg(F.max("after").alias("after"))
    return rows.join(F.broadcast(latest), "after").drop("after")
