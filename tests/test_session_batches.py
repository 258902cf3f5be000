"""What a batch of edit events moves."""

from pyspark.sql import functions as F

from sheetwise.session import scratch_path, shared_folder
from sheetwise.streaming import sessions
from test_scene_limits import _shuffled


def test_a_batch_is_judged_once_and_not_joined_back(spark):
    shared_folder(spark)
    n, path, table = 4000, scratch_path(spark, "events"), scratch_path(spark, "kept")
    i = F.col("id")
    rows = spark.range(n).select(
        F.concat(F.lit("s"), (i % 20).cast("string")).alias("session"), F.timestamp_seconds(i).alias("ts"), i.alias("seq"),
        F.when(i < 20, "create").when(i >= n - 40, "delete").otherwise("update").alias("op"), F.when(i < n - 40, F.concat(F.lit("n"), i.cast("string"))).alias("name"),
        F.lit("gray").alias("filter"), F.lit(0).alias("rotate"),
    )
    rows.coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stream = spark.readStream.schema(rows.schema).parquet(path)
        _, moved = _shuffled(spark, lambda: sessions.scan_sessions(stream, table, scratch_path(spark, "ck")).awaitTermination())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved < 2 * n
    answers = {r["status"]: r["count"] for r in sessions.session_answers(spark, table).groupBy("status").count().collect()}
    assert answers == {201: 20, 200: n - 40, 404: 20}
    left = {r["name"]: r["deleted"] for r in sessions.current_sessions(spark, table).collect()}
    assert left == {f"n{k}": True for k in range(n - 60, n - 40)}
