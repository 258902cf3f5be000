"""Sessions, inbox listings and their files bound to events, orders, customer and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query, table
from bindings.views import quads
from sheetwise.functions import geometry as g
from sheetwise.operators import sessions as ops
from sheetwise.operators.ordered import ordered, running_sum
from sheetwise.sources import files
from sheetwise.session import scratch_path

EDITS = """edits AS (SELECT user_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS number, ts, event_id,
    CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' ELSE 'update' END AS op,
    CASE WHEN event_type = 'signup' THEN 'scan' || event_id WHEN event_type = 'purchase' THEN 'file' || event_id END AS name,
    CASE WHEN event_type = 'signup' THEN 'auto' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'gray' WHEN event_type = 'view' THEN 'bw' END AS filter,
    CASE WHEN event_type = 'signup' THEN 0 WHEN event_type = 'click' THEN (event_id % 4 * 90)::INT END AS rotate FROM events)"""


def edits(spark, d):
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    kind, i = F.col("event_type"), F.col("event_id")
    made = F.when(kind == "signup", 1).otherwise(0)
    numbered = ordered(events, ["user_id"], ["ts", "event_id"], {"number": running_sum(made.cast("long"))})
    return numbered.select(
        "user_id", "number", "ts", "event_id",
        F.when(kind == "signup", "create").when(kind == "error", "delete").when(kind == "purchase", "rename").otherwise("update").alias("op"),
        F.when(kind == "signup", F.concat(F.lit("scan"), i.cast("string"))).when(kind == "purchase", F.concat(F.lit("file"), i.cast("string"))).alias("name"),
        F.when(kind == "signup", "auto").when((kind == "view") & (i % 2 == 0), "gray").when(kind == "view", "bw").alias("filter"),
        F.when(kind == "signup", 0).when(kind == "click", (i % 4 * 90).cast("int")).alias("rotate"),
    )


JUDGED = f"""{EDITS}, j AS (SELECT *, CASE WHEN number = 0 OR coalesce(max(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, number ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 404
    WHEN op = 'create' THEN 201 ELSE 200 END AS status FROM edits)"""
FOLDED = f"""{JUDGED}, s AS (SELECT user_id, number, min(ts) FILTER (status = 201) AS created, last(name ORDER BY ts, event_id) FILTER (status < 400 AND name IS NOT NULL) AS name,
    last(filter ORDER BY ts, event_id) FILTER (status < 400 AND filter IS NOT NULL) AS filter, last(rotate ORDER BY ts, event_id) FILTER (status < 400 AND rotate IS NOT NULL) AS rotate,
    count(*) FILTER (status < 400 AND op = 'update') AS version, count(*) FILTER (status < 400 AND op = 'delete') > 0 AS deleted, count(*) FILTER (status >= 400) AS rejected FROM j WHERE number > 0 GROUP BY user_id, number)"""


@query("win12_session_fold", f"WITH {FOLDED} SELECT user_id, number, created::VARCHAR[:19] AS created, name, filter, rotate, version, deleted, rejected FROM s".replace("created::VARCHAR[:19]", "strftime(created, '%Y-%m-%d %H:%M:%S')"))
def _(spark, d):
    out = ops.session_fold(edits(spark, d), ["user_id", "number"], ["ts", "event_id"])
    return out.withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


@query("win12_judge_events", f"WITH {JUDGED} SELECT event_id, status FROM j")
def _(spark, d):
    return ops.judge_events(edits(spark, d), ["user_id", "number"], ["ts", "event_id"]).select("event_id", "status")


@query("win12_describe_sessions", f"""WITH {FOLDED} SELECT user_id, number, '{{"id":"' || md5(user_id || '/' || number) || '","name":"' || name || '","filter":"' || filter || '","rotate":' || rotate || ',"version":' || version
    || ',"previewUrl":"/api/scan/' || md5(user_id || '/' || number) || '/preview?v=' || version || '","sourceUrl":"/api/scan/' || md5(user_id || '/' || number) || '/source"}}' AS answer FROM s""")
def _(spark, d):
    out = ops.session_fold(edits(spark, d), ["user_id", "number"], ["ts", "event_id"])
    out = out.withColumn("id", F.md5(F.concat_ws("/", F.col("user_id").cast("string"), F.col("number").cast("string"))))
    return ops.describe_sessions(out).select("user_id", "number", "answer")


@query("srt01_inbox_order", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS mtime FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def _(spark, d):
    listing = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("mtime"))
    return ops.inbox_order(listing, "mtime", "o_orderkey")


@query("srt09_keep_recent", """SELECT o_orderstatus AS owner, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) <= 30
    UNION ALL SELECT 'all', o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30)""")
def _(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderstatus").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"))
    everyone = ops.keep_recent(orders).withColumn("owner", F.lit("all"))
    return ops.keep_recent(orders, owner=["owner"]).unionByName(everyone).select("owner", "id")


@query("set05_expire_known", """SELECT event_id, 'User' || user_id AS name FROM events a WHERE ts >= TIMESTAMP '2024-01-29' AND EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.ts < TIMESTAMP '2024-01-03')""")
def _(spark, d):
    events = table(spark, d, "events")
    named = events.select("event_id", F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("name"), F.col("ts").alias("until"))
    known = events.filter(F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz")).select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"))
    now = F.lit("2024-01-28 23:59:59.999999").cast("timestamp_ntz")
    return ops.expire_known(named, known, now).select("event_id", "name")


SECONDS = "((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE)"


def seconds():
    return (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6


@query("str02_recent_flags_batch", f"SELECT event_id FROM events WHERE {SECONDS} <= 1296000 AND {SECONDS} + 3.5 * 3600 > 1296000")
def _(spark, d):
    seen = table(spark, d, "events").select("event_id", seconds().alias("arrived"))
    return ops.recent_flags(seen, F.lit(1296000.0), seconds=3.5 * 3600).select("event_id")


@query("str05_stalled_transfers_batch", f"""WITH p AS (SELECT event_id, user_id, {SECONDS} AS at_, CASE event_type WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done' ELSE 'sending' END AS phase,
        lead({SECONDS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
    SELECT event_id, phase, round(at_ + CASE phase WHEN 'processing' THEN 90 * 3600 ELSE 30 * 3600 END, 3) AS timed_out_at FROM p
    WHERE phase <> 'done' AND coalesce(nxt, 2592000) - at_ > CASE phase WHEN 'processing' THEN 90 * 3600 ELSE 30 * 3600 END""")
def _(spark, d):
    progress, plain = progress_rows(spark, d)
    return plain(ops.stalled_transfers(progress, ["user_id"], ["at", "event_id"], "at", "phase", F.lit(2592000.0), 30 * 3600.0, 90 * 3600.0))


def progress_rows(spark, d):
    """The events as progress of transfers, and how stalls are shown."""
    kind = F.col("event_type")
    phase = F.when(kind == "click", "processing").when(kind == "purchase", "done").otherwise("sending")
    progress = table(spark, d, "events").select("event_id", "user_id", seconds().alias("at"), phase.alias("phase"))
    return progress, lambda out: out.select("event_id", "phase", F.round("timed_out_at", 3).alias("timed_out_at"))


SQL_THROUGHPUT = """SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) FILTER (event_type IN ('view', 'click')) AS sent, count(*) FILTER (event_type = 'error') AS failed,
    coalesce(sum(event_id) FILTER (event_type IN ('view', 'click')), 0)::BIGINT AS bytes, round(coalesce(sum(event_id) FILTER (event_type IN ('view', 'click')), 0) / 3600, 6) AS speed FROM events GROUP BY 1"""


def upload_rows(events):
    kind = F.col("event_type")
    state = F.when(kind.isin("view", "click"), "sent").when(kind == "error", "failed").otherwise("queued")
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("size"), state.alias("state"))


def plain_throughput(out):
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "sent", "failed", "bytes", F.round("speed", 6).alias("speed"))


@query("str07_upload_throughput_batch", SQL_THROUGHPUT)
def _(spark, d):
    return plain_throughput(ops.upload_throughput(upload_rows(table(spark, d, "events"))))


@query("str08_purge_sessions", """WITH f AS (SELECT o_orderkey AS id, o_custkey AS owner, CASE o_orderkey % 4 WHEN 0 THEN '/tmp/Drop-' WHEN 1 THEN '/tmp/deep/Drop-' WHEN 2 THEN '/tmp/other-' ELSE '/tmp/Drop-x' END || o_orderkey AS path FROM orders)
    SELECT id, id % 4 IN (0, 3) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = owner AND c_acctbal > 0) AS purge FROM f""")
def _(spark, d):
    key = F.col("o_orderkey")
    head = F.when(key % 4 == 0, "/tmp/Drop-").when(key % 4 == 1, "/tmp/deep/Drop-").when(key % 4 == 2, "/tmp/other-").otherwise("/tmp/Drop-x")
    folders = table(spark, d, "orders").select(key.alias("id"), F.col("o_custkey").alias("owner"), F.concat(head, key.cast("string")).alias("path"))
    live = table(spark, d, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("owner"))
    return ops.purge_sessions(folders, live, "/tmp", "Drop-").select("id", "purge")


# ---- files: written from the tables to the shared folder, read back ----------------------------


@query("src01_read_photo_folder", "SELECT sum(octet_length(encode(text)) + 1)::BIGINT AS bytes FROM documents")
def _(spark, d):
    path = scratch_path(spark, "photos")
    table(spark, d, "documents").select("text").write.text(path)
    return files.read_photo_folder(spark, path, ("txt",)).agg(F.sum("length").alias("bytes"))


@query("src02_read_frames", "SELECT 'lang=' || lang || '/source=' || replace(replace(source, ':', '%3A'), '/', '%2F') AS folder, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes FROM documents GROUP BY lang, source")
def _(spark, d):
    path = scratch_path(spark, "frames")
    table(spark, d, "documents").select("lang", "source", "text").repartition("lang", "source").write.partitionBy("lang", "source").text(path)
    frames = files.read_frames(spark, path, "*.txt")
    folder = F.regexp_replace("image_path", "/[^/]*$", "")
    return frames.groupBy(folder.alias("folder")).agg(F.sum("length").alias("bytes"))


@query("src03_read_truth_csv", "SELECT vec_id || '.jpeg' AS image_path, label::VARCHAR AS bg_name, round(embedding[1]::DOUBLE, 6) AS tl_x, round(embedding[6]::DOUBLE, 6) AS br_y FROM embeddings")
def _(spark, d):
    path = scratch_path(spark, "truth")
    e = F.col("embedding")
    corners = ["tl_x", "tl_y", "tr_x", "tr_y", "br_x", "br_y", "bl_x", "bl_y"]
    rows = table(spark, d, "embeddings").select(
        F.concat(F.col("vec_id").cast("string"), F.lit(".jpeg")).alias("image_path"), F.col("label").cast("string").alias("bg_name"), F.lit("m").alias("model_name"),
        *[e[i].cast("double").alias(c) for i, c in enumerate(corners)],
    )
    # an older row for each key comes first in the file and must lose
    older = rows.withColumn("tl_x", F.lit(9.0)).withColumn("_o", F.lit(0))
    older.unionByName(rows.withColumn("_o", F.lit(1))).orderBy("_o").coalesce(1).drop("_o").write.option("header", True).option("compression", "gzip").csv(path)
    schema = ", ".join(["image_path string, bg_name string, model_name string", *[f"{c} double" for c in corners]])
    truth = files.read_truth_csv(spark, path, schema)
    return truth.select("image_path", "bg_name", F.round("tl_x", 6).alias("tl_x"), F.round("br_y", 6).alias("br_y"))


@query("src04_detections_csv", "SELECT 'bg' || label || '/' || vec_id || '.jpeg' AS image_path, vec_id % 3 = 0 AS confident, vec_id % 900 AS ms, round(0.1::DOUBLE + 0.15::DOUBLE * embedding[1]::DOUBLE, 6) AS x0, 1920 AS width FROM embeddings")
def _(spark, d):
    path = scratch_path(spark, "detections")
    corners = [F.col("corners")[k][a].alias(f"{a}{k}") for k in range(4) for a in ("x", "y")]
    name = F.concat(F.lit("bg"), F.col("family").cast("string"), F.lit("/"), F.col("photo_id").cast("string"), F.lit(".jpeg"))
    rows = quads(spark, d).select(
        name.alias("image_path"), (F.col("photo_id") % 3 == 0).alias("confident"), (F.col("photo_id") % 900).alias("ms"), *corners,
        F.lit(1920).alias("width"), F.lit(1080).alias("height"),
    )
    files.write_detections_csv(rows, path)
    return files.read_detections_csv(spark, path).select("image_path", "confident", "ms", F.round("x0", 6).alias("x0"), "width")


@query("src05_candidates", "SELECT 'p' || vec_id AS path, i AS cand_idx, round(embedding[8 * i + 1]::DOUBLE, 6) AS f0, round(0.1::DOUBLE + 0.15::DOUBLE * embedding[1]::DOUBLE, 6) AS x0 FROM embeddings, (SELECT unnest(range(8))::INT AS i)")
def _(spark, d):
    path = scratch_path(spark, "cands")
    e = F.col("embedding")
    quad = quads(spark, d).select(F.col("photo_id").alias("vec_id"), F.transform("corners", lambda p: F.array(p["x"], p["y"])).alias("c"))
    photos = table(spark, d, "embeddings").join(quad, "vec_id").select(
        F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("path"), F.lit(1000).alias("w"), F.lit(750).alias("h"), F.lit(0).alias("chosen"),
        F.array(*[F.struct(F.col("c"), F.slice(e, 8 * i + 1, 8).alias("f")) for i in range(8)]).alias("cands"),
    )
    files.write_candidates(photos, path)
    rows = files.explode_candidates(files.read_candidates(spark, path))
    return rows.select("path", "cand_idx", F.round(F.col("features")[0].cast("double"), 6).alias("f0"), F.round(F.col("corners")[0][0], 6).alias("x0"))


@query("src06_read_outlines", "SELECT 'sample=' || label AS name, label % 2 = 0 AS confident, count(*) AS n FROM embeddings GROUP BY label")
def _(spark, d):
    path = scratch_path(spark, "outlines")
    families = quads(spark, d).groupBy(F.col("family")).agg(F.count(F.lit(1)).alias("n"))
    square = F.transform(g.full_frame(), lambda p: F.array(p["x"], p["y"]))
    docs = families.select(
        F.col("family").alias("sample"), square.alias("Corners"), (F.col("family") % 2 == 0).alias("Confident"),
        F.struct(F.lit(1).alias("decode"), F.col("n").alias("detect"), F.lit(3).alias("render")).alias("ms"),
    )
    docs.repartition("sample").write.partitionBy("sample").json(path)
    out = files.read_sample_json(spark, path, "*.json", files.OUTLINE_SCHEMA)
    return out.select("name", F.col("Confident").alias("confident"), F.col("ms.detect").alias("n"))


@query("src08_rows_with_all_columns", """SELECT l_linenumber, l_orderkey, l_quantity, NULL::BIGINT AS o_custkey, NULL::BIGINT AS o_orderkey FROM lineitem UNION ALL SELECT NULL, NULL, NULL, o_custkey, o_orderkey FROM orders""")
def _(spark, d):
    return files.rows_with_all_columns(
        table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    )


@query("src09_list_inbox", "SELECT sum(octet_length(encode(text)) + 1)::BIGINT AS bytes, true AS named FROM documents")
def _(spark, d):
    path = scratch_path(spark, "inbox")
    table(spark, d, "documents").select("text").write.text(path)
    listed = files.list_inbox(spark, path).filter("name <> '_SUCCESS'")  # the writer's own mark
    return listed.agg(F.sum("length").alias("bytes"), F.bool_and(F.col("name").endswith(".txt")).alias("named"))
