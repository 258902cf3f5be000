"""Scoring, reports and joins bound to lineitem, orders, events, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query, table
from bindings.outlines import OVERLAP, points_of_curves, r6, rounded, sql_corner_error
from bindings.views import CANDS, CURVES, QUADS, SAMPLES, cands, quads, samples
from sheetwise.operators import candidates as cand_ops
from sheetwise.operators import matching, scoring
from sheetwise.operators.ordered import ordered, position
from sheetwise.operators.outlines import quad_overlap
from sheetwise.plans import benchmark

RESULTS = """rows AS (SELECT l_orderkey AS image_path, l_linenumber, o_orderpriority AS family, l_quantity / 50 AS iou,
    CASE WHEN l_linenumber = 3 THEN 'NaN'::DOUBLE WHEN l_linenumber <> 2 THEN abs(l_discount) END AS missing, l_tax * 10 AS corner,
    l_returnflag = 'N' AS confident, l_extendedprice AS ms FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def results(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_path"), "l_linenumber", (F.col("l_quantity") / 50).alias("iou"),
        F.when(F.col("l_linenumber") == 3, float("nan")).when(F.col("l_linenumber") != 2, F.abs("l_discount")).alias("missing"),
        (F.col("l_tax") * 10).alias("corner"), (F.col("l_returnflag") == "N").alias("confident"), F.col("l_extendedprice").alias("ms"),
    )
    truth = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_path"), F.col("o_orderpriority").alias("family"))
    return scoring.score_join(lines, truth)


@query("joi01_score_join", "SELECT l_orderkey AS image_path, l_linenumber, l_extendedprice, o_orderpriority AS family, round(l_extendedprice / o_totalprice, 6) AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_path"), "l_linenumber", "l_extendedprice")
    truth = table(spark, d, "orders").filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("image_path"), F.col("o_orderpriority").alias("family"), "o_totalprice"
    )
    out = scoring.score_join(lines, truth)
    return out.select("image_path", "l_linenumber", "l_extendedprice", "family", F.round(F.col("l_extendedprice") / F.col("o_totalprice"), 6).alias("part"))


@query("joi02_with_results", """SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS scored FROM orders""")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    have, lack = scoring.with_results(orders, table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    return have.withColumn("scored", F.lit(True)).unionByName(lack.withColumn("scored", F.lit(False)))


KEYS = ["iou", "missing", "corner", "confident", "ms"]
SUMMED = ", ".join(
    f"avg({k}::DOUBLE) FILTER (NOT isnan({k}::DOUBLE)) AS {k}_mean, max({k}::DOUBLE) FILTER (NOT isnan({k}::DOUBLE)) AS {k}_worst" for k in KEYS
)
SQL_SUMMARY = f"s AS (SELECT CASE WHEN grouping(family) = 1 THEN 'ALL' ELSE family END AS family, grouping(family)::INT AS is_all, count(*) AS n, {SUMMED} FROM rows GROUP BY ROLLUP (family))"


@query("agg01_summary", f"WITH {RESULTS}, {SQL_SUMMARY} SELECT family, is_all, n, {', '.join(f'round({k}_{s}, 6) AS {k}_{s}' for k in KEYS for s in ('mean', 'worst'))} FROM s")
def _(spark, d):
    out = scoring.summary(results(spark, d), KEYS)
    return out.select("family", "is_all", "n", *[F.round(f"{k}_{s}", 6).alias(f"{k}_{s}") for k in KEYS for s in ("mean", "worst")])


@query("agg02_nanmean", f"WITH {RESULTS} SELECT image_path, round(avg(missing) FILTER (NOT isnan(missing)), 6) AS missing, count(*) AS n FROM rows GROUP BY image_path")
def _(spark, d):
    return results(spark, d).groupBy("image_path").agg(F.round(scoring.nanmean(F.col("missing")), 6).alias("missing"), F.count(F.lit(1)).alias("n"))


@query("agg03_mean_and_worst", f"""WITH {RESULTS}, {SQL_SUMMARY} SELECT family, CASE WHEN missing_mean IS NULL THEN '-' ELSE printf('%.2f%% (worst %.1f%%)', missing_mean * 100, missing_worst * 100) END AS missing,
    printf('%.2f%% (worst %.1f%%)', corner_mean, corner_worst) AS corner FROM s""")
def _(spark, d):
    out = scoring.summary(results(spark, d), ["missing", "corner"])
    return out.select("family", *[scoring.metric_text(k, F.col(f"{k}_mean"), F.col(f"{k}_worst")).alias(k) for k in ("missing", "corner")])


@query("agg04_share", f"WITH {RESULTS} SELECT family, printf('%.0f%%', avg(confident::INT) * 100) AS confident, printf('%.3f', avg((iou > 0.9)::INT)) AS good, round(avg((iou > 0.9)::INT), 6) AS good_share FROM rows GROUP BY family")
def _(spark, d):
    rows = results(spark, d).withColumn("good", F.col("iou") > scoring.GOOD_IOU)
    out = rows.groupBy("family").agg(scoring.share(F.col("confident")).alias("c"), scoring.share(F.col("good")).alias("g"))
    none = F.lit(None).cast("double")
    return out.select(
        "family", scoring.metric_text("confident", F.col("c"), none).alias("confident"),
        scoring.metric_text("good", F.col("g"), none).alias("good"), F.round("g", 6).alias("good_share"),
    )


@query("srt05_groups_all_last", f"WITH {RESULTS}, {SQL_SUMMARY} SELECT (row_number() OVER (ORDER BY is_all, family) - 1)::BIGINT AS place, family, n FROM s")
def _(spark, d):
    # place from the sorted output's own order: one partition, a handful of groups
    out = scoring.groups_all_last(scoring.summary(results(spark, d), ["iou"])).select("family", "n").coalesce(1)
    return out.select(F.monotonically_increasing_id().alias("place"), "family", "n")


@query("src07_summary_markdown", f"""WITH {RESULTS}, {SQL_SUMMARY} SELECT '| family | n | iou | corner | confident | ms |' AS line UNION ALL SELECT '|---|---|---|---|---|---|'
    UNION ALL SELECT printf('| %s | %d | %.3f | %.2f%% (worst %.1f%%) | %.0f%% | %.0f |', family, n, iou_mean, corner_mean, corner_worst, confident_mean * 100, ms_mean) FROM s""")
def _(spark, d):
    keys = ["iou", "corner", "confident", "ms"]
    return scoring.summary_lines(scoring.summary(results(spark, d), keys), keys).select("line")


CELLS = """t AS (SELECT DISTINCT l_suppkey AS photo, l_partkey AS cell FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 AND l_suppkey % 3 = 0),
    f AS (SELECT DISTINCT l_suppkey AS photo, l_partkey AS cell FROM lineitem WHERE l_linestatus = 'F'),
    c AS (SELECT coalesce(t.photo, f.photo) AS photo, t.cell IS NOT NULL AS t, f.cell IS NOT NULL AS f FROM t FULL JOIN f ON t.photo = f.photo AND t.cell = f.cell)"""


@query("agg05_overlap_metrics", f"""WITH {CELLS} SELECT photo, round(count(*) FILTER (t AND f) / greatest(count(*), 1), 6) + 0.0 AS iou, round(1 - count(*) FILTER (t AND f) / greatest(count(*) FILTER (t), 1), 6) + 0.0 AS missing,
    round(1 - count(*) FILTER (t AND f) / greatest(count(*) FILTER (f), 1), 6) + 0.0 AS foreign_ FROM c GROUP BY photo""")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("photo"), F.col("l_partkey").alias("cell"), "l_returnflag", "l_linestatus", "l_linenumber",
        F.when(F.col("l_suppkey") % 3 == 0, "dogear").otherwise("flat").alias("family"),
    )
    unfolded = lines.filter((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1))
    out = scoring.overlap_metrics(lines.filter(F.col("l_returnflag") == "R"), lines.filter(F.col("l_linestatus") == "F"), "photo", "cell", unfolded)
    return out.select("photo", *rounded("iou", "missing", "foreign")).withColumnRenamed("foreign", "foreign_")


def placed_cands(spark, d):
    """Candidates with their place from 0 and the rules' choice: a place for two photos in three, -1 else."""
    frame = cands(spark, d).select("photo_id", "cand_idx", "family", "pred", "label")
    placed = ordered(frame, ["photo_id"], ["cand_idx"], {"place": position()})
    chosen = F.when(F.col("photo_id") % 3 == 0, -1).otherwise(F.lit(1))
    return placed.select("photo_id", (F.col("place") - 1).alias("cand_idx"), (F.col("photo_id") % 4).alias("family"), "pred", "label", chosen.alias("chosen"))


PLACED = f"WITH {CANDS}, p AS (SELECT photo_id, row_number() OVER (PARTITION BY photo_id ORDER BY cand_idx) - 1 AS i, photo_id % 4 AS family, pred, label, CASE WHEN photo_id % 3 = 0 THEN -1 ELSE 1 END AS chosen FROM cands)"


@query("agg06_evaluate_pickers", f"""{PLACED}, k AS (SELECT photo_id, family, max(label) FILTER (i = 0) AS top, max(label) FILTER (i = greatest(chosen, 0)) AS rules, max(label) AS oracle, first(label ORDER BY pred DESC, i) AS model FROM p GROUP BY photo_id, family)
    SELECT CASE WHEN grouping(family) = 1 THEN 'ALL' ELSE family::VARCHAR END AS family, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('top', 'rules', 'model', 'oracle'))} FROM k GROUP BY ROLLUP (family)""")
def _(spark, d):
    out = scoring.evaluate_pickers(placed_cands(spark, d))
    return out.select("family", "n", *[F.round(f"{c}_mean", 6).alias(c) for c in ("top", "rules", "model", "oracle")])


@query("agg07_calibration", f"""{PLACED}, k AS (SELECT photo_id, first(label ORDER BY pred DESC, i) AS label, max(pred) AS pred FROM p GROUP BY photo_id)
    SELECT t::DOUBLE AS threshold, count(*) AS n, round(avg((label >= 0.9)::INT), 6) AS good_share, round(count(*) / (SELECT count(*) FROM k), 6) AS photo_share, NULL::DOUBLE AS mean_label
        FROM k JOIN (SELECT unnest([0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9]::DOUBLE[]) AS t) ON pred >= t GROUP BY t
    UNION ALL SELECT NULL, count(*), NULL, round(count(*) / (SELECT count(*) FROM k), 6), round(avg(label), 6) FROM k WHERE pred < 0.3""")
def _(spark, d):
    picks = cand_ops.best_rows(placed_cands(spark, d), ["photo_id"], [F.col("pred").desc(), F.col("cand_idx")])
    out = scoring.calibration(picks)
    return out.select("threshold", "n", *[F.round(c, 6).alias(c) for c in ("good_share", "photo_share", "mean_label")])


def _signature_sql(levels: int = 10, chunk: int = 4) -> str:
    """Hash chunks of four, level by level, until a listing has one tag."""
    parts = ["""l AS (SELECT o_custkey, o_orderkey || '|' || o_totalprice::DECIMAL(18,2) || '|' || epoch_us(o_orderdate) AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos FROM orders)""",
             f"t0 AS (SELECT o_custkey, pos // {chunk} AS pos, sha256(string_agg(line, chr(10) ORDER BY pos)) AS line FROM l GROUP BY o_custkey, pos // {chunk})"]
    for i in range(1, levels):
        parts.append(f"c{i} AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM t{i - 1})")
        parts.append(f"t{i} AS (SELECT o_custkey, pos // {chunk} AS pos, CASE WHEN max(n) = 1 THEN max(line) ELSE sha256(string_agg(line, chr(10) ORDER BY pos)) END AS line FROM c{i} GROUP BY o_custkey, pos // {chunk})")
    return "WITH " + ", ".join(parts) + f" SELECT o_custkey, line AS signature FROM t{levels - 1}"


@query("agg21_listing_signature", _signature_sql())
def _(spark, d):
    days = F.date_diff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("size"), days.alias("day"))
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("size").cast("string"), (F.col("day") * 86400000000).cast("string"))
    return scoring.listing_signature(orders, ["o_custkey"], [-F.col("day"), "o_orderkey"], line, chunk=4)


@query("agg22_transfer_counters", """WITH c AS (SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) AS sending, count(*) FILTER (event_type = 'purchase') AS sent, count(*) FILTER (event_type = 'error' AND value > 40) AS failed FROM events GROUP BY user_id)
    SELECT *, concat_ws(' · ', CASE WHEN sending > 0 THEN sending || ' sending' END, CASE WHEN sent > 0 THEN sent || ' sent' END, CASE WHEN failed > 0 THEN failed || ' failed' END) AS text FROM c""")
def _(spark, d):
    kind = F.col("event_type")
    state = F.when(kind == "view", "queued").when(kind == "click", "sending").when(kind == "purchase", "sent").when((kind == "error") & (F.col("value") > 40), "failed")
    return scoring.transfer_counters(table(spark, d, "events").select("user_id", state.alias("state")), ["user_id"])


@query("agg26_cer", r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~\s]', '?', 'g') AS text FROM conversations),
    f AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM t)
    SELECT a.conv_id, a.turn, round(CASE WHEN length(a.text) = 0 THEN 'NaN'::DOUBLE ELSE least(levenshtein(a.text, b.text) / length(a.text), 1) END, 6) AS cer FROM f a JOIN f b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def _(spark, d):
    # ASCII on both sides: the two engines count other characters differently
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[^ -~\s]", "?").alias("text"))
    nexts = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("read"))
    both = turns.join(nexts, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(scoring.character_error_rate(F.col("text"), F.col("read")), 6).alias("cer"))


@query("agg27_truth_overlap_labels", f"WITH {QUADS}, {OVERLAP} SELECT photo_id, {r6('shared / (aa + ab - shared)')} AS label FROM ov")
def _(spark, d):
    both = quads(spark, d)
    labelled = quad_overlap(both.select("photo_id", "corners").join(both.select("photo_id", "truth"), "photo_id"))
    return labelled.select("photo_id", (F.round("iou", 6) + 0.0).alias("label"))


BENCH = f"""WITH {QUADS}, {OVERLAP}, r AS (SELECT family::VARCHAR AS family, shared / (aa + ab - shared) AS iou, {sql_corner_error()} AS corner, photo_id % 3 > 0 AS confident, photo_id % 700 AS ms FROM ov)
    SELECT CASE WHEN grouping(family) = 1 THEN 'ALL' ELSE family END AS family, grouping(family)::INT AS is_all, count(*) AS n, round(avg(iou), 6) AS iou_mean, round(avg((iou > 0.9)::INT), 6) AS good_mean,
    round(avg(corner), 6) AS corner_mean, round(max(corner), 6) AS corner_worst, round(avg(confident::INT), 6) AS confident_mean, round(avg(ms), 6) AS ms_mean FROM r GROUP BY ROLLUP (family)"""


@query("plan_benchmark_report", BENCH)
def _(spark, d):
    both = quads(spark, d)
    found = both.select(
        F.col("photo_id").alias("image_path"), "corners", (F.col("photo_id") % 3 > 0).alias("confident"), (F.col("photo_id") % 700).alias("ms")
    )
    truth = both.select(F.col("photo_id").alias("image_path"), F.col("truth"), F.col("family").cast("string").alias("family"))
    out = benchmark.benchmark_report(found, truth)
    return out.select("family", "is_all", "n", *[F.round(c, 6).alias(c) for c in ("iou_mean", "good_mean", "corner_mean", "corner_worst", "confident_mean", "ms_mean")])


# ---- joins ------------------------------------------------------------------------------------

BLOBS = """blobs AS MATERIALIZED (SELECT row_number() OVER () AS n, l_orderkey AS photo_id, l_linenumber * 100000000 + round(l_extendedprice * 100)::BIGINT AS blob_idx, l_quantity AS x, l_tax * 1000 AS y, l_linenumber::DOUBLE AS radius, abs(l_discount) * 10 AS circularity FROM lineitem)"""


@query("joi06_partnered", f"""WITH {BLOBS} SELECT photo_id, blob_idx FROM blobs h WHERE circularity >= 0.85 OR EXISTS (SELECT 1 FROM blobs o WHERE o.photo_id = h.photo_id AND o.n <> h.n
    AND o.radius < h.radius * 1.25 AND o.radius > h.radius * 0.75 AND ((o.x < h.x + 0.03::DOUBLE * 100 AND o.x > h.x - 0.03::DOUBLE * 100) OR (o.y < h.y + 0.03::DOUBLE * 100 AND o.y > h.y - 0.03::DOUBLE * 100)))""")
def _(spark, d):
    blobs = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("photo_id"),
        (F.col("l_linenumber") * F.lit(100000000).cast("long") + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("blob_idx"),
        F.col("l_quantity").alias("x"), (F.col("l_tax") * 1000).alias("y"), F.col("l_linenumber").cast("double").alias("radius"),
        (F.abs("l_discount") * 10).alias("circularity"),
    )
    return matching.partnered(blobs, 100.0).select("photo_id", "blob_idx")


LINES = """lines AS (SELECT l_orderkey AS photo_id, l_linenumber * 100000000 + round(l_extendedprice * 100)::BIGINT AS line_idx, l_quantity * 20 AS ax, l_tax * 10000 AS ay,
    l_quantity * 20 + 100 * cos(l_extendedprice / 1000) AS bx, l_tax * 10000 + 100 * sin(l_extendedprice / 1000) AS by_, l_quantity, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice * (0.4::DOUBLE + least(1, l_quantity / 25)) DESC, line_idx) <= 26)"""


def _fold(e):
    return f"(CASE WHEN {e} > pi()/2 THEN {e} - pi() WHEN {e} < -pi()/2 THEN {e} + pi() ELSE {e} END)"


def _fold2(e):
    return _fold(_fold(e))


@query("joi07_quads_from_lines", f"""WITH {LINES}, l AS (SELECT photo_id, line_idx AS i, ax AS x, ay AS y, cos(atan2(by_ - ay, bx - ax)) AS dx, sin(atan2(by_ - ay, bx - ax)) AS dy, atan2(by_ - ay, bx - ax) AS an FROM lines),
    c AS (SELECT a.photo_id, a.i AS a, b.i AS b, c.i AS c, d.i AS d, unnest([1, 2, 3]) AS pairing, [a.an, b.an, c.an, d.an] AS an, [a.x, b.x, c.x, d.x] AS xs, [a.y, b.y, c.y, d.y] AS ys, [a.dx, b.dx, c.dx, d.dx] AS dxs, [a.dy, b.dy, c.dy, d.dy] AS dys
        FROM l a JOIN l b ON a.photo_id = b.photo_id AND a.i < b.i JOIN l c ON a.photo_id = c.photo_id AND b.i < c.i JOIN l d ON a.photo_id = d.photo_id AND c.i < d.i),
    p AS (SELECT *, [1, [2, 3, 4][pairing], [3, 2, 2][pairing], [4, 4, 3][pairing]] AS o FROM c),
    s AS (SELECT *, abs({_fold2('(an[o[1]] - an[o[2]])')}) AS d1, abs({_fold2('(an[o[3]] - an[o[4]])')}) AS d2, abs({_fold2('(an[o[1]] - an[o[3]])')}) AS cr FROM p),
    b AS (SELECT * FROM s WHERE d1 <= 0.6 AND d2 <= 0.6 AND cr >= 0.5 QUALIFY row_number() OVER (PARTITION BY photo_id, a, b, c, d ORDER BY d1 + d2, pairing) = 1),
    k AS (SELECT photo_id, a, b, c, d, [o[1], o[3], o[2], o[4], o[1]] AS r, xs, ys, dxs, dys FROM b),
    q AS (SELECT photo_id, a, b, c, d, {', '.join(f"dxs[r[{k}]] * dys[r[{k + 1}]] - dys[r[{k}]] * dxs[r[{k + 1}]] AS den{k - 1}, ((xs[r[{k + 1}]] - xs[r[{k}]]) * dys[r[{k + 1}]] - (ys[r[{k + 1}]] - ys[r[{k}]]) * dxs[r[{k + 1}]]) / (dxs[r[{k}]] * dys[r[{k + 1}]] - dys[r[{k}]] * dxs[r[{k + 1}]]) AS t{k - 1}, xs[r[{k}]] AS px{k - 1}, ys[r[{k}]] AS py{k - 1}, dxs[r[{k}]] AS pdx{k - 1}, dys[r[{k}]] AS pdy{k - 1}" for k in (1, 2, 3, 4))} FROM k),
    z AS (SELECT photo_id, a, b, c, d, {', '.join(f'den{k}, px{k} + pdx{k} * t{k} AS x{k}, py{k} + pdy{k} * t{k} AS y{k}' for k in range(4))} FROM q)
    SELECT photo_id, a, b, c, d, round(x0, 3) + 0.0 AS x0, round(y2, 3) + 0.0 AS y2 FROM z WHERE {' AND '.join(f'abs(den{k}) >= 1e-6 AND x{k} >= -0.08::DOUBLE * 1000 AND y{k} >= -0.08::DOUBLE * 800 AND x{k} <= 1.08::DOUBLE * 1000 AND y{k} <= 1.08::DOUBLE * 800' for k in range(4))}
    AND (({' AND '.join(f'((x{(i + 1) % 4}-x{i})*(y{(i + 2) % 4}-y{(i + 1) % 4})-(y{(i + 1) % 4}-y{i})*(x{(i + 2) % 4}-x{(i + 1) % 4})) >= 0' for i in range(4))}) OR ({' AND '.join(f'((x{(i + 1) % 4}-x{i})*(y{(i + 2) % 4}-y{(i + 1) % 4})-(y{(i + 1) % 4}-y{i})*(x{(i + 2) % 4}-x{(i + 1) % 4})) <= 0' for i in range(4))}))
    AND abs((x0*y1-x1*y0 + x1*y2-x2*y1 + x2*y3-x3*y2 + x3*y0-x0*y3) / 2) / (1000.0::DOUBLE * 800) BETWEEN 0.025 AND 0.985""")
def _(spark, d):
    turn = F.col("l_extendedprice") / 1000
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("photo_id"),
        (F.col("l_linenumber") * F.lit(100000000).cast("long") + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("line_idx"),
        (F.col("l_quantity") * 20).alias("ax"), (F.col("l_tax") * 10000).alias("ay"),
        (F.col("l_quantity") * 20 + 100 * F.cos(turn)).alias("bx"), (F.col("l_tax") * 10000 + 100 * F.sin(turn)).alias("by"),
        F.col("l_extendedprice").alias("support"), F.col("l_extendedprice").alias("length"), F.col("l_quantity").alias("step"),
    )
    pool = cand_ops.line_pool(lines, F.lit(100.0))
    out = matching.quads_from_lines(pool, F.lit(1000.0), F.lit(800.0))
    return out.select("photo_id", "a", "b", "c", "d", (F.round(F.col("corners")[0]["x"], 3) + 0.0).alias("x0"), (F.round(F.col("corners")[2]["y"], 3) + 0.0).alias("y2"))


@query("joi08_apply_inbox_events", """WITH RECURSIVE ev AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'rename' END AS kind, 'f' || user_id AS name, 'f' || ((user_id + event_id) % 400) AS new_name
        FROM events WHERE event_type IN ('error', 'purchase')),
    hop AS (SELECT c_custkey AS session, 'f' || (c_custkey % 400) AS name, -1::BIGINT AS at_, 'start' AS kind FROM customer
        UNION ALL SELECT h.session, CASE WHEN e.kind = 'rename' THEN e.new_name ELSE h.name END, e.seq, e.kind FROM hop h JOIN ev e ON e.name = h.name AND e.seq > h.at_ AND h.kind <> 'remove'
            AND e.seq = (SELECT min(x.seq) FROM ev x WHERE x.name = h.name AND x.seq > h.at_))
    SELECT session, name FROM hop QUALIFY row_number() OVER (PARTITION BY session ORDER BY at_ DESC) = 1 AND kind <> 'remove'""")
def _(spark, d):
    user = F.col("user_id")
    events = table(spark, d, "events").filter(F.col("event_type").isin("error", "purchase")).select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "remove").otherwise("rename").alias("kind"),
        F.concat(F.lit("f"), user.cast("string")).alias("name"), F.concat(F.lit("f"), ((user + F.col("event_id")) % 400).cast("string")).alias("new_name"),
    )
    sessions = table(spark, d, "customer").select(
        F.col("c_custkey").alias("session"), F.concat(F.lit("f"), (F.col("c_custkey") % 400).cast("string")).alias("name")
    )
    return matching.apply_inbox_events(sessions, events)


@query("joi09_arrivals", """WITH n AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'User' ELSE 'user' END || user_id AS name, ts::DATE AS day FROM events)
    SELECT day::VARCHAR AS day, name FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.day = a.day - 1 AND lower(b.name) = lower(a.name))""")
def _(spark, d):
    # every day against the day before: the day travels in the name
    day = F.to_date("ts")
    spelled = F.concat(F.when(F.col("user_id") % 2 == 0, "User").otherwise("user"), F.col("user_id").cast("string"))
    seen = table(spark, d, "events").select(day.alias("day"), spelled.alias("n")).distinct()
    now = seen.select("day", F.col("n"), F.concat(F.col("day").cast("string"), F.lit("/"), F.col("n")).alias("name"))
    known = seen.select(F.concat(F.date_add("day", 1).cast("string"), F.lit("/"), F.upper("n")).alias("name"))
    return matching.arrivals(now, known).select(F.col("day").cast("string").alias("day"), F.col("n").alias("name"))


SQL_NAMES = """WITH b AS (SELECT p_partkey, p_name || '.txt' AS name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS r FROM part),
    t AS (SELECT DISTINCT p_name || '.txt' AS name, (p_size * 3) AS slot FROM part WHERE p_size % 5 = 0),
    u AS (SELECT name, slot, slot - row_number() OVER (PARTITION BY name ORDER BY slot) + 1 AS free FROM t),
    n AS (SELECT p_partkey, b.name, r + (SELECT count(*) FROM u WHERE u.name = b.name AND u.free <= r) AS i FROM b)
    SELECT p_partkey, CASE WHEN i = 0 THEN name WHEN i < 10000 THEN replace(name, '.txt', '') || ' (' || i || ').txt'
        ELSE replace(name, '.txt', '') || '-' || md5(name || '/' || p_partkey) || '.txt' END AS final_name FROM n"""


def part_names(spark, d):
    part = table(spark, d, "part")
    batch = part.select("p_partkey", F.concat("p_name", F.lit(".txt")).alias("name"))
    slot = (F.col("p_size") * 3).cast("string")
    taken = part.filter(F.col("p_size") % 5 == 0).select(
        F.concat("p_name", F.when(slot == "0", "").otherwise(F.concat(F.lit(" ("), slot, F.lit(")"))), F.lit(".txt")).alias("name")
    )
    return batch, taken


@query("joi10_resolve_collisions", SQL_NAMES)
def _(spark, d):
    batch, taken = part_names(spark, d)
    return matching.assign_unique_names(batch, taken, "p_partkey").select("p_partkey", "final_name")


@query("nam03_assign_unique_names", """SELECT p_partkey, CASE WHEN r = 0 THEN p_name WHEN r < 10000 THEN p_name || ' (' || r || ')' ELSE p_name || '-' || md5(p_name || '/' || p_partkey) END AS final_name FROM
    (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS r FROM part)""")
def _(spark, d):
    batch = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    return matching.assign_unique_names(batch, batch.select("name").limit(0), "p_partkey").select("p_partkey", "final_name")


@query("nam06_rename_plan", """WITH r AS (SELECT c_custkey, c_name || '.jpg' AS old, CASE c_custkey % 5 WHEN 0 THEN ' . ' WHEN 1 THEN c_name WHEN 2 THEN upper(c_name) WHEN 3 THEN 'scan' ELSE c_mktsegment || '.png' END AS typed FROM customer),
    p AS (SELECT *, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 4 THEN typed ELSE typed || '.jpg' END AS name FROM r),
    m AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c_custkey) - (CASE WHEN name = 'scan.jpg' THEN 0 ELSE 1 END) AS i FROM p WHERE c_custkey % 5 IN (3, 4))
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'keep' ELSE 'recase' END AS action, CASE c_custkey % 5 WHEN 0 THEN NULL ELSE name END AS final_name FROM p WHERE c_custkey % 5 < 3
    UNION ALL SELECT c_custkey, 'move', CASE WHEN i = 0 THEN name WHEN i < 10000 THEN replace(replace(name, '.jpg', ''), '.png', '') || ' (' || i || ')' || right(name, 4)
        ELSE replace(replace(name, '.jpg', ''), '.png', '') || '-' || md5(name || '/' || c_custkey) || right(name, 4) END FROM m""")
def _(spark, d):
    c = F.col
    turn = c("c_custkey") % 5
    typed = F.when(turn == 0, " . ").when(turn == 1, c("c_name")).when(turn == 2, F.upper("c_name")).when(turn == 3, "scan").otherwise(F.concat("c_mktsegment", F.lit(".png")))
    customers = table(spark, d, "customer")
    renames = customers.select("c_custkey", F.concat("c_name", F.lit(".jpg")).alias("old"), typed.alias("typed"))
    existing = customers.select(F.concat("c_name", F.lit(".jpg")).alias("name")).unionByName(customers.select(F.lit("scan.jpg").alias("name")))
    return matching.rename_plan(renames, existing, order="c_custkey").select("c_custkey", "action", "final_name")


@query("joi11_nearest_sample", """SELECT l_orderkey, l_linenumber, l_extendedprice, n_name FROM lineitem JOIN nation ON n_nationkey = round_even(l_linenumber / 8.0::DOUBLE * 24, 0)""")
def _(spark, d):
    cols = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    edge = table(spark, d, "nation").select(F.col("n_nationkey").alias("bucket"), "n_name")
    return matching.nearest_sample(cols, edge, F.col("l_linenumber"), F.lit(9), [], "bucket", last=24).drop("bucket")


@query("joi12_nearest_by_distance", f"""WITH {QUADS}, {CURVES}, m AS (SELECT photo_id, pos, k AS corner, sqrt(power(c.x - [x0,x1,x2,x3][k+1], 2) + power(c.y - [y0,y1,y2,y3][k+1], 2)) AS dist FROM curves c JOIN quads USING (photo_id), (SELECT unnest(range(4))::INT AS k))
    SELECT photo_id, corner, pos, {r6('dist')} AS distance FROM m QUALIFY row_number() OVER (PARTITION BY photo_id, corner ORDER BY dist, pos) = 1""")
def _(spark, d):
    out = matching.nearest_points(points_of_curves(spark, d), quads(spark, d))
    return out.select("photo_id", "corner", "pos", *rounded("distance"))


def _sql_rotation():
    return "least(" + ", ".join(
        "(" + " + ".join(f"sqrt(power(x{(i + r) % 4}-tx{i},2)+power(y{(i + r) % 4}-ty{i},2))" for i in range(4)) + ") / 4" for r in range(4)
    ) + ")"


@query("joi12_nearest_to_truth", f"WITH {QUADS} SELECT photo_id, 0 AS cand_idx, {r6(_sql_rotation())} AS distance FROM quads")
def _(spark, d):
    both = quads(spark, d)
    # three candidates per photo: the found quad, and two shifted copies that are further off
    shifted = [both.select("photo_id", F.lit(i).alias("cand_idx"), F.transform("corners", lambda p: F.struct((p["x"] + i * 3.0).alias("x"), p["y"].alias("y"))).alias("corners")) for i in range(3)]
    pool = shifted[0].unionByName(shifted[1]).unionByName(shifted[2])
    out = matching.nearest_to_truth(pool, both.select("photo_id", F.col("truth").alias("corners")))
    return out.select("photo_id", "cand_idx", *rounded("distance"))


@query("joi14_scenario_grid", "SELECT p_partkey, p_name || '-' || seed AS key, seed FROM part, (SELECT unnest(range(5))::INT AS seed)")
def _(spark, d):
    return matching.scenario_grid(table(spark, d, "part").select("p_partkey", "p_name"), 5, "p_name").drop("p_name")


REFS = "refs AS (SELECT photo_id, side, avg(outside) AS ol, avg(sat) AS oa, min(sat) AS ob, avg(inside) AS pl, 10.0::DOUBLE AS pa, 5.0::DOUBLE AS pb FROM samples GROUP BY ALL)"


def _cd(a, b):
    return f"sqrt(power(({a[0]}-{b[0]})*0.5,2)+power({a[1]}-{b[1]},2)+power({a[2]}-{b[2]},2))"


@query("joi15_nearer_to", f"""WITH {SAMPLES}, {REFS} SELECT photo_id, side, t, t2, {_cd(('inside', 'sat', 'outside'), ('ol', 'oa', 'ob'))} < {_cd(('inside', 'sat', 'outside'), ('pl', 'pa', 'pb'))} AND {_cd(('inside', 'sat', 'outside'), ('ol', 'oa', 'ob'))} < 42 AS hit
    FROM samples JOIN refs USING (photo_id, side) WHERE {_cd(('ol', 'oa', 'ob'), ('pl', 'pa', 'pb'))} >= 28""")
def _(spark, d):
    s = samples(spark, d)
    refs = s.groupBy("photo_id", "side").agg(
        F.avg("outside").alias("out_l"), F.avg("sat").alias("out_a"), F.min("sat").alias("out_b"), F.avg("inside").alias("page_l"),
        F.lit(10.0).alias("page_a"), F.lit(5.0).alias("page_b"),
    )
    rows = s.select("photo_id", "side", "t", "t2", F.col("inside").alias("l"), F.col("sat").alias("a"), F.col("outside").alias("b"))
    return matching.nearer_to(rows, refs, ["photo_id", "side"]).select("photo_id", "side", "t", "t2", "hit")
