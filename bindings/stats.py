"""Group statistics and ordered series bound to lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query, table
from bindings.outlines import points_of_curves, r6, rounded
from bindings.views import CURVES, LEVELS, QUADS, SAMPLES, levels, quads, samples
from sheetwise.functions import geometry as g
from sheetwise.operators import series, stats


@query("agg10_histogram256", f"""WITH {LEVELS}, g AS (SELECT DISTINCT photo_id FROM levels), n AS (SELECT photo_id, level, count(*) AS n FROM levels GROUP BY ALL)
    SELECT photo_id, l AS level, coalesce(n, 0) AS n FROM g CROSS JOIN (SELECT unnest(range(256))::INT AS l) LEFT JOIN n USING (photo_id) WHERE n.level = l
    UNION ALL SELECT photo_id, l, 0 FROM g CROSS JOIN (SELECT unnest(range(256))::INT AS l) a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.photo_id = g.photo_id AND n.level = a.l)""")
def _(spark, d):
    return stats.histogram256(levels(spark, d), ["photo_id"], "level")


RUNNING = "r AS (SELECT photo_id, level, sum(count(*)) OVER (PARTITION BY photo_id ORDER BY level) AS upto, sum(count(*)) OVER (PARTITION BY photo_id) AS total FROM levels GROUP BY photo_id, level)"


@query("agg11_hist_percentile", f"""WITH {LEVELS}, {RUNNING} SELECT photo_id, coalesce(min(level) FILTER (upto >= 0.95::DOUBLE * total), 255) AS p95,
    coalesce(min(level) FILTER (upto >= 0.005::DOUBLE * total), 255) AS p005 FROM r GROUP BY photo_id""")
def _(spark, d):
    return stats.hist_percentile(levels(spark, d), ["photo_id"], "level", {"p95": 0.95, "p005": 0.005})


@query("agg12_otsu_split", f"""WITH {LEVELS}, h AS (SELECT photo_id, level, count(*) AS n FROM levels GROUP BY ALL),
    m AS (SELECT *, sum(n) OVER w AS n1, sum(n * level) OVER w AS s1, sum(n) OVER (PARTITION BY photo_id) AS nn, sum(n * level) OVER (PARTITION BY photo_id) AS ss FROM h WINDOW w AS (PARTITION BY photo_id ORDER BY level)),
    b AS (SELECT *, power(s1::DOUBLE * nn - ss::DOUBLE * n1, 2) / (n1::DOUBLE * (nn - n1)) AS v FROM m WHERE n1 < nn)
    SELECT g.photo_id, coalesce(t.level, 0) AS threshold FROM (SELECT DISTINCT photo_id FROM levels) g LEFT JOIN
    (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY v DESC, level) = 1) t USING (photo_id)""")
def _(spark, d):
    return stats.otsu_split(levels(spark, d), ["photo_id"], "level")


@query("agg13_upper_median", f"""WITH {SAMPLES} SELECT photo_id, list_sort(list(inside))[count(*) // 2 + 1] AS inside, list_sort(list(sat))[count(*) // 2 + 1] AS sat FROM samples GROUP BY photo_id""")
def _(spark, d):
    return stats.upper_median(samples(spark, d), ["photo_id"], ["inside", "sat"])


@query("agg13_pop_spread", f"WITH {SAMPLES} SELECT photo_id, {r6('stddev_pop(inside)')} AS spread FROM samples GROUP BY photo_id")
def _(spark, d):
    return stats.pop_spread(samples(spark, d), ["photo_id"], "inside").select("photo_id", *rounded("spread"))


@query("agg14_bright_half_median", """WITH s AS (SELECT l_orderkey AS photo_id, l_quantity AS l, l_extendedprice AS a, l_tax AS b, l_linenumber, l_extendedprice AS p FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY l DESC, l_linenumber, p) AS i, count(*) OVER (PARTITION BY photo_id) AS n FROM s),
    m AS (SELECT photo_id, list_sort(list(l))[count(*) // 2 + 1] AS l, list_sort(list(a))[count(*) // 2 + 1] AS a, list_sort(list(b))[count(*) // 2 + 1] AS b FROM r WHERE i <= n // 2 AND n >= 10 GROUP BY photo_id)
    SELECT photo_id, n, l, a, b FROM (SELECT photo_id, count(*) AS n FROM s GROUP BY 1) LEFT JOIN m USING (photo_id)""")
def _(spark, d):
    s = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("photo_id"), F.col("l_quantity").alias("l"), F.col("l_extendedprice").alias("a"),
        F.col("l_tax").alias("b"), "l_linenumber", F.col("l_extendedprice").alias("p"),
    )
    return stats.bright_half_median(s, ["photo_id"], "l", ["l", "a", "b"], ["l_linenumber", "p"])


@query("agg15_polarity", f"WITH {SAMPLES} SELECT photo_id, CASE WHEN sum(inside) >= sum(outside) THEN 1 ELSE -1 END AS polarity FROM samples GROUP BY photo_id")
def _(spark, d):
    return stats.polarity(samples(spark, d), ["photo_id"])


PX = "px AS (SELECT photo_id, " + ", ".join(f"x{k}*1000 AS x{k}, y{k}*1000 AS y{k}" for k in range(4)) + " FROM quads)"


def _dist(a, b):
    return f"sqrt(power(x{a}-x{b},2)+power(y{a}-y{b},2))"


def _clamp(e, lo="0", hi="1"):
    return f"greatest({lo}, least({hi}, {e}))"


@query("agg16_perimeter_score", None)
def _(spark, d):
    s = samples(spark, d).withColumn("d", (F.col("inside") - F.col("outside")) / 10).withColumn("in_frame", F.col("sat") < 75)
    pixels = F.transform("corners", lambda p: g.point(p["x"] * 1000, p["y"] * 1000))
    quad = quads(spark, d).select("photo_id", pixels.alias("corners"))
    bands = s.groupBy("photo_id").agg(F.avg("inside").alias("mean_in"), F.avg("sat").alias("sat_in"), F.avg("outside").alias("mean_out"))
    out = stats.perimeter_score(s, quad, bands, ["photo_id"], F.lit(1000.0), F.lit(1000.0))
    return out.select("photo_id", *rounded(*[c for c in out.columns if c != "photo_id"]))


def _register_score_sql():
    from bindings import SQL
    from bindings.outlines import SHOELACE, TURNS, sql_angle

    angles = [sql_angle((i + 3) % 4, i, (i + 1) % 4) for i in range(4)]
    off = "greatest(0, " + ", ".join(f"45 - {a}, {a} - 135" for a in angles) + ")"
    s1, s2 = f"(({_dist(0, 1)}+{_dist(2, 3)})/2)", f"(({_dist(1, 2)}+{_dist(3, 0)})/2)"
    parts = ["support", "strength", "contrast", "paper", "shape", "size", "border", "brighter", "aspect"]
    SQL["agg16_perimeter_score"] = f"""WITH {SAMPLES}, {QUADS}, {PX}, s AS (SELECT *, (inside - outside) / 10 AS d, sat < 75 AS here FROM samples),
        a AS (SELECT photo_id, count(*) FILTER (here) AS samples, count(*) FILTER (NOT here) AS ob, count(*) FILTER (here AND abs(d) > 4.5) AS sup,
            coalesce(sum(least(abs(d), 30)) FILTER (here), 0) AS st, count(*) FILTER (here AND inside - outside > 6) AS bi, count(*) FILTER (here AND inside - outside < -6) AS di,
            avg(inside) AS mi, avg(sat) AS si, avg(outside) AS mo FROM s GROUP BY photo_id),
        b AS (SELECT a.* EXCLUDE (photo_id), px.photo_id, abs({SHOELACE}) / 1000000 AS share, ({' AND '.join(f'{t} >= 0' for t in TURNS)}) OR ({' AND '.join(f'{t} <= 0' for t in TURNS)}) AS convex,
            {off} AS off_, greatest({s1}, {s2}) / greatest(least({s1}, {s2}), 1) AS aspect FROM px LEFT JOIN a USING (photo_id)),
        c AS (SELECT *, sup / samples AS support, {_clamp('st / samples / 18')} AS strength, greatest(bi, di) / samples AS contrast, CASE WHEN bi >= di THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS pol,
            ob / greatest(samples + ob, 1) AS border, bi / greatest(1, bi + di) AS brighter,
            0.7::DOUBLE * {_clamp('(mi - 90) / 110')} * {_clamp('1 - (si - 40) / 120')} + 0.3::DOUBLE * {_clamp('(mi - mo + 10) / 50')} AS paper,
            {_clamp('1 - off_ / 25')} * CASE WHEN aspect > 6 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS shape,
            {_clamp('(share - 0.02::DOUBLE) / 0.25::DOUBLE')} * CASE WHEN share > 0.93 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS size FROM b),
        e AS (SELECT *, (0.30::DOUBLE*support + 0.12::DOUBLE*strength + 0.16::DOUBLE*contrast*pol + 0.17::DOUBLE*paper + 0.10::DOUBLE*shape + 0.15::DOUBLE*size) * (1 - {_clamp('(border - 0.25::DOUBLE) * 1.2::DOUBLE', '0', '0.6::DOUBLE')}) AS total,
            share >= 0.02 AND share <= 0.99 AND convex AND samples >= 20 AS ok FROM c)
        SELECT photo_id, {', '.join(f"{r6(f'CASE WHEN ok THEN {c} ELSE 0.0::DOUBLE END')} AS {c}" for c in ['total', *parts])} FROM e"""


_register_score_sql()

GRAY = SAMPLES.replace("AS sat,", "AS sat, l_quantity * 5 AS gray,")


@query("agg17_extra_is_like", f"""WITH {SAMPLES}, m AS (SELECT photo_id, {', '.join(f"count(*) FILTER (band = '{b}') AS n_{b}, avg(inside) FILTER (band = '{b}') AS g_{b}, avg(sat) FILTER (band = '{b}') AS s_{b}" for b in ('in', 'extra', 'out'))} FROM samples GROUP BY photo_id),
    a AS (SELECT photo_id, count(*) AS n_added, count(*) FILTER (abs(inside - g_out) + abs(sat - s_out) <= 18) AS n_like FROM samples JOIN m USING (photo_id) WHERE band = 'extra' GROUP BY photo_id)
    SELECT photo_id, coalesce(n_extra >= 20 AND n_in >= 20 AND s_extra <= s_in + 25 AND g_extra >= 0.6::DOUBLE * g_in AND (n_out <= 20 OR (
        NOT (abs(g_extra - g_out) + abs(s_extra - s_out) < abs(g_extra - g_in) + abs(s_extra - s_in)) AND NOT coalesce(n_added > 20 AND n_like > 0.2::DOUBLE * n_added, false))), false) AS accepted FROM m LEFT JOIN a USING (photo_id)""")
def _(spark, d):
    return stats.extra_is_like(samples(spark, d), ["photo_id"], gray="inside")


@query("agg18_margin_brighter", f"""WITH {SAMPLES}, s AS (SELECT photo_id, side, avg(outside) >= avg(inside) + 4 AS b FROM samples WHERE band <> 'in' GROUP BY ALL)
    SELECT photo_id, coalesce(bool_and(b), false) AS margin FROM (SELECT DISTINCT photo_id FROM samples) LEFT JOIN s USING (photo_id) GROUP BY photo_id""")
def _(spark, d):
    return stats.margin_brighter(samples(spark, d).withColumn("interior", F.col("band") != "in"), ["photo_id"])


@query("agg19_band_stats", f"""WITH {SAMPLES}, m AS (SELECT photo_id, count(*) FILTER (band = 'out') > 10 AS ho, CASE WHEN count(*) FILTER (band = 'in') > 10 THEN avg(inside) FILTER (band = 'in') ELSE 0 END AS ig,
        CASE WHEN count(*) FILTER (band = 'in') > 10 THEN avg(sat) FILTER (band = 'in') ELSE 0 END AS is_, avg(inside) FILTER (band = 'out') AS og0, avg(sat) FILTER (band = 'out') AS os0 FROM samples GROUP BY photo_id),
    n AS (SELECT *, CASE WHEN ho THEN og0 ELSE ig END AS og, CASE WHEN ho THEN os0 ELSE is_ END AS os FROM m)
    SELECT photo_id, {r6('any_value(ig)')} AS in_gray, {r6('any_value(is_)')} AS in_sat, {r6('any_value(og)')} AS out_gray, {r6('any_value(os)')} AS out_sat,
        {r6("CASE WHEN any_value(ho) AND count(*) FILTER (band = 'extra') > 0 THEN count(*) FILTER (band = 'extra' AND abs(inside - og) + abs(sat - os) <= 18) / count(*) FILTER (band = 'extra') ELSE 0 END")} AS interior_bg,
        {r6("CASE WHEN any_value(ho) AND count(*) FILTER (band = 'out') > 0 THEN count(*) FILTER (band = 'out' AND abs(inside - ig) + abs(sat - is_) <= 18) / count(*) FILTER (band = 'out') ELSE 0 END")} AS outband_paper
    FROM samples JOIN n USING (photo_id) GROUP BY photo_id""")
def _(spark, d):
    out = stats.band_stats(samples(spark, d), ["photo_id"], gray="inside", core="extra")
    return out.select("photo_id", *rounded("in_gray", "in_sat", "out_gray", "out_sat", "interior_bg", "outband_paper"))


@query("agg20_side_lift", f"""WITH {SAMPLES}, s AS (SELECT photo_id, side, avg(outside - inside) AS l FROM samples GROUP BY ALL)
    SELECT photo_id, {r6('max(l)')} AS side_lift_max, {r6('min(l)')} AS side_lift_min FROM s GROUP BY photo_id""")
def _(spark, d):
    return stats.side_lift(samples(spark, d), ["photo_id"]).select("photo_id", *rounded("side_lift_max", "side_lift_min"))


@query("agg23_stage_latency", f"""SELECT l_returnflag AS family, count(*) AS n, {r6('avg(l_linenumber)')} AS decode, {r6('avg(l_quantity)')} AS detect, {r6('avg(l_extendedprice)')} AS render,
    {r6('avg(l_quantity + l_extendedprice)')} AS ms, {r6('quantile_disc(l_quantity + l_extendedprice, 0.95)')} AS p95 FROM lineitem GROUP BY l_returnflag""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("decode"), F.col("l_quantity").alias("detect"), F.col("l_extendedprice").alias("render")
    )
    return stats.stage_latency(rows, ["family"]).select("family", "n", *rounded("decode", "detect", "render", "ms", "p95"))


@query("agg24_weighted_center", f"""WITH s AS (SELECT l_partkey AS page, l_orderkey % 8 AS slice, sum(abs(l_discount) * 100) AS w, sum(abs(l_discount) * 100 * l_quantity) AS m FROM lineitem GROUP BY ALL),
    c AS (SELECT page, m / w / 50 AS c FROM s WHERE w > 0)
    SELECT page, CASE WHEN count(*) >= 6 THEN round(avg(c) - 0.5::DOUBLE, 9) + 0.0 ELSE 'NaN'::DOUBLE END AS "offset", CASE WHEN count(*) >= 6 THEN round(max(c) - min(c), 9) + 0.0 ELSE 'NaN'::DOUBLE END AS spread FROM c GROUP BY page""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("page"), (F.col("l_orderkey") % 8).alias("slice"), (F.abs("l_discount") * 100).alias("w"), "l_quantity"
    )
    return stats.weighted_center(rows, ["page"], "slice", "w", "l_quantity", F.lit(50), F.lit(0.5)).select(
        "page", *[(F.round(c, 9) + 0.0).alias(c) for c in ("offset", "spread")]
    )


@query("agg25_best_match", """WITH s AS (SELECT vec_id, k, corr(embedding[i + 1]::DOUBLE, embedding[i + 8 * k + 9]::DOUBLE) AS c FROM embeddings, (SELECT unnest(range(32))::INT AS i), (SELECT unnest(range(4))::INT AS k) GROUP BY ALL)
    SELECT vec_id, k, round(c, 6) + 0.0 AS correlation FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, k) = 1""")
def _(spark, d):
    e = F.col("embedding")
    variants = F.array(*[F.lit(k) for k in range(4)])
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode_outer(variants).alias("k"))
    rows = rows.select("vec_id", "k", "embedding", F.explode_outer(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    rows = rows.select("vec_id", "k", F.get(e, F.col("i")).cast("double").alias("a"), F.get(e, F.col("i") + 8 * F.col("k") + 8).cast("double").alias("b"))
    return stats.best_match(rows, ["vec_id"], "k", "a", "b").select("vec_id", "k", *rounded("correlation"))


# ---- ordered series ---------------------------------------------------------------------------

EV = "PARTITION BY user_id ORDER BY ts, event_id"


def sql_smooth(source, value):
    return f"SELECT *, CASE WHEN lag({value}) OVER w IS NULL OR lead({value}) OVER w IS NULL THEN {value} ELSE 0.25::DOUBLE * lag({value}) OVER w + 0.5::DOUBLE * {value} + 0.25::DOUBLE * lead({value}) OVER w END AS s_{value} FROM {source} WINDOW w AS ({EV})"


@query("win04_smooth_series", f"WITH a AS ({sql_smooth('events', 'value')}), b AS ({sql_smooth('a', 's_value')}) SELECT event_id, {r6('s_s_value')} AS smooth FROM b")
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return series.smooth_series(events, ["user_id"], ["ts", "event_id"], "value", passes=2).select("event_id", *rounded("smooth"))


@query("win05_cumulative_length", f"""WITH {CURVES}, s AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS st FROM curves WINDOW w AS (PARTITION BY photo_id ORDER BY pos))
    SELECT photo_id, pos, {r6('sum(st) OVER (PARTITION BY photo_id ORDER BY pos)')} AS length FROM s""")
def _(spark, d):
    return series.cumulative_length(points_of_curves(spark, d), ["photo_id"], ["pos"]).select("photo_id", "pos", *rounded("length"))


SIDE = "PARTITION BY photo_id, side ORDER BY t, t2"


@query("win06_runs_from_edge", f"""WITH {SAMPLES}, p AS (SELECT *, inside > 100 AS hit, row_number() OVER ({SIDE}) AS pos FROM samples),
    g AS (SELECT *, pos - coalesce(max(CASE WHEN hit THEN pos END) OVER (PARTITION BY photo_id, side ORDER BY pos), 0) AS gap FROM p),
    b AS (SELECT *, min(CASE WHEN gap > 3 THEN pos END) OVER (PARTITION BY photo_id, side) AS stop FROM g)
    SELECT photo_id, side, coalesce(max(pos) FILTER (hit AND (stop IS NULL OR pos < stop)), 0) AS depth FROM b GROUP BY ALL""")
def _(spark, d):
    return series.runs_from_edge(samples(spark, d), ["photo_id", "side"], ["t", "t2"], F.col("inside") > 100)


ISLANDS = f"""f AS (SELECT *, value > 20 AS ok, row_number() OVER ({EV}) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    i AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS isl FROM f WHERE ok)"""


@query("win07_min_runs", f"""WITH {ISLANDS} SELECT user_id, min(pos) AS start, max(pos) AS stop, count(*) AS length FROM i GROUP BY user_id, isl
    HAVING count(*) >= greatest(3, floor(max(n) * 0.08::DOUBLE)) AND sqrt(greatest(0, (var_pop(pos) + var_pop(value / 100)) / 2 - sqrt(power(var_pop(pos) - var_pop(value / 100), 2) / 4 + power(covar_pop(pos, value / 100), 2)))) < 1.2""")
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "value", (F.col("value") / 100).alias("v"))
    return series.min_runs(events, ["user_id"], ["ts", "event_id"], F.col("value") > 20, value="v")


@query("win08_clusters", f"WITH {ISLANDS} SELECT user_id, {r6('avg(pos) / max(n)')} AS center, count(*) AS length FROM i GROUP BY user_id, isl HAVING count(*) >= 2")
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return series.clusters(events, ["user_id"], ["ts", "event_id"], F.col("value") > 20).select("user_id", *rounded("center"), "length")


@query("win09_coalesce_segments", f"""WITH s AS (SELECT user_id, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE AS a, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE + value * 600 AS b, event_id FROM events),
    r AS (SELECT *, max(b) OVER (PARTITION BY user_id, event_type ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    l AS (SELECT *, sum(CASE WHEN coalesce(a - reach >= 3600, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY a, b, event_id) AS line FROM r)
    SELECT user_id, event_type, round(min(a), 3) AS start, round(max(b), 3) AS "end", round(sum(b - a), 3) AS support, count(*) AS pieces FROM l GROUP BY user_id, event_type, line""")
def _(spark, d):
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", start.alias("a"), (start + F.col("value") * 600).alias("b"))
    out = series.coalesce_segments(rows, ["user_id", "event_type"], "a", "b", 3600.0, ["event_id"])
    return out.select("user_id", "event_type", *[F.round(c, 3).alias(c) for c in ("start", "end", "support")], "pieces")


@query("win11_moving_status", f"""WITH s AS (SELECT event_id, user_id, event_type <> 'error' AS online, lag(event_type <> 'error') OVER ({EV}) AS was FROM events)
    SELECT event_id, user_id, online, was FROM s WHERE was IS DISTINCT FROM online""")
def _(spark, d):
    polls = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("online"))
    return series.moving_status(polls, ["user_id"], ["ts", "event_id"], "online").drop("ts")


@query("win13_baseline_normalize", f"""WITH v AS (SELECT event_id, user_id, ts, least(255, floor(value))::INT AS lv FROM events), t AS (SELECT *, max(lv) OVER ({EV} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM v),
    p AS (SELECT *, floor(avg(top) OVER ({EV} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + 0.5)::INT AS paper FROM t),
    h AS (SELECT user_id, paper, sum(count(*)) OVER (PARTITION BY user_id ORDER BY paper) AS u, sum(count(*)) OVER (PARTITION BY user_id) AS a FROM p GROUP BY user_id, paper),
    y AS (SELECT user_id, coalesce(min(paper) FILTER (u >= 0.95::DOUBLE * a), 255) AS typ FROM h GROUP BY user_id),
    f AS (SELECT p.*, least(255, floor(lv / greatest(paper, greatest(60, typ * 0.55::DOUBLE)) * 255 + 0.5)::INT) AS flat FROM p JOIN y USING (user_id)),
    g AS (SELECT user_id, flat, sum(count(*)) OVER (PARTITION BY user_id ORDER BY flat) AS u, sum(count(*)) OVER (PARTITION BY user_id) AS a FROM f GROUP BY user_id, flat),
    k AS (SELECT user_id, least(80, coalesce(min(flat) FILTER (u >= 0.005::DOUBLE * a), 255)) AS black FROM g GROUP BY user_id)
    SELECT event_id, CASE WHEN black > 10 THEN least(255, greatest(0, floor(flat * (255.0::DOUBLE / (255 - black)) - black * (255.0::DOUBLE / (255 - black)) + 0.5)))::INT ELSE flat END AS normalized FROM f JOIN k USING (user_id)""")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.least(F.lit(255), F.floor("value").cast("int")).alias("lv"))
    return series.baseline_normalize(rows, ["user_id"], ["ts", "event_id"], "lv").select("event_id", "normalized")


@query("win14_min_cost_track")
def _(spark, d):
    # supplier x week x state: late lines are cheap cells, as a strong edge is
    lines = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("side"), F.floor(F.date_diff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")) / 7).alias("step"),
        (F.col("l_quantity").cast("int") % 24).alias("state"), (-F.col("l_discount") * 10).alias("cost"),
    )
    return series.min_cost_track(lines, ["side"], "step", "state", "cost", center=12, fill=(0, 23, 0.0))
