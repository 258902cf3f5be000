"""Candidate ranking bound to the lines of each order (see ``views.cands``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query, table
from bindings.views import CANDS, cands, interval_overlap
from sheetwise.operators import candidates as ops

ORDER = "score DESC, cand_idx"


@query("win01_rank_candidates", f"""WITH {CANDS} SELECT photo_id, cand_idx, row_number() OVER w - 1 AS rank,
    count(*) OVER (PARTITION BY photo_id) AS n, round((row_number() OVER w - 1) / count(*) OVER (PARTITION BY photo_id), 6) AS rank_fraction
    FROM cands WINDOW w AS (PARTITION BY photo_id ORDER BY {ORDER})""")
def _(spark, d):
    ranked = ops.rank_candidates(cands(spark, d).select("photo_id", "cand_idx", "score"))
    return ranked.select("photo_id", "cand_idx", "rank", "n", F.round("rank_fraction", 6).alias("rank_fraction"))


@query("win02_relative_features", f"""WITH {CANDS} SELECT photo_id, cand_idx,
    round(score - first(score) OVER w, 6) + 0.0 AS score_rel, round(ln(greatest(area, 1) / greatest(first(area) OVER w, 1)), 6) + 0.0 AS area_rel,
    round(area / 50, 6) AS area_share FROM cands WINDOW w AS (PARTITION BY photo_id ORDER BY {ORDER})""")
def _(spark, d):
    out = ops.relative_features(cands(spark, d).select("photo_id", "cand_idx", "score", "area"), F.lit(50.0))
    return out.select("photo_id", "cand_idx", *[(F.round(c, 6) + 0.0).alias(c) for c in ("score_rel", "area_rel", "area_share")])


@query("joi03_attach_labels", """SELECT vec_id AS photo_id, i AS cand_idx, embedding[i + 1] AS cand, embedding[i + 33] AS label
    FROM embeddings, (SELECT unnest(range(32))::INT AS i)""")
def _(spark, d):
    photos = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("photo_id"), F.slice("embedding", 1, 32).alias("cands"), F.slice("embedding", 33, 32).alias("labels")
    )
    return ops.attach_labels(photos, "cands", "labels")


@query("joi04_close_rivals", f"""WITH {CANDS} SELECT a.photo_id, a.cand_idx, count(*) FILTER (b.cand_idx <> a.cand_idx AND b.score >= a.score - 0.1::DOUBLE AND b.area > 1.1::DOUBLE * a.area) AS n_larger_close,
    count(*) FILTER (b.cand_idx <> a.cand_idx AND b.score >= a.score - 0.1::DOUBLE AND b.area < a.area / 1.1::DOUBLE) AS n_smaller_close
    FROM cands a JOIN cands b USING (photo_id) GROUP BY ALL""")
def _(spark, d):
    return ops.close_rivals(cands(spark, d).select("photo_id", "cand_idx", "score", "area"))


@query("joi05_relate_to_top", f"""WITH {CANDS}, t AS (SELECT *, first(area) OVER w AS ta, first(lo) OVER w AS tlo, first(hi) OVER w AS thi, first(cand_idx) OVER w AS ti
    FROM cands WINDOW w AS (PARTITION BY photo_id ORDER BY {ORDER})), o AS (SELECT *, greatest(0, least(hi, thi) - greatest(lo, tlo)) * 10 AS shared FROM t)
    SELECT photo_id, cand_idx, round(shared / greatest(ta, 1), 6) AS contains_top, round(shared / greatest(area, 1), 6) AS inside_top,
    cand_idx <> ti AND area > 1.05::DOUBLE * ta AS grows FROM o""")
def _(spark, d):
    out = ops.relate_to_top(cands(spark, d).select("photo_id", "cand_idx", "score", "area", "lo", "hi"), interval_overlap, ["lo", "hi"])
    return out.select("photo_id", "cand_idx", F.round("contains_top", 6).alias("contains_top"), F.round("inside_top", 6).alias("inside_top"), "grows")


SQL_GROW = f"""WITH RECURSIVE {CANDS}, top AS (SELECT photo_id, cand_idx, score, area, source, lo, hi, score AS top_score FROM cands
        QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY {ORDER}) = 1)"""


def _sql_round(prev: str, name: str) -> str:
    return f""", {name} AS (SELECT p.photo_id, coalesce(g.cand_idx, p.cand_idx) AS cand_idx, CASE WHEN g.score IS NULL THEN p.score ELSE greatest(g.score, p.score) END AS score,
        coalesce(g.area, p.area) AS area, coalesce(g.source || '+grown', p.source) AS source, coalesce(g.lo, p.lo) AS lo, coalesce(g.hi, p.hi) AS hi, p.top_score
        FROM {prev} p LEFT JOIN (SELECT c.* FROM cands c JOIN {prev} q USING (photo_id)
            WHERE c.score >= q.top_score - 0.1::DOUBLE AND c.area >= 1.12::DOUBLE * q.area
              AND greatest(0, least(c.hi, q.hi) - greatest(c.lo, q.lo)) * 10 >= 0.92::DOUBLE * q.area AND c.family >= 'F'
            QUALIFY row_number() OVER (PARTITION BY c.photo_id ORDER BY c.area DESC, c.score DESC, c.cand_idx) = 1) g ON g.photo_id = p.photo_id)"""


GROWN = SQL_GROW.replace("WITH RECURSIVE", "WITH") + _sql_round("top", "g1") + _sql_round("g1", "g2") + _sql_round("g2", "g3")


@query("joi13_grow_to_whole", f"{GROWN} SELECT photo_id, cand_idx, round(score, 6) AS score, area, source FROM g3")
def _(spark, d):
    frame = cands(spark, d).select("photo_id", "cand_idx", "score", "area", "source", "family", "lo", "hi")
    out = ops.grow_to_whole(frame, interval_overlap, lambda b, c: c["family"] >= "F", ["lo", "hi", "family"])
    return out.select("photo_id", "cand_idx", F.round("score", 6).alias("score"), "area", "source")


@query("srt02_top_regions", f"""WITH {CANDS} SELECT photo_id, source, cand_idx, area FROM (SELECT *, row_number() OVER (PARTITION BY photo_id, source ORDER BY area DESC, cand_idx) AS r FROM cands)
    WHERE r <= 3 AND area >= 0.025::DOUBLE * 400""")
def _(spark, d):
    return ops.top_regions(cands(spark, d).select("photo_id", "source", "cand_idx", "area"), F.lit(400.0))


@query("srt03_shortlist", f"""WITH {CANDS} SELECT photo_id, cand_idx, source FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY score - 0.2::DOUBLE DESC, cand_idx) AS r
    FROM cands WHERE score - 0.2::DOUBLE > 0) WHERE r <= 2 OR source <> 'lines'""")
def _(spark, d):
    quick = cands(spark, d).select("photo_id", "cand_idx", "source", (F.col("score") - 0.2).alias("quick"))
    return ops.shortlist(quick, k=2).select("photo_id", "cand_idx", "source")


@query("srt04_extend_top", f"""WITH {CANDS} SELECT photo_id, cand_idx, source || '+extended' AS source, side FROM (SELECT * FROM cands
    QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY {ORDER}) <= 6), (SELECT unnest(range(4))::INT AS side)""")
def _(spark, d):
    return ops.extend_top(cands(spark, d).select("photo_id", "cand_idx", "source", "score")).drop("score")


@query("srt06_line_pool", """SELECT l_suppkey AS photo_id, line_idx, round(line_rank, 6) AS line_rank FROM (
    SELECT l_suppkey, l_orderkey * 1000000000 + l_linenumber * 100000000 + round(l_extendedprice * 100)::BIGINT AS line_idx,
        l_extendedprice * (0.4::DOUBLE + least(1, l_quantity / 25)) AS line_rank, l_quantity, l_extendedprice FROM lineitem)
    WHERE l_quantity > 0.035::DOUBLE * 100 AND l_extendedprice > 0.035::DOUBLE * 100
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY line_rank DESC, line_idx) <= 26""")
def _(spark, d):
    million = F.lit(1000000000).cast("long")
    lines = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("photo_id"),
        (F.col("l_orderkey") * million + F.col("l_linenumber") * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("line_idx"),
        F.col("l_quantity").alias("length"), F.col("l_extendedprice").alias("support"), F.col("l_quantity").alias("step"),
    )
    return ops.line_pool(lines, F.lit(100.0)).select("photo_id", "line_idx", F.round("line_rank", 6).alias("line_rank"))


PICK = f"picks AS (SELECT photo_id, cand_idx, pred AS score, source || '+ranked' AS source FROM cands QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY pred DESC, {ORDER}) = 1)"


@query("srt07_argmax_pick", f"WITH {CANDS}, {PICK} SELECT * FROM picks")
def _(spark, d):
    frame = cands(spark, d).select("photo_id", "cand_idx", "score", "source", "pred")
    return ops.argmax_pick(frame).drop("pred")


@query("srt08_gate", f"""WITH {CANDS}, {PICK}, best AS (SELECT photo_id, cand_idx, score, source FROM cands QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY {ORDER}) = 1)
    SELECT photo_id, source, score >= 0.3::DOUBLE AS accepted, score >= 0.6::DOUBLE AS confident FROM picks
    UNION ALL SELECT photo_id, source, score >= 0.35::DOUBLE, score >= 0.55::DOUBLE FROM best""")
def _(spark, d):
    frame = cands(spark, d).select("photo_id", "cand_idx", "score", "source", "pred")
    ranked = ops.argmax_pick(frame).drop("pred")
    ruled = ops.best_rows(frame.drop("pred"), ["photo_id"], [F.col("score").desc(), F.col("cand_idx")])
    return ops.gate(ranked.unionByName(ruled)).select("photo_id", "source", "accepted", "confident")


@query("set01_union_hypotheses", """SELECT l_orderkey AS photo_id, l_quantity AS area, CASE l_returnflag WHEN 'N' THEN 'lines' WHEN 'R' THEN 'edges' ELSE 'bright' END AS source FROM lineitem""")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    part = {"lines": "N", "edges": "R", "bright": "A"}
    return ops.union_hypotheses({
        name: lines.filter(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("photo_id"), F.col("l_quantity").alias("area"))
        for name, flag in part.items()
    })


@query("set02_concat_sorted", f"""WITH {CANDS}, pool AS (SELECT photo_id, cand_idx, score, source FROM cands
    UNION ALL SELECT photo_id, -cand_idx, score * 0.9::DOUBLE, source || '+extended' FROM cands WHERE source = 'edges')
    SELECT photo_id, cand_idx, source, row_number() OVER (PARTITION BY photo_id ORDER BY {ORDER}, source) - 1 AS rank FROM pool""")
def _(spark, d):
    scored = cands(spark, d).select("photo_id", "cand_idx", "score", "source")
    extended = scored.filter(F.col("source") == "edges").select(
        "photo_id", (-F.col("cand_idx")).alias("cand_idx"), (F.col("score") * 0.9).alias("score"), F.concat("source", F.lit("+extended")).alias("source")
    )
    return ops.concat_sorted(scored, extended).select("photo_id", "cand_idx", "source", "rank")


PEAKS = """peaks AS (SELECT l_suppkey AS photo_id, l_linenumber % 4 AS side, 8 + 2 * (l_quantity::INT % 12) AS "offset",
    abs(l_discount) * 100 AS drop_, l_tax FROM lineitem),
    per AS (SELECT photo_id, side, "offset", count(*) AS n, count(*) FILTER (drop_ > 2.5) AS s, coalesce(sum(least(drop_, 20)) FILTER (drop_ > 2.5), 0) AS st FROM peaks GROUP BY ALL),
    reach AS (SELECT *, max(CASE WHEN n < 4 THEN 1 ELSE 0 END) OVER (PARTITION BY photo_id, side ORDER BY "offset") AS ended, s / n AS sup, round(s / n * st / n, 9) AS sc FROM per),
    got AS (SELECT photo_id, side, coalesce(arg_max("offset", sc * 1000000 - "offset") FILTER (ended = 0 AND sup >= 0.7 AND sc > 0), 0) AS strongest,
        coalesce(max("offset") FILTER (ended = 0 AND sup >= 0.7), 0) AS outermost FROM reach GROUP BY ALL)"""


def peak_samples(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("photo_id"), (F.col("l_linenumber") % 4).alias("side"),
        (8 + 2 * (F.col("l_quantity").cast("int") % 12)).alias("offset"), (F.abs("l_discount") * 100).alias("drop"),
    )


@query("win10_edge_peaks", f"WITH {PEAKS} SELECT * FROM got")
def _(spark, d):
    return ops.edge_peaks(peak_samples(spark, d), ["photo_id", "side"], min_samples=4)


@query("set03_distinct_offsets", f"""WITH {PEAKS} SELECT photo_id, side, strongest AS "offset" FROM got WHERE strongest <> 0
    UNION ALL SELECT photo_id, side, outermost FROM got WHERE outermost <> 0 AND outermost <> strongest""")
def _(spark, d):
    return ops.distinct_offsets(ops.edge_peaks(peak_samples(spark, d), ["photo_id", "side"], min_samples=4))
