"""Photos with candidate outlines and brightness samples, made from the embeddings, and what the samples say about the outlines.

A photo is 160 by 160 pixels, read every 8 pixels. Five outlines are proposed on it: the page, its upper panel, a block of print on it, a
longer sheet and one that takes in the surroundings. Which of them is paper, and what lies around it, depends on the id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query, table
from sheetwise.functions import geometry as g
from sheetwise.operators import evidence
from sheetwise.operators.candidates import best_rows
from sheetwise.operators.ordered import computed_once, first_of_group, ordered
from sheetwise.plans import ranking
from sheetwise.session import settle

FRAME = evidence.Frame(160, 160, cells=4)
STEP, SIDE = 8, 20
#: Corners (tl, tr, br, bl) before they are moved a little.
SHAPES = (
    ("lines", ((24, 24), (136, 24), (136, 136), (24, 136))),
    ("edges", ((24, 24), (136, 24), (136, 86), (24, 86))),
    ("bright", ((50, 50), (110, 50), (110, 110), (50, 110))),
    ("weak-edges", ((24, 24), (136, 24), (136, 155), (24, 155))),
    ("neutral", ((10, 12), (150, 12), (150, 150), (10, 150))),
)
#: What is paper in photos of each kind (id modulo 5).
PAPER = (0, 3, 4, 0, 0)


def _element(index):
    return F.get("embedding", index).cast("double")


def _corner(k: int, i: int):
    x, y = SHAPES[k][1][i]
    first = k * 8 + 2 * i
    return g.point(F.lit(float(x)) + 8 * _element(first), F.lit(float(y)) + 8 * _element(first + 1))


def _quad(k: int):
    return F.array(*[_corner(k, i) for i in range(4)])


def _photos(spark, d):
    """The embeddings, dealt out before each becomes 400 samples."""
    return table(spark, d, "embeddings").repartition(spark.sparkContext.defaultParallelism, "vec_id")


def scene_cands(spark, d):
    """``photo_id, family, cand_idx, source, corners, area, score, label`` and the measured score terms."""
    rows = [
        F.struct(
            F.lit(k).alias("cand_idx"), F.lit(source).alias("source"), _quad(k).alias("corners"),
            (0.8 - 0.03 * ((F.floor(F.col("vec_id") / 5) + k) % 5) + 0.1 * F.abs(_element(41 + k))).alias("score"), F.abs(_element(46 + k)).alias("label"),
        )
        for k, (source, _) in enumerate(SHAPES)
    ]
    out = _photos(spark, d).select(F.col("vec_id").alias("photo_id"), F.col("label").alias("family"), F.inline(F.array(*rows)))
    out = out.withColumn("area", F.abs(g.quad_signed_area(F.col("corners"))))
    terms = [n for n in ranking.MEASURED if n not in evidence.APPEARANCE]
    return out.select("*", *[(F.col("label") * (i + 1)).alias(n) for i, n in enumerate(terms)])


def scene_samples(spark, d):
    """``photo_id, x, y, gray, sat``: whole levels, written once for all that reads them."""
    grid = F.sequence(F.lit(0), F.lit(SIDE - 1))
    photos = _photos(spark, d).select(F.col("vec_id").alias("photo_id"), "embedding", *[_quad(k).alias(f"q{k}") for k in (0, 2, 3, 4)])
    photos = evidence.with_terms(photos, **{f"t{k}": f"q{k}" for k in (0, 2, 3, 4)}).drop("q0", "q2", "q3", "q4")
    rows = photos.withColumn("ix", F.explode(grid)).withColumn("iy", F.explode(grid))
    rows = rows.withColumns({"x": F.lit(STEP) * F.col("ix") + F.lit(4.0), "y": F.lit(STEP) * F.col("iy") + F.lit(4.0)})
    for k in (0, 2, 3, 4):
        turns = [g.side_offset(F.col("x"), F.col("y"), F.col(f"t{k}"), i)["turn"] for i in range(4)]
        rows = computed_once(rows, **{f"in{k}": F.least(*turns) >= 0})

    def inside(k: int):
        return F.col(f"in{k}")

    kind = F.col("photo_id") % 5
    paper = F.lit(False)
    for k, of in enumerate(PAPER):
        paper = paper | ((kind == k) & inside(of))
    printed = paper & (kind < 3) & inside(2)
    gray = (
        F.when(printed, 160).when(paper & (kind == 4) & (F.col("y") > 86), 110).when(paper, 205).when(kind == 3, 190).otherwise(90)
        + F.floor(40 * _element((F.col("ix") * 7 + F.col("iy") * 13) % 64))
    )
    sat = F.when(paper, 12).when(kind == 3, 75).otherwise(60) + F.floor(16 * _element((F.col("ix") * 5 + F.col("iy") * 11) % 64))
    return settle(rows.select("photo_id", "x", "y", gray.cast("int").alias("gray"), sat.cast("int").alias("sat")), "samples")


# the same in SQL


def _values() -> str:
    return ", ".join(f"({k}, '{source}', [{', '.join(str(float(v)) + '::DOUBLE' for c in quad for v in c)}])" for k, (source, quad) in enumerate(SHAPES))




def _moved() -> str:
    return ", ".join(f"base[{2 * i + n + 1}] + 8 * embedding[cand_idx * 8 + {2 * i + n + 1}]::DOUBLE AS {a}{i}" for i in range(4) for n, a in enumerate("xy"))


def area(p: str = "") -> str:
    return "abs(" + " + ".join(f"({p}x{i}*{p}y{(i + 1) % 4} - {p}x{(i + 1) % 4}*{p}y{i})" for i in range(4)) + ") / 2"


def turns(p: str, x: str, y: str) -> str:
    return ", ".join(f"({p}x{(i + 1) % 4}-{p}x{i})*({y}-{p}y{(i + 1) % 4}) - ({p}y{(i + 1) % 4}-{p}y{i})*({x}-{p}x{(i + 1) % 4})" for i in range(4))


def ring(p: str, x: str, y: str) -> str:
    parts = []
    for i in range(4):
        ax, ay, bx, by = f"{p}x{i}", f"{p}y{i}", f"{p}x{(i + 1) % 4}", f"{p}y{(i + 1) % 4}"
        t = f"greatest(0, least(1, (({x}-{ax})*({bx}-{ax})+({y}-{ay})*({by}-{ay}))/(({bx}-{ax})*({bx}-{ax})+({by}-{ay})*({by}-{ay})+1e-9)))"
        parts.append(f"sqrt(power({x}-({ax}+({bx}-{ax})*{t}),2)+power({y}-({ay}+({by}-{ay})*{t}),2))")
    return f"least({', '.join(parts)})"


def depth(p: str) -> str:
    return f"CASE WHEN least({turns(p, 'x', 'y')}) >= 0 THEN {ring(p, 'x', 'y')} ELSE -{ring(p, 'x', 'y')} END"


def side_terms(p: str, i: int) -> tuple[str, str]:
    """Along and out of a side; quads run clockwise, so out is always on the left."""
    ax, ay, bx, by = f"{p}x{i}", f"{p}y{i}", f"{p}x{(i + 1) % 4}", f"{p}y{(i + 1) % 4}"
    dx, dy = f"({bx}-{ax})", f"({by}-{ay})"
    return f"((x-{ax})*{dx}+(y-{ay})*{dy})/({dx}*{dx}+{dy}*{dy})", f"((x-{ax})*{dy}-(y-{ay})*{dx})/sqrt({dx}*{dx}+{dy}*{dy})"


_TERMS = [n for n in ranking.MEASURED if n not in evidence.APPEARANCE]
_SIGHT = " OR ".join(f"(k = {k} AND cand_idx = {of})" for k, of in enumerate(PAPER))

SCENES = f"""shapes(cand_idx, source, base) AS (VALUES {_values()}),
moved AS (SELECT vec_id AS photo_id, label AS family, cand_idx, source, embedding, {_moved()},
    0.8::DOUBLE - 0.03::DOUBLE * ((vec_id // 5 + cand_idx) % 5) + 0.1::DOUBLE * abs(embedding[42 + cand_idx]::DOUBLE) AS score, abs(embedding[47 + cand_idx]::DOUBLE) AS label
    FROM embeddings, shapes),
sc AS MATERIALIZED (SELECT *, {area()} AS area FROM moved),
grid AS (SELECT ix, iy, {STEP} * ix + 4.0::DOUBLE AS x, {STEP} * iy + 4.0::DOUBLE AS y FROM (SELECT unnest(range({SIDE}))::INT AS ix), (SELECT unnest(range({SIDE}))::INT AS iy)),
seen AS (SELECT photo_id, photo_id % 5 AS k, ix, iy, x, y, any_value(embedding) AS e, bool_or(({_SIGHT}) AND s) AS paper, bool_or(cand_idx = 2 AND s) AS block
    FROM (SELECT photo_id, photo_id % 5 AS k, cand_idx, embedding, ix, iy, x, y, least({turns('', 'x', 'y')}) >= 0 AS s FROM sc, grid) GROUP BY ALL),
sm AS MATERIALIZED (SELECT photo_id, x, y,
    CASE WHEN paper AND k < 3 AND block THEN 160 WHEN paper AND k = 4 AND y > 86 THEN 110 WHEN paper THEN 205 WHEN k = 3 THEN 190 ELSE 90 END
        + floor(40 * e[(ix * 7 + iy * 13) % 64 + 1]::DOUBLE)::INT AS gray,
    CASE WHEN paper THEN 12 WHEN k = 3 THEN 75 ELSE 60 END + floor(16 * e[(ix * 5 + iy * 11) % 64 + 1]::DOUBLE)::INT AS sat FROM seen)"""

_OUTER = ", ".join(f"b.{a}{i} AS t{a}{i}" for i in range(4) for a in "xy")
_INNER = ", ".join(f"a.{a}{i}" for i in range(4) for a in "xy")
TOPS = "tops AS (SELECT photo_id, cand_idx AS pick_idx, score AS top_score, area AS top_area FROM sc QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, cand_idx) = 1)"


def _pairs(where: str) -> str:
    return f"""pr AS MATERIALIZED (SELECT a.photo_id, a.cand_idx AS i, b.cand_idx AS o, {_INNER}, {_OUTER}
        FROM sc a JOIN sc b ON a.photo_id = b.photo_id AND a.cand_idx <> b.cand_idx JOIN tops ON tops.photo_id = a.photo_id WHERE {where})"""


def _probe(i: int, t: float) -> tuple[str, str]:
    j = (i + 1) % 4
    return f"(x{i}*{1 - t}::DOUBLE+x{j}*{t}::DOUBLE)", f"(y{i}*{1 - t}::DOUBLE+y{j}*{t}::DOUBLE)"


def _gap(i: int) -> str:
    return "greatest(" + ", ".join(ring("t", *_probe(i, t)) for t in (0.25, 0.5, 0.75)) + ")"


_ANY = lambda form, word: "(" + f" {word} ".join(form.format(i=i) for i in range(4)) + ")"
_STRIPS = ", ".join(
    f"avg(gray) FILTER (mid{i} > 0.025::DOUBLE * diag AND al{i} BETWEEN 1/24 AND 1 - 1/24 AND out{i} BETWEEN 3 AND 12) AS go{i}, "
    f"avg(gray) FILTER (mid{i} > 0.025::DOUBLE * diag AND al{i} BETWEEN 1/24 AND 1 - 1/24 AND out{i} BETWEEN -12 AND -3) AS gi{i}" for i in range(4)
)
_BANDS = {"in": "di >= 0 AND di < 16", "extra": "du >= 0 AND du < 16 AND di < 0", "out": "du < 0 AND du >= -16", "added": "du >= 16 AND di <= -16"}
_BAND_AGGS = ", ".join(f"count(*) FILTER ({w}) AS n_{b}, avg(gray) FILTER ({w}) AS g_{b}, avg(sat) FILTER ({w}) AS s_{b}" for b, w in _BANDS.items())

JUDGED = f"""cr AS MATERIALIZED (SELECT *, greatest(sqrt(power(tx0-tx2,2)+power(ty0-ty2,2)), sqrt(power(tx1-tx3,2)+power(ty1-ty3,2))) AS diag,
        greatest({', '.join(ring('t', f'x{i}', f'y{i}') for i in range(4))}) AS corner, {', '.join(f'{_gap(i)} AS gap{i}, {ring("t", *_probe(i, 0.5))} AS mid{i}' for i in range(4))} FROM pr),
    cs AS (SELECT *, corner <= 0.035::DOUBLE * diag AND NOT {_ANY('(gap{i} > 0.025::DOUBLE * diag AND gap{i} < 0.1::DOUBLE * diag)', 'OR')} AND {_ANY('gap{i} >= 0.1::DOUBLE * diag', 'OR')} AS corners_on FROM cr),
    sd AS (SELECT photo_id, i, o, gray, sat, diag, {', '.join(f'mid{i}, {side_terms("", i)[0]} AS al{i}, {side_terms("", i)[1]} AS out{i}' for i in range(4))}, {depth('')} AS di, {depth('t')} AS du FROM cs JOIN sm USING (photo_id)),
    ag AS MATERIALIZED (SELECT photo_id, i, o, {_STRIPS}, {_BAND_AGGS} FROM sd GROUP BY ALL),
    lk AS (SELECT photo_id, i, o, count(*) AS n_like FROM sd JOIN ag USING (photo_id, i, o) WHERE {_BANDS['added']} AND abs(gray - g_out) + abs(sat - s_out) <= 18 GROUP BY ALL),
    pv AS (SELECT cs.photo_id, i, o, corners_on,
        coalesce({_ANY('go{i} IS NOT NULL AND gi{i} IS NOT NULL', 'OR')} AND {_ANY('coalesce(go{i} >= gi{i} + 4, true)', 'AND')}, false) AS print_inside,
        coalesce(n_extra >= 20 AND n_in >= 20 AND s_extra <= s_in + 25 AND g_extra >= 0.6::DOUBLE * g_in AND (n_out <= 20 OR (
            NOT (abs(g_extra - g_out) + abs(s_extra - s_out) < abs(g_extra - g_in) + abs(s_extra - s_in)) AND NOT (n_added > 20 AND coalesce(n_like, 0) > 0.2::DOUBLE * n_added))), false) AS extra_paper
        FROM cs LEFT JOIN ag USING (photo_id, i, o) LEFT JOIN lk USING (photo_id, i, o)),
    judged AS MATERIALIZED (SELECT *, (corners_on OR print_inside) AND extra_paper AS accepted FROM pv)"""


@query("joi13_acceptance_by_evidence", f"""WITH {SCENES}, {TOPS}, {_pairs('a.cand_idx = pick_idx AND b.area > 1.05::DOUBLE * a.area')}, {JUDGED}
    SELECT photo_id, i AS pick_idx, o AS cand_idx, corners_on, print_inside, extra_paper, accepted FROM judged""")
def _(spark, d):
    ranked = ordered(scene_cands(spark, d), ["photo_id"], [-F.col("score"), "cand_idx"], {"_top": first_of_group(F.struct("cand_idx", "area", "corners"))})
    pairs = ranked.filter((F.col("cand_idx") != F.col("_top.cand_idx")) & (F.col("area") > 1.05 * F.col("_top.area"))).select(
        "photo_id", F.col("_top.cand_idx").alias("pick_idx"), "cand_idx", F.col("_top.corners").alias("inner"), F.col("corners").alias("outer")
    )
    judged = evidence.pair_evidence(pairs, scene_samples(spark, d), FRAME)
    return judged.select("photo_id", "pick_idx", "cand_idx", "corners_on", "print_inside", "extra_paper", "accepted")


def _shared() -> str:
    from bindings.outlines import sql_clipped

    return f"greatest(0, ({sql_clipped('', 't')} + {sql_clipped('t', '')}) / 2)"


def _round(before: str, name: str) -> str:
    return f""", {name} AS (SELECT p.photo_id, coalesce(g.cand_idx, p.cand_idx) AS cand_idx, CASE WHEN g.score IS NULL THEN p.score ELSE greatest(g.score, p.score) END AS score,
        coalesce(g.area, p.area) AS area, coalesce(g.source || '+grown', p.source) AS source
        FROM {before} p LEFT JOIN (SELECT c.photo_id, c.cand_idx, c.score, c.area, c.source FROM {before} q JOIN fits ON fits.photo_id = q.photo_id AND fits.i = q.cand_idx JOIN sc c ON c.photo_id = q.photo_id AND c.cand_idx = fits.o
            QUALIFY row_number() OVER (PARTITION BY c.photo_id ORDER BY c.area DESC, c.score DESC, c.cand_idx) = 1) g ON g.photo_id = p.photo_id)"""


GROWN = f"""WITH {SCENES}, {TOPS}, {_pairs('b.score >= top_score - 0.1::DOUBLE AND b.area >= 1.12::DOUBLE * a.area')}, {JUDGED},
    fits AS (SELECT judged.photo_id, judged.i, judged.o FROM judged JOIN pr ON pr.photo_id = judged.photo_id AND pr.i = judged.i AND pr.o = judged.o WHERE accepted AND {_shared()} >= 0.92::DOUBLE * {area()}),
    g0 AS (SELECT sc.photo_id, cand_idx, score, area, source FROM sc JOIN tops ON sc.photo_id = tops.photo_id AND cand_idx = pick_idx)""" + _round("g0", "g1") + _round("g1", "g2") + _round("g2", "g3")


@query("joi13_grow_by_evidence", f"{GROWN} SELECT photo_id, cand_idx, round(score, 6) AS score, round(area, 6) AS area, source FROM g3")
def _(spark, d):
    grown = evidence.grow_by_evidence(scene_cands(spark, d), scene_samples(spark, d), FRAME)
    return grown.select("photo_id", "cand_idx", F.round("score", 6).alias("score"), F.round("area", 6).alias("area"), "source")


def _on_photo(i: int) -> str:
    ax, ay, bx, by = f"x{i}", f"y{i}", f"x{(i + 1) % 4}", f"y{(i + 1) % 4}"
    dx, dy = f"({bx}-{ax})", f"({by}-{ay})"
    length, along = f"sqrt({dx}*{dx}+{dy}*{dy})", side_terms("", i)[0]
    ends = [(f"({ax}+{dx}*{along}{s}12*{dy}/{length})", f"({ay}+{dy}*{along}{'-' if s == '+' else '+'}12*{dx}/{length})") for s in "+-"]
    return " AND ".join(f"{x} BETWEEN 0 AND 160 AND {y} BETWEEN 0 AND 160" for x, y in ends)


_LIFTS = ", ".join(
    f"avg(gray) FILTER (al{i} BETWEEN 1/16 AND 1 - 1/16 AND out{i} BETWEEN 3 AND 12 AND on{i}) - avg(gray) FILTER (al{i} BETWEEN 1/16 AND 1 - 1/16 AND out{i} BETWEEN -12 AND -3 AND on{i}) AS lift{i}" for i in range(4)
)
LOOKS = f"""pd AS (SELECT photo_id, cand_idx, gray, sat, {depth('')} AS dp, {', '.join(f'{side_terms("", i)[0]} AS al{i}, {side_terms("", i)[1]} AS out{i}, {_on_photo(i)} AS on{i}' for i in range(4))} FROM sc JOIN sm USING (photo_id)),
    pm AS MATERIALIZED (SELECT photo_id, cand_idx, count(*) FILTER (dp < 0 AND dp >= -16) > 10 AS ho, count(*) FILTER (dp >= 0 AND dp < 16) > 10 AS hi,
        avg(gray) FILTER (dp >= 0 AND dp < 16) AS ig0, avg(sat) FILTER (dp >= 0 AND dp < 16) AS is0, avg(gray) FILTER (dp < 0 AND dp >= -16) AS og0, avg(sat) FILTER (dp < 0 AND dp >= -16) AS os0, {_LIFTS} FROM pd GROUP BY ALL),
    pn AS (SELECT photo_id, cand_idx, ho, CASE WHEN hi THEN ig0 ELSE 0 END AS in_gray, CASE WHEN hi THEN is0 ELSE 0 END AS in_sat, CASE WHEN ho THEN og0 WHEN hi THEN ig0 ELSE 0 END AS out_gray, CASE WHEN ho THEN os0 WHEN hi THEN is0 ELSE 0 END AS out_sat,
        coalesce(greatest({', '.join(f'lift{i}' for i in range(4))}), 0) AS side_lift_max, coalesce(least({', '.join(f'lift{i}' for i in range(4))}), 0) AS side_lift_min FROM pm),
    ps AS (SELECT photo_id, cand_idx, CASE WHEN any_value(ho) THEN coalesce(count(*) FILTER (dp >= 16 AND abs(gray - out_gray) + abs(sat - out_sat) <= 18) / nullif(count(*) FILTER (dp >= 16), 0), 0) ELSE 0 END AS interior_bg,
        CASE WHEN any_value(ho) THEN coalesce(count(*) FILTER (dp < 0 AND dp >= -16 AND abs(gray - in_gray) + abs(sat - in_sat) <= 18) / nullif(count(*) FILTER (dp < 0 AND dp >= -16), 0), 0) ELSE 0 END AS outband_paper
        FROM pd JOIN pn USING (photo_id, cand_idx) GROUP BY ALL),
    looks AS MATERIALIZED (SELECT * EXCLUDE (ho) FROM pn JOIN ps USING (photo_id, cand_idx))"""


@query("agg19_appearance_of_outlines", f"WITH {SCENES}, {LOOKS} SELECT photo_id, cand_idx, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in evidence.APPEARANCE)} FROM looks")
def _(spark, d):
    out = evidence.appearance(scene_cands(spark, d), scene_samples(spark, d), FRAME)
    return out.select("photo_id", "cand_idx", *[(F.round(n, 6) + 0.0).alias(n) for n in evidence.APPEARANCE])


def _features_sql() -> str:
    """Growth, appearance and the relation to the top, as the 35 features of each candidate."""
    terms = {n: f"label * {k + 1}" for k, n in enumerate(_TERMS)} | {n: f"looks.{n}" for n in evidence.APPEARANCE}
    order = [
        *[terms[n] for n in ranking.MEASURED if n not in ("aspect", *evidence.APPEARANCE)], f"least({terms['aspect']}, 10)",
        "w.area / 25600", "w.score - ts", "ln(greatest(w.area, 1) / greatest(ta, 1))", "shared / greatest(ta, 1)", "shared / greatest(w.area, 1)",
        *[f"coalesce({n} AND w.area > 1.05::DOUBLE * ta, false)::INT" for n in ("corners_on", "print_inside", "extra_paper")],
        *[terms[n] for n in evidence.APPEARANCE], *[f"(w.source = '{s}')::INT" for s in ("lines", "edges", "weak-edges", "bright", "neutral")],
        "rk / n", "lc", "sc2", "(w.cand_idx = g3.cand_idx)::INT",
    ]
    return f"""{GROWN}, {LOOKS},
    w AS (SELECT photo_id, cand_idx, source, label, score, area, row_number() OVER w - 1 AS rk, count(*) OVER (PARTITION BY photo_id) AS n, first(cand_idx) OVER w AS ti, first(score) OVER w AS ts, first(area) OVER w AS ta
        FROM sc WINDOW w AS (PARTITION BY photo_id ORDER BY score DESC, cand_idx)),
    rv AS (SELECT a.photo_id, a.cand_idx, count(*) FILTER (b.cand_idx <> a.cand_idx AND b.score >= a.score - 0.1::DOUBLE AND b.area > 1.1::DOUBLE * a.area) AS lc,
        count(*) FILTER (b.cand_idx <> a.cand_idx AND b.score >= a.score - 0.1::DOUBLE AND b.area < a.area / 1.1::DOUBLE) AS sc2 FROM sc a JOIN sc b USING (photo_id) GROUP BY ALL),
    lap AS (SELECT photo_id, o AS cand_idx, {_shared()} AS shared FROM (SELECT a.photo_id, b.cand_idx AS o, {_INNER}, {_OUTER} FROM sc a JOIN tops ON a.photo_id = tops.photo_id AND a.cand_idx = pick_idx JOIN sc b ON b.photo_id = a.photo_id AND b.cand_idx <> a.cand_idx)),
    tj AS (SELECT j.photo_id, o AS cand_idx, corners_on, print_inside, extra_paper FROM judged j JOIN tops ON j.photo_id = tops.photo_id AND j.i = pick_idx)
    SELECT w.photo_id, w.cand_idx, [{', '.join(f'round(({e})::FLOAT::DOUBLE, 4) + 0.0' for e in order)}] AS features
    FROM w JOIN rv ON rv.photo_id = w.photo_id AND rv.cand_idx = w.cand_idx JOIN g3 ON g3.photo_id = w.photo_id JOIN looks ON looks.photo_id = w.photo_id AND looks.cand_idx = w.cand_idx
    LEFT JOIN (SELECT * FROM lap UNION ALL SELECT photo_id, pick_idx, top_area FROM tops) l ON l.photo_id = w.photo_id AND l.cand_idx = w.cand_idx
    LEFT JOIN tj ON tj.photo_id = w.photo_id AND tj.cand_idx = w.cand_idx"""


# pairs of the top and any larger candidate are judged as well as those that may grow
_FEATURES = _features_sql().replace(
    "b.score >= top_score - 0.1::DOUBLE AND b.area >= 1.12::DOUBLE * a.area", "(b.score >= top_score - 0.1::DOUBLE AND b.area >= 1.12::DOUBLE * a.area) OR (a.cand_idx = pick_idx AND b.area > 1.05::DOUBLE * a.area)"
).replace("WHERE accepted AND", """WHERE (judged.photo_id, judged.i, judged.o) IN (SELECT (u.photo_id, u.cand_idx, v.cand_idx) FROM sc u JOIN sc v ON u.photo_id = v.photo_id JOIN tops ON tops.photo_id = u.photo_id
    WHERE v.score >= top_score - 0.1::DOUBLE AND v.area >= 1.12::DOUBLE * u.area) AND accepted AND""")


@query("win03_features_from_samples", _FEATURES)
def _(spark, d):
    out = ranking.features_from_samples(scene_cands(spark, d), scene_samples(spark, d), FRAME)
    return out.select("photo_id", "cand_idx", F.transform("features", lambda v: F.round(v.cast("double"), 4) + 0.0).alias("features"))


@query("mlr03_rank_pages_by_evidence", f"{GROWN} SELECT photo_id, cand_idx, round(score, 6) AS score, score >= 0.35::DOUBLE AS accepted, score >= 0.55::DOUBLE AS confident FROM g3")
def _(spark, d):
    out = ranking.rank_pages_by_evidence(scene_cands(spark, d), scene_samples(spark, d), FRAME, None)
    return out.select("photo_id", "cand_idx", F.round("score", 6).alias("score"), "accepted", "confident")


@query("mlr04_ablate_by_evidence", f"""{GROWN}, v AS (SELECT 'rules' AS variant, photo_id, cand_idx FROM g3 UNION ALL SELECT 'top', photo_id, pick_idx FROM tops)
    SELECT CASE WHEN grouping(family) = 1 THEN 'ALL' ELSE family::VARCHAR END AS family, variant, count(*) AS n, round(avg(label), 6) AS label_mean, round(max(label), 6) AS label_worst
    FROM v JOIN sc USING (photo_id, cand_idx) GROUP BY GROUPING SETS ((variant, family), (variant))""")
def _(spark, d):
    frame = scene_cands(spark, d).withColumn("family", F.col("family").cast("string"))
    variants = {
        "rules": lambda c: evidence.grow_by_evidence(c, scene_samples(spark, d), FRAME),
        "top": lambda c: best_rows(c, ["photo_id"], [F.col("score").desc(), F.col("cand_idx")]),
    }
    out = ranking.ablate(frame, variants)
    return out.select("family", "variant", "n", F.round("label_mean", 6).alias("label_mean"), F.round("label_worst", 6).alias("label_worst"))
