"""Training and serving bound to the candidate view, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query, table
from bindings.candidates import GROWN
from bindings.views import CANDS, cands, interval_overlap
from sheetwise.operators import training
from sheetwise.operators.candidates import best_rows, grow_to_whole
from sheetwise.plans import ranking
from sheetwise.session import scratch_path


@query("agg08_holdout_split", """SELECT doc_id, url AS source, (dense_rank() OVER (ORDER BY url) - 1) % 2 = 1 AS held_out FROM (SELECT page_id AS doc_id, regexp_extract(url, '//([^/]+)', 1) AS url FROM pages)
    UNION ALL SELECT doc_id, source, (dense_rank() OVER (ORDER BY source) - 1) % 2 = 1 FROM documents""")
def _(spark, d):
    hosts = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("url", "//([^/]+)", 1).alias("source"))
    docs = table(spark, d, "documents").select("doc_id", "source")
    split = training.holdout_split(hosts, "source").unionByName(training.holdout_split(docs, "source"))
    return split.select("doc_id", "source", "held_out")


@query("set04_train_union", """SELECT 'synthetic' AS origin, page_id AS id FROM pages UNION ALL SELECT 'real', doc_id FROM
    (SELECT doc_id, (dense_rank() OVER (ORDER BY source) - 1) % 2 = 1 AS held FROM documents) WHERE NOT held""")
def _(spark, d):
    synthetic = table(spark, d, "pages").select(F.lit("synthetic").alias("origin"), F.col("page_id").alias("id"))
    real = table(spark, d, "documents").select(F.lit("real").alias("origin"), F.col("doc_id").alias("id"), "source")
    return training.train_union(synthetic, real, "source").select("origin", "id")


def nested_photos(spark, d):
    """Embeddings as nested candidate rows: eight candidates of eight features, one label each."""
    e = F.col("embedding")
    pieces = F.array(*[F.struct(F.slice(e, 8 * i + 1, 8).alias("f")) for i in range(8)])
    labels = F.transform(F.slice(e, 1, 8), lambda v: F.abs(v.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", pieces.alias("cands"), labels.alias("labels"))


@query("agg09_training_matrix", """SELECT round(embedding[8 * i + 1]::DOUBLE, 6) AS first_feature, round(embedding[8 * i + 8]::DOUBLE, 6) AS last_feature, round(power(abs(embedding[i + 1]::DOUBLE), 2.5), 9) AS label
    FROM embeddings, (SELECT unnest(range(8))::INT AS i)""")
def _(spark, d):
    out = training.training_matrix(nested_photos(spark, d), power=2.5)
    return out.select(
        F.round(F.col("features")[0].cast("double"), 6).alias("first_feature"),
        F.round(F.col("features")[7].cast("double"), 6).alias("last_feature"), F.round("label", 9).alias("label"),
    )


def measured_cands(spark, d):
    """Candidates with every measured column filled from the line."""
    c = F.col
    frame = cands(spark, d)
    known = {
        "total": c("score"), "support": c("label"), "strength": c("pred"), "contrast": c("area") / 50, "paper": c("lo") / 10,
        "shape": c("hi") / 20, "size": c("area") / 100, "border": c("label") / 2, "brighter": c("pred") / 2, "aspect": c("area"),
    }
    zero = F.lit(0.0)
    return frame.select("*", *[known.get(n, zero).alias(n) for n in ranking.MEASURED])


def line_features(spark, d):
    return ranking.candidate_features(
        measured_cands(spark, d), F.lit(400.0), ["lo", "hi", "family"], interval_overlap, lambda b, c: c["family"] >= "F",
        corners_on=lambda top, own: own["lo"] <= top["lo"],
    )


SQL_FEATURES = f"""{GROWN}, w AS (SELECT *, row_number() OVER w - 1 AS rk, count(*) OVER (PARTITION BY photo_id) AS n, first(score) OVER w AS ts, first(area) OVER w AS ta, first(lo) OVER w AS tlo, first(hi) OVER w AS thi
        FROM cands WINDOW w AS (PARTITION BY photo_id ORDER BY score DESC, cand_idx)),
    rv AS (SELECT a.photo_id, a.cand_idx, count(*) FILTER (b.cand_idx <> a.cand_idx AND b.score >= a.score - 0.1::DOUBLE AND b.area > 1.1::DOUBLE * a.area) AS lc,
        count(*) FILTER (b.cand_idx <> a.cand_idx AND b.score >= a.score - 0.1::DOUBLE AND b.area < a.area / 1.1::DOUBLE) AS sc FROM cands a JOIN cands b USING (photo_id) GROUP BY ALL)
    SELECT w.photo_id, w.cand_idx, [{', '.join(f'round(({e})::FLOAT::DOUBLE, 4) + 0.0' for e in [
        'w.score', 'label', 'pred', 'w.area / 50', 'w.lo / 10', 'w.hi / 20', 'w.area / 100', 'label / 2', 'pred / 2', 'least(w.area, 10)',
        'w.area / 400', 'w.score - ts', 'ln(greatest(w.area, 1) / greatest(ta, 1))',
        'greatest(0, least(w.hi, thi) - greatest(w.lo, tlo)) * 10 / greatest(ta, 1)', 'greatest(0, least(w.hi, thi) - greatest(w.lo, tlo)) * 10 / greatest(w.area, 1)',
        '(rk > 0 AND w.area > 1.05::DOUBLE * ta AND w.lo <= tlo)::INT', '0', '0', '0', '0', '0', '0', '0', '0', '0', '0',
        "(w.source = 'lines')::INT", "(w.source = 'edges')::INT", '0', "(w.source = 'bright')::INT", '0', 'rk / n', 'lc', 'sc', '(w.cand_idx = g3.cand_idx)::INT'])}] AS features
    FROM w JOIN rv ON rv.photo_id = w.photo_id AND rv.cand_idx = w.cand_idx JOIN g3 ON g3.photo_id = w.photo_id"""


@query("win03_candidate_features", SQL_FEATURES)
def _(spark, d):
    def rounded(v):
        """Most features are whole numbers, which rounding leaves as they are."""
        return F.when(v == F.rint(v), v.cast("double")).otherwise(F.round(v.cast("double"), 4)) + 0.0

    return line_features(spark, d).select("photo_id", "cand_idx", F.transform("features", rounded).alias("features"))


# A hand-made model of two trees of depth one: a value equal to the threshold goes left.
NODES = [
    (0, 0, 0, 0.25, 1, 2, 0.0), (0, 1, 0, 0.0, -1, -1, 2.0), (0, 2, 0, 0.0, -1, -1, 8.0),
    (1, 0, 1, 30.0, 1, 2, 0.0), (1, 1, 1, 0.0, -1, -1, 1.0), (1, 2, 1, 0.0, -1, -1, 5.0),
]


def hand_made(spark):
    return spark.createDataFrame(NODES, training.NODE_COLUMNS)


def two_features(spark, d):
    pair = F.array(F.col("score").cast("float"), F.col("area").cast("float"))
    return cands(spark, d).withColumn("features", pair)


PRED = "(0.1::DOUBLE + 0.05::DOUBLE * CASE WHEN score::FLOAT <= 0.25::FLOAT THEN 2.0::DOUBLE ELSE 8.0::DOUBLE END + 0.05::DOUBLE * CASE WHEN area::FLOAT <= 30::FLOAT THEN 1.0::DOUBLE ELSE 5.0::DOUBLE END)"


@query("mlr02_predict_overlap", f"WITH {CANDS} SELECT photo_id, cand_idx, round({PRED}, 6) AS pred FROM cands")
def _(spark, d):
    out = training.predict_overlap(two_features(spark, d).drop("pred"), hand_made(spark), bias=0.1)
    return out.select("photo_id", "cand_idx", F.round("pred", 6).alias("pred"))


@query("mlr03_rank_pages", f"""{GROWN}, m AS (SELECT photo_id, cand_idx, {PRED} AS p, source FROM cands QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY {PRED} DESC, score DESC, cand_idx) = 1)
    SELECT 'model' AS how, photo_id, cand_idx, round(p, 6) AS score, p >= 0.3::DOUBLE AS accepted, p >= 0.6::DOUBLE AS confident FROM m
    UNION ALL SELECT 'rules', photo_id, cand_idx, round(score, 6), score >= 0.35::DOUBLE, score >= 0.55::DOUBLE FROM g3""")
def _(spark, d):
    frame = two_features(spark, d).drop("pred")

    def pick(nodes):
        return ranking.rank_pages(frame, nodes, ["lo", "hi", "family"], interval_overlap, lambda b, c: c["family"] >= "F", bias=0.1)

    columns = ["photo_id", "cand_idx", F.round("score", 6).alias("score"), "accepted", "confident"]
    model = pick(hand_made(spark)).select(F.lit("model").alias("how"), *columns)
    return model.unionByName(pick(None).select(F.lit("rules").alias("how"), *columns))


@query("mlr04_ablate", f"""{GROWN}, t AS (SELECT photo_id, cand_idx FROM cands QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, cand_idx) = 1),
    v AS (SELECT 'rules' AS variant, photo_id, cand_idx FROM g3 UNION ALL SELECT 'top', photo_id, cand_idx FROM t)
    SELECT CASE WHEN grouping(family) = 1 THEN 'ALL' ELSE family END AS family, variant, count(*) AS n, round(avg(label), 6) AS label_mean, round(max(label), 6) AS label_worst
    FROM v JOIN cands USING (photo_id, cand_idx) GROUP BY GROUPING SETS ((variant, family), (variant))""")
def _(spark, d):
    frame = cands(spark, d)
    variants = {
        "rules": lambda c: grow_to_whole(c, interval_overlap, lambda b, x: x["family"] >= "F", ["lo", "hi", "family"]),
        "top": lambda c: best_rows(c, ["photo_id"], [F.col("score").desc(), F.col("cand_idx")]),
    }
    out = ranking.ablate(frame, variants)
    return out.select("family", "variant", "n", F.round("label_mean", 6).alias("label_mean"), F.round("label_worst", 6).alias("label_worst"))


def small_model(spark, d):
    """Twelve trees on eight columns of the lines."""
    columns = ["score", "area", "pred", "lo", "hi", "contrast", "paper", "shape"]
    frame = measured_cands(spark, d).withColumn("features", F.array(*[F.col(c).cast("float") for c in columns]))
    return columns, frame, training.train_ranker(frame, trees=12)


@query("mlr01_train_ranker")
def _(spark, d):
    columns, frame, model = small_model(spark, d)
    nodes = training.tree_table(model, spark)
    predicted = training.predict_overlap(frame.drop("pred"), nodes)
    return predicted.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean_pred"), F.avg("label").alias("mean_label"))


@query("src12_tree_table")
def _(spark, d):
    columns, _, model = small_model(spark, d)
    path = scratch_path(spark, "nodes")
    training.write_tree_table(training.tree_table(model, spark), path, columns, 0.0, 0.05)
    return training.read_tree_table(spark, path, columns)


@query("srt10_top_importances")
def _(spark, d):
    columns, _, model = small_model(spark, d)
    return training.top_importances(model, columns, spark)


@query("src11_incremental_labels", """WITH days AS (SELECT user_id AS path, max(ts::DATE - DATE '2024-01-01') AS mtime, count(*) AS n FROM events GROUP BY user_id)
    SELECT path, n * 2 AS label, path % 3 <> 0 OR mtime >= 25 AS made FROM days""")
def _(spark, d):
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    recs = table(spark, d, "events").groupBy(F.col("user_id").alias("path")).agg(F.max(day).alias("mtime"), F.count(F.lit(1)).alias("n"))
    store = recs.filter(F.col("path") % 3 == 0).select("path", F.lit(25).alias("labelled_at"), (F.col("n") * 2).alias("label"))
    first, made = training.incremental_labels(recs, store, F.col("n") * 2, F.lit(99))
    again, none = training.incremental_labels(recs, store.unionByName(made), F.col("n") * 2, F.lit(100))
    return again.unionByName(none).select("path", "label", (F.col("labelled_at") == 99).alias("made"))
