"""Photos of few candidates are judged in place, crowded ones by counting and joining; both as a plain computation does."""

import random

import pytest
from pyspark.sql import functions as F

from sheetwise.operators import candidates
from sheetwise.plans import ranking
from test_scene_limits import _shuffled


def _overlap(a, b):
    return F.least(a["area"], b["area"]) * 0.95


def _accept(a, b):
    return b["kind"] != a["kind"]


def _rows(sizes):
    rnd = random.Random(5)
    return [
        (photo, i, "lines", round(rnd.random() * 0.4, 2), float(rnd.randint(1, 60)), rnd.randint(0, 2)) for photo, n in enumerate(sizes) for i in range(n)
    ]


SCHEMA = "photo_id long, cand_idx long, source string, score double, area double, kind int"
SIZES = [1, 2, 7, candidates.FEW, candidates.FEW + 1, 200, 3]


def _grown(rows):
    pick = top = max(rows, key=lambda r: (r[3], -r[1]))
    score, grown = pick[3], 0
    for _ in range(3):
        near = [c for c in rows if c[3] >= top[3] - 0.1 and c[4] >= 1.12 * pick[4] and min(c[4], pick[4]) * 0.95 >= 0.92 * pick[4] and c[5] != pick[5]]
        if near:
            pick = max(near, key=lambda c: (c[4], c[3], -c[1]))
            score, grown = max(score, pick[3]), 1
    return pick[1], score, grown


def _close(rows):
    return {
        (a[0], a[1]): (
            sum(b[1] != a[1] and b[3] >= a[3] - 0.1 and b[4] > 1.1 * a[4] for b in rows), sum(b[1] != a[1] and b[3] >= a[3] - 0.1 and b[4] < a[4] / 1.1 for b in rows)
        )
        for a in rows
    }


def test_few_and_crowded_agree_with_a_plain_computation(spark):
    rows = _rows(SIZES)
    cands = spark.createDataFrame(rows, SCHEMA)
    by_photo = {p: [r for r in rows if r[0] == p] for p in range(len(SIZES))}
    close = {k: v for own in by_photo.values() for k, v in _close(own).items()}
    for hot_rows in (candidates.HOT_ROWS, 5):
        got = {(r["photo_id"], r["cand_idx"]): (r["n_larger_close"], r["n_smaller_close"]) for r in candidates.close_rivals(cands, hot_rows=hot_rows).collect()}
        assert got == close
    picks = {r["photo_id"]: r for r in candidates.grow_to_whole(cands, _overlap, _accept, ["kind"]).collect()}
    for photo, own in by_photo.items():
        idx, score, grown = _grown(own)
        assert (picks[photo]["cand_idx"], picks[photo]["score"], "grown" in picks[photo]["source"]) == (idx, score, bool(grown)), photo

    zero = {n: F.lit(0.0) for n in ranking.MEASURED}
    featured = ranking.candidate_features(cands.withColumns(zero), F.lit(400.0), ["kind"], _overlap, _accept)
    at = {n: ranking.FEATURES.index(n) for n in ("n_larger_close", "n_smaller_close", "rules_pick")}
    seen = 0
    for r in featured.collect():
        key, f = (r["photo_id"], r["cand_idx"]), r["features"]
        assert (f[at["n_larger_close"]], f[at["n_smaller_close"]]) == close[key]
        assert f[at["rules_pick"]] == (picks[key[0]]["cand_idx"] == key[1])
        seen += 1
    assert seen == len(rows)


def test_rows_without_a_score_are_no_rivals(spark):
    rows = [(1, 0, "lines", 0.5, 10.0, 0), (1, 1, "lines", None, 90.0, 1), (1, 2, "lines", 0.5, 20.0, 1), (1, 3, "lines", 0.5, None, 1)]
    for hot_rows in (candidates.HOT_ROWS, 2):
        found = candidates.close_rivals(spark.createDataFrame(rows, SCHEMA), hot_rows=hot_rows).collect()
        assert {r["cand_idx"]: (r["n_larger_close"], r["n_smaller_close"]) for r in found} == {0: (1, 0), 1: (0, 0), 2: (0, 1), 3: (0, 0)}


def test_features_of_few_candidates_shuffle_them_once(spark):
    cands = spark.range(30_000).select(
        (F.col("id") % 6000).alias("photo_id"), F.floor(F.col("id") / 6000).alias("cand_idx"), F.lit("lines").alias("source"), (F.col("id") % 11 / 20).alias("score"),
        (F.col("id") % 17 + 1.0).alias("area"), (F.col("id") % 3).cast("int").alias("kind"), *[F.lit(0.0).alias(n) for n in ranking.MEASURED],
    )
    featured = ranking.candidate_features(cands, F.lit(400.0), ["kind"], _overlap, _accept).select("photo_id", "features")
    n, moved = _shuffled(spark, lambda: len(featured.collect()))
    assert n == 30_000 and moved <= 30_000 * 1.1


def test_rows_of_one_index_are_one_candidate(spark):
    """Rows that share their index are no rivals of each other, and their counts are added up."""
    rows = [(p, i // 2 if p else i, *rest) for p, i, *rest in _rows([3, 9, candidates.FEW + 8, 150])]
    rows += [(9, 0, "lines", 0.5, -3.0, 0), (9, 1, "lines", 0.45, -9.0, 1)]
    cands = spark.createDataFrame(rows, SCHEMA)
    close = {}
    for a in rows:
        near = [b for b in rows if b[0] == a[0] and b[1] != a[1] and b[3] >= a[3] - 0.1]
        n, m = close.get(a[:2], (0, 0))
        close[a[:2]] = (n + sum(b[4] > 1.1 * a[4] for b in near), m + sum(b[4] < a[4] / 1.1 for b in near))
    for hot_rows in (candidates.HOT_ROWS, 2):  # in place, and all by counting
        got = [tuple(r) for r in candidates.close_rivals(cands, hot_rows=hot_rows).collect()]
        assert sorted(got) == sorted((*k, *v) for k, v in close.items())

    zero = {n: F.lit(0.0) for n in ranking.MEASURED}
    featured = ranking.candidate_features(cands.withColumns(zero), F.lit(400.0), ["kind"], _overlap, _accept).collect()
    at = [ranking.FEATURES.index(n) for n in ("n_larger_close", "n_smaller_close")]
    assert len(featured) == len(rows)
    for r in featured:
        assert tuple(r["features"][i] for i in at) == close[r["photo_id"], r["cand_idx"]]


def test_rivals_and_features_of_one_index_match_their_sql(spark, tmp_path):
    """Prices that differ by less than a hundredth give one index to two lines, as some do in large tables."""
    import bindings
    from check import compare

    duckdb = pytest.importorskip("duckdb")
    bindings.load_all()
    lines = spark.range(3000).selectExpr(
        "IF(id < 300, 0, id % 600) AS l_orderkey", "CAST(1 + id % 2 AS INT) AS l_linenumber", "CAST(1 + id % 47 AS DOUBLE) AS l_quantity",
        "id % 13 * 900.0D + id / 1000000.0D AS l_extendedprice", "id % 11 / 100.0D AS l_discount", "id % 9 / 100.0D AS l_tax",
        "CASE id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'R' ELSE 'A' END AS l_returnflag", "IF(id % 2 = 0, 'F', 'O') AS l_linestatus")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    for name in ("joi04_close_rivals", "win03_candidate_features"):
        assert compare(bindings.QUERIES[name](spark, str(tmp_path)), con, bindings.SQL[name]) == "", name
