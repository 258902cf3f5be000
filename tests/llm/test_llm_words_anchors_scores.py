"""Spelling variants, hard negatives and language-model scores against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from check import compare, connect
from sheetwise.llm import hard_negatives, maxent, queries, spelling
from sheetwise.llm.common import table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_trie_pair_variants", "op13_anchor_tree_negatives"])
def test_sql_twins(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.SQL[name]) == ""


# spelling variants


def brute_words(rows, every=97):
    n = collections.Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    return {w: c for w, c in n.items() if c >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: sorted((v for v in n if one_apart(v, w)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: vs[0] if vs and n[vs[0]] >= 2 * n[w] else None for w, vs in near.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


@pytest.mark.parametrize("letters", [25, 2_000_000])
def test_variants_of_made_words(spark, letters):
    rng = np.random.default_rng(1)
    n = {"aaaaa": 9, "aaaaaa": 4, "aaaaaaa": 1, "baaaa": 9, "zaaaa": 20, "élanß": 5, "elanß": 11, "ÿÿÿÿÿ": 3, "ÀÿÿÿÿÿÿÀ": 2, "x" * 3000: 8, "x" * 1500 + "y" + "x" * 1499: 4}
    for _ in range(300):
        word = "".join(rng.choice(list("abé"), rng.integers(5, 9)))
        n[word] = int(rng.integers(1, 60))
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    got = [tuple(r) for r in spelling.grouped_variants(words, letters=letters).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(n) and set(got) == brute_variants(n)


def test_variants_of_documents(spark):
    text = "Maison maisons MAISON maizon, maison; École école Ecole écoles x" * 3
    rows = [(1, text), (1, text), (None, text), (None, None), (7, ""), (8, "abcdefgh " * 40000), (9, "abcdefg " * 3), *((100 + i, "étoile étoiles étoil") for i in range(120))]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, id int, word string, n int").repartition(4)
    got = [tuple(r) for r in spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(set(got)) == len(got) and set(got) == brute_variants(brute_words(rows))
    assert any(form for _, form, *_ in got)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0 and spelling.spelling_variants(docs.where("doc_id = 7")).count() == 0


def test_node_numbers_across_parts():
    words = sorted({"a", "ab", "abc", "abcd", "abce", "abd", "b", "ba", "bab", "c", "cc", "ccc", "cccc", "cccd", "d"})
    for size in (1, 2, 3, 20):
        parts = [words[i : i + size] for i in range(0, len(words), size)]
        known = spelling.owners([(k, p[0], p[-1]) for k, p in enumerate(parts)])
        node = {}
        for k, part in enumerate(parts):
            for word, numbers in zip(part, spelling.number(k, part, known[k]), strict=True):
                assert len(numbers) == len(word) + 1
                for i, x in enumerate(numbers):
                    assert node.setdefault(word[:i], x) == x
        assert len(set(node.values())) == len(node)


# hard negatives


def brute_negatives(rows, every, positives=5, top=10):
    whole = {}
    rows = [(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, label, v in rows]
    out = collections.Counter()
    width = max(len(v) for _, _, v in rows)
    rows = [(i, label, v + (0,) * (width - len(v))) for i, label, v in rows]
    data = np.array([v for *_, v in rows])
    for i, label, v in {r for r in rows if r[0] % every == 0}:
        whole = data @ np.array(v)
        near = sorted((-int(s), j) for s, (j, other, _) in zip(whole, rows, strict=True) if j != i and other == label)[:positives]
        far = sorted((-int(s), j) for s, (j, other, _) in zip(whole, rows, strict=True) if j != i and other != label)
        for p, positive in near:
            inside = [(s, j) for s, j in far if -30 * p <= -100 * s <= -90 * p][:top]
            out.update((i, positive, rank, j, -p, -s) for rank, (s, j) in enumerate(inside, 1))
    return out


KIND = "vec_id long, embedding array<float>, label int, extra string, a int, row int"


def mined(spark, rows, **sizes):
    frame = spark.createDataFrame([(i, None if v is None else [float(x) if x is not None else None for x in v], label, "x", 1, 2) for i, label, v in rows], KIND)
    return collections.Counter(tuple(r) for r in hard_negatives.hard_negatives(frame.repartition(5), **sizes).collect())


@pytest.mark.parametrize("sizes", [{"every": 3, "group": 40, "lane": 5}, {"every": 2, "group": 30, "lane": 3}, {"every": 3}])
def test_negatives_of_made_vectors(spark, sizes):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(0, 3)), centres[rng.integers(0, 6)] + 0.2 * rng.normal(size=8)) for i in range(400)]
    rows += [(30, 1, rows[30][2]), (30, 1, rows[30][2]), (31, 0, rows[31][2]), (31, 0, rows[31][2]), (33, 2, rows[33][2][:5])]  # repeated rows and ids
    bad = [(None, 1, rows[0][2]), (3, None, rows[0][2]), (6, 1, None), (9, 1, [1.0, None]), (12, 1, [float("nan")] * 8), (15, 1, [float("inf")] * 8), (18, 1, [])]
    want = brute_negatives(rows + [bad[-1]], sizes["every"])
    assert mined(spark, rows + bad, **sizes) == want and len(want) > 500


def test_negatives_at_the_edges(spark):
    flat = [(i, i % 2, [1.0, 1.0]) for i in range(0, 2000, 10)]  # all scores are equal: no window holds any
    assert mined(spark, flat) == brute_negatives(flat, 100)
    ties = [(i, i % 2 if i % 100 else 1, [1.0, 0.0] if i % 2 or i % 100 == 0 else [0.5, 0.0]) for i in range(0, 600, 5)]
    want = brute_negatives(ties, 100)
    assert mined(spark, ties) == want and want
    assert mined(spark, [(1, 1, [1.0])]) == mined(spark, []) == collections.Counter()
    assert mined(spark, [(100, 1, [1.0])]) == collections.Counter()


def test_bounds_pass_over_candidates():
    rng = np.random.default_rng(3)
    centres = 40 * rng.normal(size=(12, 16))
    points = np.round(20 * (centres[np.arange(600) % 12] + rng.normal(size=(600, 16)))).astype(np.int64)
    of, depth, parent, edge = hard_negatives.planted(points[:240].astype(float), 20)
    tree = {"v": points[:240], "vec_id": np.arange(240), "label": np.zeros(240, int), "lane": of, "depth": depth, "parent": parent, "edge": edge}
    cands = {"v": points, "vec_id": np.arange(600), "label": np.zeros(600, int)}
    sizes = np.bincount(of)
    lanes = [hard_negatives.Kept(np.arange(n), np.full(n, -np.inf), np.full(n, np.inf), n, 5) for n in sizes]
    computed = hard_negatives.scan(tree, cands, lanes, True, 50)
    assert computed < 0.6 * 240 * 600
    for k, kept in enumerate(lanes):
        own = np.flatnonzero(of == k)
        for slot in range(len(own)):
            scores = points @ points[own[slot]]
            want = sorted((-int(s), j) for j, s in enumerate(scores) if j != own[slot])[:5]
            assert [(-int(s), int(j)) for s, j in zip(kept.score[kept.slot == slot], kept.id[kept.slot == slot], strict=True)] == want


# language-model scores


def brute_base(rows):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, t in rows if not out(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(t))) for i, t in rows]


def order(row):
    return (row[0] is None, row[0] or 0, row[2], round(row[5], 6))


def test_scores_of_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = sorted((tuple(r) for r in maxent.language_scores(docs).collect()), key=order)
    want = sorted(brute_base([(r.doc_id, r.text) for r in docs.collect()]), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    unseen = [r for r in got if r[1]]
    assert sum(r[6] for r in unseen) > sum(r[5] for r in unseen) + 0.1 * sum(r[2] for r in unseen)  # a tenth of a digit a token on texts not learnt from
    few = sorted((tuple(r) for r in maxent.language_scores(docs, most=3000).collect()), key=order)  # other counts come by the join
    assert [r[:5] for r in few] == [r[:5] for r in want] and np.allclose([r[5:] for r in few], [r[5:] for r in got], rtol=1e-6)


def test_scores_of_odd_rows(spark):
    rows = [(1, "A b a"), (1, "A b a"), (None, "b É é"), (5, None), (5, ""), (6, " \n\t "), (7, "w" * 100000 + " b"), (8, "b " * 50000), *((i, f"a b c{i}") for i in range(20, 60))]
    kind = "doc_id long, text string, token int, n int, row int, rest string"
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], kind).repartition(3)
    for most in (1 << 20, 4, 0):
        got = sorted((tuple(r) for r in maxent.language_scores(docs, most=most).collect()), key=order)
        want = sorted(brute_base(rows), key=order)
        assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5] for r in got], [r[5] for r in want])
        assert all(math.isfinite(r[6]) and r[6] <= 0 for r in got)
    assert maxent.language_scores(docs.limit(0)).count() == 0
    alone = docs.where(maxent.held_out(docs["doc_id"]))  # nothing to learn from
    assert alone.count() and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in maxent.language_scores(alone).collect())


def test_shares_sum_to_one():
    rng = np.random.default_rng(4)
    head, n, kind = np.sort(rng.integers(0, 1 << 62, 300).astype(np.uint64)), np.arange(400, 100, -1), rng.integers(0, maxent.ENDINGS, 300).astype(np.int32)
    rare = {k: (int(n[kind == k].sum()) + 10 * k, int((kind == k).sum()) + 2 * k) for k in range(maxent.ENDINGS)}  # 2k rare tokens that occur 5 times each
    model = maxent.Model(head, n, kind, rare)
    for t in model.tables:
        t += rng.normal(size=t.shape).astype(np.float32)
    symbol = np.concatenate([[7, 9, 11, s] for s in range(300)] + [[7, 9, 11, maxent.HEAD + k] for k in range(maxent.ENDINGS)])
    of, slot, rows, inner = maxent.features(symbol, np.full(len(symbol) // 4, 4))
    last = np.arange(3, len(symbol), 4)
    p, _ = maxent._softmax(maxent._logits(model.tables[0], rows[:, last], model.class_prior))
    share = p[np.arange(len(last)), of[last]].astype(float)
    known = slot[last] >= 0
    p, _ = maxent._softmax(maxent._logits(model.tables[1], inner[:, last][:, known], model.word_prior[of[last][known]]))
    share[known] *= p[np.arange(known.sum()), slot[last][known]]
    tokens = [(2 * k * 5.5 + 0.5) * 10 ** -model.rare_log[k] for k in range(maxent.ENDINGS)]  # all tokens of an ending and the one never seen
    assert np.allclose(tokens, 1)
    assert abs(share.sum() + p_of_empty_classes(model, rows[:, last[:1]]) - 1) < 1e-4


def p_of_empty_classes(model, rows):
    """Classes of the head without words get next to nothing."""
    p, _ = maxent._softmax(maxent._logits(model.tables[0], rows, model.class_prior))
    return float(p[0, 5 : maxent.HEAD // maxent.WIDTH].sum())
