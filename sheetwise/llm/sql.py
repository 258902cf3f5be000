"""The dealt queries in DuckDB SQL, over the same tables.

Not expressible: op2 (keyed hashes), op7 (markup), op8 (token ids), op9 and op12 (training); the tests hold those against brute force.
"""

from __future__ import annotations

from sheetwise.llm import quality, secrets

W = r"'[^\x20\x09-\x0D]+'"
GAP = r"'[\x20\x09-\x0D]+'"

OP1 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS oid,
         regexp_extract_all(coalesce(text, ''), {W}) AS w FROM documents),
s AS (
  SELECT r, doc_id, oid, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s FROM d),
keyed AS (SELECT r, doc_id, oid, s, CASE WHEN len(s) > 0 THEN md5(len(s) || array_to_string(s, chr(10))) END AS k FROM s),
sets AS (SELECT k, min(oid) AS oid, count(*) AS n_rows, any_value(s) AS s FROM keyed WHERE k IS NOT NULL GROUP BY k),
tokens AS (SELECT k, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.k AS u, b.k AS v FROM tokens a JOIN tokens b ON a.t = b.t AND a.k <> b.k
  GROUP BY a.k, b.k, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
reach(k, other) AS (
  SELECT k, k FROM sets UNION SELECT reach.k, pairs.v FROM reach JOIN pairs ON reach.other = pairs.u),
class AS (SELECT reach.k, min(o.oid) AS class_id FROM reach JOIN sets o ON o.k = reach.other GROUP BY reach.k),
links AS (SELECT u AS k, count(*) AS n FROM pairs GROUP BY u)
SELECT keyed.doc_id, CASE WHEN keyed.k IS NULL THEN keyed.doc_id WHEN class_id < 9223372036854775807 THEN class_id END AS class_id,
       coalesce(links.n, 0) AS n_links, coalesce(sets.n_rows - 1, 0) AS n_copies
FROM keyed LEFT JOIN sets ON keyed.k = sets.k LEFT JOIN class ON keyed.k = class.k LEFT JOIN links ON keyed.k = links.k
"""

OP3 = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
WHERE rank <= 5
"""


def _op4() -> str:
    names = [name for name, _ in quality.CLASSES]
    steps, last = [], "text"
    for name, pattern in quality.CLASSES:
        escaped = pattern.replace("'", "''")
        steps.append(f"regexp_replace({last}, '{escaped}', '', 'g') AS after_{name}")
        last = f"after_{name}"
    chained, inner = "SELECT *, len(text) AS n_chars FROM d", ""
    for i, step in enumerate(steps):
        chained = f"SELECT *, {step} FROM ({chained})"
    befores = ["text", *[f"after_{n}" for n in names[:-1]]]
    counts = ", ".join(f"len({b}) - len(after_{n})" for b, n in zip(befores, names, strict=True))
    listed = " ".join(
        f"WHEN lang = '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in sorted(quality.COMMON_WORDS.items())
    )
    k = len(names) + 1
    sums = ", ".join(f"coalesce(sum(CAST(floor(classes[{i + 1}] * 1000000 / n_chars) AS BIGINT)), 0) / (count(*) * 1e6)" for i in range(k))
    word_sums = ", ".join(f"coalesce(sum(CAST(floor(commons[{i + 1}] * 1000000 / n_words) AS BIGINT)), 0) / (count(*) * 1e6)" for i in range(10))

    def distance(own: str, ref: str, n: int) -> str:
        part = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"
        terms = " + ".join(f"({part(f'{own}[{i}]', f'{ref}[{i}]')} + {part(f'{ref}[{i}]', f'{own}[{i}]')})" for i in range(1, n + 1))
        return f"sqrt(greatest(({terms}) / 2, 0))"

    rest = lambda x: f"list_concat({x}, [greatest(1 - list_sum({x}), 0)])"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {W}) AS w FROM documents),
win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM (
    SELECT r, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
rep AS (
  SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM (SELECT r, i, unnest([0, 1, 2]) AS j FROM win WHERE n > 1) GROUP BY r),
c AS ({chained}),
f AS (
  SELECT c.r, doc_id, coalesce('=' || lang, '') AS lang, n_chars, len(w) AS n_words, n_chars - (len(after_lower) - len(after_blank)) AS word_chars,
    len(regexp_replace(after_{names[-1]}, '{quality.SYMBOLS}', '', 'g')) AS n_symbols, coalesce(n_repeat_words, 0) AS n_repeat_words,
    [{counts}, len(after_{names[-1]})] AS classes,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, {W})] AS lines,
    CASE {listed} END AS listed, w
  FROM c LEFT JOIN rep ON c.r = rep.r),
g AS (
  SELECT * EXCLUDE (lines, listed, w), len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    CASE WHEN listed IS NOT NULL THEN [len([y FOR y IN w IF y = x]) FOR x IN listed] END AS commons,
    n_words < {quality.BASE_WORDS} OR 100 * n_repeat_words > {quality.BASE_REPEATS} * n_words AS base_failed FROM f),
ref AS (
  SELECT lang, [{sums}] AS class_means, [{word_sums}] AS common_means FROM g
  WHERE n_words >= {quality.MIN_WORDS} AND n_chars >= {quality.MIN_CHARS} GROUP BY lang HAVING count(*) >= {quality.MIN_DOCS}),
h AS (
  SELECT g.*, class_means, {rest("common_means")} AS ref_words, [x / n_chars FOR x IN classes] AS own_classes,
    {rest("[x / n_words FOR x IN commons]")} AS own_words FROM g LEFT JOIN ref ON g.lang = ref.lang),
j AS (
  SELECT *, CASE WHEN class_means IS NOT NULL AND n_chars >= {quality.MIN_CHARS} THEN {distance("own_classes", "class_means", k)} END AS class_distance,
    CASE WHEN class_means IS NOT NULL AND n_words >= {quality.MIN_WORDS} AND commons IS NOT NULL THEN {distance("own_words", "ref_words", 11)} END AS word_distance
  FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(class_distance, 0) <= {quality.CLASS_DISTANCE} AND coalesce(word_distance, 0) <= {quality.WORD_DISTANCE} AS kept,
  CAST(floor(class_distance * 1e6) AS BIGINT) AS class_ppm, CAST(floor(word_distance * 1e6) AS BIGINT) AS word_ppm
FROM j
"""


OP5 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS oid,
         regexp_extract_all(coalesce(text, ''), {W}) AS w FROM documents),
win AS (
  SELECT r, p, rank() OVER (PARTITION BY k ORDER BY oid, p) AS place FROM (
    SELECT r, oid, p, array_to_string(w[p:p + 19], ' ') AS k FROM (SELECT r, oid, w, unnest(range(1, len(w) - 18)) AS p FROM d))),
gone AS (SELECT DISTINCT r, p + j AS i FROM (SELECT r, p, unnest(range(0, 20)) AS j FROM win WHERE place > 1)),
word AS (SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
"""

OP6 = f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), {W})) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, text FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
n AS (SELECT *, row_number() OVER (ORDER BY src = '', src) - 1 AS n FROM s),
r AS (SELECT *, [5, 2, 1][n % 3 + 1] AS weight, 2 * source_size AS cap, 2 * source_size / [5, 2, 1][n % 3 + 1] AS full_at FROM n),
e AS (
  SELECT *, row_number() OVER (ORDER BY full_at, n) AS pos,
    (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY full_at, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY full_at, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS fin FROM r),
v AS (SELECT arg_min(fin, pos) AS fin FROM e WHERE fin <= full_at),
t AS (SELECT src, source_size, weight, least(CAST(cap AS DOUBLE), weight * v.fin) AS target FROM e, v),
p AS (
  SELECT doc_id, size, source_size, weight, target,
    sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)) AS BIGINT) AS taken,
  CAST(start + size AS DOUBLE) / weight AS finish
FROM p
"""


def _op10() -> str:
    kinds = []
    for kind, (_, pattern, group, _) in enumerate(secrets.KINDS):
        quoted = "'" + pattern.replace("'", "''") + "'"
        kinds.append(
            f"SELECT r, {kind} AS kind, regexp_split_to_array(t, {quoted}) AS g, regexp_extract_all(t, {quoted}) AS h, "
            f"regexp_extract_all(t, {quoted}, {group}) AS v FROM d"
        )
    least = [k[3] for k in secrets.KINDS]
    names = [k[0] for k in secrets.KINDS]
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(names))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(kinds)}),
c AS (SELECT r, kind, i, len(g[i]) AS gap, h[i] AS hit, v[i] AS val FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m)),
p AS (
  SELECT r, kind, val, len(hit) AS n, sum(gap + len(hit)) OVER (PARTITION BY r, kind ORDER BY i) AS fin FROM c),
s AS (
  SELECT r, kind, CAST(fin - n AS BIGINT) AS start, CAST(fin AS BIGINT) AS fin, val,
    len(list_distinct(string_split(val, ''))) >= {secrets.LEAST_VARIETY} AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AS random
  FROM p WHERE len(val) >= {least}[kind + 1]),
o AS (
  SELECT val, sum(repos) AS n_repos, count(*) AS n_owners FROM (
    SELECT val, source, count(*) AS repos FROM (SELECT DISTINCT val, source, doc_id FROM s JOIN d USING (r)) GROUP BY val, source) GROUP BY val),
j AS (
  SELECT s.*, n_owners >= {secrets.MANY_OWNERS} AND n_repos >= {secrets.MANY_REPOS} AS example FROM s JOIN o ON s.val = o.val),
k AS (
  SELECT *, NOT example AND random AS live,
    max(CASE WHEN kind < 3 THEN fin END) OVER (PARTITION BY r ORDER BY start, fin, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_before,
    min(CASE WHEN kind < 3 THEN start END) OVER (PARTITION BY r ORDER BY start, fin, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS base_after
  FROM j),
f AS (SELECT * FROM k WHERE kind < 3 OR live AND coalesce(base_before, 0) <= start AND coalesce(base_after, fin) >= fin),
a AS (
  SELECT r, {counts}, count(*) FILTER (example) AS n_example, count(*) FILTER (live) AS n_live,
    string_agg({names}[kind + 1] || ':' || start || ':' || fin, ',' ORDER BY start, kind) AS spans,
    string_agg({names}[kind + 1] || ':' || start || ':' || fin, ',' ORDER BY start, kind) FILTER (kind < 3) AS base
  FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in names)}, coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.r = a.r
"""


#: CRC-32 table and checksum of a list of bytes.
_CRC_TABLE = "[list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) FOR i IN range(256)]"

OP11 = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
runs AS MATERIALIZED (
  SELECT id, run, len(run) AS size, count(*) AS k FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
      translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) GROUP BY id, run),
bytes AS (
  SELECT id, run, size, k, list_prepend(4294967295, flatten([CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END
    FOR c IN string_split(id || ':' || run, '')])) AS b FROM runs),
marked AS (
  SELECT id, run, size, k, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM bytes, crc),
cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % size AS INTEGER)) || substring(run, CAST(h % size AS INTEGER) + 2) ELSE run END AS word, k FROM marked),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE len(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
less AS (SELECT word, n, left(word, i - 1) AS a, substring(word, i + 1) AS z FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT u.word, v.word AS other, v.n AS m FROM less u JOIN less v ON u.a = v.a AND u.z = v.z AND u.word <> v.word
  UNION SELECT u.word, v.word, v.n FROM less u JOIN words v ON u.a || u.z = v.word
  UNION SELECT v.word, u.word, u.n FROM less u JOIN words v ON u.a || u.z = v.word),
ranked AS (
  SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM near),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN ranked ON w.word = ranked.word AND r = 1),
chain(word, here, next) AS (
  SELECT word, word, form FROM forms UNION ALL SELECT chain.word, chain.next, forms.form FROM chain JOIN forms ON chain.next = forms.word)
SELECT forms.word, forms.form, chain.here AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n
FROM forms JOIN chain ON forms.word = chain.word AND chain.next IS NULL
"""

OP13 = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
anchors AS (SELECT row_number() OVER () AS a, * FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0)),
s AS MATERIALIZED (
  SELECT a, anchors.vec_id AS anchor_id, c.vec_id, c.label = anchors.label AS alike, CAST(list_dot_product(anchors.v, c.v) AS BIGINT) AS score
  FROM anchors JOIN v c ON c.vec_id <> anchors.vec_id),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS p FROM s WHERE alike QUALIFY p <= 5),
found AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.vec_id) AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM positives p JOIN s ON s.a = p.a AND NOT s.alike AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10
"""

SQL: dict[str, str] = {
    "op1_chosen_path_join": OP1,
    "op3_norm_sorted_search": OP3,
    "op4_distribution_divergence": _op4(),
    "op5_suffix_tree_repeats": OP5,
    "op6_fair_queue_mix": OP6,
    "op10_secret_ownership": _op10(),
    "op11_trie_pair_variants": OP11,
    "op13_anchor_tree_negatives": OP13,
}
