"""Pages, vectors and the pipeline."""

import collections
import html
import re

import numpy as np
import pytest

import corpus_pipeline
from sheetwise.llm import inner_products, page_text, queries
from sheetwise.llm.common import table, written

FOLDER = "/root/testdata/sf0.001"


# pages


def test_marked_articles_on_the_table(spark):
    pages = table(spark, FOLDER, "pages")
    got = {r.page_id: r for r in page_text.main_text(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*)</article>", row.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[row.page_id].text == want and got[row.page_id].n_chars == len(want) and got[row.page_id].url == row.url


FRAME = "<div>Our site menu</div><div>{}</div><div>All rights kept</div>"


def test_nearest_pages_are_differenced(spark):
    rows = [
        (1, "http://h.org/a/1?x=1", FRAME.format("First story.<p>More of it.")), (2, "https://H.org/a/2", FRAME.format("Second &amp; last story.")),
        (3, None, "<p>Alone"), (4, "http://h.org/z", None), (5, "http://other.org/a/1", "<p>Our site menu"), (6, "not a url", "<p>Kept"),
        (7, "http://copies.org/x/1", FRAME.format("The same page.")), (7, "http://copies.org/x/1", FRAME.format("The same page.")), (None, "http://n.org", ""),
    ]
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, text string, uid int").repartition(4)
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in page_text.main_text(docs).collect())
    whole = "Our site menu\n\nThe same page.\n\nAll rights kept"
    want = [
        (1, "First story.\n\nMore of it."), (2, "Second & last story."), (3, "Alone"), (4, ""), (5, "Our site menu"), (6, "Kept"), (7, whole), (7, whole), (None, ""),
    ]
    assert got == collections.Counter((i, t, len(t)) for i, t in want)
    assert page_text.main_text(docs.limit(0)).count() == 0


def test_short_articles_in_a_large_frame(spark):
    menu = "".join(f"<div>Menu entry number {i}</div>" for i in range(40))
    frame = menu + "<div>{}</div>" + "<div>All rights kept</div>" * 5
    rows = [
        (1, "http://h.org/a/1", frame.format("A short story of one line.")), (2, "http://h.org/a/2", frame.format("Another short story.")),
        (3, "http://s.org/a/1", frame.format("Only this page has a text.")), (4, "http://s.org/a/2", frame.format("")),
        (5, "http://c.org/a/1", frame.format("Seen twice.") + "1"), (6, "http://c.org/a/2", frame.format("Seen twice.") + "2"),
    ]
    got = {r.page_id: r.text for r in page_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "A short story of one line." and got[2] == "Another short story." and got[3] == "Only this page has a text." and got[4] == ""
    assert all("Seen twice." in got[i] and "Menu entry number 3" in got[i] for i in (5, 6))  # near copies


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><header><h1>Title</h1></header>a&nbsp;b  c<br>d<script>var x='<p>no</p>'</script><p>e&lt;f&#233;</article>", ["Title", "a b c d", "e<fé"]),
        ("<main><p class='x comments'>no</p><div id=cookie-notice>no<div>no</div></div><p>yes<form>no</form>tail</main>", ["yes", "tail"]),
        ("<article><nav><ul><li>no</nav><ul><li>one<li>two</ul><!-- <p>no --><table><tr><td>x<td>y</table></article>", ["one", "two", "x", "y"]),
        ("<article>open <b>bold<p>next", ["open bold", "next"]),
        ("<article>1 < 2 and <a href='x>y'>link</a></article><footer>no", ["1 < 2 and link"]),
        ("<article><style>p{}</style><p hidden>no</p><p>yes</p><textarea>no</textarea></article>", ["yes"]),
    ],
)
def test_lines(page, want):
    lines, marks = page_text.lines_of(page)
    assert [x for x, m in zip(lines, marks, strict=True) if m] == want


@pytest.mark.parametrize(
    "page",
    [
        "<div class='site has-sidebar'>{}<div class=sidebar>no</div></div>", "<div class='layout no-sidebar'>{}</div><div class='site-footer'>no</div>",
        "<article class='post comments-open'>{}<div class='comments-area'>no</div></article>", "<main id='search-results'>{}</main>",
        "<div class='menu-wrapper'><div>x</div><main>{}</main></div>", "<div id=page-widget><script>'<article>'</script><article>{}</article></div>",
        "<div class='content-with-sidebar'>{}</div><div class='related-posts'>no<article class=comment>no</article></div>",
        "<div class='cookie-notice'>no</div><div class='widget-page'><article>{}</article></div><div class='related-posts'><article>no</article></div>",
        "<article class='share-post'>{}<div class='related-posts'><article>no</article></div></article>",
    ],
)
def test_wrappers_of_the_text_stay(page):
    lines, marks = page_text.lines_of(page.format("<p>The story.</p>"))
    assert "The story." in lines and "no" not in lines and ("<main" in page or "<article>" not in page or any(marks))


@pytest.mark.parametrize("seed", range(30))
def test_longest_common_lines(seed):
    rng = np.random.default_rng(seed)
    a, b = (list(rng.integers(0, 5, rng.integers(0, 14))) for _ in range(2))
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    pairs = page_text.common_lines(a, b)
    assert len(pairs) == best[-1, -1] and all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_very_long_page(spark):
    page = "<article>" + "".join(f"<p>line {i} &amp; more" for i in range(20_000)) + "</article>"
    row = page_text.main_text(spark.createDataFrame([(1, "http://a.org", page)], "page_id long, url string, html string")).first()
    assert row.text.count("\n\n") == 19_999


# vectors


def brute_top(rows, every, top):
    out = collections.Counter()
    usable = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in usable), default=0)
    usable = [(i, np.pad(v, (0, width - len(v)))) for i, v in usable]
    asked = {(i, tuple(v)) for i, v in usable if i % every == 0}
    for q, v in asked:
        best = sorted((-int(np.dot(v, c)), i) for i, c in usable if i != q)[:top]
        for rank, (score, i) in enumerate(best, 1):
            out[(q, rank, i, -score)] += 1
    return out


def test_top_products(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 5])]) for i in range(700)]
    rows += [(i, rows[0][1]) for i in range(700, 760)] + [rows[50], rows[50]]
    rows += [(760, None), (761, [None] * 8), (800, [float("nan")] * 8), (801, [float("inf")] * 8), (None, rows[3][1]), (802, []), (850, [1.0, -2.0]), (100, rows[7][1])]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, norm int").repartition(5)
    rows = [(r.vec_id, r.embedding) for r in docs.collect()]  # as floats
    got = collections.Counter(tuple(r) for r in inner_products.top_products(docs).collect())
    assert got == brute_top(rows, 50, 5)
    few = docs.where("vec_id in (0, 1, 2)")
    assert inner_products.top_products(few).count() == 2
    assert inner_products.top_products(docs.limit(0)).count() == 0


def test_search_prunes_by_length(spark, monkeypatch):
    """Short vectors cannot reach the thresholds of long ones; results stay exact."""
    monkeypatch.setattr(inner_products, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (10 if i % 3 else 0.01)]) for i in range(400)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in docs.collect()]
    assert collections.Counter(tuple(r) for r in inner_products.top_products(docs).collect()) == brute_top(rows, 50, 5)


# the pipeline


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, FOLDER), f"test-{name}")
        if name != "pack":
            assert out.columns == first.columns, name
            ids = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
            assert set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}
            assert name == "mix" or max(ids.values()) == 1
        docs = out
    assert docs.count() > 0
    again = corpus_pipeline.run(spark, FOLDER)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert collections.Counter(map(tuple, again.select(key).collect())) == collections.Counter(map(tuple, docs.select(key).collect()))


def test_stages_on_nothing(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), "none")
    assert docs.count() == 0


def test_every_query_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES) == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)
