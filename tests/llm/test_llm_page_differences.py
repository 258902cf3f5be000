"""Main text of pages: the difference to the nearest page takes part on every page, whether it marks an article or not."""

import difflib
import random

from sheetwise.llm import page_text

SCHEMA = "page_id long, url string, html string"


def test_lines_beside_a_marked_article_are_differenced(spark):
    def page(title, story, shared=""):
        return f"<body><div>Daily Paper</div><h1>{title}</h1><article><p>{story}</p>{shared}</article><div>All rights reserved</div><nav>{title} menu</nav></body>"

    said = "<p>He said so twice.</p>"
    rows = [
        (1, "http://a.org/news/one", page("First title", "First story.", said)), (2, "http://a.org/news/two", page("Second title", "Second story.", said)),
        (3, "http://b.org/alone", page("Lone title", "Lone story.")),
        (4, "http://c.org/x/1", page("Same", "The very same story.")), (5, "http://c.org/x/2", page("Same", "The very same story.")),
    ]
    got = {r.page_id: r.text for r in page_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        1: "First title\n\nFirst story.\n\nHe said so twice.", 2: "Second title\n\nSecond story.\n\nHe said so twice.",
        3: "Lone story.", 4: "The very same story.", 5: "The very same story.",
    }


def test_all_pages_are_compared_with_their_neighbour(spark):
    """Two pages a host, a third of them without a marked article, against a plain comparison of their lines."""
    rnd = random.Random(11)
    rows, lines, marked = [], {}, {}
    for host in range(40):
        frame = [f"Frame {host} {i}" for i in range(4)]
        for k in (0, 1):
            uid = 2 * host + k
            own = [f"Text {uid} {i} {rnd.random()}" for i in range(rnd.randint(2, 6))]
            lines[uid], marked[uid] = [*frame[:2], *own, *frame[2:]], own[1:] if host % 3 else []
            html = "".join(f"<div>{x}</div>" for x in [*frame[:2], own[0]])
            rest = "".join(f"<p>{x}</p>" for x in own[1:])
            rows.append((uid, f"http://h{host}.org/p/{k}", html + (f"<article>{rest}</article>" if host % 3 else rest) + "".join(f"<div>{x}</div>" for x in frame[2:])))
    got = {r.page_id: r.text for r in page_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for uid, own in lines.items():
        other = lines[uid ^ 1]
        same = {i + n for i, _, size in difflib.SequenceMatcher(None, own, other, autojunk=False).get_matching_blocks() for n in range(size)}
        assert got[uid] == "\n\n".join(x for i, x in enumerate(own) if i not in same or x in marked[uid]), uid
