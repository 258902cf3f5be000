"""Main text of web pages: differences to the page with the nearest URL, and marked structure.

A page becomes the lines of its block elements. Lines under menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments go by their element, role or class; a compound class name does not remove what holds the article. Every page is
compared with another page of its host: pages are sorted by path, the neighbour whose path has more in common is taken (the one
before, in a tie), the lines of both are aligned by longest common subsequence, and the lines they share are deleted as the
site's own. Pages with next to nothing left on both sides are copies of each other and delete nothing; a page that
lies whole within the other (a stub, a listing without entries) has no text of its own.

If the page marks its article, the article's lines stay even if shared, because two articles may share passages, and of the lines beside it
(a heading or a summary above the article, the site's frame) those stay that are the page's own. Without a neighbour, or beside a copy, the
difference says nothing: then the article's lines are the text of a page that marks one, and all lines that of any other page.

Null pages are empty. A null URL has no host and no neighbour; an article marked in such a page is found all the same. Repeated rows are
handled one by one, and are copies of each other. Broken markup is read leniently. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import written
from sheetwise.session import ship_package

# What a tag looks like, and what elements, roles and class words mean.
TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul head".split()
)
SKIPPED = frozenset("nav header footer aside form menu dialog button select object svg canvas audio video head".split())
ARTICLE = frozenset(("article", "main"))
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo "
    "related replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Beside these, a word tells how a page is laid out, not what the element is: has-sidebar, comments-open.
STATES = frozenset("has have no non not without with hide show open opened close closed enabled disabled active allowed free layout".split())
MARKED = re.compile(r"\brole\s*=\s*[\"']?(main|article)\b")
#: Elements that end an open paragraph or item of the same list.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Two pages are copies if neither has more than this part of the longer one's text left beside the shared lines.
COPY = 0.01


def _named(value: str, in_article: bool) -> int:
    """2 if a class or id is a skipped word itself, 1 if one begins or ends with such a word, else 0. Words of state say nothing."""
    words = SKIPPED_WORDS - {"header"} if in_article else SKIPPED_WORDS
    verdict = 0
    for token in value.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", token) if x]
        if parts and STATES.isdisjoint(parts) and not words.isdisjoint((parts[0], parts[-1])):
            verdict = max(verdict, 2 if len(parts) == 1 else 1)
    return verdict


def _skips(name: str, attributes: str, in_article: bool, holds: Callable[[], bool]) -> bool:
    if name in SKIPPED and not (in_article and name == "header"):
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id") and name not in ("html", "body"):
            verdict = _named(value, in_article)
            if verdict == 2 or verdict == 1 and name not in ARTICLE and (in_article or not holds()):
                return True
        if key == "role" and value in SKIPPED_ROLES or key == "aria-hidden" and value == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes.lower())))


class _Wrappers:
    """Which elements hold the page's article: its first ``main``, or else its first ``article``."""

    def __init__(self, page: str):
        self.page = page
        self.tags: list[tuple[int, str, bool]] | None = None

    def _read(self) -> None:
        self.tags, firsts, at = [], {}, 0
        while tag := TAG.search(self.page, at):
            at, name = tag.end(), (tag[2] or tag[5] or "").lower()
            closing, attributes = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
            if name in RAW and not closing:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(self.page, at)
                at = end.end() if end else len(self.page)
            elif name:
                role = MARKED.search(attributes)
                if not closing and (name in ARTICLE or role) and not _skips(name, attributes, False, lambda: True):
                    firsts.setdefault(role[1] if role else name, tag.start())
                if not attributes.endswith("/"):
                    self.tags.append((tag.start(), name, closing))
        self.article = firsts.get("main", firsts.get("article", -1))

    def hold(self, start: int, name: str) -> bool:
        """Whether the element that starts here is still open where the article starts."""
        if self.tags is None:
            self._read()
        depth = 0
        for i in range(bisect.bisect_left(self.tags, (start,)), len(self.tags)):
            at, other, closing = self.tags[i]
            if at >= self.article:
                break
            if other == name:
                depth += -1 if closing else 1
                if not depth:
                    return False
        return start < self.article


def lines_of(page: str) -> tuple[list[str], list[bool]]:
    """The page's lines outside skipped parts, and whether each stands in a marked article."""
    lines: list[str] = []
    marks: list[bool] = []
    held: list[str] = []
    wrappers = _Wrappers(page)
    open_: list[tuple[str, bool, bool]] = []  # name, skipped, in article
    skipped = article = False

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            lines.append(text)
            marks.append(article)

    at = 0
    while True:
        tag = TAG.search(page, at)
        if not skipped:
            held.append(page[at : tag.start() if tag else len(page)])
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = tag[1] or tag[4], tag[3] or tag[6] or ""
        if closing:
            if name in BLOCKS and not skipped:
                flush()
            if name == "br" and not skipped:
                held.append(" ")
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    del open_[i:]
                    break
        else:
            if name in BLOCKS and not skipped:
                flush()
            elif name == "br" and not skipped:
                held.append(" ")
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if name in ENDS:
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i][0] in ENDS[name]:
                        del open_[i:]
                        break
                    if open_[i][0] in ("ul", "ol", "dl", "table", "select", "div", "article", "main"):
                        break
            if name not in VOID and not attributes.endswith("/"):
                if name == "p" and open_ and open_[-1][0] == "p":  # a paragraph ends an open one
                    open_.pop()
                hide, inside = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
                hide = hide or _skips(name, attributes, inside, lambda: wrappers.hold(tag.start(), name))  # noqa: B023
                marked = name in ARTICLE or MARKED.search(attributes)
                open_.append((name, hide, inside or bool(marked) and not hide))
        skipped, article = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
    if not skipped:
        flush()
    return lines, marks


def _line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of positions: equal ends first, then the longest rising chain of matches."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict = {}
    for j in range(head, len(b) - tail):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []  # least end of a chain of each length
    chains: list = []
    for i in range(head, len(a) - tail):
        for j in reversed(where.get(a[i], ())):
            k = bisect.bisect_left(ends, j)
            link = (i, j, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    middle, link = [], chains[-1] if chains else None
    while link:
        middle.append(link[:2])
        link = link[2]
    return [*((i, i) for i in range(head)), *reversed(middle), *((len(a) - t, len(b) - t) for t in range(tail, 0, -1))]


def _own(lines: list[int], sizes: list[int], other: list[int], other_sizes: list[int]) -> list[int] | None:
    """Positions of the lines that are not shared with the other page; None if the two are copies."""
    shared = common_lines(lines, other)
    same, longer = sum(sizes[i] for i, _ in shared), max(sum(sizes), sum(other_sizes))
    left = max(sum(sizes) - same, sum(other_sizes) - same)
    if left <= COPY * longer:
        return None
    gone = {i for i, _ in shared}
    return [i for i in range(len(lines)) if i not in gone]


def _stays(marks: list[bool], own: list[int] | None) -> list[int]:
    """Positions of the lines that are the page's text, from the marks of its article and the lines of its own, if known."""
    places = range(len(marks))
    if own is None:
        return [i for i in places if marks[i]] if any(marks) else list(places)
    return sorted({*own, *(i for i in places if marks[i])})


def _packed(lines: list[str]) -> bytes:
    """Lines hold no white space but blanks, so line ends part them."""
    return zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))


def _unpacked(packed: bytes) -> list[str]:
    return zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n")


_PARSED = "page_id long, url string, host string, path string, packed binary, marks array<boolean>, hashes array<long>, sizes array<int>"


def _parsed(pages: DataFrame) -> DataFrame:
    """Pages as lines, packed to travel, which of them stand in a marked article, and their hashes, by place in the host."""
    names = re.findall(r"(\w+) (?:long|string|binary|array)", _PARSED)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines_of(page or "") for page in batch["html"].to_pylist()]
            extra = [
                pa.array([_packed(lines) for lines, _ in found], pa.binary()), pa.array([marks for _, marks in found], pa.list_(pa.bool_())),
                pa.array([[_line_hash(x) for x in lines] for lines, _ in found], pa.list_(pa.int64())),
                pa.array([[len(x) for x in lines] for lines, _ in found], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("page_id", "url", "host", "path")), *extra], names)

    bare = F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    path = F.regexp_replace(F.regexp_replace(bare, r"^[^/]*", ""), r"(?:\.html?|/)$", "")
    named = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.lower(F.regexp_extract(bare, r"^[^/:]*", 0)).alias("host"), path.alias("path"), "html"
    )
    return named.mapInArrow(parse, _PARSED)


def _neighbours(slim: DataFrame) -> DataFrame:
    """``uid`` with the uids before and after it in its host, by path. Sorted by range, so a large host is spread over tasks."""
    parts = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "uid"]
    ranged = slim.select(*order).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "page-order")
    inside = Window.partitionBy("part").orderBy(*order)
    one = F.struct(*order)
    near = ranged.withColumns({"prev": F.lag(one).over(inside), "next": F.lead(one).over(inside)})
    edges = ranged.groupBy("part").agg(F.min(one).alias("first"), F.max(one).alias("last"))  # one row per partition
    across = Window.orderBy("part")
    edges = edges.select("part", F.lag("last").over(across).alias("edge_prev"), F.lead("first").over(across).alias("edge_next"))
    near = near.join(edges, "part").withColumns({"prev": F.coalesce("prev", "edge_prev"), "next": F.coalesce("next", "edge_next")})
    own = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.col(c))
    near = near.withColumns({"prev": own("prev"), "next": own("next")})

    def shared(c: str) -> Column:
        """How many leading characters of the paths agree."""
        n = F.least(F.length("path"), F.length(f"{c}.path"))
        same = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring("path", F.lit(1), i) == F.substring(F.col(f"{c}.path"), F.lit(1), i))
        return F.when(F.col(c).isNull(), -1).when(n == 0, 0).otherwise(F.size(same))

    nearest = F.when(shared("next") > shared("prev"), F.col("next.uid")).otherwise(F.coalesce("prev.uid", "next.uid"))
    return near.select("uid", nearest.alias("near"))


def _staying(parsed: DataFrame, places: DataFrame) -> DataFrame:
    """``uid, stays``: the positions of each page's lines that are its text, after it was compared with its neighbour. Only hashes travel."""
    slim = parsed.select("uid", "marks", "hashes", "sizes")
    other = parsed.select(F.col("uid").alias("near"), F.col("hashes").alias("near_hashes"), F.col("sizes").alias("near_sizes"))
    pairs = slim.join(places, "uid", "left").join(other, "near", "left")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for marks, *sides in zip(*(batch[c].to_pylist() for c in ("marks", "hashes", "sizes", "near_hashes", "near_sizes")), strict=True):
                stays.append(_stays(marks, None if sides[2] is None else _own(*sides)))
            yield pa.RecordBatch.from_arrays([batch["uid"], pa.array(stays, pa.list_(pa.int32()))], ["uid", "stays"])

    return pairs.select("uid", "marks", "hashes", "sizes", "near_hashes", "near_sizes").mapInArrow(differ, "uid long, stays array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    ship_package(pages.sparkSession)
    parsed = written(_parsed(pages).withColumn("uid", F.monotonically_increasing_id()), "pages")
    places = written(_neighbours(parsed.where(F.col("host") != "").select("uid", "host", "path")), "neighbours")
    stays = written(_staying(parsed, places), "stays")  # written, so that its shuffle files go before the texts travel

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for packed, places in zip(batch["packed"].to_pylist(), batch["stays"].to_pylist(), strict=True):
                lines = _unpacked(packed)
                texts.append("\n\n".join([lines[i] for i in places]))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    differing = parsed.select("uid", "page_id", "url", "packed").join(stays, "uid")
    texts = differing.select("page_id", "url", "packed", "stays").mapInArrow(cut, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
