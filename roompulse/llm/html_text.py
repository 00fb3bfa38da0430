"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. The text lengths of the lines, summed over a sliding window,
rise where the article begins (surge) and fall to nothing where it ends (dive); lines between a surge and its dive
are kept, with what stands between them in the same container. Text that markup names as something else (menus, notices, forms, comments, ...) has length 0, and text that
markup names as the article always counts as dense, so that its short paragraphs make no dive.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and the words in class, id and role that mark what is not the article.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table
tbody td tfoot th thead title tr ul""".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
OUTSIDE = frozenset("nav footer aside form dialog button menu head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SOFT = frozenset("p li dt dd td th tr option".split())   # closed by the next element of their kind
MARKS = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos
promotion promotions banner banners sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie
cookies consent notice notices alert alerts popup modal newsletter subscribe subscription share sharing social related
recommended comment comments respond replies login signin signup search widget widgets toolbar pagination pager copyright
disclaimer contentinfo complementary skip""".split())
HEADERS = frozenset("site-header page-header".split())
# Words after a mark that say no more than that it is a part of the page.
PARTS = frozenset("""area bar block blocks body bottom box button buttons center column container content count feed field
fixed form group holder icon icons inner inline item items large left link links list main outer panel primary right row
secondary section slot small space text title top unit wrap wrapper zone""".split())
WORDS = re.compile(r"[\s_-]+")
HOMES = frozenset("article body center div main section td".split())     # what holds the blocks of one text
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""",
                 re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
STATE = re.compile(r"(?:^|[_-])(?:has|with|without|no|not|hide|hides)[_-]|[_-](?:open|opened|closed|collapsed|enabled|disabled)$",
                   re.I)    # a token that says what an element has or lacks, not what it is
REPLIES = frozenset("comment comments respond replies".split())
SPACES = re.compile(r"\s+")

WINDOW = 3      # lines summed
SURGE = 80      # characters outside links in a window where an article without markup begins


def _mark(token: str) -> str | None:
    """The mark that a token of class, id or role names: its last word, other than numbers and words for parts. What stands
    before tells which one it is; a mark before another noun (``share-price``) is none."""
    token = token.lower()
    if token in HEADERS:
        return token
    words = [w for w in WORDS.split(token) if w and not w.isdigit()]
    while len(words) > 1 and words[-1] in PARTS:
        words.pop()
    return words[-1] if words and words[-1] in MARKS else None


def _lines(page: str) -> list[tuple[str, int, int]]:
    """``(text, weight, home)`` of each block in page order; home is the container that holds it, -1 if the block is marked
    as something else than the article, which makes its weight 0.

    A class, id or role marks no noise where its element holds most of the page's text outside links and the page names
    no article: such a name belongs to the layout. Readers' replies may be longer than the article and stay marked.
    """
    layout: set[int] = set()
    while True:
        lines, wrong = _weighted(page, layout)
        if wrong is None:
            return lines
        layout.add(wrong)


def _weighted(page: str, layout: set[int]) -> tuple[list[tuple[str, int, int]], int | None]:
    """The lines, and where an element begins that is marked as noise but holds most of the text; ``layout`` are
    places of elements whose marks do not count."""
    lines: list[tuple[str, int, int]] = []
    homes: list[tuple[str, int]] = [("", 0)]    # open containers and where they begin
    parts: list[str] = []
    linked = 0
    skip: list[str] = []        # open elements whose text does not count, outermost first
    article = 0                 # open article or main elements
    heads: list[str] = []       # open header elements inside the article
    in_link = False
    heading = False
    total = 0                   # characters outside links
    named = False               # whether an article or main element holds text
    marked_at = None            # where the outermost element on ``skip`` begins, if only a name marks it
    held: dict[int, int] = {}   # characters outside links in each of these

    def flush() -> None:
        nonlocal linked, total, named
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                plain = max(0, len(text) - linked)
                total += plain
                if skip and marked_at is not None:
                    held[marked_at] = held.get(marked_at, 0) + plain
                named = named or bool(article and not skip and plain)
                if skip or (heads and not heading):
                    weight = 0
                elif article:
                    weight = max(SURGE, len(text))
                else:
                    weight = max(0, len(text) - 2 * linked)
                lines.append((text, weight, -1 if skip or (heads and not heading) else homes[-1][1]))
            parts.clear()
        linked = 0

    at = 0
    find = TAG.search
    while (m := find(page, at)) is not None:
        if m.start() > at:
            piece = page[at:m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        closing = m[1] == "/"
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if name == "title":
                flush()
            if end is not None:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            continue
        if name == "a":
            in_link = not closing
        if name == "br":
            parts.append(" ")
        if name not in BLOCKS and name not in OUTSIDE:
            if not closing and not skip and name not in VOID and _marked(m[3], m.start() in layout):
                flush()
                marked_at = m.start() if _named(m[3]) else None
                skip.append(name)
            elif closing and skip and name in skip:
                flush()
                del skip[len(skip) - 1 - skip[::-1].index(name):]
            elif skip and not closing and name in skip and name not in VOID:
                skip.append(name)
            continue
        flush()
        if name in HEADINGS:
            heading = not closing
        if name in HOMES and not closing:
            homes.append((name, m.start() + 1))
        elif name in HOMES:
            last = next((i for i in range(len(homes) - 1, 0, -1) if homes[i][0] == name), None)
            if last is not None:
                del homes[last:]
        if closing:
            if name in skip:
                del skip[len(skip) - 1 - skip[::-1].index(name):]
            if name in ("article", "main"):
                skip.clear()
                heads.clear()
                article = max(0, article - 1)
            elif name == "header" and heads:
                heads.pop()
            elif name in ("body", "html"):
                article = 0
            continue
        if skip and skip[-1] in SOFT and (name == skip[-1] or skip[-1] == "p"):
            skip.pop()
        mark = _marked(m[3], m.start() in layout)
        if name in ("article", "main") and not mark:
            skip.clear()
            article += 1
        elif skip:
            if name in skip and name not in VOID:
                skip.append(name)
        elif name in OUTSIDE or (name == "header" and not article) or mark:
            if name not in VOID and name not in ("html", "body"):
                by_name = name not in OUTSIDE and name != "header" and _named(m[3])
                marked_at = m.start() if by_name else None
                skip.append(name)
        elif name == "header":
            heads.append(name)
    parts.append(page[at:])
    flush()
    most = max(held, key=held.get, default=None)
    return lines, most if most is not None and not named and 2 * held[most] > total else None


def _noise_names(attributes: str) -> list[str]:
    """The tokens of class, id and role that name noise."""
    return [x for a, b, c in NAMED.findall(attributes) for x in (a or b or c).split()
            if _mark(x) and not STATE.search(x)]


def _marked(attributes: str, layout: bool = False) -> bool:
    if not attributes:
        return False
    return HIDDEN.search(attributes) is not None or (not layout and bool(_noise_names(attributes)))


def _named(attributes: str) -> bool:
    """Whether only names mark an element, and none of them names readers' replies."""
    return HIDDEN.search(attributes) is None and not any(_mark(x) in REPLIES for x in _noise_names(attributes))


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of a page: its blocks in order, joined by an empty line; "" for null, empty or no article.

    A surge is a line with weight whose window sum reaches ``surge`` after a line outside the article; a dive is a
    line where the sum has fallen to 0, or the page's end. Where no window reaches ``surge`` the page is
    all short text and the largest window sum serves as the height of a surge. Short blocks before a surge or
    after a dive (a title, a list of links, the paragraphs after it) belong to the article too where a container holds
    them and a dense block of it, from the container's first line with weight to its last. Very long pages are read whole, in time that grows with their length.
    """
    lines = _lines(page or "")
    weights = [w for _, w, _ in lines]
    sums = [sum(weights[i:i + window]) for i in range(len(weights))]
    height = min(surge, max(sums, default=0))
    if not height:
        return ""
    kept = [False] * len(lines)
    inside = False
    first: dict[int, int] = {}      # lines where a container's text begins and ends
    last: dict[int, int] = {}
    dense: set[int] = set()         # containers that hold a dense block of the article
    for i, ((_, weight, home), total) in enumerate(zip(lines, sums)):
        if not inside:
            inside = weight > 0 and total >= height
        elif total == 0:
            inside = False
        kept[i] = inside and weight > 0
        if weight >= surge and kept[i]:
            dense.add(home)
        if weight > 0:
            first.setdefault(home, i)
            last[home] = i
    return "\n\n".join(text for i, (text, _, home) in enumerate(lines)
                       if kept[i] or (home in dense and first[home] <= i <= last[home]))


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` for each row of ``pages``, row by row, from the whole page.

    Rows that repeat are extracted alike; null keys and urls are passed on; other columns are ignored. A null or empty page
    gives "", an empty table an empty result.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"), F.col(page).alias("page"))
    return rows.mapInArrow(run, "key bigint, url string, text string, n_chars bigint").select(
        F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
