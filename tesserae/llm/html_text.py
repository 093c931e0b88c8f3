"""Main text of web pages by line-block distribution.

Markup is stripped into lines: every block tag ends one, so that tags without text between them leave empty lines, and texts of different
containers lie further apart than those of one. Lines of parts that are never the article (menus, page headers and footers,
sidebars, adverts' elements, forms, scripts) and lines that are mostly links keep their place but have no length. Over the
lines' lengths slide windows of three: the text surges where a window first has length again after an empty one, and dives where windows
are empty. Between a surge and the next dive lies a stretch of text. The article element's stretches are the main text if there is
one; otherwise the longest stretch, those whose highest window comes near to its own, and headings right before them. A stretch is kept
whole, short lines included.

Class and id words (an advert, a sidebar) and forms around an article, which older pages put around their whole body, only lower a
block's weight: its lines have no length at first, and have it after all where the rest of the page has next to nothing. Readers'
comments have a length only where nothing else is left. A part that is never closed (a menu without its end tag) is lowered likewise, and
ends at the next section.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import in_arrow, pieces

WINDOW = 3
#: A stretch beside the longest is kept if its highest window has this share of the longest one's.
NEAR = 0.5
#: Lowered blocks are text after all where the rest has less than this share of all but comments.
REST = 0.2

# Element names and class words.
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea select option title head xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words that may stand beside a class word in a name of several.
BESIDE = frozenset("area bar block box button buttons container content form group header inner item items left link links list main outer panel post right section slot top bottom unit wrap wrapper".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUT = frozenset("nav footer aside menu dialog button fieldset".split())
SECTION = frozenset("article aside footer header main nav section body".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUT_CLASSES = frozenset(
    "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side-bar widget "
    "footer header masthead comment comments disqus respond replies reply cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations toolbar skip-link".split()
)
COMMENTS = frozenset("comment comments disqus respond replies reply".split())
LOWERED, COMMENT = 1, 2

_PART = re.compile(r"<(/?)(nav|aside|menu|header|footer|dialog)(?=[\s/>])", re.I)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+|[^a-z\s_-]+")


def _judged(name: str, attrs: str, in_article: bool) -> tuple[bool, int, bool]:
    """(never the article, how far its weight is lowered, marked as the main part)."""
    out = name in OUT or name == "header" and not in_article or name == "form" and in_article
    level = LOWERED if name == "form" else 0
    main = False
    if attrs and name not in ("body", "html", "main", "article") and name not in HEADING:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role":
                if value == "form" and not in_article:
                    level = max(level, LOWERED)
                else:
                    out = out or value in OUT_ROLES
                main = value == "main"
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                out = True
            elif key in ("class", "id"):
                level = max([level, *map(_class, value.split())])
    return out, level, main


def _class(word: str) -> int:
    """How far a class or id word lowers a part: itself, or with words beside it that say nothing else."""
    parts = [word] if word in OUT_CLASSES else [x for x in _WORD.findall(word) if x.isalpha()]
    if not any(x in OUT_CLASSES for x in parts) or not all(x in OUT_CLASSES or x in BESIDE for x in parts):
        return 0
    return COMMENT if any(x in COMMENTS for x in parts) else LOWERED


def _unclosed(page: str) -> set[int]:
    """Where parts start that have no end tag."""
    found: dict[str, list[int]] = {}
    for m in _PART.finditer(page):
        starts = found.setdefault(m[2].lower(), [])
        if not m[1]:
            starts.append(m.start())
        elif starts:
            starts.pop()
    return {x for starts in found.values() for x in starts}


Line = tuple[str, int, bool, int, bool]


def lines_of(page: str) -> Iterator[Line]:
    """(text, length that counts, within an article, how far lowered, a heading) of each line; text is empty between blocks and at the borders of sections."""
    stack: list[tuple[str, bool, bool, bool, int]] = []  # name, its text is out, it is an article, it is a link, how far it is lowered
    open_ended = _unclosed(page)
    ends: list[int] = []  # depths of open parts without an end tag
    opened: Counter[str] = Counter()
    words: list[tuple[str, bool]] = []
    at, n = 0, len(page)
    low = ""

    def line() -> Line:
        text = " ".join("".join(t for t, _ in words).split())
        linked = sum(len(t) for t, a in words if a)
        out, article, level = (stack[-1][1], stack[-1][2], stack[-1][4]) if stack else (False, False, 0)
        words.clear()
        return text, 0 if out or not article and linked * 2 > len(text) else len(text), article, level, bool(stack and stack[-1][0] in HEADING)

    def add(text: str) -> None:
        if text and not (stack and stack[-1][1]):
            words.append((html.unescape(text), bool(stack and stack[-1][3])))

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        while ends and ends[-1] >= len(stack):
            ends.pop()
        return name

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not closing and not attrs.endswith("/"):
                low = low or page.lower()
                if name == "head" and (body := low.find("<body", at)) >= 0:
                    at = body
                elif (end := low.find(f"</{name}", at)) >= 0:
                    at = end
                elif name != "head":
                    at = n
            continue
        if name in BLOCK:
            yield line()
            if name in SECTION:
                yield from [("", 0, False, 0, False)] * WINDOW
        elif name == "br":
            words.append((" ", False))
        if name in VOID:
            continue
        if closing:
            if opened[name]:
                while pop() != name:
                    pass
        elif not attrs.endswith("/"):
            if name in SECTION and name != "body" and ends:
                for _ in range(len(stack) - ends[0]):
                    pop()
            if name in ("p", "li", "tr", "td", "dt", "dd") and stack and stack[-1][0] == name:
                pop()
            out, article, link, level = stack[-1][1:] if stack else (False, False, False, 0)
            own_out, own_level, main = _judged(name, attrs, article)
            if own_out and m.start() in open_ended:
                own_out, own_level = False, max(own_level, LOWERED)
                ends.append(len(stack))
            out = out or own_out
            stack.append((name, out, article or (name in ("article", "main") or main) and not out, link or name == "a", max(level, own_level)))
            opened[name] += 1
    yield line()


def stretches(lines: list[Line], most: int = 0) -> list[tuple[list[str], int, int, bool, bool]]:
    """(texts, total length, highest window, within an article, headings alone) between each surge and dive; lines lowered further than `most` have no length."""
    out, texts, sizes, inside, titles = [], [], [], False, True
    empty = 0
    for text, size, article, low, heading in [*lines, *[("", 0, False, 0, False)] * WINDOW]:
        if size and low <= most:
            texts.append(text)
            sizes.append(size)
            inside |= article
            titles &= heading
            empty = 0
        elif texts:
            empty += 1
            sizes.append(0)
            if empty >= WINDOW:
                high = max(sum(sizes[i : i + WINDOW]) for i in range(max(1, len(sizes) - WINDOW + 1)))
                out.append((texts, sum(sizes), high, inside, titles))
                texts, sizes, inside, titles, empty = [], [], False, True, 0
    return out


def main_text(page: str | None) -> str:
    """The article of one page; empty for null, empty and textless pages."""
    lines = list(lines_of(page or ""))
    found = stretches(lines)
    article = any(x[2] for x in lines)
    length = sum(x[1] for x in lines if (x[2] or not article) and x[3] <= LOWERED)
    if sum(s[1] for s in found if s[3] or not article) < REST * length:
        found = stretches(lines, LOWERED)
    if not any(s[3] or not article for s in found):
        found = stretches(lines, COMMENT)
    if any(s[3] for s in found):
        kept = [s for s in found if s[3]]
    elif found:
        longest = max(found, key=lambda s: s[1])
        near = [s is longest or s[2] >= NEAR * longest[2] for s in found]
        kept = [s for i, s in enumerate(found) if near[i] or s[4] and i + 1 < len(found) and near[i + 1]]
    else:
        kept = []
    return "\n".join(t for s in kept for t in s[0])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points of text).

    Null and empty html give an empty text. Every block is kept whole and nothing is capped. Of stretches of equal length the first counts.
    Repeated rows and null ids give a row each, an empty table none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column(2)):
                text = [main_text(x.as_py()) for x in b.column(2)[i:j]]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return in_arrow(own, run, "page_id long, url string, text string, n_chars long")
