"""Main text of web pages by two passes over blocks.

A page is cut into blocks at block-level tags, outside parts that are never content (navigation,
headers and footers of the page, asides, forms, scripts, styles, hidden parts, and boxes whose class
or id names them as adverts, notices, sidebars or comments).

Pass 1 classes a block by its length, its link density and its stop-word density.  Pass 2 settles
the ambiguous ones, short or near-good, by the nearest decided neighbours on either side: both sides
must agree, and a tie of near-good blocks goes to content.  Within an article element the markup
is a prior only: pass 1 grades a block one step better, and pass 2 drops an ambiguous one only between
bad blocks of the article.  A box that holds the page's main part isn't dropped for its name.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import ship

SHORT, LONG = 70, 200
LINKS_MOST, STOPS_LOW, STOPS_HIGH = 0.4, 0.15, 0.3

# Frequent words of the languages that pages come in.
STOP_WORDS = frozenset(
    """the of and to in a is it that was for on are with as be by this at from or an not have but
    de la le les des et un une du en est que qui dans sur pour pas par au avec ne se ce
    der die das und ist ein eine zu den von mit auf für nicht sich dem im des es auch als
    el los las y que del se por con para una no su al lo como más o""".split()
)
# Element names by what they mean for extraction.
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
NEVER = frozenset("script style noscript template svg math iframe object canvas head title textarea select option button audio video".split())
DROPPED = frozenset("nav footer aside form header menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
_BOX = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notification|alert|popup|modal|newsletter|subscribe|signup|login|"
    r"sidebar|side|widget|related|recommend\w*|share|sharing|social|comments?|replies|respond|disqus|breadcrumbs?|pagination|pager|menu|nav\w*|"
    r"header|masthead|footer|foot|copyright|legal|skip|hidden|toolbar|tags?|print)",
    re.I,
)
_MARK = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")


class _Tags:
    """The tags of a page, each found in time that all of them share, however broken the page is."""

    def __init__(self, page: str):
        self.page = page
        self.special = [m.start() for m in _SPECIAL.finditer(page)]
        self.ends: dict[int, int] = {}
        self.closed: dict[str, int] = {}

    def end(self, at: int) -> int:
        """Where the tag that is open at a place ends, quoted parts left aside; -1 if nowhere."""
        path, i = [], bisect.bisect_left(self.special, at)
        found = -1
        while i < len(self.special):
            s = self.special[i]
            if s in self.ends:
                found = self.ends[s]
                break
            path.append(s)
            if self.page[s] == ">":
                found = s
                break
            close = self.page.find(self.page[s], s + 1)
            if close < 0:
                break
            i = bisect.bisect_left(self.special, close + 1, i)
        for s in path:
            self.ends[s] = found
        return found

    def after(self, name: str, at: int) -> int:
        """Where the text of a raw element ends: behind its end tag, or the page's end."""
        if self.closed.get(name, 0) < 0:
            return len(self.page)
        m = re.compile(rf"</{name}\s*>", re.I).search(self.page, at)
        if m is None:
            self.closed[name] = -1
        return m.end() if m else len(self.page)

    def __iter__(self):
        """(start, end, closing, name, attributes); comments and the like have an empty name, and raw elements' texts too."""
        page, at = self.page, 0
        broken = False  # a comment or declaration that never ends: none after it does
        while (lo := page.find("<", at)) >= 0:
            if page.startswith(("<!", "<?"), lo):
                m = None if broken else _MARK.match(page, lo)
                broken = broken or m is None
                at = m.end() if m else lo + 1
                if m:
                    yield lo, at, False, "", ""
                continue
            m = _NAME.match(page, lo)
            hi = self.end(m.end()) if m else -1
            if hi < 0:
                at = lo + 1
                continue
            name = m[2].lower()
            yield lo, hi + 1, bool(m[1]), name, page[m.end() : hi]
            at = hi + 1
            if name in RAW and not m[1]:
                after = self.after(name, at)
                if after > at:
                    yield at, after, False, "", ""
                at = after


class _Open:
    """The open elements, and how many of each name there are."""

    def __init__(self):
        self.stack: list[tuple] = []
        self.count: Counter = Counter()

    def push(self, name: str, *more) -> None:
        self.stack.append((name, *more))
        self.count[name] += 1

    def pop(self) -> tuple:
        top = self.stack.pop()
        self.count[top[0]] -= 1
        return top


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


def _hidden(own: dict[str, str]) -> bool:
    return "hidden" in own or own.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")))


def _boxed(name: str, own: dict[str, str]) -> bool:
    """Whether an element's role, class or id says that it isn't content.

    A class counts as a whole, or if every hyphenated part of it is such a word: `no-sidebar` isn't a sidebar.
    """
    if own.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form"):
        return True
    if name in ("html", "body", "article", "main"):
        return False
    return any(all(_BOX.fullmatch(x) for x in re.split("[_-]+", c)) for c in f"{own.get('class', '')} {own.get('id', '')}".split())


def _holders(page: str) -> frozenset[int]:
    """Where the elements begin that hold the page's first main element or, without one, its first article."""
    opened = _Open()
    held: frozenset[int] = frozenset()
    articles = 0
    for start, _, closing, name, _ in _Tags(page):
        if not name or name in RAW:
            continue
        if closing:
            if opened.count[name]:
                while opened.pop()[0] != name:
                    pass
        elif name in ("article", "main"):
            if name == "main" or not articles:
                held = frozenset(x for _, x in opened.stack)
            if name == "main":
                break
            articles += 1
            opened.push(name, start)
        elif (name in BLOCK or name in ("span", "a")) and name not in VOID:
            opened.push(name, start)
    return held


_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_INLINE = frozenset("b i em strong span a u small font".split())


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, heading, in an article) of the page's blocks outside dropped parts."""
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    opened = _Open()
    count = opened.count
    dropped = linked = at = 0
    holders: frozenset[int] | None = None

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, linked, any(count[h] for h in _HEADINGS), count["article"] + count["main"] > 0))
        parts, linked = [], 0

    def read(stop: int) -> None:
        nonlocal linked
        if stop > at and not dropped:
            parts.append(page[at:stop])
            if count["a"]:
                linked += len(html.unescape(page[at:stop]).strip())

    for start, end, closing, name, raw in _Tags(page):
        read(start)
        at = end
        if not name or (name in RAW and not closing):
            continue
        if closing:
            if not count[name]:
                if name in BLOCK:
                    close()
                continue
            while True:
                if opened.stack[-1][0] in BLOCK:
                    close()
                x, was = opened.pop()
                dropped -= was
                if x == name:
                    break
            continue
        if name == "br":
            if not dropped:
                parts.append(" ")
            continue
        if name in BLOCK:
            close()
            # an open paragraph or item ends where the next one begins
            ends = {"p"} | ({"li"} if name == "li" else {"dd", "dt"} if name in ("dd", "dt") else {"td", "th"} if name in ("td", "th") else set())
            while opened.stack and (opened.stack[-1][0] in ends or opened.stack[-1][0] in _INLINE):
                if not any(x in ends for x, _ in opened.stack[-8:]):
                    break
                dropped -= opened.pop()[1]
        if name in VOID or raw.rstrip().endswith("/") and name not in BLOCK:
            continue
        inside = count["article"] + count["main"] > 0
        own = _attributes(raw)
        gone = name in NEVER or _hidden(own)
        if not gone and not (name == "header" and inside) and (name in DROPPED or _boxed(name, own)):
            if holders is None and not dropped:
                holders = _holders(page)
            gone = bool(dropped) or start not in holders
        opened.push(name, gone)
        dropped += gone
    read(len(page))
    close()
    return out


def classify(found: list[tuple[str, int, bool, bool]]) -> list[bool]:
    """Whether each block is content."""
    first = []
    for text, linked, heading, vouched in found:
        length = len(text)
        density = linked / length
        words = text.lower().split()
        stops = sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / len(words)
        if density > LINKS_MOST:
            # a linked heading or sentence of an article is left to its neighbours
            first.append("near" if vouched and (heading or (length >= SHORT and stops >= STOPS_LOW)) else "bad")
        elif "©" in text or text.startswith("&copy"):
            first.append("near" if vouched else "bad")
        elif length < SHORT:
            first.append("short" if vouched or not linked else "bad")
        elif stops >= STOPS_HIGH:
            first.append("good" if vouched or length > LONG else "near")
        elif stops >= STOPS_LOW:
            first.append("good" if vouched else "near")
        else:
            first.append("near" if vouched else "bad")
    n = len(first)

    def nearest(places) -> list[str]:
        """The nearest decided block's class by block; to a block of an article, all outside it is good."""
        out = [""] * n
        last, own = "bad", False
        for i in places:
            out[i] = "good" if found[i][3] and not own else last
            if first[i] in ("good", "bad"):
                last, own = first[i], found[i][3]
        return out

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    out = []
    for i, c in enumerate(first):
        if c == "good" or c == "bad":
            out.append(c == "good")
        elif found[i][2]:  # a heading goes with what it heads
            out.append(after[i] == "good")
        elif before[i] == after[i]:
            out.append(before[i] == "good")
        else:
            out.append(found[i][3] or c == "near")
    return out


def extract(page: str | None) -> str:
    """The page's main text, one line a block; empty for null, empty and contentless pages."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b[0] for b, good in zip(found, classify(found)) if good)


def extract_pages(pages: DataFrame, name: str = "text") -> DataFrame:
    """pages(html, ...) with the main text and n_chars, its code points (both replaced if there).

    Broken markup never fails: unclosed parts end with the page, stray end tags end a block.  Rows
    are extracted one by one; an empty table gives an empty table.
    """
    ship(pages.sparkSession)
    pages = pages.drop(name, "n_chars")
    column = pages.columns.index("html")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [extract(x.as_py()) for x in part.column(column)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*part.schema.names, name, "n_chars"])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField(name, StringType()), StructField("n_chars", LongType())]))


def digest(pages: DataFrame) -> DataFrame:
    return extract_pages(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
