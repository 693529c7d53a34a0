"""Text lines of an HTML page, with what the markup says about each; and the longest common subsequence of lines.

Block elements make lines, inline elements do not part words, character references are decoded, white space
inside a line becomes one space.  Broken markup is read leniently: end tags without a start are ignored, an end
tag closes whatever is open inside its element, the end of the text closes everything.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that never hold main text, and those that do not inside whichever article they stand.
NEVER = frozenset("nav aside footer form button select option menu dialog object audio video canvas map head fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of class and id attributes that name what is not main text.
WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead topbar ad ads advert adverts advertisement "
    "advertisements advertising adsbygoogle sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond reply replies widget widgets toolbar pagination pager skip search copyright disclaimer".split()
)
#: Beside one of these a word describes the page and not the element ("with-sidebar", "comments-open").
ABOUT = frozenset("with has have no without open closed enabled layout page body wrapper container content main".split())
#: What may hold a whole article all the same: a form around the page, a page header, a dialog.
AROUND = frozenset("form fieldset dialog object header".split())
ARTICLE_CLASSES = frozenset("article-body article-content articlebody entry-content post-content post-body story-body".split())
#: Attributes that a verdict may depend on.
TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)


class Line(NamedTuple):
    """Text; whether in a declared article; whether markup rejects it; whether at least half of it is link text."""

    text: str
    article: bool
    rejected: bool
    linked: bool


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


def _rejects(name: str, given: dict[str, str]) -> bool:
    """Whether the element's own name and attributes say that it is not main text."""
    if name in NEVER or name == "header":
        return True
    if not given or name in ("html", "body", "main"):
        return False
    if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")):
        return True
    if given.get("role", "").lower() in ROLES:
        return True
    for token in f"{given.get('class', '')} {given.get('id', '')}".split():
        words = set(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower().replace("-", " ").replace("_", " ").split())
        if words & WORDS and not words & ABOUT:
            return True
    return False


def _declares(name: str, given: dict[str, str]) -> bool:
    if name in ("article", "main") or given.get("role", "").lower() in ("main", "article") or given.get("itemprop") == "articleBody":
        return True
    return bool(set(given.get("class", "").lower().split()) & ARTICLE_CLASSES)


@lru_cache(1 << 14)
def _verdict(name: str, source: str) -> tuple[bool, bool]:
    """Whether a start tag rejects what is inside, and whether it declares an article."""
    given = _attributes(source)
    rejects = _rejects(name, given)
    return rejects, not rejects and _declares(name, given)


class _Open:
    """An element that is open: its name, whether it rejects or declares, whether its own end tag was seen."""

    __slots__ = ("closed", "declares", "name", "rejects")

    def __init__(self, name: str, rejects: bool, declares: bool):
        self.name, self.rejects, self.declares, self.closed = name, rejects, declares, False


class _Reader:
    def __init__(self):
        self.stack: list[_Open] = []
        self.words: list[tuple[str, bool]] = []
        self.lines: list[tuple[str, list[_Open], bool]] = []

    def flush(self) -> None:
        if self.words:
            text = " ".join("".join(w for w, _ in self.words).split())
            if text:
                links = sum(len("".join(w.split())) for w, linked in self.words if linked)
                whole = len(text) - text.count(" ")
                above = [e for e in self.stack if e.rejects or e.declares or e.name in HEADINGS]
                self.lines.append((text, above, 2 * links >= whole))
            self.words = []

    def start(self, name: str, source: str) -> None:
        if name not in INLINE:
            self.flush()
            if name in VOID:
                return
            if self.stack and (self.stack[-1].name == "p" or self.stack[-1].name in CLOSES.get(name, ())):
                self.stack.pop().closed = True
        elif name in VOID:
            return
        rejects, declares = _verdict(name, source if TELLING.search(source) else "")
        if rejects and name in INLINE:
            self.flush()
        self.stack.append(_Open(name, rejects, declares))

    def end(self, name: str) -> None:
        if name == "br":
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == name:
                if name not in INLINE or self.stack[i].rejects:
                    self.flush()
                self.stack[i].closed = True
                del self.stack[i:]
                return
            # An inline end tag does not reach out of its block, no end tag but its own leaves an article.
            if name in INLINE and self.stack[i].name not in INLINE or self.stack[i].name in ("article", "main"):
                if name not in ("body", "html", "article", "main"):
                    return
        if name not in INLINE:
            self.flush()

    def text(self, source: str) -> None:
        self.words.append((unescape(source) if "&" in source else source, any(e.name == "a" for e in self.stack[-4:])))


def _judge(above: list[_Open]) -> tuple[bool, bool]:
    """(in a declared article, rejected) by the elements around a line, outermost first."""
    inside = max((i for i, e in enumerate(above) if e.declares), default=-1)
    first = min((i for i, e in enumerate(above) if e.declares), default=len(above))
    heading = any(e.name in HEADINGS for e in above)
    for i, e in enumerate(above):
        if not e.rejects:
            continue
        if i < first and inside >= 0 and (e.name in AROUND or not e.closed):
            continue  # around the article, or left open before it
        if e.name == "header" and i > first and heading:
            continue  # an article's own header: its headings belong to it
        return inside >= 0, True
    return inside >= 0, False


def page_lines(html: str | None) -> list[Line]:
    """The lines of a page in page order; null and empty pages have none."""
    html = html or ""
    reader, at, n = _Reader(), 0, len(html)
    while at < n:
        token = TOKEN.search(html, at)
        if token is None:
            reader.text(html[at:])
            break
        if token.start() > at:
            reader.text(html[at : token.start()])
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue  # a comment or declaration
        if token[1]:
            reader.end(name)
        elif name in RAW:
            if not token[3].endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = close.end() if close else n
            if name not in INLINE and name not in ("svg", "math"):
                reader.flush()
        else:
            reader.start(name, token[3])
    reader.flush()
    return [Line(text, *_judge(above), linked) for text, above, linked in reader.lines]


#: Bits of table rows kept at a time to walk back through.
KEPT_BITS = 1 << 27


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of one longest common subsequence of the two sequences.

    Bit-parallel: a row of the table is one integer of len(b) bits.  Rows are kept at intervals and worked out
    again on the way back, so memory stays bounded for long pages.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = [*range(head), *range(len(a) - tail, len(a))]
    places: dict[int, int] = {}
    for j, symbol in enumerate(b[head : len(b) - tail]):
        places[symbol] = places.get(symbol, 0) | 1 << j
    rows = [(i, places[a[i]]) for i in range(head, len(a) - tail) if a[i] in places]
    width = len(b) - head - tail
    if not rows:
        return found
    full = (1 << width) - 1

    def after(state: int, mask: int) -> int:
        hit = state & mask
        return ((state + hit) | (state - hit)) & full

    every = max(1, -(-len(rows) * width // KEPT_BITS))
    marks, state = [], full
    for k, (_, mask) in enumerate(rows):
        if k % every == 0:
            marks.append(state)
        state = after(state, mask)
    column, row, block = width, len(rows), []
    base = len(rows)
    while row and column:
        if row - 1 < base or not block:
            base = (row - 1) // every * every
            block = [marks[base // every]]
            for _, mask in rows[base : min(base + every, len(rows))]:
                block.append(after(block[-1], mask))
        if block[row - base] >> (column - 1) & 1:
            column -= 1
            continue
        # A zero bit: the row's length grows at this column; if it did so in the row above, nothing was matched here.
        if block[row - 1 - base] >> (column - 1) & 1:
            found.append(rows[row - 1][0])
            column -= 1
        row -= 1
    return sorted(found)
