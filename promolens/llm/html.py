"""Main text of web pages by tree scoring.

A page is read once into a tree. Elements that are never article text (menus,
scripts, asides and so on, by tag or role) are set aside. Classes, ids and forms
only raise a suspicion. A name whose head is a word such as sidebar or comments
("post-comments", but not "has-sidebar") sets its element aside, unless the
page's heading or main element is in it or nothing else is left; a name that has
such a word elsewhere does so for little text or much link text, and costs points
otherwise. A form is set aside unless it holds the heading or most of the page.
Every paragraph gives points for its length and commas to its parent, half to
the grandparent and less further up; a container's points are discounted by the
share of its text that is link text. The best container, and the siblings that
score well beside it, are the article.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)(?:>|(?=<)|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text, not markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body html caption legend option optgroup summary td th tr tbody thead tfoot title".split())
#: A new one ends an open one of the group, up to the boundary.
_SIBLING = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
}
_DROP = frozenset(
    "head title script style noscript template svg math canvas nav footer aside iframe select datalist button textarea input object embed "
    "applet audio video dialog menu map noembed noframes xmp".split()
)
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of class and id that mark what is not the article; fixed values.
_DROP_WORDS = re.compile(
    r"ads?|advert\w*|adsense|adbox|adslot|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|rail|comments?|commentlist|disqus\w*|replies|respond|"
    r"footer\w*|masthead|topbar|cookies?|consent|gdpr|notice\w*|notification\w*|popup\w*|modal\w*|overlay\w*|newsletter\w*|subscri\w*|share|sharing|social\w*|related|recommended|"
    r"recommendations|widgets?|pagination|pager|login|signin|signup|register|searchform|searchbox|toolbar|hidden|paywall|outbrain|taboola|tagcloud|skiplink"
)
#: Words before such a word that tell how a page is laid out, and words behind it that leave it the head of the name; fixed values.
_LAYOUT = frozenset("has have with no not without hide show is single overflow visually".split())
_BEHIND = frozenset(
    "main left right top bottom wrapper wrap container box block blocks section area list item items inner outer content body holder group row col column panel bar form site page primary secondary first "
    "last small large fixed sticky mobile desktop template thread link links title heading slot unit zone posts articles stories".split()
)
#: Such words that are also common for containers of articles: never the head of a name by themselves.
_VAGUE = re.compile(r"hidden|widgets?|rail|overlay\w*|modal\w*|paywall|promo\w*|notice\w*|subscri\w*|share|register|menu\w*|banner\w*")
_NO_HEAD = re.compile(r"widgets?|rail|overlay\w*")
#: Characters of text up to which, and share of link text from which on, a name with such a word sets an element aside.
LITTLE, LINKED = 200, 0.5
NONE, FAINT, STRONG, FORM = range(4)
_ROOTS = frozenset(["html", "body", "main"])
_PRIOR = {"article": 10.0, "main": 10.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "td": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0, "body": -5.0, "html": -10.0}
_COMMA = re.compile("[,،、，]")
LEVELS = 5


def suspicion(name: str) -> int:
    """What one name of class or id tells of an element."""
    words = [w for w in _SPLIT.split(name) if w]
    marked = [bool(_DROP_WORDS.fullmatch(w)) for w in words]
    if not any(marked):
        return NONE
    while len(words) > 1 and (words[-1] in _BEHIND or words[-1].isdigit()) and not marked[-1]:
        words.pop()
        marked.pop()
    if len(words) > 1 and words[-2] in _LAYOUT:
        return NONE
    if not marked[-1]:
        return FAINT
    vague = _VAGUE.fullmatch(words[-1]) if len(words) == 1 else _NO_HEAD.fullmatch(words[-1]) and not all(marked)
    return FAINT if vague else STRONG


class _Page:
    """The tree of a page: parallel lists over elements in document order, and the text blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.end, self.dropped, self.suspect, self.owner = ["#root"], [-1], [0], [False], [NONE], [0]
        self.texts: list[tuple[int, int, bool, str]] = []  # element, block, in a link, text
        self.block = 0
        self.stack: list[int] = [0]
        self.open: defaultdict[str, list[int]] = defaultdict(list)  # places of each tag in the stack
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self.close(name)
                continue
            attributes = m[3] if m[2] else m[6]
            self.start(name, attributes)
            if name in _RAW and not attributes.endswith("/"):
                stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = stop.start() if stop else n  # what these hold is never article text
        while len(self.stack) > 1:
            self.pop()
        self.end[0] = len(self.tag)

    def text(self, raw: str) -> None:
        element = self.stack[-1]
        if not self.dropped[element]:
            self.texts.append((element, self.block, bool(self.open["a"]), html.unescape(raw)))

    def pop(self) -> None:
        element = self.stack.pop()
        name = self.tag[element]
        self.end[element] = len(self.tag)
        self.open[name].pop()
        self.block += name in _BLOCK

    def pop_to(self, names: Iterable[str], boundary: Iterable[str]) -> None:
        """Closes the innermost open element of ``names``, unless one of ``boundary`` is open inside it."""
        inner = max((self.open[x][-1] for x in names if self.open[x]), default=0)
        if inner and inner > max((self.open[x][-1] for x in boundary if self.open[x]), default=0):
            while len(self.stack) > inner:
                self.pop()

    def start(self, name: str, attributes: str) -> None:
        if name == "a" and self.open["a"]:
            self.pop_to(("a",), _BLOCK)
        if name in _CLOSES_P and self.open["p"]:
            self.pop_to(("p",), ("table", "td", "th", "button"))
        if name in _SIBLING:
            self.pop_to(*_SIBLING[name])
        self.block += name in _BLOCK
        above = self.stack[-1]
        if name == "br":
            self.texts.append((above, self.block, False, " "))
        element = len(self.tag)
        self.tag.append(name)
        self.parent.append(above)
        self.end.append(element + 1)
        self.owner.append(element if name in _BLOCK else self.owner[above])
        unwanted, suspect = self.judged(name, attributes)
        self.dropped.append(self.dropped[above] or unwanted)
        self.suspect.append(suspect)
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK:
            return
        self.open[name].append(len(self.stack))
        self.stack.append(element)

    def close(self, name: str) -> None:
        if self.open[name] and name not in ("body", "html"):
            while True:
                element = self.stack[-1]
                self.pop()
                if self.tag[element] == name:
                    break

    def judged(self, name: str, attributes: str) -> tuple[bool, int]:
        """Whether an element is never article text, and the suspicion that its names raise."""
        if name in _DROP or name == "header" and not self.open["article"]:
            return True, NONE
        suspect = FORM if name == "form" else NONE
        if not attributes or name in _ROOTS:
            return False, suspect
        for m in _ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                if suspect != FORM:
                    suspect = max([suspect, *map(suspicion, value.split())])
            elif key == "role" and value in _DROP_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                return True, NONE
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, NONE
        return False, suspect

    def blocks(self) -> list[tuple[int, str, int]]:
        """(innermost element around the block, text, characters in links), in page order."""
        out: list[tuple[int, str, int]] = []
        i = 0
        while i < len(self.texts):
            j, owner = i, self.owner[self.texts[i][0]]
            while j < len(self.texts) and self.texts[j][1] == self.texts[i][1]:
                j += 1
            text = _SPACE.sub(" ", "".join(t[3] for t in self.texts[i:j])).strip()
            if text:
                links = sum(len(_SPACE.sub(" ", t[3])) for t in self.texts[i:j] if t[2])
                out.append((owner, text, min(links, len(text))))
            i = j
        return out


def _sums(page: _Page, blocks: list[tuple[int, str, int]]) -> tuple[list[int], list[int]]:
    """Characters of text and of link text in every element."""
    size, linked = [0] * len(page.tag), [0] * len(page.tag)
    for owner, text, links in blocks:
        size[owner] += len(text)
        linked[owner] += links
    for k in range(len(page.tag) - 1, 0, -1):
        size[page.parent[k]] += size[k]
        linked[page.parent[k]] += linked[k]
    return size, linked


def _set_aside(page: _Page, size: list[int], linked: list[int], strong: bool) -> list[bool]:
    """Elements that their suspicion sets aside, with all that is in them."""
    heads = [tag in ("h1", "main") and not dropped and size[k] > 0 for k, (tag, dropped) in enumerate(zip(page.tag, page.dropped, strict=True))]
    for k in range(len(page.tag) - 1, 0, -1):
        heads[page.parent[k]] |= heads[k]
    out = [False] * len(page.tag)
    for k in range(1, len(out)):
        suspect = page.suspect[k]
        out[k] = out[page.parent[k]] or suspect != NONE and not heads[k] and (
            2 * size[k] <= size[0] if suspect == FORM else suspect == STRONG and strong or size[k] <= LITTLE or linked[k] >= LINKED * size[k]
        )
    return out


def _article(page: _Page, blocks: list[tuple[int, str, int]]) -> str:
    """The best container's blocks and those of the siblings that score well beside it."""
    if not blocks:
        return ""
    n = len(page.tag)
    points: dict[int, float] = {}
    size, linked = _sums(page, blocks)
    for owner, text, links in blocks:
        own = (1 - links / len(text)) * (min(len(text) / 100, 3) + len(_COMMA.findall(text)) + min(len(text) / 25, 1))
        up = page.parent[owner] if page.tag[owner] in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt") and owner else owner
        for level in range(LEVELS):
            if up < 0:
                break
            points[up] = points.get(up, 0.0) + own / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up = page.parent[up]

    def score(k: int) -> float:
        prior = _PRIOR.get(page.tag[k], 0.0) - 5.0 * (page.suspect[k] in (FAINT, STRONG))
        return (points.get(k, 0.0) + prior) * (1 - linked[k] / max(size[k], 1))

    best = max(points, key=lambda k: (score(k), -k))
    up = best
    while up > 0:  # the article element around the best container is the whole article
        if page.tag[up] == "article":
            best = up
            break
        up = page.parent[up]
    least, top = max(10.0, score(best) * 0.2), page.parent[best]
    edges = [0] * (n + 1)  # where kept elements begin and end
    edges[best] += 1
    edges[page.end[best]] -= 1
    if top >= 0:
        for k in points.keys() | {owner for owner, _, _ in blocks}:
            if page.parent[k] == top and k != best:
                density = linked[k] / max(size[k], 1)
                if score(k) >= least and page.tag[k] not in ("ul", "ol", "dl") or page.tag[k] == "p" and (size[k] > 80 and density < 0.25 or 25 < size[k] <= 80 and not density):
                    edges[k] += 1
                    edges[page.end[k]] -= 1
    kept = list(accumulate(edges))
    return "\n\n".join(text for owner, text, _ in blocks if kept[owner])


def main_text(source: str) -> str:
    """The article of a page, its blocks joined by two line ends; empty if there is none."""
    page = _Page(source)
    blocks = page.blocks()
    size, linked = _sums(page, blocks)
    aside = _set_aside(page, size, linked, True)
    text = _article(page, [x for x in blocks if not aside[x[0]]])
    if len(text) <= LITTLE < size[0]:  # the article may be in an element with such a name
        aside = _set_aside(page, size, linked, False)
        other = _article(page, [x for x in blocks if not aside[x[0]]])
        if len(other) > 4 * len(text):
            return other
    return text


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and ``text`` of every row of ``pages``.

    A null or empty page, or one without article text, has the empty text.
    Character references are decoded, white space in a block becomes one space.
    Repeated rows each get a row; null ids and addresses stay; other columns are
    ignored; an empty table gives no rows. Each page is read by itself; its time and
    memory follow its own length, however deep it is nested.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) if x else "" for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(extract, "page_id long, url string, text string")
