"""Main text of web pages by scoring the element tree.

A page is parsed once into elements and *runs* (the inline text of one block). Each run is a
paragraph that passes points for its length and its commas to the elements above it, less
the further up they are; an element's points are discounted by its share of link text. The
best element is the article; its siblings join when they score or read like a part of it.
Elements that are menus, notices, adverts and the like by tag, role, class or id are left
out before scoring.

Every step is linear in the page: parsing keeps the positions of open tags, scoring walks
the elements once forth and once back. Pages are independent, so nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The vocabulary of HTML and of the class names that sites use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: no part of the text around them, and no break in it
SILENT = frozenset("input img link meta script style".split())
#: never article text, whatever they hold
DROPPED = frozenset("nav footer aside script style noscript template svg canvas object audio video iframe button select "
                    "textarea fieldset label menu dialog datalist map title head".split())
SCOPES = frozenset("html table td th caption object template".split())
#: a start tag of the group ends an open element of the same group, unless a barrier stands between
GROUPS = {"li": "li", "dd": "dd", "dt": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option", "p": "p"}
BARRIERS = {"ul": ("li", "p"), "ol": ("li", "p"), "dl": ("dd",), "table": ("tr", "td", "p", "li"), "tr": ("td",),
            "td": ("p", "li"), "th": ("p", "li"), "select": ("option",), "button": ("p",), "caption": ("p",)}
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar form".split())
NEGATIVE = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion "
    "sidebar sidebars rail aside nav navbar navigation menu menus submenu topbar toolbar breadcrumb breadcrumbs pagination pager "
    "masthead header footer foot colophon cookie cookies consent gdpr notice notices notification alert banner popup modal overlay "
    "lightbox newsletter subscribe subscription signup login share sharing sharebar social related recommended recommendations "
    "trending widget widgets skip search copyright disclaimer legal outbrain taboola paywall tracking".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
POSITIVE = frozenset("article body content entry main post story text blog page hentry prose".split())
#: a header of these is the article's own, and a widget with any positive word may hold it
OWN_HEADER = frozenset("article post entry story hentry".split())
#: "has-sidebar" and its like describe a page, not the element
MODIFIERS = r"(?i)(?<![a-z])(?:has|with|without|no)[-_]\w+"

#: headings of what follows an article, in the languages of the corpus
AFTERWORD = re.compile(r"\W*(\d+\s+)?(reader\s+|user\s+|your\s+)?(comments?|responses|replies|kommentare|commentaires|comentarios|leave a (reply|comment)"
                       r"|related (articles|posts|stories|links))\W*(\d+\W*)?", re.I)

POSITIVE_POINTS, ARTICLE_POINTS, MAIN_POINTS = 25, 50, 10
START = {"article": ARTICLE_POINTS, "main": MAIN_POINTS, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3,
         "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTAINERS = frozenset("article aside body center div dd details dl fieldset figure form header hgroup html main ol section table tbody td tfoot thead tr ul".split())
BOXES = frozenset("div section ul ol dl td".split())
#: blocks inside the article that may turn out to be lists of links
LISTS = frozenset("ul ol dl div section table".split())

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)?)?|=)*+)>""")
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))?)?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

HARD, SOFT, HEADER = 1, 2, 3


class Page:
    """Elements (parent before child) and runs of text of one page."""

    def __init__(self, source: str):
        self.tag, self.parent, self.drop, self.classes, self.points = ["html"], [-1], [0], [""], [0.0]
        #: (element, text, characters inside links)
        self.runs: list[tuple[int, str, int]] = []
        self.links = [0]
        self._stack, self._open = [0], {"html": [0]}
        self._blocks, self._scopes = [0], [0]
        self._groups: dict[str, list[int]] = {g: [] for g in set(GROUPS.values())}
        self._anchor, self._muted = -1, 0
        self._text: list[str] = []
        self._link_chars = 0
        self._parse(source)
        self._flush()

    # -- tree -----------------------------------------------------------------------------
    def _push(self, tag: str, drop: int, classes: str, points: float) -> None:
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        self.drop.append(drop)
        self.classes.append(classes)
        self.points.append(points)
        self.links.append(0)
        depth = len(self._stack)
        self._stack.append(len(self.tag) - 1)
        self._open.setdefault(tag, []).append(depth)
        if tag not in INLINE:
            self._blocks.append(depth)
        elif drop == HARD:
            self._muted += 1
        if tag in SCOPES:
            self._scopes.append(depth)
        if tag in GROUPS:
            self._groups[GROUPS[tag]].append(depth)
        for group in BARRIERS.get(tag, ()):
            self._groups[group].append(-1)

    def _pop_to(self, depth: int) -> None:
        """Ends all open elements at ``depth`` and below."""
        while len(self._stack) > depth:
            node = self._stack.pop()
            tag = self.tag[node]
            self._open[tag].pop()
            if tag not in INLINE:
                self._blocks.pop()
            elif self.drop[node] == HARD:
                self._muted -= 1
            if tag in SCOPES:
                self._scopes.pop()
            for group in reversed(BARRIERS.get(tag, ())):
                self._groups[group].pop()
            if tag in GROUPS:
                self._groups[GROUPS[tag]].pop()
        if self._anchor >= len(self._stack):
            self._anchor = -1

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.runs.append((self._stack[self._blocks[-1]], text, min(self._link_chars, len(text))))
        self._text, self._link_chars = [], 0

    def _add(self, text: str) -> None:
        if not text or self._muted:
            return
        text = entities.unescape(text) if "&" in text else text
        self._text.append(text)
        if self._anchor >= 0:
            self._link_chars += len(" ".join(text.split()))

    # -- tags -----------------------------------------------------------------------------
    def _parse(self, s: str) -> None:
        at, size, last = 0, len(s), s.rfind(">")
        while at < size:
            mark = s.find("<", at)
            if mark < 0:
                self._add(s[at:])
                return
            self._add(s[at:mark])
            following = s[mark + 1:mark + 2]
            if following == "!" and s.startswith("<!--", mark):
                if s.startswith((">", "->"), mark + 4):
                    end = s.find(">", mark)
                else:
                    end = s.find("-->", mark + 4)
                    end = end + 2 if end >= 0 else size
                at = end + 1
            elif following in ("!", "?") or following == "/" and not s[mark + 2:mark + 3].isalpha():
                end = s.find(">", mark)
                at = end + 1 if end >= 0 else size
            elif following == "/" or following.isascii() and following.isalpha():
                if mark > last:  # an unfinished tag takes the rest
                    return
                found = _TAG.match(s, mark)
                if not found:
                    self._add("<")
                    at = mark + 1
                    continue
                at = found.end()
                name = found[2].lower()
                if found[1]:
                    self._end(name)
                else:
                    at = self._start(name, found[3], s, at)
            else:
                self._add("<")
                at = mark + 1

    def _start(self, tag: str, attributes: str, s: str, at: int) -> int:
        if tag == "br":
            self._add(" ")
            return at
        if tag not in INLINE and tag not in SILENT:
            self._flush()
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(s, at)
            if not end:
                return len(s)
            close = s.find(">", end.end())
            return close + 1 if close >= 0 else len(s)
        if tag in VOID or tag in ("html", "head"):
            return at
        own = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attributes)} if attributes.strip(" /\n\t") else {}
        if tag == "body":
            return at
        if tag == "a":
            if self._anchor >= 0 and self._open.get("a") and self._open["a"][-1] > self._blocks[-1]:
                self._pop_to(self._open["a"][-1])
        else:
            group = GROUPS.get(tag, "p" if tag not in INLINE else None)
            if group and self._groups[group] and self._groups[group][-1] >= 0:
                self._pop_to(self._groups[group][-1])
            if group and group != "p" and self._groups["p"] and self._groups["p"][-1] >= 0:
                self._pop_to(self._groups["p"][-1])
        drop, points = self._judge(tag, own)
        classes = own.get("class", "")
        self._push(tag, drop, classes, points)
        if tag == "a" and "href" in own and self._anchor < 0:
            self._anchor = len(self._stack) - 1
            self.links[self._stack[self._blocks[-1]]] += 1
        return at

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._add(" ")
            return
        if tag in VOID or tag in ("html", "body", "head"):
            return
        places = self._open.get(tag)
        if tag in INLINE:
            if places and places[-1] > self._blocks[-1]:
                self._pop_to(places[-1])
            elif tag == "a":
                self._anchor = -1
            return
        self._flush()
        if places and (places[-1] >= self._scopes[-1]):
            self._pop_to(places[-1])

    def _judge(self, tag: str, own: dict[str, str]) -> tuple[int, float]:
        """Whether an element is left out, and the points that it starts with."""
        points = float(START.get(tag, -5 if tag in HEADINGS else 0))
        if tag in DROPPED or "hidden" in own or own.get("aria-hidden") == "true" or "style" in own and _HIDDEN.search(own["style"]):
            return HARD, points
        names = re.sub(MODIFIERS, "", f"{own.get('class', '')} {own.get('id', '')}")
        words = {w.lower() for w in _TOKEN.findall(names)} if names.strip() else set()
        if words & COMMENTS:
            return HARD, points
        if words & POSITIVE:
            points += POSITIVE_POINTS if tag not in INLINE else 0
        role = own.get("role", "").lower()
        if role in ROLES:
            return (HEADER if role == "banner" else HARD), points
        bad = words & NEGATIVE
        if words & POSITIVE:
            bad -= {"widget", "widgets"}
        if tag == "header" or bad == {"header"}:
            return (0 if words & OWN_HEADER else HEADER), points
        if tag in ("article", "main"):
            return (HARD if bad - {"header", "page"} and tag == "article" and not words & POSITIVE else 0), points
        if bad or tag == "form":
            return (HARD if tag in INLINE else SOFT), points
        return 0, points


def _left_out(page: Page, soft: bool) -> list[bool]:
    """Which elements are no part of any article, with everything below them."""
    n = len(page.tag)
    for node, text, _ in page.runs:  # a box of its own under such a heading
        up = page.parent[node]
        if page.tag[node] in HEADINGS and page.tag[node] != "h1" and page.tag[up] in BOXES and len(text) < 60 and AFTERWORD.fullmatch(text):
            page.drop[up] = HARD
    holds = [False] * n  # an article, a main part or the title below
    for i in range(n - 1, 0, -1):
        if holds[i] or page.tag[i] in ("article", "main", "h1") and page.drop[i] != HARD:
            holds[page.parent[i]] = page.drop[i] != HARD or holds[page.parent[i]]
    inside = [False] * n  # below an article or a main part
    out = [False] * n
    for i in range(1, n):
        up = page.parent[i]
        inside[i] = inside[up] or page.tag[up] in ("article", "main")
        kind = page.drop[i]
        out[i] = out[up] or kind == HARD or soft and (kind == SOFT and not holds[i] or kind == HEADER and not (inside[i] and holds[i]))
    return out


def main_text(source: str | None) -> str:
    """Blocks of the article of one page, joined by line breaks; empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    out = _left_out(page, True)
    if all(out[node] for node, _, _ in page.runs) and not {"article", "main"} & set(page.tag):
        out = _left_out(page, False)  # no page is all menu: its class names mislead
    n = len(page.tag)
    chars, linked, links = [0] * n, [0] * n, list(page.links)
    score: dict[int, float] = {}
    for node, text, link in page.runs:
        if out[node]:
            continue
        chars[node] += len(text)
        linked[node] += link
        points = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - link / len(text))
        up = node if page.tag[node] in CONTAINERS else page.parent[node]
        level = 0
        while up >= 0 and level < 5:
            score[up] = score.get(up, page.points[up]) + points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = page.parent[up], level + 1
    if not score:
        return ""
    for i in range(n - 1, 0, -1):
        if not out[i]:
            up = page.parent[i]
            chars[up] += chars[i]
            linked[up] += linked[i]
            links[up] += links[i]
    density = [linked[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
    final = {i: s * (1 - density[i]) for i, s in score.items()}
    best = max(final, key=lambda i: (final[i], -i))
    up = best
    while up > 0:  # an article element delimits the article
        if page.tag[up] == "article":
            best = up
        up = page.parent[up]
    kept = [False] * n
    kept[best] = True
    stays = _siblings(page, out, best, final, chars, density, kept)
    for i in range(1, n):
        if not kept[i]:
            menu = page.tag[i] in LISTS and links[i] >= 2 and density[i] > 0.5 or page.tag[i] in LISTS and links[i] >= 3 and density[i] > 0.4
            kept[i] = kept[page.parent[i]] and not out[i] and not menu
    return "\n".join(text for r, (node, text, _) in enumerate(page.runs) if kept[node] or r in stays)


def _siblings(page: Page, out, best, final, chars, density, kept) -> set[int]:
    """Marks the siblings of the best element that belong to the article; returns such runs of its parent."""
    stays: set[int] = set()
    if best == 0:
        return stays
    home = page.parent[best]
    floor = max(10.0, 0.2 * final.get(best, 0.0))
    alone = page.tag[best] == "article"
    titled = [False] * len(page.tag)
    for i in range(len(page.tag) - 1, 0, -1):
        if not out[i] and (titled[i] or page.tag[i] == "h1"):
            titled[page.parent[i]] = True
    first: dict[int, str] = {}
    for r, (node, text, link) in enumerate(page.runs):
        if page.parent[node] == home:
            first[node] = f"{first[node]}\n{text}" if node in first else text
        elif node == home and not out[node] and not alone and (len(text) > 80 and link < 0.25 * len(text)):
            stays.add(r)
    for i in range(1, len(page.tag)):
        if page.parent[i] != home or i == best or out[i] or not chars[i]:
            continue
        tag, text = page.tag[i], first.get(i, "")
        if tag in CONTAINERS or tag in LISTS:
            same = tag == page.tag[best] and page.classes[i] == page.classes[best]
            kept[i] = density[i] < 0.25 and (same and final.get(i, 0.0) >= floor or titled[i] and i < best)
        elif alone:
            continue
        elif tag in HEADINGS:
            kept[i] = density[i] < 0.25 and tag in ("h1", "h2") and i < best
        else:
            kept[i] = len(text) > 80 and density[i] < 0.25 or len(text) <= 80 and density[i] == 0 and re.search(r"\.( |$)", text) is not None and "©" not in text
    return stays


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` without ``html``, with ``text`` (blocks joined by a line break) and ``n_chars``.

    Null or empty html, and pages without any article text, give an empty text. White space
    inside a block, a ``<br>`` and a no-break space included, is one space. Every row has its own result, repeated
    page_ids too; other columns stay, those named ``text`` or ``n_chars`` are replaced. An
    unfinished tag, comment or script at the end of a page takes the rest of it, as in a
    browser. One page is parsed in memory at a time.
    """
    rest = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]
    schema = T.StructType(rest + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [*(batch[f.name] for f in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*(f.name for f in rest), "text", "n_chars"])

    return pages.select(*(f.name for f in rest), "html").mapInArrow(run, schema)
