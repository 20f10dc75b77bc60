"""Operator 2: main text of web pages by tree scoring.

The markup is read into a flat list of elements (parents before children) and
of text events. What names itself as menu, header, footer, sidebar, notice,
advert, form or reader comments, by element, role or class, is set aside. Each
remaining paragraph then gives points (one, one per comma, up to three for
length) to its container, half to the next and less to those further up; a
container's points are discounted by its link density. The best container and
those of its siblings that score or read like it are kept, with headings beside
it; outside an article element, lists in them that are nearly all links are left
out. Of an article's own header the headings stay. Blocks come out in page order.

Defined cases: a null or empty html gives an empty text; broken markup (open
or crossing elements, cut-off tags, stray ``<``) never fails; nesting of any
depth is handled without recursion; repeated rows are kept; an empty table
gives an empty result. White space (any Unicode white space, so also
``&nbsp;``) becomes one space; ``br`` counts as white space. Only the id, url
and html columns are read."""
from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbook.llm import common

# Element and class names.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section
summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("""aside button canvas datalist dialog embed footer form head header iframe input label menu nav
noscript object option script select style svg template textarea title""".split())
ROLES = frozenset("""alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search
toolbar""".split())
BOILERPLATE = frozenset("""ad ads adbox adsense advert adverts advertisement advertising alert banner breadcrumb
breadcrumbs byline comment commentlist comments consent cookie cookies copyright discussion disqus footer gdpr header
infobar legal login masthead menu menubar modal nav navbar navigation newsletter notice notification outbrain overlay
pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar
sidenav signup skip social sponsor sponsored subscribe subscription taboola toolbar widget""".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
COMPANIONS = frozenset("""area articles bar block box button buttons content cta form icons inner items links list posts
prompt section slot stories text tools unit wrap wrapper""".split())
LAYOUT = frozenset("has no with without wrapper layout page site container".split())
MAIN = frozenset(("article", "main"))
#: A start tag closes an open element of these kinds first (up to the limits).
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "option": ("option",),
    "thead": ("tbody", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = frozenset("p pre td th blockquote li dd dt figcaption caption".split())
PARTS = frozenset("li tr td th tbody thead tfoot dt dd".split())
#: Bonus of elements that say they hold the article.
BONUS = 25.0

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_QUOTED_END = re.compile(r"""(?>[^>"']|"[^"]*"|'[^']*')*>""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])").findall


class Element:
    __slots__ = ("tag", "parent", "words", "named", "set_aside", "main", "linked", "depth", "article", "inside", "titles", "title",
                 "score", "chars", "link_chars", "head_chars", "links", "kept")

    def __init__(self, tag: str, parent: int, depth: int):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.words: frozenset | set = frozenset()
        self.named = False                        # a whole name says boilerplate
        self.set_aside = self.main = self.linked = self.kept = False
        # an article; inside one; its header; a heading there
        self.article = self.inside = self.titles = self.title = False
        self.score = 0.0
        self.chars = self.link_chars = self.head_chars = self.links = 0


class Page:
    """Elements in page order, and events: (element, text) or None where a
    block starts or ends."""

    def __init__(self, html: str):
        self.elements = [Element("html", -1, 0)]
        self.events: list[tuple[int, str] | None] = []
        self._open = [0]
        self._count = {"html": 1}
        self._read(html)

    # -- tree building
    def _push(self, tag: str, attrs: str) -> None:
        up = self._open[-1]
        e = Element(tag, up, self.elements[up].depth + 1)
        parent = self.elements[up]
        e.set_aside, e.linked = parent.set_aside, parent.linked or tag == "a"
        e.inside = parent.inside or parent.article
        e.titles = parent.titles or tag == "header" and e.inside and not parent.set_aside
        e.title = parent.title or parent.titles and tag in HEADINGS
        if attrs:
            self._attributes(e, attrs)
        comments = not e.words.isdisjoint(COMMENTS)
        if tag in MAIN:
            e.main = not comments and (e.words.isdisjoint(BOILERPLATE) or tag == "main")
            e.set_aside = e.set_aside or not e.main
            e.article = e.article or tag == "article" and e.main
        elif tag in DROPPED:
            e.set_aside = True
        elif e.title:
            e.set_aside = False
        if tag == "a":
            e.links = 1
        self.elements.append(e)
        if tag not in VOID:
            self._open.append(len(self.elements) - 1)
            self._count[tag] = self._count.get(tag, 0) + 1

    @staticmethod
    def _attributes(e: Element, attrs: str) -> None:
        words: set[str] = set()
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
            if name in ("class", "id"):
                for token in value.split():
                    parts = {w.lower() for w in _WORDS(token)}
                    words |= parts
                    named = parts & BOILERPLATE
                    e.named = e.named or bool(named) and parts <= named | COMPANIONS
            elif name == "role":
                if value.lower() in ROLES:
                    e.set_aside = True
                e.main = e.main or value.lower() == "main"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" \
                    or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                e.set_aside = True
            elif name == "itemprop" and value.lower() == "articlebody":
                e.main = e.article = True
            elif name == "itemtype" and value.rstrip("/").endswith("/Comment"):
                words.add("comment")
        e.words = words

    def _pop_to(self, tags: tuple[str, ...], limits: tuple[str, ...] = (), inline: bool = False) -> None:
        """Close the nearest open element of these tags, and what is in it."""
        if not any(self._count.get(t) for t in tags):
            return
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.elements[self._open[k]].tag
            if tag in tags:
                for i in self._open[k:]:
                    self._count[self.elements[i].tag] -= 1
                del self._open[k:]
                return
            if tag in limits or inline and tag in BLOCK:
                return

    def _start(self, tag: str, attrs: str) -> None:
        if tag in ("html", "body") and self._count.get(tag):
            return
        if tag in BLOCK:
            self.events.append(None)
            self._pop_to(("p",), ("table", "button", "object"))
            if tag in HEADINGS and self.elements[self._open[-1]].tag in HEADINGS:
                self._pop_to(tuple(HEADINGS))
        if tag in CLOSES:
            # cells and rows belong to the innermost table
            limits = LIMITS.get(tag, ("table",))
            for _ in CLOSES[tag]:
                self._pop_to(CLOSES[tag], limits)
        if tag == "a":
            self._pop_to(("a",), inline=True)
        self._push(tag, attrs)
        if tag == "br":
            self.events.append((self._open[-1], " "))

    def _end(self, tag: str) -> None:
        if tag in BLOCK and (tag == "p" or self._count.get(tag)):
            self.events.append(None)
        if tag == "br":
            self.events.append((self._open[-1], " "))
        elif tag != "html" and tag != "body":
            limits = () if tag in ("table", "article", "main", "section", "div") else ("table", "td", "th")
            self._pop_to((tag,), () if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") else limits,
                         inline=tag not in BLOCK)

    def _text(self, text: str) -> None:
        if text:
            self.events.append((self._open[-1], entities.unescape(text) if "&" in text else text))

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self._text(s[at:])
                return
            c = s[lt + 1:lt + 2]
            if c == "!" or c == "?":
                self._text(s[at:lt])
                if s.startswith("<!--", lt):
                    end = s.find("-->", lt + 2 if s.startswith("<!-->", lt) else lt + 4)
                    at = n if end < 0 else end + 3
                else:
                    end = s.find(">", lt)
                    at = n if end < 0 else end + 1
                continue
            m = _NAME.match(s, lt + 2 if c == "/" else lt + 1)
            if not m:
                if c == "/":                      # a bogus comment
                    self._text(s[at:lt])
                    end = s.find(">", lt)
                    at = n if end < 0 else end + 1
                    continue
                self._text(s[at:lt + 1])          # an ordinary "<"
                at = lt + 1
                continue
            self._text(s[at:lt])
            tag, after = m[0].lower(), m.end()
            end = s.find(">", after)
            if end < 0:                           # the page is cut off in a tag
                return
            attrs = s[after:end]
            if attrs.count('"') & 1 or attrs.count("'") & 1:
                q = _QUOTED_END.match(s, after)
                if q:
                    end, attrs = q.end() - 1, s[after:q.end() - 1]
            at = end + 1
            if c == "/":
                self._end(tag)
                continue
            self._start(tag, attrs)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(s, at)
                stop = close.start() if close else n
                at = stop
            elif attrs.endswith("/") and tag in ("svg", "path", "circle", "rect", "use", "g"):
                self._end(tag)

    # -- scoring
    def set_boilerplate_aside(self) -> None:
        """By class and id names; not what holds the article, nor page frames
        whose names merely mention a part ("has-sidebar"). Inside an article, and
        for paragraphs and headings, a whole name must say so ("related-posts",
        not "related-work"), unless it speaks of comments."""
        holds = [False] * len(self.elements)
        for i in range(len(self.elements) - 1, 0, -1):
            e = self.elements[i]
            holds[i] = holds[i] or e.main and not e.set_aside
            if holds[i]:
                holds[e.parent] = True
        for i, e in enumerate(self.elements):
            if e.title:
                continue
            if i and self.elements[e.parent].set_aside:
                e.set_aside = True
            elif e.words and not holds[i] and e.tag not in ("html", "body"):
                named = e.words & BOILERPLATE
                if not e.named and (e.inside or e.tag in PARAGRAPH or e.tag in HEADINGS):
                    named = named & COMMENTS
                if named and (e.words.isdisjoint(LAYOUT) or not named.isdisjoint(COMMENTS)):
                    e.set_aside = True

    def blocks(self) -> list[tuple[int, str, int]]:
        """(block element, text, link characters) of what is not set aside."""
        out, parts, owner, links = [], [], -1, 0
        elements = self.elements

        def flush():
            nonlocal parts, owner, links
            text = " ".join("".join(parts).split())
            if text:
                out.append((owner, text, min(links, len(text))))
            parts, owner, links = [], -1, 0
        for event in self.events:
            if event is None:
                if parts:
                    flush()
                continue
            i, text = event
            e = elements[i]
            if e.set_aside:
                parts.append(" ") if parts else None
                continue
            if owner < 0:
                owner = i
                while elements[owner].tag not in BLOCK and elements[owner].parent >= 0:
                    owner = elements[owner].parent
            parts.append(text)
            if e.linked:
                links += len(text.strip())
        if parts:
            flush()
        return out

    def main_text(self) -> str:
        self.set_boilerplate_aside()
        elements, blocks = self.elements, self.blocks()
        if not blocks:
            return ""
        for owner, text, links in blocks:
            e = elements[owner]
            e.chars += len(text)
            e.link_chars += links
            if e.tag in HEADINGS:
                e.head_chars += len(text)
                continue
            points = 1 + text.count(",") + min(len(text) / 100, 3)
            i = e.parent if e.tag in PARAGRAPH and e.parent >= 0 else owner
            level = 0
            while i >= 0:
                elements[i].score += points / (1, 2)[level] if level < 2 else points / (3 * level)
                i, level = elements[i].parent, level + 1
        for e in reversed(elements[1:]):
            up = elements[e.parent]
            up.chars += e.chars
            up.link_chars += e.link_chars
            up.head_chars += e.head_chars
            up.links += e.links
        for e in elements:
            if e.chars:
                e.score = (e.score + BONUS * e.main) * (1 - e.link_chars / e.chars)
        live = [i for i, e in enumerate(elements) if e.chars and not e.set_aside and e.tag in BLOCK]
        best = max(live, key=lambda i: (elements[i].score, elements[i].depth), default=0)
        while best and elements[best].tag in PARTS:
            best = elements[best].parent
        # the article as a whole, if the best container is a part of one
        i = best
        while i > 0:
            if elements[i].main:
                best = i
            i = elements[i].parent
        self._keep(best, live)
        return "\n".join(text for owner, text, _ in blocks if elements[owner].kept)

    def _keep(self, best: int, live: list[int]) -> None:
        elements = self.elements
        top = elements[best]
        roots = {best}
        for i in live:
            e = elements[i]
            if i == best or best == 0 or e.parent != top.parent:
                continue
            density = e.link_chars / e.chars
            alike = e.score >= max(10, 0.2 * top.score) and (e.main or not top.main)
            reads = e.tag == "p" and not top.main and (e.chars > 80 and density < 0.25 or density == 0)
            heads = not top.main and (e.tag in HEADINGS
                                      or i < best and e.head_chars == e.chars and not e.link_chars)
            if alike or reads or heads:
                roots.add(i)
        for i, e in enumerate(elements):
            e.kept = i in roots or i > 0 and elements[e.parent].kept
            if e.kept and e.tag in ("ul", "ol", "div", "section", "table") and i not in roots \
                    and not e.inside and e.links >= 3 and e.link_chars > 0.9 * e.chars:
                e.kept = False


def main_text(html: str | None) -> str:
    """The article of a page, one line per block."""
    return Page(html).main_text() if html else ""


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    common.prepare(pages.sparkSession)

    def run(rows):
        for b in common.batches(rows):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         common.text_or_empty(html_col).alias("html"))
            .withColumn("page_id", F.col("page_id").cast("long"))
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
