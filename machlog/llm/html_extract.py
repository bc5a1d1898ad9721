"""HTML extraction by tree scoring.

Every run of text in a block is a paragraph.  It passes points for its length
and commas to the container around it, half to the next one and a shrinking
share further up; a container's points are discounted by its link density.  The
best container and those of its siblings that score too, or read like
paragraphs, are kept; boilerplate elements never count.  An element marked as
boilerplate by a word of its class, id or role, and a form, is judged when the
page is read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from machlog.llm.common import fields, quoted, whole_row

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<more>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<more2>[^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}

_VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that are paragraphs themselves: their points go to the block around them.
PARAGRAPH = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
#: An open element of the value ends where the key begins.
CLOSES = {t: ("p",) for t in BLOCK} | {
    "li": ("p", "li"), "dd": ("p", "dd", "dt"), "dt": ("p", "dd", "dt"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"),
    "th": ("p", "td", "th"), "option": ("option",)}
#: Ending an element does not reach beyond these.
WALLS = frozenset("html body article main section div ul ol dl table blockquote aside nav header footer form".split())
NEVER = frozenset(
    "head title script style noscript template iframe object embed svg math canvas audio video map nav footer aside button "
    "select option textarea input label fieldset menu dialog xmp noembed noframes".split())
#: Words of class, id and role that mark boilerplate.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner banners nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars aside footer header masthead comment comments reply replies respond disqus cookie cookies "
    "consent notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended widget widgets pagination pager copyright search contentinfo complementary".split())
GOOD = frozenset("article body content entry main page post story text blog".split())
#: A name that begins or ends with one of these says something of the element, not what it is.
MODIFIERS = frozenset("has no with without not is category tag type format status".split())
STATES = frozenset("open closed enabled disabled on off".split())
#: Words that make an article element a reader's comment or an advert.
NO_ARTICLE = frozenset("comment comments reply replies respond ad ads advert adverts advertisement sponsored".split())
SEMANTIC = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A form with this share of the page's points is the page, not a form to fill in.
LARGE = 0.5
LEVELS = 5


class _Node:
    __slots__ = ("tag", "up", "gone", "kept", "points", "size", "linked", "link", "bonus", "marked", "certain", "slug", "semantic")

    def __init__(self, tag: str, up: _Node | None, gone: bool, link: bool, bonus: float, marked: bool = False,
                 certain: bool = False, slug: tuple = ()):
        self.tag, self.up, self.gone, self.link, self.bonus = tag, up, gone, link, bonus
        self.marked, self.certain, self.slug = marked, certain, slug
        self.semantic = tag in SEMANTIC and not gone and not marked
        self.kept, self.points, self.size, self.linked = False, 0.0, 0, 0

    def score(self) -> float:
        return (self.points + self.bonus) * (1 - self.linked / self.size) if self.size and self.points else 0.0


class _Page:
    """The element tree of a page as far as scoring needs it: nodes in page order, blocks of text."""

    def __init__(self, source: str):
        self.root = _Node("#root", None, False, False, 0.0)
        self.nodes = [self.root]
        self.open = [self.root]
        self.counts: dict[str, int] = {}
        self.marks = False
        self.runs: list[tuple[_Node, list[tuple[str, _Node]]]] = []
        self.pending: list[tuple[str, _Node]] = []
        self._read(source)
        self.blocks = self._judged() if self.marks else self._blocks()

    def _read(self, s: str) -> None:
        at = 0
        for m in iter(lambda: _MARKUP.search(s, at), None):
            if m.start() > at:
                self._text(s[at:m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"), plain=True)
                continue
            tag = tag.lower()
            if m["end"] or m["end2"]:
                self._end(tag)
                continue
            more = m["more"] if m["tag"] else m["more2"]
            self._start(tag, more)
            if tag in _RAW and not more.rstrip().endswith("/"):
                close = _RAW[tag].search(s, at)
                at = close.start() if close else len(s)
        self._text(s[at:])
        self._flush()

    def _text(self, text: str, plain: bool = False) -> None:
        top = self.open[-1]
        if text and not top.gone:
            self.pending.append((text if plain or "&" not in text else html.unescape(text), top))

    def _flush(self) -> None:
        if not self.pending:
            return
        self.runs.append((next(n for n in reversed(self.open) if n.tag in BLOCK or n is self.root), self.pending))
        self.pending = []

    def _blocks(self) -> list[tuple[_Node, str, int]]:
        """Owner, text and linked length of every block that has text in elements not gone."""
        out = []
        for owner, runs in self.runs:
            runs = [(t, n.link) for t, n in runs if not n.gone]
            text = " ".join("".join(t for t, _ in runs).split())
            if text:
                linked = sum(len(" ".join(t.split())) for t, link in runs if link)
                out.append((owner, text, min(linked, len(text))))
        return out

    def _judged(self) -> list[tuple[_Node, str, int]]:
        """The blocks without those of boilerplate.  A marked element is boilerplate if
        it has no article or main inside and not the id of its own title.  A name that
        only mentions boilerplate (``search-results``) does not condemn all the page
        has, nor a form half of it.  Inner elements are judged first and then count no more."""
        held = dict.fromkeys(self.nodes, 0.0)
        titles: dict[_Node, tuple] = {}
        for owner, runs in self.runs:
            text = " ".join("".join(t for t, _ in runs).split())
            size = len(text)
            for t, n in runs:  # a block's points by the share of its runs
                if size and not n.link:
                    held[n] += _points(text, 0) * min(1.0, len(t.strip()) / size)
            if owner.tag in HEADINGS and owner.up is not None:
                titles.setdefault(owner.up, _slug(text))
        for n in reversed(self.nodes):
            if n.up is not None:
                held[n.up] += held[n]
                n.up.semantic |= n.semantic
        total, taken = held[self.root], dict.fromkeys(self.nodes, 0.0)
        for n in reversed(self.nodes):
            own = held[n] - taken[n]
            share = 0.999 if n.tag != "form" else LARGE
            spared = n.slug and titles.get(n) == n.slug or not n.certain and own >= share * total > 0
            if n.marked and not n.semantic and not spared:
                n.gone, total, taken[n] = True, total - own, held[n]
            if n.up is not None:
                taken[n.up] += taken[n]
        for n in self.nodes:
            n.gone = n.gone or n.up is not None and n.up.gone
        return self._blocks()

    def _start(self, tag: str, more: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        if tag in BLOCK:
            self._flush()
        for other in CLOSES.get(tag, ()):
            if self.counts.get(other):
                self._pop(other, walls=True)
        if tag in VOID:
            return
        up = self.open[-1]
        gone, bonus, marked, certain, slug = up.gone, 0.0, False, False, ()
        if not gone:
            attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(more)} if more.strip() else {}
            read = ("class", "role") if tag in HEADINGS else ("class", "id", "role")
            names = _names(" ".join(attributes.get(k, "") for k in read))
            inner = any(n.tag in SEMANTIC for n in self.open) if tag == "header" else False
            gone = tag in NEVER or tag == "header" and not inner or self._hidden(attributes, more)
            if not gone and names and tag not in ("html", "body", "main", "hgroup") and tag not in HEADINGS:
                marked, certain = _marks(names, NO_ARTICLE if tag == "article" else BOILERPLATE)
            if not gone and tag == "form":
                marked, certain = True, certain
            if marked:
                self.marks = True
                other = _marks(_names(f"{attributes.get('class', '')} {attributes.get('role', '')}"), BOILERPLATE)[0]
                own = _slug(attributes.get("id", ""))
                slug = own if not other and not BOILERPLATE.issuperset(own) else ()
            bonus = 10.0 * (tag in SEMANTIC and not marked) + 5.0 * any(GOOD.intersection(n) for n in names)
        node = _Node(tag, up, gone, up.link or tag == "a", bonus, marked, certain, slug)
        self.nodes.append(node)
        self.open.append(node)
        self.counts[tag] = self.counts.get(tag, 0) + 1

    @staticmethod
    def _hidden(attributes: dict[str, str], more: str) -> bool:
        return (attributes.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|\s)hidden(?=[\s/=]|$)", _VALUE.sub("", more).lower()) is not None
                or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")) is not None)

    def _end(self, tag: str) -> None:
        if self.counts.get(tag):
            if tag in BLOCK:
                self._flush()
            self._pop(tag, walls=tag not in WALLS)

    def _pop(self, tag: str, walls: bool) -> None:
        """Close the innermost open ``tag`` and what is open inside it; a wall between hides it."""
        k = len(self.open) - 1
        while k > 0 and self.open[k].tag != tag:
            if walls and self.open[k].tag in WALLS:
                return
            k -= 1
        if k > 0:
            self._flush()
            for n in self.open[k:]:
                self.counts[n.tag] -= 1
            del self.open[k:]


def extract_text(source: str | None) -> str:
    """The main text of one page: its kept blocks in page order, one a line."""
    if not source:
        return ""
    page = _Page(source)
    if not page.blocks:
        return ""
    for owner, text, linked in page.blocks:
        owner.size += len(text)
        owner.linked += linked
        points = _points(text, linked)
        node = owner.up if owner.tag in PARAGRAPH and owner.up else owner
        for level in range(LEVELS):
            node.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            if node.up is None:
                break
            node = node.up
    for node in reversed(page.nodes):  # children come after their parents
        if node.up is not None:
            node.up.size += node.size
            node.up.linked += node.linked
    best = max(page.nodes, key=_Node.score)
    if not best.score():  # nothing but links
        return ""
    around = best
    while around is not None:  # a part of an article or main element stands for all of the outermost one
        if around.tag in SEMANTIC and not around.marked:
            best = around
        around = around.up
    if best.up is not None:
        _keep_siblings(page, best)
    if best.tag in SEMANTIC:  # other articles, wherever they stand
        least = max(10.0, 0.2 * best.score())
        for node in page.nodes:
            node.kept = node.kept or node.tag in SEMANTIC and not node.gone and not node.marked and node.score() >= least
    for node in page.nodes:
        node.kept = node.kept or node is best or (node.up is not None and node.up.kept)
    out = []
    for owner, text, linked in page.blocks:
        alone = best.tag in SEMANTIC and owner.tag == "p" and owner.up is best.up and best.up is not None
        if owner.kept or alone and _reads(text, linked):
            out.append(text)
    return "\n".join(out)


def _keep_siblings(page: _Page, best: _Node) -> None:
    """Mark what is kept beside ``best``: containers that score too; beside a container
    that is no article or main also whatever reads like prose, however short, and the
    headings whose part, up to the next heading of their level, has a kept element."""
    around = [n for n in page.nodes if n.up is best.up and (n is best or not n.gone and n.tag in BLOCK)]
    if best.tag in SEMANTIC:
        least = max(10.0, 0.2 * best.score())
        for node in around:
            node.kept = node.tag not in ("h1", "h2", "h3") and node.score() >= least
        return
    top = dict(zip(around, around))
    for node in page.nodes:
        if node.up in top:
            top[node] = top[node.up]
    last = {top[owner]: text for owner, text, _ in page.blocks if owner in top}
    live = [False] * 7
    for node in reversed(around):
        if node.tag in HEADINGS:
            level = int(node.tag[1])
            node.kept, live[level:] = live[level], [False] * (7 - level)
        elif node is best or node.size and (node.tag not in PARAGRAPH and node.score() >= 0.2 * best.score()
                                            or _reads(last[node], node.linked, node.size)):
            node.kept, live = True, [True] * 7


def _points(text: str, linked: int) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))


_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _names(said: str) -> list[list[str]]:
    """The words of every class, id or role name: cut at signs, digits and humps."""
    found = [[w for w in re.split(r"[^a-z]+", _HUMP.sub("-", name).lower()) if w] for name in said.split()]
    return [words for words in found if words and words[0] not in MODIFIERS and words[-1] not in STATES]


def _marks(names: list[list[str]], boilerplate: frozenset) -> tuple[bool, bool]:
    """Whether a name mentions boilerplate, and whether one is a name of boilerplate (its last word)."""
    hits = [words for words in names if boilerplate.intersection(words)
            and not (boilerplate.intersection(words) <= {"header"} and GOOD.intersection(words))]  # an entry-header holds the title
    return bool(hits), any(words[-1] in boilerplate for words in hits)


def _slug(title: str) -> tuple:
    return tuple(re.findall(r"[a-z]+", title.lower()))


def _reads(text: str, linked: int, size: int | None = None) -> bool:
    """Whether what stands beside the best container reads like prose; ``text`` is the last of its ``size`` characters."""
    size = len(text) if size is None else size
    return linked < 0.25 * size if size > 80 else not linked and text.endswith((".", "!", "?"))


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with ``html`` replaced by ``text`` and ``n_chars`` (its code points).

    * Null or empty html, a page without text, or one of links alone: ''.
    * White space in a block, decoded no-break spaces and <br> included, becomes one space.
    * Broken markup is read as browsers do for paragraphs, lists and table cells;
      an end tag without its start is skipped, what is open at the end is closed.
    * Pages are read on their own, repeated rows alike; input columns called
      ``text`` or ``n_chars`` are replaced; an empty table gives an empty table.
    """
    out = {source, "text", "n_chars"}
    rows = pages.select(whole_row(pages, out).alias("row"), F.col(quoted(source)).alias("html"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = pa.array(map(extract_text, part.column(1).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], ["row", "text"])

    return rows.mapInArrow(run, schema).select(*fields("row", pages, out), "text", F.length("text").cast("long").alias("n_chars"))
