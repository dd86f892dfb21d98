"""Main text of web pages by scoring the element tree.

A page is read once into a tree of block elements. Every block of text passes points for its
length and commas, discounted by its link density, to its ancestors: all to the parent, half
to the next one, 1/(3k) to the k-th above. The element with the most points, again discounted
by the links in it, is the container; siblings that score a fifth of it or read like its
paragraphs are kept beside it. Elements that their tag, role or class names mark as page
furniture take no part, and link lists inside the container go.

The reading follows the HTML standard where text depends on it: raw text elements, void
elements, comments, end tags that are implied or have no partner, character references. It is
linear in the page's length, and the tree is kept in flat arrays.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form header hgroup html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split())
CLOSE_P = BLOCKS - frozenset("body caption html option optgroup tbody td tfoot th thead tr".split()) | {"hr"}
#: Start tag -> open elements it closes, up to the element that bounds the search.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
           "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
           "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)),
           "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "option": (("option",), ("select", "datalist"))}
#: An end tag or a new paragraph does not reach past these.
SCOPE = frozenset("caption html table td th template".split())

# What is never main text: by tag, by role, and by words in class names and ids.
FURNITURE_TAGS = frozenset("nav footer aside form noscript template select datalist button fieldset dialog menu "
                           "object video audio canvas svg label output search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu "
                            "menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo "
    "promos promotion leaderboard banner banners sidebar sidebars aside nav navbar navigation menu menus breadcrumb "
    "breadcrumbs "
    "header masthead topbar topnav sidenav subnav footer colophon comment comments commentlist disqus reply replies respond discussion cookie cookies "
    "consent gdpr notice notices notification notifications alert popup popups modal overlay dialog newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations widget widgets "
    "toolbar pagination pager paywall copyright".split())
CONTENT_WORDS = frozenset("article body content entry main page post story text wrapper container column row".split())
KEPT_TAGS = frozenset("html body main".split())

TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"'=]+|=\s*(?:"[^"]*"|'[^']*')?|["'])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
COMMAS = ",،、，"
ANCESTORS = 6


@dataclass(frozen=True)
class Scoring:
    chars_per_point: int = 100    # one point for so many characters of a block ...
    most_length_points: int = 3   # ... up to so many
    full_block: int = 25          # a shorter block earns its first point in proportion
    sibling_share: float = 0.2    # siblings from this part of the container's score on stay
    paragraph_chars: int = 80     # longer sibling paragraphs stay, if they hold few links
    sibling_links: float = 0.25
    list_links: float = 0.5       # lists with more of their characters in links go


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def furniture_name(name: str) -> bool:
    """Whether one class name or id speaks of page furniture: ``ad-box``, ``siteFooter``; not
    ``has-sidebar``, ``no-comments`` or ``with-ads``."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    found = FURNITURE_WORDS.intersection(words)
    if found == {"header"} and not CONTENT_WORDS.isdisjoint(words):
        return False                                # the head of an article: its title
    return bool(found) and words[0] not in ("has", "no", "with", "without")


def content_name(name: str) -> bool:
    words = [w.lower() for w in NAME_WORD.findall(name)]
    return bool(words) and CONTENT_WORDS.issuperset(words)


def is_furniture(tag: str, given: dict[str, str], in_article: bool) -> bool:
    if tag in KEPT_TAGS:
        return False
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return True
    if "hidden" in given or given.get("role", "").lower() in FURNITURE_ROLES or HIDDEN.search(given.get("style", "")):
        return True
    names = (given.get("class", "") + " " + given.get("id", "")).split()
    if tag == "article":
        return any(n.lower() in ("comment", "reply") or n.lower().startswith(("comment-", "comment_")) for n in names)
    if tag in HEADINGS or (tag == "header" and in_article):
        names = [n for n in names if "header" not in n.lower()]
    return any(map(furniture_name, names)) and not any(map(content_name, names))


class Tree:
    """Block elements of one page in document order, and its blocks of text."""

    def __init__(self, html: str) -> None:
        self.tag: list[str] = []
        self.parent = array("q")
        self.furniture = bytearray()
        self.block_owner = array("q")
        self.block_text: list[str] = []
        self.block_links = array("q")
        self._open: list[int] = []                 # nodes, outermost first
        self._places: dict[str, list[int]] = {}    # tag -> depths at which it is open
        self._scopes: list[int] = []               # depths of the elements in SCOPE
        self._hidden = 0                           # open elements that are furniture for certain
        self._link = -1                            # depth at which a link is open, or -1
        self._runs: list[str] = []                 # text since the last block boundary
        self._in_link: list[bool] = []
        self._push("html", False)
        self._read(html)
        self._flush()

    def _push(self, tag: str, furniture: bool) -> None:
        self.parent.append(self._open[-1] if self._open else -1)
        depth = len(self._open)
        self._open.append(len(self.tag))
        self.tag.append(tag)
        self.furniture.append(furniture)
        self._hidden += furniture and tag != "form"
        self._places.setdefault(tag, []).append(depth)
        if tag in SCOPE:
            self._scopes.append(depth)

    def _pop_to(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        self._flush()
        while len(self._open) > depth:
            node = self._open.pop()
            tag = self.tag[node]
            self._hidden -= self.furniture[node] and tag != "form"
            self._places[tag].pop()
            if tag in SCOPE:
                self._scopes.pop()
        if self._link > depth:
            self._link = -1

    def _depth(self, tag: str, bound: int = 0) -> int:
        """Depth of the innermost open ``tag`` at or below ``bound``, or -1."""
        at = self._places.get(tag)
        return at[-1] if at and at[-1] >= bound else -1

    def _flush(self) -> None:
        if self._runs:
            runs = [unescape(r) for r in self._runs]
            text = " ".join("".join(runs).split())
            if text:
                self.block_owner.append(self._open[-1])
                self.block_text.append(text)
                linked = sum(len("".join(r.split())) for r, inside in zip(runs, self._in_link) if inside)
                self.block_links.append(linked)
            self._runs.clear()
            self._in_link.clear()

    def _text(self, run: str) -> None:
        if run and not self._hidden:
            self._runs.append(run)
            self._in_link.append(self._link >= 0)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            left = html.find("<", at)
            if left < 0:
                self._text(html[at:])
                return
            self._text(html[at:left])
            mark = html[left + 1:left + 2]
            if mark == "!" and html.startswith("--", left + 2):
                at = self._comment_end(html, left + 4)
            elif mark in ("!", "?") and mark or (mark == "/" and not html[left + 2:left + 3].isascii()) or (
                    mark == "/" and left + 2 < size and not html[left + 2].isalpha()):
                end = html.find(">", left + 2)
                at = size if end < 0 else end + 1
            elif (mark.isascii() and mark.isalpha()) or (mark == "/" and left + 2 < size):
                m = TAG.match(html, left)
                if m is None:
                    return                          # the page ends inside a tag
                name, at = m.group(1).lower(), m.end()
                if mark == "/":
                    self._end(name)
                else:
                    self._start(name, m.group(2))
                    if name in RAW and not (name == "title" and self._places.get("svg")):
                        at = self._raw_end(html, name, at)
            else:
                self._text("<")
                at = left + 1

    @staticmethod
    def _comment_end(html: str, at: int) -> int:
        if html.startswith(">", at):
            return at + 1
        if html.startswith("->", at):
            return at + 2
        m = re.compile("--!?>").search(html, at)
        return m.end() if m else len(html)

    @staticmethod
    def _raw_end(html: str, name: str, at: int) -> int:
        m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
        return m.start() if m else len(html)

    def _start(self, name: str, rest: str) -> None:
        if name == "br":
            self._text("\n")
            return
        if name == "a":
            self._link = len(self._open) if "href" in rest.lower() else -1
            return
        block = name in BLOCKS
        if block or name == "hr":
            self._flush()
        scope = self._scopes[-1] if self._scopes else 0
        if name in CLOSE_P and (p := self._depth("p", scope)) >= 0:
            self._pop_to(p)
        if name in IMPLIED:
            closed, bounds = IMPLIED[name]
            bound = max(self._depth(b) for b in bounds)
            for tag in closed:
                if (at := self._depth(tag, bound + 1)) >= 0:
                    self._pop_to(at)
        if name in HEADINGS and self.tag[self._open[-1]] in HEADINGS:
            self._pop_to(len(self._open) - 1)
        if name in VOID or name in RAW or name in ("html", "head"):
            return
        plain = not rest or rest.isspace()
        if not plain and rest.rstrip().endswith("/") and name in ("svg", "path", "g"):
            return
        given = {} if plain else attributes(rest)
        if name == "body":
            return
        furniture = is_furniture(name, given, bool(self._places.get("article")))
        if block or furniture:
            self._push(name, furniture)

    def _end(self, name: str) -> None:
        if name == "a":
            self._link = -1
        elif name == "br":
            self._text("\n")
        elif name not in ("html", "body", "head"):
            scope = (self._scopes[-1] if self._scopes else 0) if name not in SCOPE else 0
            if name in HEADINGS:
                depth = max(self._depth(h, scope) for h in HEADINGS)
            else:
                depth = self._depth(name, scope)
            if depth > 0:
                self._pop_to(depth)
            elif name in BLOCKS:
                self._flush()


def density(links: float, chars: float) -> float:
    return min(links / chars, 1.0) if chars else 0.0


def extract(html: str | None, rules: Scoring = Scoring()) -> list[str]:
    """The blocks of a page's main text, in page order."""
    if not html:
        return []
    tree = Tree(html)
    n, parent, tags = len(tree.tag), tree.parent, tree.tag
    # A form around an article (a page inside one form) is no furniture.
    gone, around = bytearray(tree.furniture), bytearray(n)
    for i in range(n - 1, 0, -1):
        if around[i] and tags[i] == "form":
            gone[i] = 0
        if around[i] or (tags[i] in ("article", "main") and not gone[i]):
            around[parent[i]] = 1
    for i in range(1, n):
        gone[i] |= gone[parent[i]]
    blocks = [b for b in range(len(tree.block_text)) if not gone[tree.block_owner[b]]]
    if not blocks:
        return []

    points, chars, links = array("d", bytes(8 * n)), array("d", bytes(8 * n)), array("d", bytes(8 * n))
    lists = bytearray(n)                     # how many of its blocks are wholly links, up to 2
    for b in blocks:
        owner, text, linked = tree.block_owner[b], tree.block_text[b], tree.block_links[b]
        size = len(text) - text.count(" ")
        chars[owner] += size
        links[owner] += linked
        tag = tags[owner]
        if tag in HEADINGS:
            continue
        earned = (min(1.0, size / rules.full_block) + sum(map(text.count, COMMAS))
                  + min(size / rules.chars_per_point, rules.most_length_points)) * (1 - density(linked, size))
        # A paragraph's points go to its parent; text that stands in a container itself stays there.
        up = parent[owner] if tag in ("p", "pre", "blockquote", "li", "td", "th", "dd", "dt", "figcaption") \
            and owner else owner
        for k in range(ANCESTORS):
            points[up] += earned if k == 0 else earned / 2 if k == 1 else earned / (3 * k)
            up = parent[up]
            if up < 0:
                break
    for i in range(n - 1, 0, -1):            # children come after their parents
        chars[parent[i]] += chars[i]
        links[parent[i]] += links[i]
    score = [points[i] * (1 - density(links[i], chars[i])) for i in range(n)]
    best = max(range(n), key=lambda i: (score[i], -i))

    # The whole article, where the page marks one around the best container.
    up = best
    while up > 0:
        if tags[up] in ("article", "main"):
            best = up
            if tags[up] == "article":
                break
        up = parent[up]

    keep = bytearray(n)
    keep[best] = 1
    if best:
        least, home = rules.sibling_share * score[best], parent[best]
        for i in range(1, n):
            if parent[i] != home or gone[i] or i == best:
                continue
            few_links = density(links[i], chars[i]) < rules.sibling_links
            if tags[best] in ("article", "main"):
                keep[i] = tags[i] == tags[best] and score[i] >= least
            elif tags[i] in HEADINGS:
                keep[i] = i < best and home > 0 and few_links
            elif tags[i] == "p":
                keep[i] = few_links and chars[i] >= rules.paragraph_chars
            else:
                keep[i] = score[i] >= least and few_links
    for i in range(1, n):
        keep[i] |= keep[parent[i]]
        # Link lists inside the container: menus without a name.
        if keep[i] and i != best and tags[i] in ("ul", "ol", "div", "section", "table", "dl") \
                and links[i] > rules.list_links * chars[i]:
            gone[i] = 1
        gone[i] |= gone[parent[i]]
    return [tree.block_text[b] for b in blocks if keep[tree.block_owner[b]] and not gone[tree.block_owner[b]]]


def extract_pages(pages: DataFrame, carry: list[str] | None = None, html: str = "html",
                  rules: Scoring = Scoring()) -> DataFrame:
    """One row per input row: struct ``doc`` with the ``carry`` columns (default all), the main
    ``text`` (blocks joined by a space, white space as Python's ``str.split`` sees it) and
    ``n_blocks``.

    A null, empty or tagless page of blanks gives an empty text; plain text without tags is one
    block; repeated rows give equal texts, an empty table no rows; the input columns stay inside
    ``doc``, so they may have any names. Ties between containers go to the outer, then the
    earlier element. A page of any length is read whole.
    """
    carry = pages.columns if carry is None else carry
    given = pages.select(F.struct(*[pages[c] for c in carry]).alias("doc"), pages[html].cast("string").alias("_html"))
    schema = T.StructType([given.schema["doc"]]).add("text", "string").add("n_blocks", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h.as_py(), rules) for h in batch.column("_html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([" ".join(f) for f in found], pa.string()),
                 pa.array([len(f) for f in found], pa.int64())], names=["doc", "text", "n_blocks"])

    return given.mapInArrow(run, schema)
