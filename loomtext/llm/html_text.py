"""Operator 10, HTML extraction by layout-aware rendering.

A tokenizer and tree builder follow the HTML parsing rules where these change the visible text: implied end tags and elements,
raw text, scopes, foster-parented table content, comments and doctypes, character references. Visibility rules drop what a
browser doesn't render. All visible text is then laid out: white space collapses, blocks begin and end lines, paragraphs and
headings stand apart by an empty line, list items have markers and indents, and table cells are aligned in columns.

One projection of the html column, with no shuffle.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import table

#: A cell wider than ALIGN doesn't widen its column; no cell is moved beyond place FARTHEST by blanks. Elements nested deeper than
#: DEEPEST become siblings, as in browsers, which have this limit too.
ALIGN, GAP, FARTHEST, DEEPEST = 80, 2, 1000, 512
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?=>)|[^\s"'>][^\s>]*+))*+>""")
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?""")
_COMMENT_END = re.compile(r"--!?>")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_UNSHOWN = re.compile(r"display\s*:\s*none")
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)")
_RULE = re.compile(r"([^{}]*+)\{([^{}]*+)\}")
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?$")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript title textarea".split())
NEVER = frozenset("head script style template noscript title iframe noembed noframes object video audio canvas datalist rp map area base link meta param source track".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table tbody td textarea tfoot th thead tr ul xmp caption".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre listing xmp figure table fieldset".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("html table td th caption template object applet marquee".split())
SECTIONS = frozenset(("tbody", "thead", "tfoot"))
TABLE_PARTS = SECTIONS | {"tr", "td", "th", "caption", "colgroup", "col"}
IN_HEAD = frozenset("base link meta title style script noscript template".split())


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("tag", "attrs", "children", "parent", "depth")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.depth = parent.depth + 1 if parent else 0

    def attributes(self) -> dict[str, str]:
        """Names in lower case; the first of equal names counts."""
        out: dict[str, str] = {}
        for m in _ATTR.finditer(self.attrs):
            v = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            out.setdefault(m[1].lower(), unescape(v) if "&" in v else v)
        return out


class Tree:
    """The tree of a page, and the text of its style sheets."""

    def __init__(self, html: str):
        self.root = Node("html", "", None)
        self.open, self.styles, self.body = [self.root], [], None
        html = html.replace("\0", "").replace("\r\n", "\n").replace("\r", "\n") if "\0" in html or "\r" in html else html
        at, n, text_from = 0, len(html), 0
        while True:
            i = html.find("<", at)
            if i < 0 or i + 1 >= n:
                break
            c = html[i + 1]
            end = None
            if c.isascii() and c.isalpha():
                name = _NAME.match(html, i + 1)
                rest = _REST.match(html, name.end())
                if rest:
                    self.text(html[text_from:i])
                    attrs = html[name.end() : rest.end() - 1]
                    end = self.start(name[0].lower(), attrs, html, rest.end())
            elif c == "/":
                if i + 2 < n and html[i + 2].isascii() and html[i + 2].isalpha():
                    name = _NAME.match(html, i + 2)
                    rest = _REST.match(html, name.end())
                    if rest:
                        self.text(html[text_from:i])
                        self.end(name[0].lower())
                        end = rest.end()
                else:
                    end = html.find(">", i + 2) + 1 if i + 2 < n else -1
                    if end == -1:
                        break
                    self.text(html[text_from:i])
            elif c in "!?":
                self.text(html[text_from:i])
                if html.startswith("<!--", i):
                    if html.startswith((">", "->"), i + 4):
                        end = html.find(">", i + 4) + 1
                    else:
                        m = _COMMENT_END.search(html, i + 4)
                        end = m.end() if m else 0
                else:
                    end = html.find(">", i + 2) + 1
                text_from = i
            else:
                at = i + 1
                continue
            if not end:  # the file ends in a tag or comment, which is dropped
                self.text(html[text_from:i])
                return
            at = text_from = end
        self.text(html[text_from:])

    # -- what happens on each token

    def text(self, s: str) -> None:
        if not s:
            return
        if "&" in s:
            s = unescape(s)
        top = self.open[-1]
        if top.tag in SECTIONS or top.tag in ("table", "tr"):
            if not s.isspace():
                self.foster(s)
            return
        if top.tag in ("html", "head"):
            if s.isspace():
                return
            top = self.into_body()
        if top.tag == "colgroup":
            self.open.pop()
            return self.text(s)
        top.children.append(s)

    def foster(self, child: Node | str) -> None:
        """Puts a child before the innermost table."""
        t = next(x for x in reversed(self.open) if x.tag == "table")
        if isinstance(child, Node):
            child.parent = t.parent
        place = t.parent.children
        at = len(place) - 1
        while place[at] is not t:
            at -= 1
        place.insert(at, child)

    def into_body(self) -> Node:
        if self.open[-1].tag == "head":
            self.open.pop()
        if len(self.open) == 1:
            if self.body is None:
                self.body = Node("body", "", self.root)
                self.root.children.append(self.body)
            self.open.append(self.body)
        return self.open[-1]

    def push(self, tag: str, attrs: str) -> Node:
        top = self.open[-1]
        while top.depth >= DEEPEST and tag not in TABLE_PARTS:
            self.open.pop()
            top = self.open[-1]
        node = Node(tag, attrs, top)
        if (top.tag in SECTIONS or top.tag in ("table", "tr")) and tag not in TABLE_PARTS:
            self.foster(node)
        else:
            top.children.append(node)
        self.open.append(node)
        return node

    def close(self, tags: frozenset[str] | tuple[str, ...], stop: frozenset[str] = SCOPE) -> bool:
        """Pops up to the innermost open element of tags, unless one of stop is nearer."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return True
            if self.open[i].tag in stop:
                break
        return False

    def back_to(self, tags: tuple[str, ...] | frozenset[str]) -> None:
        while len(self.open) > 1 and self.open[-1].tag not in tags:
            self.open.pop()

    def in_table(self) -> bool:
        return any(x.tag == "table" for x in self.open)

    def start(self, tag: str, attrs: str, html: str, at: int) -> int:
        """Handles a start tag that ends at a place; gives the place to go on from."""
        if tag == "html":
            self.root.attrs = self.root.attrs or attrs
            return at
        if tag == "head":
            if len(self.open) == 1 and self.body is None:
                self.push(tag, attrs)
            return at
        if tag == "body":
            if self.body is None:
                self.into_body().attrs = attrs
            return at
        if self.open[-1].tag in ("html", "head") and not (tag in IN_HEAD and self.body is None):
            self.into_body()
        if tag in TABLE_PARTS:
            if not self.in_table():
                return at
            self.table_part(tag, attrs)
            return at
        if tag in ENDS_P:
            self.close(("p",))
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        elif tag == "li":
            self.close(("li",), SCOPE | {"ul", "ol", "menu", "dir"})
        elif tag in ("dd", "dt"):
            self.close(("dd", "dt"), SCOPE | {"dl"})
        elif tag in ("option", "optgroup"):
            self.close(("option",), SCOPE | {"select", "optgroup"})
            if tag == "optgroup":
                self.close(("optgroup",), SCOPE | {"select"})
        elif tag in ("rb", "rt", "rtc", "rp"):
            self.close(("rb", "rt", "rp"), SCOPE | {"ruby", "rtc"})
        elif tag in ("a", "button", "nobr"):
            self.close((tag,))
        elif tag == "table" and self.open[-1].tag in SECTIONS | {"table", "tr"}:
            self.close(("table",), frozenset())
        if tag == "plaintext":
            self.push(tag, attrs).children.append(html[at:])
            return len(html)
        node = self.push(tag, attrs)
        if tag in VOID:
            self.open.pop()
        elif tag in RAW:
            m = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|$)", re.I).search(html, at)
            inner, at = (html[at : m.start()], m.end()) if m else (html[at:], len(html))
            if tag in ("textarea", "xmp"):
                inner = inner.removeprefix("\n")
                node.children.append(unescape(inner) if tag == "textarea" else inner)
            elif tag == "style":
                self.styles.append(inner)
            self.open.pop()
        elif tag in ("pre", "listing") and html.startswith("\n", at):
            at += 1
        return at

    def table_part(self, tag: str, attrs: str) -> None:
        if tag in SECTIONS or tag in ("caption", "colgroup"):
            self.back_to(("table", "template"))
        elif tag == "col":
            self.back_to(("table", "colgroup", "template"))
        elif tag == "tr":
            self.back_to(SECTIONS | {"table", "template"})
            if self.open[-1].tag == "table":
                self.push("tbody", "")
        else:
            self.back_to(SECTIONS | {"table", "tr", "template"})
            if self.open[-1].tag == "table":
                self.push("tbody", "")
            if self.open[-1].tag in SECTIONS:
                self.push("tr", "")
        self.push(tag, attrs)
        if tag == "col":
            self.open.pop()

    def end(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        if tag == "head":
            if self.open[-1].tag == "head":
                self.open.pop()
        elif tag == "p":
            if not self.close(("p",)):
                if self.open[-1].tag in ("html", "head"):
                    self.into_body()
                self.push("p", "")
                self.open.pop()
        elif tag == "br":
            self.start("br", "", "", 0)
        elif tag in HEADINGS:
            self.close(HEADINGS)
        elif tag == "li":
            self.close(("li",), SCOPE | {"ul", "ol", "menu", "dir"})
        elif tag == "table":
            self.close(("table",), frozenset(("template",)))
        elif tag in SECTIONS or tag == "tr":
            self.close((tag,), frozenset(("table", "template")))
        elif tag in ("td", "th", "caption"):
            self.close((tag,), frozenset(("table", "template")))
        elif tag in BLOCK:
            self.close((tag,))
        else:
            self.close((tag,), SCOPE | BLOCK) or self.inline(tag)

    def inline(self, tag: str) -> None:
        """The end tag of an inline element that was left open round a block: the element ends there, the block stays open."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i]
                return
            if self.open[i].tag in SCOPE:
                return


def hidden_selectors(styles: list[str]) -> list[tuple[str | None, str | None, str | None]]:
    """(tag, "." or "#", name) of the simple selectors of rules that don't display; other selectors are left alone."""
    out = []
    for css in styles:
        if "none" in css:
            for m in _RULE.finditer(re.sub(r"/\*.*?\*/", "", css, flags=re.S)):
                if _UNSHOWN.search(m[2].lower()):
                    for s in m[1].split(","):
                        if (x := _SELECTOR.fullmatch(s.strip())) and x[0]:
                            out.append((x[1], x[2], x[3]))
    return out


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in s)


class Box:
    """Lines that are being laid out."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False  # a collapsed space waits for more text
        self.apart = 0  # lines of space before what comes next: 1 a new line, 2 an empty line

    def flow(self, s: str) -> None:
        """Text whose white space collapses."""
        if "  " in s or "\n" in s or "\t" in s or "\r" in s or "\f" in s:
            s = _SPACES.sub(" ", s)
        if s == " ":
            self.space = bool(self.parts) or self.space
            return
        lead = s[0] == " "
        core = s.strip(" ")
        self.begin()
        if self.parts and (lead or self.space):
            self.parts.append(" ")
        self.parts.append(core)
        self.space = s[-1] == " "

    def begin(self) -> None:
        if self.apart:
            self.line()
            if self.lines and self.apart > 1 and self.lines[-1] != "":
                self.lines.append("")
            self.apart = 0

    def line(self) -> None:
        """Ends the line, if anything is on it."""
        if self.parts:
            self.lines.append("".join(self.parts))
            self.parts = []
        self.space = False

    def newline(self) -> None:
        self.begin()
        self.lines.append("".join(self.parts))
        self.parts, self.space = [], False

    def kept(self, s: str) -> None:
        """Text whose white space stays."""
        first, *more = s.split("\n")
        if first or more:
            self.begin()
        if first:
            self.parts.append(first)
        for x in more:
            self.lines.append("".join(self.parts))
            self.parts = [x] if x else []
        self.space = False

    def block(self, space: int) -> None:
        self.line()
        self.apart = max(self.apart, space)

    def put(self, lines: list[str]) -> None:
        self.begin()
        self.line()
        self.lines += lines
        self.apart = 1

    def done(self) -> list[str]:
        self.line()
        out = [x.rstrip(" \t") for x in self.lines]
        while out and not out[-1]:
            out.pop()
        first = next((i for i, x in enumerate(out) if x), 0)
        return out[first:]


class Renderer:
    def __init__(self, tree: Tree):
        self.tree, self.rules = tree, hidden_selectors(tree.styles)

    def lines(self) -> list[str]:
        box = Box()
        self.inside(self.tree.root, box, False, True)
        return box.done()

    def displayed(self, node: Node) -> bool:
        tag = node.tag
        if tag in NEVER:
            return False
        if not node.attrs.strip(" /"):
            return tag != "dialog" and not any(k is None and t == tag for t, k, _ in self.rules)
        a = node.attributes()
        if "hidden" in a and a["hidden"].lower() != "until-found" or tag == "dialog" and "open" not in a or tag == "input":
            return False
        if "style" in a and _UNSHOWN.search(a["style"].lower()):
            return False
        if self.rules:
            classes = a.get("class", "").split()
            for t, k, name in self.rules:
                if (t is None or t == tag) and (k is None or (k == "." and name in classes) or (k == "#" and name == a.get("id"))):
                    return False
        return True

    def inside(self, node: Node, box: Box, pre: bool, visible: bool) -> None:
        """Lays out the children of a node."""
        tag = node.tag
        closed = tag == "details" and "open" not in node.attributes()
        number, step, shown_summary = 1, 1, False
        if tag == "ol":
            a = node.attributes()
            m = re.fullmatch(r"\s*([+-]?\d{1,9})\D*.*", a.get("start", ""), re.S)
            if "reversed" in a:
                step, number = -1, sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
            number = int(m[1]) if m else number
        for child in node.children:
            if isinstance(child, str):
                if visible and not closed:
                    box.kept(child) if pre else box.flow(child)
                continue
            t = child.tag
            if t == "br":
                if visible and not closed:
                    box.newline()
                continue
            if closed:
                if t != "summary" or shown_summary:
                    continue
                shown_summary = True
            if not self.displayed(child):
                continue
            see = visible
            if "visibility" in child.attrs and (m := _VISIBILITY.search(child.attributes().get("style", "").lower())):
                see = m[1] == "visible"
            if t == "li":
                inner = Box()
                self.inside(child, inner, pre, see)
                mark = "- "
                if tag == "ol":
                    m = re.fullmatch(r"\s*([+-]?\d{1,9})\D*.*", child.attributes().get("value", ""), re.S)
                    number = int(m[1]) if m else number
                    mark = f"{number}. "
                    number += step
                if see and (got := inner.done()):
                    box.block(1)
                    box.put([mark + got[0], *(x and " " * len(mark) + x for x in got[1:])])
                elif got := inner.done():
                    box.block(1)
                    box.put(got)
                continue
            if t == "table":
                box.block(2)
                if got := self.table(child, pre, see):
                    box.put(got)
                box.block(2)
                continue
            if t == "q":
                box.flow('"')
                self.inside(child, box, pre, see)
                box.flow('"')
                continue
            if t in ("td", "th"):  # outside a table's rows
                box.flow(" ")
            elif t in BLOCK:
                space = 2 if t in APART and not (t in ("ul", "ol") and node.tag == "li") else 1
                box.block(space)
                if t == "dd" or t == "blockquote":
                    inner = Box()
                    self.inside(child, inner, pre, see)
                    if got := inner.done():
                        box.put([x and "  " + x for x in got])
                else:
                    self.inside(child, box, pre or t in ("pre", "listing", "xmp", "textarea", "plaintext"), see)
                box.block(space)
                continue
            self.inside(child, box, pre, see)

    def table(self, node: Node, pre: bool, visible: bool) -> list[str]:
        """The lines of a table: captions, then rows of cells that begin at their columns' places."""
        out, groups = [], {"thead": [], "tbody": [], "tfoot": []}
        for c in node.children:
            if isinstance(c, Node) and self.displayed(c):
                if c.tag == "caption":
                    inner = Box()
                    self.inside(c, inner, pre, visible)
                    out += inner.done()
                elif c.tag in SECTIONS:
                    groups[c.tag if groups[c.tag] == [] or c.tag == "tbody" else "tbody"].append(c)
        cells: list[tuple[int, int, int, list[str]]] = []  # row, column, span, lines
        row = 0
        for section in (*groups["thead"], *groups["tbody"], *groups["tfoot"]):
            busy: list[list[int]] = []  # column, span, rows left
            for tr in section.children:
                if not isinstance(tr, Node) or tr.tag != "tr" or not self.displayed(tr):
                    continue
                col, taken, taken_before = 0, list(busy), busy
                fresh = []
                for cell in tr.children:
                    if not isinstance(cell, Node) or cell.tag not in ("td", "th") or not self.displayed(cell):
                        continue
                    while taken and taken[0][0] <= col:
                        first = taken.pop(0)
                        col = max(col, first[0] + first[1])
                    span = down = 1
                    if "span" in cell.attrs.lower():
                        a = cell.attributes()
                        span, down = (int(m[1]) if (m := re.match(r"\s*(\d{1,6})", a.get(k, ""))) else 1 for k in ("colspan", "rowspan"))
                        span, down = min(max(span, 1), 1000), math.inf if down == 0 else down
                    inner = Box()
                    self.inside(cell, inner, pre, visible)
                    cells.append((row, col, span, inner.done()))
                    if down > 1:
                        fresh.append([col, span, down])
                    col += span
                busy = []
                for c, s, n in sorted([*taken_before, *fresh]):
                    if n > 1 and busy and busy[-1][2] == n - 1 and busy[-1][0] + busy[-1][1] >= c:
                        busy[-1][1] = max(busy[-1][1], c + s - busy[-1][0])
                    elif n > 1:
                        busy.append([c, s, n - 1])
                row += 1
        starts = sorted({c for _, c, _, _ in cells})
        place, index = [0] * (len(starts) + 1), {c: i for i, c in enumerate(starts)}
        ends: dict[int, list[tuple[int, int]]] = {}
        for _, c, span, lines in cells:
            j = index[c] + 1
            while j < len(starts) and starts[j] < c + span:
                j += 1
            w = max((x for x in map(width, lines) if x <= ALIGN), default=0)
            ends.setdefault(j, []).append((index[c], w))
        for j in range(1, len(starts)):
            place[j] = min(FARTHEST, max([place[j - 1], *(place[i] + w + GAP for i, w in ends.get(j, []) if w)]))
        at = 0
        for r in range(row):
            own = []
            while at < len(cells) and cells[at][0] == r:
                own.append(cells[at])
                at += 1
            for k in range(max((len(x[3]) for x in own), default=0)):
                line, w = [], 0
                for _, c, _, lines in own:
                    if k < len(lines) and lines[k]:
                        gap = max(place[index[c]] - w, GAP if w else 0)
                        line += [" " * gap, lines[k]]
                        w += gap + width(lines[k])
                out.append("".join(line))
        return out


def render(html: str | None) -> str | None:
    """The visible text of a page; null for null."""
    if html is None:
        return None
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))
    return "\n".join(Renderer(Tree(html)).lines()) if html else ""


@F.arrow_udf(StringType())
def page_text(html: pa.Array) -> pa.Array:
    return pa.array([render(x) for x in html.to_pylist()], pa.string())


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row for each page: the key and text, all its visible text.

    A null page has a null text, an empty one, or one where nothing shows, an empty text. Hidden: what browsers don't render by
    tag, the hidden attribute, display:none and visibility inline, and display:none by simple selectors in the page's style
    sheets; scripts count as enabled. A rowspan of 0 ends with its row group. Inline formatting isn't reopened after a paragraph that it was left open in, which has no
    effect on the text. Each row is judged alone: repeated rows repeat, an empty table gives none, other columns are ignored.
    """
    return pages.select(F.col(key), page_text(F.col(html)).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "html"))
