"""Layout-aware HTML text: a tree builder with implied tags, visibility rules, and a renderer that keeps the layout.

The tokeniser reads a page once, from left to right, as the HTML standard does: tags with their attributes, comments,
raw text of script-like elements; a tag or comment that never ends takes the rest of the page.  The builder makes a
tree of it.  It closes what a new tag implies (p before blocks, li, dt/dd, options, rows and cells), opens a missing
row or table body, lets void elements be empty, closes head at the first tag or text that cannot stand in it, ignores
end tags that nothing opened, and closes everything at the end.  It knows where each tag is open, so no tag costs more
than what it closes.

Not visible are script, style, head, template, noscript, comments and such, what svg and math only define or annotate,
elements with ``hidden`` or ``display:none``, hidden inputs, and closed ``details`` but for their summary.  Under
``visibility:hidden`` nothing shows but what is ``visibility:visible`` again.

The renderer emits all visible text: white space collapses outside ``pre`` and ``textarea``; blocks stand on lines of
their own, paragraphs and headings apart by an empty line; list items carry ``- `` or their number, indented by
depth; a table's cells stand in aligned columns, head first and foot last, with ``colspan`` and ``rowspan`` kept free;
images give their ``alt``, inputs their value.  The layout stops widening, never the text: columns are aligned up to
COLUMN characters and indentation grows up to INDENT; a table of single cells is laid out as blocks.

Cases: null and empty pages give an empty text; malformed markup always gives some tree; nesting of any depth is walked
with a stack of its own, not by recursion; repeated rows render alike; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
#: Not shown within svg and math.
UNSHOWN = frozenset("annotation annotation-xml desc metadata defs clippath mask symbol marker pattern".split())
RCDATA = frozenset("title textarea".split())
HIDDEN = frozenset("head script style template noscript iframe object audio video canvas datalist noembed noframes title meta link base param source track".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu dir".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup legend".split())
#: What an opening tag closes, up to the nearest of the named boundaries.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
CELL_BOUNDS = frozenset("td th table".split())
TABLE_PARTS = frozenset("table tr tbody thead tfoot td th body html".split())
P_BOUNDS = frozenset("td th table li button div section article".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
#: Widest column that cells are aligned to, and deepest indentation.
COLUMN, INDENT = 160, 80

_name = re.compile(r"[a-zA-Z][^\s/>]*")
_attr = re.compile(r"[\s/]*(=?[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)?))?")
_gap = re.compile(r"[\s/]*")
_display = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_visibility = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z-]+)", re.I)
_space = re.compile(r"[ \t\n\r\f]+")
_ends = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW | RCDATA}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class Builder:
    """Tokens to a tree."""

    def __init__(self) -> None:
        self.root = Node("#root")
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)  # for each tag the places in ``open`` of its elements

    def nearest(self, tags: frozenset[str] | set[str]) -> int:
        """The innermost open element of these tags; 0 without one."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def foreign(self) -> bool:
        return bool(self.at.get("svg") or self.at.get("math"))

    def cut(self, i: int) -> None:
        while len(self.open) > i:
            self.at[self.open.pop().tag].pop()

    def push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.at[node.tag].append(len(self.open))
        self.open.append(node)

    def text(self, s: str) -> None:
        if s:
            if self.open[-1].tag == "head" and s.strip(" \t\n\r\f"):
                self.cut(len(self.open) - 1)
            self.open[-1].children.append(html.unescape(s) if "&" in s else s)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if self.open[-1].tag == "head" and tag not in HEAD:
            self.cut(len(self.open) - 1)
        if tag in IMPLIED:
            self.imply(*IMPLIED[tag])
        if tag in CLOSES_P and (i := self.nearest({"p"})) > self.nearest(P_BOUNDS):
            self.cut(i)
        if tag == "tr" and self.open[-1].tag == "table":
            self.push(Node("tbody"))
        elif tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            if self.open[-1].tag == "table":
                self.push(Node("tbody"))
            self.push(Node("tr"))
        if tag in ("html", "body") and self.at.get(tag):
            return
        if tag == "a" and self.at.get("a"):
            self.end("a")
        if tag in UNSHOWN and self.foreign():
            attrs = {**attrs, "hidden": ""}
        node = Node(tag, attrs)
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self.push(node)
            if closed and self.foreign():
                self.cut(len(self.open) - 1)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br"))
            return
        i = self.nearest({tag})
        if i and (tag in TABLE_PARTS or i > self.nearest(CELL_BOUNDS)):  # an end tag doesn't reach out of its cell
            again = [Node(n.tag, n.attrs) for n in self.open[i + 1 :] if n.tag in FORMATTING][:8] if tag in FORMATTING else []
            self.cut(i)
            for n in again:  # misnested formatting goes on behind the end
                self.push(n)
        elif tag == "p":
            self.open[-1].children.append(Node("p"))

    def imply(self, closes: set[str], until: set[str]) -> None:
        i = self.nearest(closes)
        if i > self.nearest(until):
            while self.open[i - 1].tag in closes and self.open[i - 1].tag not in until:
                i -= 1
            self.cut(i)


def attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """(attributes, whether the tag closes itself, the place behind the tag or -1 where it never ends)."""
    out: dict[str, str] = {}
    n = len(page)
    while True:
        gap = _gap.match(page, at)
        at = gap.end()
        if at >= n:
            return out, False, -1
        if page[at] == ">":
            return out, gap[0].endswith("/"), at + 1
        m = _attr.match(page, at)
        at = m.end()
        if at < n and page[at] in "\"'" and page[at - 1 : at].strip(" \t\n\r\f") in ("=", "") and m[2] is m[3] is m[4] is None:
            return out, False, -1  # a quote that is never closed
        value = next((v for v in m.groups()[1:] if v is not None), "")
        out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)


def parse(page: str) -> Node:
    b, at, n = Builder(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= n:
            b.text(page[at:])
            break
        nxt = page[lt + 1]
        m = _name.match(page, lt + 1 + (nxt == "/"))
        if m:
            b.text(page[at:lt])
            tag = m[0].lower()
            if m.end() < n and page[m.end()] == ">":
                attrs, closed, at = {}, False, m.end() + 1
            else:
                attrs, closed, at = attributes(page, m.end())
            if at < 0:
                break
            if nxt == "/":
                b.end(tag)
                continue
            b.start(tag, attrs, closed)
            if tag in _ends and b.open[-1].tag == tag:  # not <title/> of an svg
                stop = _ends[tag].search(page, at)
                inner = page[at : stop.start() if stop else n]
                if tag in RCDATA:
                    b.text(inner)
                elif inner:
                    b.open[-1].children.append(inner)
                at = page.find(">", stop.end()) + 1 if stop else n
                b.end(tag)
                if not at:
                    break
        elif nxt in "!?/":
            b.text(page[at:lt])
            if page.startswith("<![CDATA[", lt) and b.foreign():
                stop = page.find("]]>", lt + 9)
                b.open[-1].children.append(page[lt + 9 : stop if stop >= 0 else n])
                at = stop + 3 if stop >= 0 else n
            elif page.startswith("<!--", lt):
                if page.startswith((">", "->"), lt + 4):
                    at = page.find(">", lt + 4) + 1
                else:
                    stop = page.find("-->", lt + 4)
                    at = stop + 3 if stop >= 0 else n
            else:
                stop = page.find(">", lt + 2)
                at = stop + 1 if stop >= 0 else n
        else:  # a sign, not a tag
            b.text(page[at : lt + 1])
            at = lt + 1
    return b.root


def displayed(node: Node) -> bool:
    a = node.attrs
    if node.tag in HIDDEN or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    shown = _display.findall(a["style"]) if "style" in a else []
    return shown[-1].lower() != "none" if shown else "hidden" not in a


def visible(node: Node, shown: bool) -> bool:
    """Whether text shows in an element whose parent's text does (or doesn't)."""
    said = _visibility.findall(node.attrs["style"]) if "style" in node.attrs else []
    return shown if not said or said[-1].lower() == "inherit" else said[-1].lower() not in ("hidden", "collapse")


def width(text: str) -> int:
    """Columns that a text takes: wide East Asian letters two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines of rendered text; a block ends the line and asks for empty lines before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.mark = ""
        self.indent = ""
        self.space = False

    def inline(self, text: str) -> None:
        text = _space.sub(" ", text)
        if not text:
            return
        if text[0] == " ":
            self.space, text = True, text[1:]
        if not text:
            return
        trail = text[-1] == " "
        text = text[:-1] if trail else text
        if self.now and self.space:
            self.now.append(" ")
        self.now.append(text)
        self.space = trail

    def flush(self) -> None:
        if self.now:
            self.put("".join(self.now))
            self.now = []
        self.space = False

    def put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        if self.mark:
            self.lines.append(self.indent[: max(0, len(self.indent) - len(self.mark))] + self.mark + line)
            self.mark = ""
        else:
            self.lines.append((self.indent + line) if line else "")

    def apart(self, lines: int) -> None:
        self.flush()
        self.gap = max(self.gap, lines)

    def deeper(self, by: int) -> str:
        """Indents by so much more; returns what to set back."""
        before = self.indent
        self.indent = " " * min(INDENT, len(before) + by)
        return before


Steps = Iterator["Steps"]


def run(steps: Steps) -> None:
    """Runs a generator that yields what is to be run before it goes on; the stack is a list, so depth is free."""
    stack = [steps]
    while stack:
        more = next(stack[-1], None)
        if more is None:
            stack.pop()
        else:
            stack.append(more)


def render(root: Node) -> str:
    page = Page()
    run(_children(root.children, page, False, True))
    page.flush()
    return "\n".join(line.rstrip() for line in page.lines)


def _children(nodes: list[Node | str], page: Page, pre: bool, shown: bool) -> Steps:
    for x in nodes:
        if not isinstance(x, str):
            if displayed(x):
                yield _element(x, page, pre, shown)
        elif not shown:
            continue
        elif pre:
            for k, line in enumerate(x.split("\n")):
                if k:
                    page.put("".join(page.now))
                    page.now = []
                if line:
                    page.now.append(line)
        else:
            page.inline(x)


def _element(node: Node, page: Page, pre: bool, shown: bool) -> Steps:
    tag, a = node.tag, node.attrs
    shown = visible(node, shown)
    if tag == "br":
        if page.now:
            page.flush()
        elif shown:
            page.put("")
    elif tag == "hr":
        page.apart(1)
    elif tag == "img":
        page.inline(a.get("alt", "") if shown else "")
    elif tag == "input":
        page.inline(" " + (a.get("value") or a.get("placeholder") or "") + " " if shown else "")
    elif tag in ("text", "mtd"):  # labels of a diagram, cells of a formula
        page.inline(" ")
        yield _children(node.children, page, pre, shown)
        page.inline(" ")
    elif tag == "table":
        page.apart(1)
        yield _table(node, page, shown)
        page.apart(1)
    elif tag in ("ul", "ol", "menu", "dir"):
        page.apart(0 if page.indent else 1)
        number = int(a["start"]) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", a.get("start", "")) else 1
        for x in node.children:
            if isinstance(x, Node) and x.tag == "li" and displayed(x):
                page.apart(0)
                page.mark = f"{number}. " if tag == "ol" else "- "
                before = page.deeper(len(page.mark))
                number += 1
                yield _children(x.children, page, pre, visible(x, shown))
                page.flush()
                if page.mark and visible(x, shown):
                    page.put("")
                page.mark, page.indent = "", before
            else:
                yield _children([x], page, pre, shown)
        page.apart(0 if page.indent else 1)
    elif tag in ("pre", "textarea"):
        page.apart(1)
        yield _children(node.children, page, True, shown)
        if page.now:
            page.put("".join(page.now))
            page.now = []
        page.apart(1)
    elif tag == "details" and "open" not in a:
        page.apart(0)
        summary = next((x for x in node.children if isinstance(x, Node) and x.tag == "summary"), None)
        yield _children([summary] if summary else [], page, pre, shown)
        page.apart(0)
    elif tag in ("blockquote", "dd"):
        page.apart(1 if tag == "blockquote" else 0)
        before = page.deeper(2)
        yield _children(node.children, page, pre, shown)
        page.flush()
        page.indent = before
        page.apart(1 if tag == "blockquote" else 0)
    elif tag in BLOCK:
        page.apart(1 if tag in APART else 0)
        yield _children(node.children, page, pre, shown)
        page.apart(1 if tag in APART else 0)
    else:
        yield _children(node.children, page, pre, shown)


def _span(node: Node, name: str, most: int) -> int:
    v = node.attrs.get(name, "").strip()
    return max(1, min(most, int(v))) if v.isascii() and v.isdecimal() and len(v) < 10 else 1


def _table(table: Node, page: Page, shown: bool) -> Steps:
    parts: dict[str, list[tuple[Node, bool]]] = {"thead": [], "tbody": [], "tfoot": []}
    for x in table.children:
        if isinstance(x, str) or x.tag not in ("caption", "thead", "tbody", "tfoot", "tr"):
            yield _children([x], page, False, shown)
        elif not displayed(x):
            continue
        elif x.tag == "caption":
            yield _children(x.children, page, False, shown)
            page.apart(0)
        elif x.tag == "tr":
            parts["tbody"].append((x, visible(x, shown)))
        else:
            for y in x.children:
                if isinstance(y, Node) and y.tag == "tr":
                    parts[x.tag] += [(y, visible(y, visible(x, shown)))] if displayed(y) else []
                else:
                    yield _children([y], page, False, visible(x, shown))
    page.flush()
    rows = [([x for x in row.children if (x.strip() if isinstance(x, str) else displayed(x))], seen) for part in parts.values() for row, seen in part]
    if all(len(row) < 2 for row, _ in rows):  # nothing to align
        for row, seen in rows:
            page.apart(0)
            yield _children(row, page, False, seen)
            page.apart(0)
        return
    grid: list[list[tuple[int, int, list[str]]]] = []  # (column, columns, lines) of each cell
    busy: list[tuple[int, int, int]] = []  # columns from, to, and the row up to which cells of rows above reach
    for r, (row, seen) in enumerate(rows):
        busy = sorted(b for b in busy if b[2] > r)
        above, cells, c, k = busy, [], 0, 0
        for x in row:
            while k < len(above) and above[k][0] <= c:
                c, k = max(c, above[k][1]), k + 1
            if isinstance(x, str):
                lines, across = [_space.sub(" ", x).strip()] if seen else [], 1
            else:
                inner = Page()
                yield _element(x, inner, False, seen)
                inner.flush()
                lines, across = [line.rstrip() for line in inner.lines], _span(x, "colspan", MAX_COLSPAN)
                if (down := _span(x, "rowspan", MAX_ROWSPAN)) > 1:
                    busy = [*busy, (c, c + across, r + down)]
            cells.append((c, across, lines))
            c += across
        grid.append(cells)
    starts = _columns(grid)
    for cells in grid:
        for k in range(max((len(lines) for *_, lines in cells), default=0)):
            line, at = [], 0
            for c, _, lines in cells:
                if k < len(lines) and lines[k]:
                    gap = max(starts[c] - at, 2 if at else 0)
                    line += [" " * gap, lines[k]]
                    at += gap + width(lines[k])
            page.put("".join(line))


def _columns(grid: list[list[tuple[int, int, list[str]]]]) -> dict[int, int]:
    """Where each column starts that some cell starts in: cells of one column set its width, wider ones the last of theirs."""
    used = sorted({c for cells in grid for c, *_ in cells})
    place = {c: k for k, c in enumerate(used)}
    wide = [0] * len(used)
    across = []
    for cells in grid:
        for c, n, lines in cells:
            most = min(COLUMN, max(map(width, lines), default=0))
            last = place[c]
            while last + 1 < len(used) and used[last + 1] < c + n:
                last += 1
            if last == place[c]:
                wide[last] = max(wide[last], most)
            elif most:
                across.append((last - place[c], place[c], last, most))
    for _, first, last, most in sorted(across):
        wide[last] += max(0, min(COLUMN, most - sum(wide[first : last + 1]) - 2 * (last - first)))
    out, at = {}, 0
    for c, n in zip(used, wide):
        out[c] = at
        at += n + 2 if n else 0
    return out


def page_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url and the visible text of each page."""
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    return common.map_rows(chosen, "page_id long, url string, text string", lambda x: {"page_id": x["page_id"], "url": x["url"], "text": [page_text(h) for h in x["html"]]})


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(common.table(spark, sf_dir, "pages"))
