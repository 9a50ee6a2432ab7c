"""Layout-aware text of HTML pages.

A tree is built with the tags that HTML implies (a block ends an open paragraph, an item the
item before it, a cell the cell before it, the end of an element all that are open in it).
An open head ends where the body must begin.  Elements that an attribute or an inline style hides
are left out (style sheets are not read); in what is merely invisible, visible parts are shown.  What
remains is laid out: blocks on lines of their own, with a blank line around paragraphs and headings,
line breaks in a row as blank lines, list items with bullets or numbers and indented by their depth
(up to DEPTH levels), tables with cells padded to their column's width and kept below each other past
cells that span rows, a selection's options on lines of their own; of SVG its text elements.

Cases: null and empty pages give an empty text; broken and unclosed markup, and nesting of any
depth, are rendered as far as they go; repeated rows are each returned; an empty table gives an
empty result.  Only the two named columns are read."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import Batches, columns_as

# fixed values: HTML's elements by the part they play
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ESCAPABLE = frozenset("textarea title".split())  # raw text in which character references count
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist object audio video canvas annotation annotation-xml".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())  # any other start tag ends an open head
SVG_UNSEEN = frozenset("defs desc metadata symbol clippath mask pattern marker".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
# a start tag on the left ends open elements on the right, but not past the scope
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
BARRIER = frozenset({"table", "td", "th", "caption", "html", "button"})

TOKEN = re.compile(r"""<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*)[^>]*+>|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
DEPTH = 40
SPACE = re.compile(r"[ \t\n\f\r]+")


class Element:
    __slots__ = ("attributes", "children", "hidden", "tag", "visible")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []
        style = attributes.get("style") or ""
        self.hidden = tag in UNSEEN or "hidden" in attributes or tag == "input" or bool(style and HIDING.search(style))
        said = VISIBILITY.findall(style) if style else []
        self.visible = said[-1].lower() == "visible" if said else None  # None: as around it


def attributes_of(text: str) -> dict[str, str]:
    if not text or text == "/":
        return {}
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def parse(page: str) -> Element:
    """The tree of a page, below a root of its own."""
    root = Element("#root", {})
    stack, at, n = [root], 0, len(page)
    opened: Counter = Counter()  # open elements by tag, so that none is looked for in vain

    def close(count: int) -> None:
        for e in stack[count:]:
            opened[e.tag] -= 1
        del stack[count:]

    def open_(node: Element) -> None:
        opened[node.tag] += 1
        stack.append(node)

    def text(s: str) -> None:
        if s:
            s = html.unescape(s) if "&" in s else s
            if stack[-1].tag == "head" and s.strip(" \t\n\f\r"):  # the body begins without a tag
                close(len(stack) - 1)
            stack[-1].children.append(s)

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in BARRIER and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
                    break
            else:
                if tag == "p":  # an end without a start is an empty paragraph
                    stack[-1].children.append(Element("p", {}))
                elif tag == "br":
                    stack[-1].children.append(Element("br", {}))
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in IMPLIED and any(opened[e] for e in IMPLIED[tag][0]):
            ends, scope = IMPLIED[tag]
            last = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in scope:
                    break
                if stack[k].tag in ends:
                    last = k
            if last is not None:
                close(last)
        if tag in ENDS_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BARRIER:
                    break
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Element("tr", {})
            stack[-1].children.append(row)
            open_(row)
        node = Element(tag, attributes_of(m[3]))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            held = page[at : end.start() if end else n]
            node.children.append(html.unescape(held).removeprefix("\n") if tag in ESCAPABLE else held)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            open_(node)
    return root


class Lines:
    """Text in the making: runs of white space count once, blocks begin lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.gap = self.broken = False
        self.breaks = 0  # line breaks in a row, beyond the first
        self.indents: list[str] = []
        self.bullet = ""

    def line_break(self) -> None:
        if self.parts:
            self.end()
            self.broken = True
        else:
            self.breaks += self.broken

    def block(self) -> None:
        """A block begins or ends here; breaks before it show nothing."""
        self.end()
        self.broken, self.breaks = False, 0

    def write(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if s[0] == " ":
            self.space = bool(self.parts) or self.space
            s = s[1:]
        if not s:
            return
        for _ in range(self.breaks):
            self.put("")
        self.broken, self.breaks = False, 0
        tail = s[-1] == " "
        if self.parts and self.space:
            self.parts.append(" ")
        self.parts.append(s[:-1] if tail else s)
        self.space = tail

    def end(self) -> None:
        """Ends the line if it has text."""
        if self.parts:
            self.put("".join(self.parts))
        self.parts, self.space = [], False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        indent = "".join(self.indents[:DEPTH])
        if self.bullet:
            indent = indent[: len(indent) - len(self.bullet)] + self.bullet
            self.bullet = ""
        self.lines.append((indent + line).rstrip())


def columns_of(text: str) -> int:
    """How many columns of a terminal a line takes: wide letters two, marks on others none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def table_lines(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of (cell text, columns it spans, rows it spans), padded so that columns stand below each
    other; where a cell from above still stands, its columns are empty."""
    width: dict[int, int] = {}
    split: list[list[tuple[list[str], int]]] = []
    above: dict[int, int] = {}  # column -> rows that a cell from above still takes
    for row in rows:
        placed: list[tuple[list[str], int]] = []
        at, taken = 0, {}
        for cell, span, down in row:
            while above.get(at):
                placed.append(([""], 1))
                at += 1
            text = cell.split("\n")
            if span == 1:
                width[at] = max(width.get(at, 0), *map(columns_of, text))
            placed.append((text, span))
            if down > 1:
                taken |= {x: down - 1 for x in range(at, at + span)}
            at += span
        above = {x: n - 1 for x, n in above.items() if n > 1} | taken
        split.append(placed)
    out = []
    for row in split:
        for k in range(max((len(c) for c, _ in row), default=0)):
            at, line = 0, []
            for cell, span in row:
                room = sum(width.get(x, 0) for x in range(at, at + span)) + 3 * (span - 1)
                own = cell[k] if k < len(cell) else ""
                line.append(own + " " * (room - columns_of(own)))
                at += span
            out.append(" | ".join(line).rstrip())
    return out


def spanned(attributes: dict[str, str], name: str, whole: int = 1) -> int:
    """A cell's span, 1,000 at most; `whole` where it is 0."""
    text = attributes.get(name, "1").strip()
    n = int(text) if text.isdecimal() and len(text) < 9 else 1
    return min(1000, n) or whole


def render(root: Element) -> str:
    """The visible text.  The walk keeps its own stack, so depth is not bounded."""
    outs, tables, lists = [Lines()], [], []
    todo: list = [(root, 0, True)]  # node, whether it is done, whether what surrounds it is visible
    pre = 0
    drawn: list[int] = []  # for each open svg, how many of its text elements are open
    while todo:
        node, done, seen = todo.pop()
        out = outs[-1]
        if isinstance(node, str):
            if not seen or (drawn and not drawn[-1]):
                continue
            if pre:
                *whole, rest = node.split("\n")
                for line in whole:
                    out.parts.append(line)
                    out.put("".join(out.parts))
                    out.parts = []
                if rest:
                    out.parts.append(rest)
            else:
                out.write(node)
            continue
        tag = node.tag
        if not done:
            if node.hidden or (drawn and not drawn[-1] and tag in SVG_UNSEEN):
                continue
            seen = seen if node.visible is None else node.visible
            if tag in ("option", "optgroup") and node.attributes.get("label") and seen:
                out.block()
                out.write(node.attributes["label"])
                out.end()
                if tag == "option":
                    continue
            if tag == "svg":
                drawn.append(0)
            elif tag in ("text", "foreignobject") and drawn:
                drawn[-1] += 1
            if tag == "br":
                out.line_break()
                continue
            if tag == "img":
                if node.attributes.get("alt") and seen:
                    out.write(node.attributes["alt"])
                continue
            if tag in BLOCK:
                out.block()
                out.gap |= tag in SPACED and not (tag in ("ul", "ol") and lists)
            if tag == "hr":
                out.put("----")
                continue
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attributes.get("start", "1")
                lists.append([tag == "ol", int(start) if start.lstrip("-").isdigit() and len(start) < 9 else 1])
            elif tag == "li":
                kind = lists[-1] if lists else [False, 1]
                mark = f"{kind[1]}. " if kind[0] else "- "
                kind[1] += 1
                out.indents.append(" " * len(mark))
                out.bullet = mark
            elif tag in ("blockquote", "dd"):
                out.indents.append("  ")
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                outs.append(Lines())
            todo.append((node, 1, seen))
            todo += [(c, 0, seen) for c in reversed(node.children)]
            continue
        if tag == "svg":
            drawn.pop()
        elif tag in ("text", "foreignobject") and drawn:
            drawn[-1] -= 1
            out.space |= bool(out.parts)
        if tag in ("td", "th") and tables:
            cell = outs.pop()
            cell.end()
            tables[-1][-1].append(("\n".join(cell.lines), spanned(node.attributes, "colspan"), spanned(node.attributes, "rowspan", 1000)))
            continue
        if tag in BLOCK:
            out.block()
            out.gap |= tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1)
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            if out.bullet:  # an empty item
                out.put("")
            out.indents.pop()
        elif tag in ("blockquote", "dd"):
            out.indents.pop()
        elif tag == "pre":
            pre -= 1
        elif tag == "table" and tables:
            gap, out.gap = out.gap, bool(out.lines)
            for line in table_lines(tables.pop()):
                out.put(line)
            out.gap = gap
    outs[0].end()
    return "\n".join(outs[0].lines)


def extract(page: str) -> str:
    return render(parse(page))


def _extract(batches: Batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(p or "") for p in b.column(1).to_pylist()]
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([t.count("\n") + bool(t) for t in texts], pa.int64()), pa.array(digests, pa.string())], ["page_id", "text", "n_chars", "n_lines", "text_sha256"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars, n_lines, text_sha256 of every page."""
    return columns_as(pages, page_id=id_col, html=html_col).mapInArrow(_extract, "page_id long, text string, n_chars long, n_lines long, text_sha256 string")
