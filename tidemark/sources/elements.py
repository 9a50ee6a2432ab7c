"""Elements of HTML pages as rows: a parser with a stack, run where the pages are.

Each element that is wanted becomes a row with its number in the page, where it ends, and the table, row
and section that it stands in; what belongs together is then a matter of joins and windows over a page.
Tables within cells are tables of their own, tables within comments are read too, attributes may
come in any order, and cells, rows and sections that are not closed end where the next one begins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: elements without content, and which open elements a start tag ends
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"tr": ("td", "th", "tr", "caption"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "thead", "tbody", "tfoot", "caption"), "thead": ("td", "th", "tr", "tbody", "tfoot", "caption"), "tfoot": ("td", "th", "tr", "thead", "tbody", "caption"), "li": ("li",), "option": ("option",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
# fixed value: open elements beyond which nothing is ended
WALLS = {"tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "tfoot": "table", "li": "ul ol", "option": "select", "p": "div td th li article section body", "dt": "dl", "dd": "dl"}
# fixed value: start tags that end an open paragraph
BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()
ENDS |= {tag: ("p",) for tag in BLOCKS}
WALLS |= {tag: WALLS["p"] for tag in BLOCKS}
SECTIONS = ("thead", "tbody", "tfoot")
ROW = "no int, end_no int, tag string, classes array<string>, attrs map<string,string>, text string, table_no int, row_no int, section string"
KIND = pa.list_(pa.struct([("no", pa.int32()), ("end_no", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("table_no", pa.int32()), ("row_no", pa.int32()), ("section", pa.string())]))


class _Page(HTMLParser):
    """The wanted elements of one page, in document order."""

    def __init__(self, tags: frozenset[str], classes: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.classes = tags, classes
        self.open: list[dict] = []
        self.found: list[dict] = []
        self.no = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._imply(tag)
        values = {k: v or "" for k, v in reversed(attrs)}  # of an attribute that is there twice the first counts
        above = self.open[-1] if self.open else None
        e = {"no": self.no, "end_no": self.no, "tag": tag, "classes": values.get("class", "").split(), "attrs": list(values.items()), "parts": None}
        self.no += 1
        for k in ("table_no", "row_no", "section"):
            e[k] = above[k] if above else None
        if tag == "table":
            e.update(table_no=e["no"], row_no=None, section=None)
        elif tag == "tr":
            e["row_no"] = e["no"]
        elif tag in SECTIONS:
            e.update(section=tag, row_no=None)
        if tag in self.tags or self.classes.intersection(e["classes"]):
            e["parts"] = []
            self.found.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                self._close(k)
                return
            if self.open[k]["tag"] == "table" and tag in ("td", "th", "tr", *SECTIONS):
                return  # the end of a cell of an outer table can't be in an inner one

    def handle_data(self, data: str) -> None:
        part = data.strip()
        if part and not (self.open and self.open[-1]["tag"] in ("script", "style")):
            for e in self.open:
                if e["parts"] is not None:
                    e["parts"].append(part)

    def handle_comment(self, data: str) -> None:
        if "<table" in data.lower():
            inner = _Page(self.tags, self.classes)
            inner.no = self.no
            inner.read(data)
            self.found += inner.found
            self.no = inner.no

    def _imply(self, tag: str) -> None:
        ends, walls = ENDS.get(tag, ()), WALLS.get(tag, "").split()
        last = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] in walls:
                break
            if self.open[k]["tag"] in ends:
                last = k
        if last is not None:
            self._close(last)

    def _close(self, k: int) -> None:
        for e in self.open[k:]:
            e["end_no"] = self.no - 1
        del self.open[k:]

    def read(self, text: str) -> list[dict]:
        self.feed(text)
        self.close()
        self._close(0)
        return self.found


def elements(pages: DataFrame, html: str, tags: Sequence[str] = (), classes: Sequence[str] = (), references: bool = True) -> DataFrame:
    """`pages` without the column `html`, a row for each element with one of the tags or classes.

    no: the place among all elements of the page; end_no: the last element within; text: its pieces of
    text, each trimmed, strung together (null without text); table_no, row_no and section: those it is in.  A null page has
    no elements.  Without `references` texts and attributes keep their character references as written, for
    those who read them by rules of their own."""
    tags, classes = frozenset(tags), frozenset(classes)
    others = [c for c in pages.columns if c != html]
    packed = pages.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("page") if others else F.struct(F.lit(1).alias("_")).alias("page"), F.col(f"`{html}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part, rows = b.slice(lo, 64), []
                for text in part.column(1).to_pylist():
                    if text is not None and not references:
                        text = text.replace("&", "&amp;")  # the parser's reading of it gives back what was written
                    found = _Page(tags, classes).read(text) if text is not None else []
                    rows.append([{**{k: e[k] for k in ("no", "end_no", "tag", "classes", "attrs", "table_no", "row_no", "section")}, "text": "".join(e["parts"]) or None} for e in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, KIND)], ["page", "found"])

    found = T.StructType().add("page", packed.schema["page"].dataType).add("found", T.ArrayType(T.StructType.fromDDL(ROW)))
    return packed.mapInArrow(run, found).select(*(["page.*"] if others else []), F.inline("found"))
