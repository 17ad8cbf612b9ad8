"""Pages of markup as rows: sections, blocks, links and table cells, in document order.

One pass over each page, on the executors; a page yields rows, nothing is gathered. Broken markup never fails: tags that
are not closed end with their parent, and a null or empty page yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
BLOCKS = {"p", "li", "div", "blockquote", "pre", "dd", "dt", "tr", "table", "ul", "ol", "section", "article", "body"}
HIDDEN = {"script", "style", "noscript", "template"}
FIELDS = "seq int, kind string, level int, path string, text string, target string, table_no int, row int, col int"


class Page(HTMLParser):
    """Rows (kind, level, path, text, target, table_no, row, col) of one page.

    ``path`` numbers the headings above a row by their levels (1.2.1). A cell that spans rows or columns is repeated in
    each place that it covers.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.counts: list[int] = []
        self.words: list[str] = []
        self.hidden = 0
        self.heading = 0
        self.link: tuple[str, int] | None = None
        self.tables: list[dict] = []
        self.n_tables = 0

    def _emit(self, kind: str, text: str | None, level: int | None = None, target: str | None = None, place: tuple = (None, None, None)) -> None:
        self.rows.append((kind, level, ".".join(map(str, self.counts)), text, target, *place))

    def _text(self, since: int = 0) -> str:
        return " ".join("".join(self.words[since:]).split())

    def _close_block(self) -> None:
        text = self._text()
        if text and self.heading:
            self.counts = (self.counts + [0] * self.heading)[: self.heading]
            self.counts[-1] += 1
            self._emit("heading", text, self.heading)
        elif text:
            self._emit("block", text)
        self.words, self.heading = [], 0

    def _close_cell(self) -> None:
        table = self.tables[-1]
        cell, table["cell"] = table["cell"], None
        if not cell:
            return
        text, (down, across) = self._text(), cell
        self.words = []
        row = table["row"]
        col = 0
        while (row, col) in table["taken"]:
            col += 1
        for r in range(row, row + down):
            for c in range(col, col + across):
                if (r, c) not in table["taken"]:
                    table["taken"].add((r, c))
                    self._emit("cell", text, place=(table["no"], r, c))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in HEADINGS:
            self._close_block()
            self.heading = HEADINGS[tag]
        elif tag == "a" and given.get("href"):
            self.link = (given["href"], len(self.words))
        elif tag == "br":
            self.words.append(" ")
        elif tag == "table":
            self._close_block()
            self.n_tables += 1
            self.tables.append({"no": self.n_tables, "row": -1, "cell": None, "taken": set()})
        elif self.tables and tag == "tr":
            self._close_cell()
            self.tables[-1]["row"] += 1
        elif self.tables and tag in ("td", "th"):
            self._close_cell()
            self.words = []
            self.tables[-1]["row"] = max(0, self.tables[-1]["row"])
            self.tables[-1]["cell"] = tuple(min(1000, max(1, int(v))) if (v := given.get(k) or "").isdecimal() else 1 for k in ("rowspan", "colspan"))
        elif tag in BLOCKS and not (self.tables and self.tables[-1]["cell"]):
            self._close_block()

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.link:
            self._emit("link", self._text(self.link[1]), target=self.link[0])
            self.link = None
        elif self.tables and tag in ("td", "th", "tr", "table"):
            self._close_cell()
            if tag == "table":
                self.tables.pop()
        elif tag in HEADINGS or (tag in BLOCKS and not (self.tables and self.tables[-1]["cell"])):
            self._close_block()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.words.append(data)

    def finished(self) -> list[tuple]:
        while self.tables:
            self._close_cell()
            self.tables.pop()
        self._close_block()
        return self.rows


def parse(html: str | None) -> list[tuple]:
    page = Page()
    page.feed(html or "")
    page.close()
    return page.finished()


def page_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row for each heading, block, link and cell of every page; ``seq`` counts from 0 in each."""
    kind = dict(pages.dtypes)[key]
    names = [key, *(f.split()[0] for f in FIELDS.split(", "))]
    types = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                rows = [(i, n, *row) for i, text in enumerate(part.column(1).to_pylist()) for n, row in enumerate(parse(text))]
                keys = part.column(0).take(pa.array([r[0] for r in rows], pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(types))], names=names)

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, {FIELDS}")
