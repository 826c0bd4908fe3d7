"""HTML pages to typed blocks and metadata.

Tokenizing a page is sequential, so it runs per page in Arrow batches; everything after it is
DataFrame work. Closing tags, trailing text and void tags behave as the format means them.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame

BLOCK_SCHEMA = (
    "page_id bigint, block_idx int, type string, text string, level int, title string, author string, "
    "description string, keywords string"
)

# --- fixed values: tags -------------------------------------------------------------
DROPPED = {"script", "style", "nav", "header", "footer", "aside", "noscript", "iframe", "svg", "canvas", "form",
           "input", "select", "textarea", "button", "label"}
VOID = {"input", "br", "hr", "meta", "img", "link"}
INLINE = {"a", "b", "i", "em", "strong", "span", "u", "small", "sub", "sup", "abbr", "code"}


class PageReader(HTMLParser):
    """Collects (type, text, level) blocks of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, int]] = []
        self.meta: dict[str, str] = {}
        self.title = ""
        self.buffer: list[str] = []
        self.cells: list[str] = []
        self.open_tag = ""
        self.dropped = 0
        self.in_title = False

    def emit(self) -> None:
        text = "".join(self.buffer).strip()
        self.buffer = []
        if not text:
            return
        tag = self.open_tag
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.blocks.append(("heading", text, int(tag[1])))
        elif tag == "pre":
            self.blocks.append(("code_block", text, 0))
        elif tag == "li":
            self.blocks.append(("list_item", text, 0))
        elif tag == "caption":
            self.blocks.append(("caption", text, 0))
        elif tag in ("td", "th"):
            self.cells.append(text)
        else:
            self.blocks.append(("paragraph", text, 0))

    def handle_starttag(self, tag, attrs):
        if self.dropped:
            self.dropped += tag in DROPPED and tag not in VOID
            return
        if tag in DROPPED:
            self.dropped += tag not in VOID
            return
        if tag == "title":
            self.emit()
            self.in_title = True
        elif tag == "meta":
            named = dict(attrs)
            if (named.get("name") or "").lower() in ("author", "description", "keywords", "subject"):
                self.meta[named["name"].lower()] = named.get("content") or ""
        elif tag == "hr":
            self.emit()
            self.blocks.append(("page_break", "[HORIZONTAL RULE]", 0))
        elif tag not in INLINE:
            self.emit()
            self.open_tag = tag

    def handle_endtag(self, tag):
        if self.dropped:
            self.dropped -= tag in DROPPED and tag not in VOID
            return
        if tag == "title":
            self.title = "".join(self.buffer).strip() or self.title
            self.buffer, self.in_title = [], False
        elif tag not in INLINE:
            self.emit()
            self.open_tag = ""
            if tag == "tr" and self.cells:
                self.blocks.append(("table", " | ".join(self.cells), 0))
                self.cells = []

    def handle_data(self, data):
        if not self.dropped:
            self.buffer.append(data)


def read_page(html: str) -> PageReader:
    reader = PageReader()
    reader.feed(html or "")
    reader.close()
    reader.emit()
    return reader


def page_blocks(pages: DataFrame) -> DataFrame:
    """Pages (page_id, html) to block rows; every row carries the page's metadata."""

    def read(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                page = read_page(html)
                about = page.meta.get("subject") or page.meta.get("description", "")
                for i, (kind, text, level) in enumerate(page.blocks):
                    rows.append((page_id, i, kind, text, level, page.title, page.meta.get("author", ""), about,
                                 page.meta.get("keywords", "")))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

    return pages.select("page_id", "html").mapInPandas(read, BLOCK_SCHEMA)
