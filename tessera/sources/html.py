"""Web pages as elements."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKIPPED = r"(?is)<(script|style|nav|header|footer|template|noscript)\b.*?</\1\s*>|<!--.*?-->"
BLOCK = r"(?is)<(h[1-6]|p|li|pre|figcaption|caption)\b[^>]*>(.*?)</\1\s*>"
# The character references that are resolved without a parser.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_elements(pages: DataFrame, doc: str = "page_id") -> DataFrame:
    """Headings, paragraphs, list items, code and captions of pages, by expressions alone; what lies in navigation or scripts is left out."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), SKIPPED, " ")
    blocks = pages.select(F.col(doc).alias("doc_id"), F.posexplode_outer(F.regexp_extract_all(body, F.lit(BLOCK), F.lit(0))).alias("k", "b")).filter("b IS NOT NULL")
    tag = F.lower(F.regexp_extract("b", BLOCK, 1))
    text = F.regexp_replace(F.regexp_replace("b", r"(?s)<[^>]*>", " "), r"\s+", " ")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    kind = F.when(F.col("tag").startswith("h"), "heading").when(F.col("tag") == "li", "list_item").when(F.col("tag") == "pre", "code").when(F.col("tag").isin("figcaption", "caption"), "caption").otherwise("paragraph")
    out = blocks.select("doc_id", "k", tag.alias("tag"), F.trim(text).alias("text")).filter("text <> ''")
    pos = (F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1).cast("int")
    return out.select("doc_id", pos.alias("pos"), kind.alias("kind"), "text", F.when(F.col("tag").startswith("h"), F.substring("tag", 2, 1).cast("int")).alias("level")).withColumn("id", F.concat(F.lit("el_"), F.col("pos").cast("string")))


class Blocks(HTMLParser):
    """Elements of one page, tables with their grids."""

    KINDS = {"p": "paragraph", "li": "list_item", "pre": "code", "caption": "caption", "figcaption": "caption"} | {f"h{k}": "heading" for k in range(1, 7)}
    SKIP = ("script", "style", "nav", "header", "footer", "template", "noscript")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.skip, self.tag, self.text = 0, None, []
        self.grid: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.header: list[str] | None = None
        self.header_cells = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "table":
            self._close()
            self.grid, self.header = [], None
        elif tag == "tr" and self.grid is not None:
            self.grid.append([])
            self.header_cells = 0
        elif tag in ("td", "th") and self.grid:
            self.cell = []
            self.header_cells += tag == "th"
        elif tag in ("img", "figure"):
            alt = dict(attrs).get("alt") or ""
            if tag == "img" and not self.skip:
                self.out.append({"kind": "figure", "text": alt})
        elif tag in self.KINDS and (self.grid is None or tag == "caption"):
            self._close()
            self.tag = tag

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.cell is not None and self.grid:
            self.grid[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.grid and self.header is None and self.header_cells:
            self.header = self.grid[-1]
        elif tag == "table" and self.grid is not None:
            rows = [r for r in self.grid if r]
            if rows and not self.skip:
                self.out.append({"kind": "table", "grid": rows, "header_row": self.header or rows[0], "text": ""})
            self.grid = None
        elif tag == self.tag:
            self._close()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        elif self.tag is not None and not self.skip:
            self.text.append(data)

    def _close(self):
        text = "".join(self.text).strip() if self.tag == "pre" else " ".join("".join(self.text).split())
        if self.tag and text:
            self.out.append({"kind": self.KINDS[self.tag], "text": text, "level": int(self.tag[1]) if self.KINDS[self.tag] == "heading" else None})
        self.tag, self.text = None, []


def parsed_html_elements(pages: DataFrame, doc: str = "page_id") -> DataFrame:
    """The same with a parser, for pages that nest or hold tables and images: tables keep their grids."""
    from tessera.functions.text import table_markdown

    def run(batches):
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("doc_id", "pos", "kind", "text", "level", "grid", "header_row")}
            for d, html in zip(batch.column("doc_id").to_pylist(), batch.column("html").to_pylist()):
                parser = Blocks()
                parser.feed(html or "")
                parser.close()
                parser._close()
                for k, x in enumerate(parser.out):
                    for c, v in {"doc_id": d, "pos": k, "kind": x["kind"], "text": x["text"], "level": x.get("level"), "grid": x.get("grid"), "header_row": x.get("header_row")}.items():
                        cols[c].append(v)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.string())), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)], list(cols))

    out = pages.select(F.col(doc).cast("long").alias("doc_id"), "html").mapInArrow(run, "doc_id long, pos int, kind string, text string, level int, grid array<array<string>>, header_row array<string>")
    return out.withColumn("text", F.when(F.col("grid").isNotNull(), table_markdown(F.col("grid"))).otherwise(F.col("text"))).withColumn("id", F.concat(F.lit("el_"), F.col("pos").cast("string")))
