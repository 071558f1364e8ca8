"""The main text of a web page, by the density of text and links in the tree of its blocks.

The page is read once into flat arrays: block elements with their parents, and
the runs of text that stand in them. Going up the tree, text and linked text
are summed, and what is navigation by its name or by its links is cut off.
Going down again, as long as one child holds most of what is left, that child
is the page's body; its runs that read like text are the content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plumbline.functions import pages, urls

#: Elements whose text is never content.
NO_CONTENT = frozenset("script style noscript template svg math head title nav footer aside form button select iframe object canvas dialog menu figure".split())
#: Elements that stand as blocks of their own; all others are part of the text around them.
BLOCKS = frozenset("html body main article section header div p ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre h1 h2 h3 h4 h5 h6 address details summary hr".split()) | NO_CONTENT
#: Elements that hold nothing and have no end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where the next one of their kind, or a block around them, begins.
ENDS_AT = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}}
#: Words in a class or id that mark what stands around the content.
AROUND = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|footer|menu|nav\w*|newsletter|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)(?:$|[\s_-])", re.I)
HEADING = re.compile(r"h[1-6]")
SPACE = re.compile(r"\s+")
#: Marks that end a sentence.
CLOSED = tuple(".!?…:;\"”»。！？؟।")
#: Linked share from which a block or run is navigation, letters of a run that needs no closing mark, and the share of the text that makes a child the body.
LINKED, LETTERS, BODY = 0.5, 40, 0.7


class Run(NamedTuple):
    node: int
    text: str
    linked: int


class Blocks(HTMLParser):
    """The flat tree of a page: ``parent``, ``tag`` and ``off`` (whether it is cut off) of each block, and the runs of text in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.off = [-1], ["html"], [False]
        self.runs: list[Run] = []
        self.open = [0]
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0

    def _flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.runs.append(Run(self.open[-1], text, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.links += 1
        elif tag == "br":
            self.parts.append(" ")
        if tag not in BLOCKS:
            return
        self._flush()
        while len(self.open) > 1 and tag in ENDS_AT.get(self.tag[self.open[-1]], ()):
            self.open.pop()
        if tag in VOID:
            return
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        # bodies keep their text whatever they are called
        around = tag not in ("html", "body", "main", "article") and AROUND.search(named) is not None
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.off.append(around or tag in NO_CONTENT)
        self.open.append(len(self.tag) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in BLOCKS:
            return
        self._flush()
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.tag[self.open[i]] == tag), 0)
        if at:  # an end without a beginning ends nothing
            del self.open[at:]
            self.links = 0

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(SPACE.sub(" ", data).strip())

    def finish(self) -> None:
        self.close()
        self._flush()


def _sizes(tree: Blocks, runs: list[Run], prune: bool) -> list[int]:
    """Letters of every block with all in it, cut off ones left out; with ``prune`` blocks that are mostly links are cut off on the way up."""
    off, size, linked = tree.off, [0] * len(tree.off), [0] * len(tree.off)
    for r in runs:
        size[r.node] += len(r.text)
        linked[r.node] += r.linked
    for i in range(len(off) - 1, 0, -1):  # children come after their parents
        off[i] = off[i] or (prune and linked[i] > LINKED * size[i])
        if not off[i]:
            size[tree.parent[i]] += size[i]
            linked[tree.parent[i]] += linked[i]
    return size


def main_content(html: str | None) -> str | None:
    """The page's main text, a line for each run; null if there is none."""
    if not html or not html.strip():
        return None
    tree = Blocks()
    tree.feed(html)
    tree.finish()
    off = tree.off
    _sizes(tree, tree.runs, prune=True)
    for i in range(1, len(off)):
        off[i] = off[i] or off[tree.parent[i]]
    runs = [r for r in tree.runs if not off[r.node] and r.linked <= LINKED * len(r.text)]
    size = _sizes(tree, runs, prune=False)
    children: dict[int, list[int]] = {}
    for i in range(1, len(off)):
        children.setdefault(tree.parent[i], []).append(i)
    body = 0
    while True:
        best = max(children.get(body, ()), key=lambda i: size[i], default=None)
        if best is None or not size[best] or size[best] < BODY * size[body] or tree.tag[best] in ("p", "li", "td", "pre"):
            break
        body = best
    inside = [False] * len(off)
    inside[body] = True
    for i in range(body + 1, len(off)):
        inside[i] = inside[tree.parent[i]]
    out: list[str] = []
    headings: list[str] = []
    for r in runs:
        if not inside[r.node]:
            continue
        if HEADING.fullmatch(tree.tag[r.node]):
            headings.append(r.text)
        elif len(r.text) >= LETTERS or r.text.endswith(CLOSED):
            out += headings  # a heading stays if text follows
            out.append(r.text)
            headings = []
    return "\n".join(out) or None


def with_content(rows: DataFrame, html_col: str = "html", out: str = "content") -> DataFrame:
    """``rows`` with the main text of their pages, null where there is none: blank, without text, or all navigation.

    Pages are read whole, one at a time, in Arrow batches; broken markup is read
    as far as it goes, elements that never end go to the page's end.
    """
    at = rows.columns.index(html_col)
    fields = [f for f in rows.schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_content(x.as_py()) for x in batch.column(at)], pa.string())
            keep = [i for i, n in enumerate(batch.schema.names) if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), found], names=[*(batch.schema.names[i] for i in keep), out])

    return rows.mapInArrow(run, StructType([*fields, StructField(out, StringType())]))


def scraped(rows: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``rows`` with content, source and published_at: what a fetch of each page gives.

    A body that begins with the mark of PDF text is that text. Pages without
    content have neither source nor date.
    """
    html, mark = F.col(html_col), "[[PDF_TEXT]]"
    pdf = F.coalesce(html, F.lit("")).startswith(mark)
    got = with_content(rows.withColumns({"_page": F.when(~pdf, html)}), "_page")
    content = F.when(pdf, F.nullif(F.trim(F.substr(html, F.lit(len(mark) + 1))), F.lit(""))).otherwise(F.col("content"))
    got = got.drop("_page").withColumn("content", content)
    told = F.col("content").isNotNull()
    return got.withColumns({"source": F.when(told, urls.domain(F.col(url_col))), "published_at": F.when(told, pages.publish_date(html))})
