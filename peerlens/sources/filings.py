"""Filings: HTML and Markdown files into a table of documents."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Headings of filings, the block that is never shown, and the page-break mark.
PART = re.compile(r"^PART\s+[IVX]+", re.IGNORECASE)
ITEM = re.compile(r"^Item\s+\d+\s*[A-Z]?\.?\s*", re.IGNORECASE)
HIDDEN_ID = "DSPFiXBRLHidden"
PAGE_BREAK = "<<<PAGE_BREAK>>>"
LONGEST_HEADING, KEY_CHARS = 200, 40
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"p", "div", "section", "article", "tr", "ul", "ol", "table", "blockquote", "pre", "header", "footer", "main", "nav"}
_SILENT = {"script", "style", "head", "title", "template"}
_MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_"}


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent", "text", "look")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        #: What is written in it, as far as a heading could be that long, and whether it looks like a heading.
        self.text, self.look = "", False


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th") and self.at.tag == tag:
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _texts(node) -> list[str]:
    """All pieces of text in order. Pages nest deeply, so nothing here recurs."""
    out, left = [], [node]
    while left:
        at = left.pop()
        if isinstance(at, str):
            if at.strip():
                out.append(at.strip())
        elif at.tag not in ("script", "style"):
            left += reversed(at.children)
    return out


def _summarise(root: _Node) -> None:
    """Sets text and look of all nodes, children before parents."""
    order, left = [], [root]
    while left:
        node = left.pop()
        order.append(node)
        left += [c for c in node.children if not isinstance(c, str)]
    for node in reversed(order):
        style = node.attrs.get("style", "")
        node.look = "font-weight" in style or "text-decoration:underline" in style.replace(" ", "") or node.tag in ("strong", "b", "u") or any(not isinstance(c, str) and c.look for c in node.children)
        if node.tag not in ("script", "style"):
            parts, size = [], 0
            for c in node.children:
                own = " ".join(c.split()) if isinstance(c, str) else c.text
                if own:
                    parts.append(own)
                    size += len(own) + 1
                if size > LONGEST_HEADING + 1:
                    break
            node.text = " ".join(parts)[: LONGEST_HEADING + 1]


def to_markdown(html: str) -> str:
    """Text with headings for parts and items, page breaks for rules, without links, images and wrapping."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    _summarise(tree.root)
    seen: set[tuple[str, str]] = set()
    out: list[str] = []

    def heading(node) -> str | None:
        if node.tag not in ("div", "p"):
            return None
        title = node.text
        if not title or len(title) > LONGEST_HEADING:
            return None
        kind = "#" if PART.match(title) else "##" if ITEM.match(title) and node.look else None
        if kind is None or (kind, title[:KEY_CHARS]) in seen:
            return None
        seen.add((kind, title[:KEY_CHARS]))
        return f"{kind} {title}"

    left: list[tuple] = [(tree.root, False)]
    while left:
        node, in_table = left.pop()
        if in_table is None:  # what closes a node whose children are done
            out.append(node)
            continue
        if isinstance(node, str):
            out.append(re.sub(r"\s+", " ", node))
            continue
        if node.attrs.get("id") == HIDDEN_ID or node.tag in _SILENT or node.tag == "img":
            continue
        if node.tag in ("hr", "br"):
            out.append(f"\n\n{PAGE_BREAK}\n\n" if node.tag == "hr" else "  \n")
            continue
        title = None if in_table else heading(node)
        level = re.fullmatch(r"h([1-6])", node.tag)
        if title or level:
            out.append(f"\n\n{title or '#' * int(level[1]) + ' ' + ' '.join(' '.join(_texts(node)).split())}\n\n")
            continue
        edge = "\n\n" if node.tag in _BLOCKS else ""
        mark = _MARKS.get(node.tag, "") if node.text else ""
        out.append(edge + ("\n  * " if node.tag == "li" else "") + mark)
        left.append((mark + edge, None))
        for child in reversed(node.children):
            if not isinstance(child, str) and child.tag in ("td", "th"):
                left.append((" | ", None))
            left.append((child, in_table or node.tag == "table"))
    lines = [line.strip() if line.strip() else "" for line in "".join(out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip() + "\n"


#: Pages in an Arrow batch at most: a worker holds a batch, what becomes of it, and one page's tree.
BATCH_PAGES = 500


def small_batches(spark: SparkSession) -> None:
    """For queries that parse pages: bounds what a Python worker holds, however many pages there are."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_PAGES:
        spark.conf.set(name, BATCH_PAGES)


@F.pandas_udf(StringType())
def markdown_of(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else to_markdown(x))


@F.pandas_udf(StringType())
def text_of(html: pd.Series) -> pd.Series:
    """All text, one piece on a line."""

    def one(x):
        if x is None:
            return None
        tree = _Tree()
        tree.feed(x)
        tree.close()
        return "\n".join(_texts(tree.root))

    return html.map(one)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc (the file's path) and text as Markdown; fails for files other than .md, .html and .htm."""
    small_batches(spark)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value"))
    kind = F.lower(F.regexp_extract("doc", r"\.([^.]+)$", 1))
    body = F.when(kind.isin("html", "htm"), markdown_of(F.col("value"))).when(kind == "md", F.col("value"))
    return files.select("doc", F.coalesce(body, F.raise_error(F.concat(F.lit("unknown kind of file: "), "doc"))).alias("text"))
