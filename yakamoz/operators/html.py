"""Entries, titles and links of pages, as table functions over an HTML column."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yakamoz.functions.text import paged_url
from yakamoz.operators.tables import skip_known

#: Pages of a topic that are read.
MAX_PAGES = 5
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[_Node | str] = []

    def walk(self) -> Iterator[_Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, _Node)]

    def text(self, glue: str = "") -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                stack += reversed(n.children)
        return glue.join(s for x in out if (s := x.strip() if glue else x)).strip()

    def has(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        n = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent and n.tag != tag:
            n = n.parent
        if n.parent:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str | None) -> _Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def title(root: _Node) -> str:
    """Of the element of itemprop name, else the first h1, else the title; '' without any."""
    nodes = list(root.walk())
    for n in nodes:
        if n.tag == "span" and n.attrs.get("itemprop") == "name":
            return n.text()
    for tag, glue in (("h1", " "), ("title", "")):
        for n in nodes:
            if n.tag == tag:
                return n.text(glue)
    return ""


def entry_nodes(root: _Node) -> list[_Node]:
    """Nodes of the first selector that finds any: items of the entry list, list items with an entry id, any with data-id."""
    items = [n for n in root.walk() if n.tag == "li"]

    def listed(n: _Node) -> bool:
        while n.parent:
            n = n.parent
            if n.attrs.get("id") == "entry-item-list":
                return True
        return False

    own = [n for n in items if n.parent and n.parent.tag == "ul" and n.parent.attrs.get("id") == "entry-item-list"]
    within = [n for n in items if listed(n)]
    return (
        own or [n for n in within if "data-id" in n.attrs] or [n for n in items if n.attrs.get("id", "").startswith("entry-item")]
        or [n for n in items if "data-id" in n.attrs] or within
    )


def entries(html: str | None) -> list[tuple[int, str, str, str, str]]:
    """(ord, entry_id, author, date, content) of each entry with a content; the first of an id stays."""
    out, seen = [], set()
    for n in entry_nodes(tree(html)):
        parts = list(n.walk())
        content = next((p.text(" ") for p in parts if p.has("content")), "")
        if not content:
            continue
        eid = n.attrs.get("data-id") or n.attrs.get("id", "").removeprefix("entry-item-")
        if eid and eid in seen:
            continue
        seen.add(eid)
        author = n.attrs.get("data-author") or next((p.text() for p in parts if p.has("entry-author") or p.has("author")), "")
        date = next((p.text() for p in parts if p.has("entry-date") or p.has("date")), "")
        out.append((len(out), eid, author, date, content))
    return out


def links(html: str | None) -> list[tuple[int, str, str]]:
    """(ord, href, text) of the links."""
    return [(i, n.attrs["href"], n.text(" ")) for i, n in enumerate(x for x in tree(html).walk() if x.tag == "a" and x.attrs.get("href"))]


def page_titles(pages: DataFrame, key: str = "url") -> DataFrame:
    return _mapped(pages, key, lambda h: [(title(tree(h)),)], ["title string"])


def page_entries(pages: DataFrame, key: str = "url") -> DataFrame:
    return _mapped(pages, key, entries, ["ord int", "entry_id string", "author string", "date string", "content string"])


def page_links(pages: DataFrame, key: str = "url") -> DataFrame:
    return _mapped(pages, key, links, ["ord int", "href string", "link_text string"])


def _mapped(pages: DataFrame, key: str, f, columns: list[str]) -> DataFrame:  # noqa: ANN001
    names = [key, *(c.split()[0] for c in columns)]
    kinds = [pa.string(), *(pa.int32() if c.endswith(" int") else pa.string() for c in columns)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *r) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in f(h)]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return pages.select(F.col(key).cast("string").alias(key), "html").mapInArrow(run, ", ".join([f"`{key}` string", *columns]))


def page_plan(topics: DataFrame, visited: DataFrame, pages: int = MAX_PAGES) -> DataFrame:
    """(topic columns, ``page``, ``page_url``) of the pages of each topic that weren't visited."""
    x = topics.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))
    x = x.withColumn("page_url", paged_url(F.col("topic_url"), F.col("page")))
    return skip_known(x, visited, "page_url")


def topic_titles(pages: DataFrame, topic: str = "topic_url", page: str = "page") -> DataFrame:
    """(topic, ``title``): of the first page of the topic that has one; '' without any. ``pages`` has ``html`` too."""
    x = pages.select(F.concat_ws("\1", topic, F.col(page).cast("string")).alias("_k"), "html")
    t = page_titles(x, "_k").select(F.split("_k", "\1")[0].alias(topic), F.split("_k", "\1")[1].cast("int").alias("_p"), "title")
    found = F.when(F.col("title") != "", F.struct(F.col("_p"), F.col("title").alias("t")))
    return t.groupBy(topic).agg(F.coalesce(F.min(found)["t"], F.lit("")).alias("title"))
