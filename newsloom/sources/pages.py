"""Landed web pages: links of list pages as article candidates, and metadata of article pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_date_text, parse_iso, selector_date, written_date
from newsloom.functions.text import EXCERPT_CHARS, PAGE_EXCERPT_CHARS, PAGE_SUMMARY_CHARS, SUMMARY_CHARS, content_hash, filled
from newsloom.operators.gate import domain_allowed, link_allowed, title_gate

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Containers of one news item, containers that count only if they are short, and how short.
_ITEMS, _BOXES, _BOX_CHARS = ("li", "article", "tr", "dl"), ("div", "section"), 1000


class _Node:
    """An open or closed element with the texts and times that it holds."""

    __slots__ = ("tag", "attrs", "parent", "texts", "times", "parts")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.texts: list[str] = []
        self.times: list[str] = []
        self.parts: list = []


class _LinkParser(HTMLParser):
    """Collects anchors with the node that they lie in; texts are gathered by every open element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Node("", {}, None)]
        self.links: list[_Node] = []
        self.metas: list[dict] = []
        self.scripts: list[str] = []

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.metas.append(found)
        if tag == "time" and found.get("datetime"):
            for node in self.stack:
                node.times.append(found["datetime"])
        if tag in _VOID:
            return
        node = _Node(tag, found, self.stack[-1])
        if tag == "a" and "href" in found:
            self.links.append(node)
        if found.get("class"):
            for outer in self.stack:
                if outer.tag == "a":
                    outer.parts.append((found["class"].split(), node))
        self.stack.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        if self.stack[-1].tag in ("script", "style"):
            if self.stack[-1].attrs.get("type") == "application/ld+json":
                self.scripts.append(data)
            return
        if text := data.strip():
            for node in self.stack:
                node.texts.append(text)


def _context(link: _Node) -> _Node | None:
    node = link.parent
    while node is not None:
        if node.tag in _ITEMS:
            return node
        node = node.parent
    node = link.parent
    while node is not None and node.tag not in _BOXES:
        node = node.parent
    return node if node is not None and len(" ".join(node.texts)) <= _BOX_CHARS else None


def _by_class(link: _Node, name: str) -> str:
    found = next((n for classes, n in link.parts if name and name in classes), None)
    return " ".join(found.texts) if found is not None else ""


_LINK = pa.schema([(n, pa.string()) for n in ("page_url", "source", "href", "url", "resolved", "title", "context", "time_in_link", "date_text")] + [("context_times", pa.list_(pa.string())), ("pos", pa.int32())])
_LINK_DDL = "page_url string, source string, href string, url string, resolved string, title string, context string, time_in_link string, date_text string, context_times array<string>, pos int"


def links_of(page_url: str, source: str, html: str | None, title_class: str = "", date_class: str = "") -> list[dict]:
    """The anchors of one page in order, with all that their title and date may come from."""
    parser = _LinkParser()
    parser.feed(html or "")
    parser.close()
    parts = urlsplit(page_url or "")
    base = f"{parts.scheme}://{parts.netloc}"
    out = []
    for pos, link in enumerate(parser.links):
        href = link.attrs["href"].strip()
        box = _context(link)
        try:
            url, resolved = (href if href.startswith("http") else urljoin(root, href) for root in (base, page_url or ""))
        except ValueError:
            continue
        out.append({
            "page_url": page_url, "source": source, "href": href, "url": url, "resolved": resolved, "title": _by_class(link, title_class) or "".join(link.texts),
            "context": " ".join(box.texts) if box else "", "time_in_link": link.times[0] if link.times else None, "date_text": _by_class(link, date_class) or None, "context_times": box.times if box else [], "pos": pos,
        })
    return out


def page_links(pages: DataFrame) -> DataFrame:
    """Every anchor of every page: ``pages`` has page_url, source, html, title_class, date_class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for row in batch.slice(at, 64).to_pylist():
                    rows += links_of(row["page_url"], row["source"], row["html"], row["title_class"] or "", row["date_class"] or "")
                yield pa.RecordBatch.from_pylist(rows, schema=_LINK)

    return pages.select("page_url", "source", "html", "title_class", "date_class").mapInArrow(run, _LINK_DDL)


def extract_links(pages: DataFrame, sources: DataFrame, date_formats: tuple[str, ...] = ()) -> DataFrame:
    """Article candidates of list pages (page_url, source, html), gated by their sources; one for each url of a page.

    The date comes from the source's date element, else from a time element in the link, the link's address, the
    surrounding item's time elements or text, or the page's address.  Six digits in an address are a date too, unless the
    source has ``numbered_urls`` (a column that may be absent), whose addresses hold running numbers.
    """
    numbered = F.coalesce("numbered_urls", F.lit(False)) if "numbered_urls" in sources.columns else F.lit(False)
    dims = F.broadcast(sources.select("source", "link_patterns", "exclude_patterns", "allowed_domains", "allow_pdf", "title_class", "date_class", "source_ord", numbered.alias("numbered_urls")))
    found = page_links(pages.join(dims.select("source", "title_class", "date_class"), "source")).join(dims.drop("title_class", "date_class"), "source")
    keep = link_allowed(F.col("href"), F.col("resolved"), F.col("exclude_patterns"), F.col("link_patterns"), F.col("allow_pdf")) & domain_allowed(F.col("resolved"), F.col("page_url"), F.col("allowed_domains"))
    kept = found.where(keep & title_gate(F.col("title")))
    address_date = lambda url: F.when(F.col("numbered_urls"), written_date(F.col(url))).otherwise(parse_date_text(F.col(url)))
    first_time = F.get(F.filter(F.transform("context_times", parse_iso), lambda t: t.isNotNull()), 0)
    date = F.coalesce(
        selector_date(F.col("date_text"), list(date_formats)), parse_date_text(F.col("date_text")), parse_iso(F.col("time_in_link")), address_date("resolved"),
        first_time, parse_date_text(F.col("context")), address_date("page_url"),
    )
    rows = kept.groupBy("page_url", "source", "url").agg(F.min_by(F.struct("title", "context", date.alias("published_at"), "pos", "source_ord"), "pos").alias("r")).select("page_url", "source", "url", "r.*")
    return rows.select(
        "page_url", "source", F.lit("html").alias("kind"), "source_ord", "title", "url", "published_at", F.substring("context", 1, PAGE_SUMMARY_CHARS).alias("summary"),
        content_hash().alias("content_hash"), F.substring("context", 1, PAGE_EXCERPT_CHARS).alias("raw_excerpt"), "pos",
    )


# Meta names that hold a page's date, in the order in which they are tried.
_DATE_PROPERTIES = ("article:published_time", "article:modified_time", "og:updated_time")
_DATE_NAMES = ("date", "pubdate", "publishdate", "dc.date", "dc.date.issued")
_PUBLISHED = re.compile(r'"datePublished"\s*:\s*"([^"]+)"')


def metadata_of(html: str | None) -> tuple[list[str], str | None]:
    """(date candidates in order, description) of one page."""
    parser = _LinkParser()
    parser.feed(html or "")
    parser.close()
    by = lambda key, name: [m["content"] for m in parser.metas if m.get(key) == name and m.get("content")]
    dates = [d for name in _DATE_PROPERTIES for d in by("property", name)]
    dates += [m[1] for s in parser.scripts if (m := _PUBLISHED.search(s))]
    dates += [d for name in _DATE_NAMES for d in by("name", name)]
    dates += parser.stack[0].times[:1]
    described = [d.strip() for d in by("name", "description")[:1] + by("property", "og:description")[:1] if d.strip()]
    return dates, described[0] if described else None


def extract_page_metadata(pages: DataFrame) -> DataFrame:
    """(url, meta_published_at, description) of article pages (url, html); the first candidate that parses is the date."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [metadata_of(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d for d, _ in found], pa.list_(pa.string())), pa.array([d for _, d in found], pa.string())], names=["url", "dates", "description"])

    rows = pages.select("url", "html").mapInArrow(run, "url string, dates array<string>, description string")
    return rows.select("url", F.get(F.filter(F.transform("dates", parse_iso), lambda t: t.isNotNull()), 0).alias("meta_published_at"), "description")


def fill_from_metadata(articles: DataFrame, metadata: DataFrame) -> DataFrame:
    """Missing dates and summaries from page metadata; the excerpt only together with the summary.

    Of several rows of metadata for one url the first date and the first description count, so no article is repeated.
    """
    once = metadata.groupBy("url").agg(F.min("meta_published_at").alias("meta_published_at"), F.min("description").alias("description"))
    out = articles.join(once, "url", "left")
    fills = F.nullif(F.coalesce("summary", F.lit("")), F.lit("")).isNull() & F.col("description").isNotNull()
    out = out.withColumn("raw_excerpt", F.when(fills, F.coalesce(filled("raw_excerpt"), F.substring("description", 1, EXCERPT_CHARS))).otherwise(F.col("raw_excerpt")))
    out = out.withColumn("summary", F.when(fills, F.substring("description", 1, SUMMARY_CHARS)).otherwise(F.col("summary")))
    return out.withColumn("published_at", F.coalesce("published_at", "meta_published_at")).drop("meta_published_at", "description")
