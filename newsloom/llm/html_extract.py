"""Main text of web pages: a host's suffix arrays find what its pages repeat, markup says how often is too often.

1. Each page is parsed into blocks of text, each with a zone: prose of an article or main element (ARTICLE), other text
   inside one, such as bare divs and lists (LOOSE), inside a container that is boilerplate by its element, role, class or
   id (FRAME), or none of these (OPEN).
2. The token streams of a host's pages are concatenated in shards of pages, one set of shards for what stands outside the
   articles and one for the articles; a suffix array of each shard, sorted to a depth of RUN tokens, finds the runs of RUN
   tokens and the pages that hold them.  The shards' counts are added up, so a host with most of the pages is many tasks
   and no page is left out.
3. Runs on MIN_PAGES distinct pages of a host are boilerplate outside articles.  Articles share passages and are copied,
   so inside them copies of an article count once, and a run is boilerplate among loose blocks from LOOSE_SHARE of the
   host's different articles on, among prose from PROSE_SHARE on.
4. Every page is judged by its host's runs.  A page with an article yields the article's blocks, any other page its open
   blocks, less those that boilerplate runs mostly cover.  An article whose prose they mostly cover is a copy of others and
   stays whole: copies are text, not boilerplate.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.tables import fresh_dir

#: While a page is parsed: frames that only their names or a form make, and an article or main element inside one.
ARTICLE, OPEN, FRAME, SOFT, INSET, LOOSE = 0, 1, 2, 3, 4, 5
#: Tokens of a run, distinct pages that make it boilerplate, pages in a shard, and covered part that removes a block.
RUN, MIN_PAGES, SHARD_PAGES, COVERED = 8, 3, 128, 0.5
#: Parts of a host's different articles, and articles at least, from which a run is boilerplate in loose blocks and in prose.
LOOSE_SHARE, PROSE_SHARE, PROSE_PAGES = 0.5, 2 / 3, 5
#: A host of several shards counts a run of its articles in the shards where this part of them holds it, and everywhere in
#: shards of fewer articles than FEW.  Articles are dealt by hash: a run that half of a host's articles hold is on fewer than
#: an eighth of 32 in one shard of a million.
LEAST_SHARE, FEW = 0.125, 32

#: Hosts of several shards up to which their table is broadcast, and the parts in which a host meets a larger table.
MOST_BROADCAST, PARTS = 50_000, 256

# Fixed values of HTML: elements without content, elements whose text is no page text, and elements that stay in a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe svg math canvas object audio video head title select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FRAMES = frozenset("nav footer aside form button textarea fieldset dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead banner footer sidebar ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login share sharing social comment comments commentlist respond reply replies disqus "
    "related recommended recommendations popup modal overlay toolbar pagination pager widget skip copyright "
    "alert disclaimer legal side rail topbar search discussion feedback reviews outbrain taboola".split()
)
#: Of these, the ones that also count on an article element itself (a comment is often one of its own).
ARTICLE_NAMES = frozenset("comment comments reply replies respond related recommended promo sponsored advert ad teaser".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that inside an article are text unless a whole class or id is one of NAMES.
_TOPICAL = frozenset("p section h1 h2 h3 h4 h5 h6 figure table blockquote".split())
#: Elements that make text inside an article prose.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figure dl".split())
#: An article with fewer characters than this part of the open blocks is not the page's text.
OUTWEIGHS = 0.25
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=\d)")


class BlockParser(HTMLParser):
    """Collects (zone, text) blocks of one page; unclosed and stray tags are taken as browsers roughly do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool | None]] = []  # element; zone, silent and prose around it
        self.zone, self.silent = OPEN, False
        self.prose: bool | None = False  # None: in an element with a boilerplate word in its name, where nothing is prose
        self.held: list[str] = []
        self.blocks: list[tuple[int, bool, str]] = []

    def _flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.blocks.append((self.zone, bool(self.prose), text))
            self.held = []

    def _zone(self, tag: str, attrs: list) -> int:
        if self.zone == FRAME:
            return FRAME
        values = dict(attrs)
        if tag == "form":
            return SOFT if self.zone in (OPEN, SOFT) else FRAME
        if tag in FRAMES or (values.get("role") or "").lower() in ROLES or "hidden" in values or (values.get("aria-hidden") or "").lower() == "true":
            return FRAME
        inside = self.zone in (ARTICLE, INSET)
        if tag == "header" and not inside:
            return FRAME
        if tag not in ("html", "body", "main"):
            # an article's own header holds its title; inside it only whole names count, a section may be named for its topic
            known = ARTICLE_NAMES if tag == "article" else NAMES - {"header"} if inside else NAMES
            for key in ("class", "id"):
                name = (values.get(key) or "").lower()
                if name and not known.isdisjoint(_SPLIT.split(name)):
                    if inside or tag == "article":
                        return LOOSE if inside and tag in _TOPICAL and known.isdisjoint(name.split()) else FRAME
                    return SOFT
        if tag in ("article", "main") or (values.get("role") or "").lower() in ("main", "article"):
            return INSET if self.zone in (SOFT, INSET) else ARTICLE
        return self.zone

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self._flush()
        elif tag == "br":
            self.held.append(" ")
        if tag in VOID:
            return
        if tag in _CLOSES_P or tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            self._imply_end(tag)
        zone = self._zone(tag, attrs)
        prose = self.prose
        if zone == LOOSE:
            zone, prose = self.zone, None
        elif zone in (ARTICLE, INSET) and prose is not None:
            prose = prose or tag in _PROSE
        if zone != self.zone:
            self._flush()
        self.open.append((tag, self.zone, self.silent, self.prose))
        self.zone, self.silent, self.prose = zone, self.silent or tag in SILENT, prose

    def _imply_end(self, tag: str) -> None:
        """A paragraph ends at the next block, a list item or cell at the next of its kind."""
        ends = {"p"} if tag in _CLOSES_P else {"p", "dt", "dd"} if tag in ("dd", "dt") else {"p", "td", "th"} if tag in ("td", "th") else {"p", tag}
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in ends:
                self._close(k)
                return
            if self.open[k][0] not in INLINE:
                return

    def _close(self, k: int) -> None:
        self._flush()
        _, self.zone, self.silent, self.prose = self.open[k]
        del self.open[k:]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an HTML element

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if self.open[k][1] != self.zone or tag not in INLINE:
                    self._flush()
                _, self.zone, self.silent, self.prose = self.open[k]
                del self.open[k:]
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return  # formatting does not end the block that it lies in

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.held.append(data)


def blocks_of(html: str | None) -> list[tuple[int, str]]:
    """The (zone, text) blocks of a whole page in order; null has none."""
    if not html:
        return []
    parser = BlockParser()
    parser.feed(html)
    parser.close()
    parser._flush()
    return _zoned(parser.blocks)


def _zoned(blocks: list[tuple[int, bool, str]]) -> list[tuple[int, str]]:
    """The (zone, prose, text) blocks with their final zones.

    An article inside a wrapper that only has a boilerplate name counts if the page has no other article; an article that
    the open blocks outweigh (a card beside the text) is an open block like them.
    """
    size = dict.fromkeys((ARTICLE, OPEN, FRAME, SOFT, INSET), 0)
    for zone, _, text in blocks:
        size[zone] += len(text)
    final = {ARTICLE: ARTICLE, OPEN: OPEN, FRAME: FRAME, SOFT: FRAME, INSET: FRAME if size[ARTICLE] else ARTICLE}
    if size[ARTICLE] < OUTWEIGHS * size[OPEN]:
        final[ARTICLE] = OPEN
    return [(LOOSE if final[zone] == ARTICLE and not prose else final[zone], text) for zone, prose, text in blocks]


def host_of(url: str | None) -> str:
    """What stands between the first :// and the next /, ? or #, with A-Z lowered; empty if there is none."""
    found = re.search(r"://([^/?#]*)", url or "")
    return found[1].lower() if found else ""


BLOCKS = pa.list_(pa.struct([("zone", pa.int32()), ("text", pa.string())]))


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, host, blocks) for each row of ``pages``."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                blocks = [[{"zone": z, "text": t} for z, t in blocks_of(h)] for h in part.column(2).to_pylist()]
                hosts = [host_of(u) for u in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hosts), pa.array(blocks, BLOCKS)], names=["id", "url", "host", "blocks"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"id {id_type}, url string, host string, blocks array<struct<zone:int,text:string>>")


def shard_runs(streams: list[list[str]], run: int = RUN, owners: list[int] | None = None, least: int = 1) -> dict[int, int]:
    """Run hash to number of pages, for all runs of ``run`` tokens of a shard's token streams, by a suffix array.

    The array is sorted by prefix doubling to a depth of ``run`` tokens; neighbours that agree to this depth are one
    run.  A stream of fewer tokens is a run as a whole.  Streams with the same of ``owners`` are one page; without it
    each stream is a page of its own.  Runs on fewer than ``least`` pages are left out.
    """
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    if not lengths.sum():
        return {}
    tokens = [t for s in streams for t in s]
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(t, len(numbers) + 1) for t in tokens], dtype=np.int64)
    # a gap of zeros after each stream, so that no run goes on in the next page
    begin = np.cumsum(lengths + run) - (lengths + run)
    at = np.repeat(begin, lengths) + np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rank = np.zeros(int((lengths + run).sum()) + run, dtype=np.int64)
    rank[at] = ids
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        pair = rank[:-run] * (rank.max() + 1) + rank[step : len(rank) - run + step]
        order = np.argsort(pair, kind="stable")
        new = np.r_[0, np.cumsum(pair[order][1:] != pair[order][:-1])]
        rank[order] = new + 1
        rank[:-run][pair == 0] = 0
        depth += step
    page = np.repeat(np.arange(len(streams)), lengths)
    offset = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    whole = (offset + run <= lengths[page]) | (offset == 0)
    token = np.flatnonzero(whole)
    owner = page if owners is None else np.array(owners, dtype=np.int64)[page]
    order = token[np.lexsort((owner[token], rank[at[token]]))]
    key = rank[at[order]]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    other = np.r_[True, (key[1:] != key[:-1]) | (owner[order][1:] != owner[order][:-1])]
    pages = np.add.reduceat(other.astype(np.int64), head)
    out = {}
    often = pages >= least
    for k, n in zip(order[head][often].tolist(), pages[often].tolist(), strict=True):
        stop = min(k + run, k - int(offset[k]) + int(lengths[page[k]]))
        out[run_hash(tokens[k:stop])] = n
    return out


def run_hash(tokens: list[str]) -> int:
    """The hash of a run as a signed 64-bit integer."""
    h = xxhash.xxh64_intdigest(" ".join(tokens).encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def _run_counts(streams: DataFrame, least: Callable[[int, bool], int]) -> DataFrame:
    """(host, run, pages) of (host, page, stream) rows: the number of distinct pages that hold a run.

    ``least`` gives the pages from which a shard reports a run, for its number of pages and whether it is its host's only
    one.  Streams of one page fall in one shard; equal streams of a page count once.
    """
    # only hosts of more than one shard need their count; few enough of them are broadcast, and of more each meets its
    # pages in PARTS parts, so no host is dealt whole
    sizes = streams.groupBy("host").agg(F.count("*").alias("_pages")).where(F.col("_pages") > SHARD_PAGES).select(F.col("host").alias("_host"), F.ceil(F.col("_pages") / SHARD_PAGES).alias("_shards"))
    same_host = F.col("host") == F.col("_host")
    if sizes.count() <= MOST_BROADCAST:
        sizes = F.broadcast(sizes)
    else:
        sizes = sizes.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        same_host &= F.col("_part") == F.pmod(F.xxhash64("page"), F.lit(PARTS))
    shards = F.coalesce("_shards", F.lit(1))
    sharded = streams.join(sizes, same_host, "left").select("host", F.pmod("page", shards).alias("shard"), (shards == 1).alias("alone"), "page", "stream")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # all article text is shuffled here, so it goes compressed: two thirds of what the shuffle's own codec makes of it
        codec = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield batch.set_column(4, "stream", pa.array([codec.compress(s.encode("utf-8")) for s in batch.column(4).to_pylist()], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        codec = zstandard.ZstdDecompressor()

        def flush() -> pa.RecordBatch:
            owners = [p for p, _ in held]
            tokens = [codec.decompress(s).decode("utf-8").split(" ") for _, s in held]
            found = shard_runs(tokens, owners=owners, least=least(len(set(owners)), key[2]))
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.string()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["host", "run", "pages"])

        for batch in batches:
            for host, shard, alone, page, stream in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, shard, alone) != key:
                    if held:
                        yield flush()
                    key, held = (host, shard, alone), []
                if not held or held[-1] != (page, stream):
                    held.append((page, stream))
        if held:
            yield flush()

    packed = sharded.mapInArrow(pack, "host string, shard long, alone boolean, page long, stream binary")
    counts = packed.repartition("host", "shard").sortWithinPartitions("host", "shard", "page").mapInArrow(run, "host string, run long, pages long")
    return counts.groupBy("host", "run").agg(F.sum("pages").alias("pages"))


def _stream(inside: bool):
    """A page's tokens: those of its article, or all others."""
    zones = f"b.zone IN ({ARTICLE}, {LOOSE})"
    return F.expr(f"array_join(transform(filter(blocks, b -> {zones if inside else 'NOT ' + zones}), b -> b.text), ' ')")


def boilerplate_runs(parsed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, run) for the runs outside articles on at least ``min_pages`` distinct pages of a host.

    Rows with one id and url are one page, repeated or fetched anew; rows without both are told apart by their text.
    """
    outside = parsed.select("host", "id", "url", _stream(False).alias("stream")).where("stream <> ''")
    page = F.when(F.coalesce(F.col("id").cast("string"), "url").isNull(), F.xxhash64("stream")).otherwise(F.xxhash64("id", "url"))
    counts = _run_counts(outside.select("host", page.alias("page"), "stream").distinct(), lambda n, alone: min_pages if alone else 1)
    return counts.where(F.col("pages") >= min_pages).select("host", "run")


def article_runs(parsed: DataFrame) -> DataFrame:
    """(host, run, firm) for the runs that are boilerplate inside articles: firm ones in prose, the others in loose blocks."""
    inside = parsed.select("host", _stream(True).alias("stream")).where("stream <> ''").select("host", F.xxhash64("stream").alias("page"), "stream")
    articles = inside.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("articles"))
    counts = _run_counts(inside, lambda n, alone: max(MIN_PAGES, math.ceil(LOOSE_SHARE * n)) if alone else 1 if n < FEW else math.ceil(LEAST_SHARE * n))
    often = lambda share, least: F.col("pages") >= F.greatest(F.lit(float(least)), F.lit(share) * F.col("articles"))
    return counts.where(F.col("pages") >= MIN_PAGES).join(articles, "host").where(often(LOOSE_SHARE, MIN_PAGES)).select("host", "run", often(PROSE_SHARE, PROSE_PAGES).alias("firm"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: id, url, text (main blocks joined by line ends), n_chars.

    Html is parsed once; the blocks are kept in the shared folder.  The token streams are shuffled by host and shard.
    Pages that a run can change are then joined with the runs: those without an article, and of hosts with runs that are
    boilerplate inside articles those that the runs concern.

    Null or empty html has an empty text; a null url has the empty host; repeated rows stay; a table without rows gives
    none; other columns are not read.
    """
    spark = pages.sparkSession
    path = fresh_dir(spark, "page-blocks")
    parsed = parse_pages(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id())
    parsed.write.option("compression", "zstd").parquet(path)
    parsed = spark.read.schema(parsed.schema).parquet(path)
    runs_path = fresh_dir(spark, "host-runs")
    boilerplate_runs(parsed).withColumn("firm", F.lit(False)).write.parquet(f"{runs_path}/outside")
    article_runs(parsed).write.parquet(f"{runs_path}/inside")
    outside_runs, inside_runs = (spark.read.schema("host string, run long, firm boolean").parquet(f"{runs_path}/{name}") for name in ("outside", "inside"))
    has = lambda *zones: F.exists("blocks", lambda b: b.zone.isin(*zones))
    parsed = parsed.withColumn("inside", has(ARTICLE, LOOSE))
    hosts = inside_runs.groupBy("host").agg(F.max("firm").alias("_firm"))
    if hosts.count() <= MOST_BROADCAST:
        parsed = parsed.join(F.broadcast(hosts), "host", "left").withColumn("judged", ~F.col("inside") | F.col("_firm").isNotNull() & (F.coalesce("_firm", F.lit(False)) | has(LOOSE)))
    else:
        parsed = parsed.withColumn("judged", F.lit(True))
    done = parsed.where("NOT judged").select("id", "url", F.array_join(F.transform(F.filter("blocks", lambda b: b.zone.isin(ARTICLE, LOOSE)), lambda b: b.text), "\n").alias("text"))
    rest = parsed.where("judged").select("row", "id", "url", "host", "inside", "blocks")
    hits = _hits(rest.where("NOT inside"), _stream(False), outside_runs).unionByName(_hits(rest.where("inside"), _stream(True), inside_runs))
    covered = hits.groupBy("row").agg(F.collect_list("at").alias("at"), F.collect_list("firm").alias("firm"))
    kept = rest.join(covered, "row", "left").select("id", "url", "blocks", "at", "firm").mapInArrow(_kept_batches, f"id {pages.schema[id_col].dataType.simpleString()}, url string, text string")
    out = done.unionByName(kept)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def _hits(rest: DataFrame, stream, runs: DataFrame) -> DataFrame:
    """(row, at, firm) for each place of a row's token stream where one of its host's boilerplate runs begins."""
    tokens = rest.select("row", "host", F.split(stream, " ").alias("tokens"))
    windows = tokens.select("row", "host", F.posexplode(F.expr(f"transform(sequence(0, greatest(size(tokens) - {RUN}, 0)), i -> xxhash64(array_join(slice(tokens, i + 1, {RUN}), ' ')))")).alias("at", "run"))
    return windows.join(runs, ["host", "run"]).select("row", "at", "firm")


def _kept_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [kept_text([(b["zone"], b["text"]) for b in blocks], at or [], firm or []) for blocks, at, firm in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def kept_text(blocks: list[tuple[int, str]], at: list[int], firm: list[bool]) -> str:
    """The text of a page whose stream has boilerplate runs at the places ``at``, as the last steps above say."""
    inside = any(zone in (ARTICLE, LOOSE) for zone, _ in blocks)
    stream = [(zone, text) for zone, text in blocks if (zone in (ARTICLE, LOOSE)) == inside]
    if not at:
        return "\n".join(text for zone, text in stream if inside or zone == OPEN)
    zones = np.array([zone for zone, _ in stream])
    size = np.array([text.count(" ") + 1 for _, text in stream])
    ends = np.cumsum(size)

    def covered(places: np.ndarray) -> np.ndarray:
        """Tokens of each block inside the runs at ``places``."""
        step = np.zeros(int(ends[-1]) + RUN + 1, dtype=np.int64)
        np.add.at(step, places, 1)
        np.add.at(step, places + RUN, -1)
        return np.add.reduceat((np.cumsum(step)[: ends[-1]] > 0).astype(np.int64), ends - size)

    places = np.array(at, dtype=np.int64)
    often = covered(places)
    if inside:
        body = zones == ARTICLE if (zones == ARTICLE).any() else zones == LOOSE
        if often[body].sum() >= COVERED * size[body].sum():
            keep = np.ones(len(stream), dtype=bool)
        else:
            keep = np.where(zones == ARTICLE, covered(places[np.array(firm, dtype=bool)]), often) < COVERED * size
    else:
        keep = (zones == OPEN) & (often < COVERED * size)
    return "\n".join(text for (_, text), k in zip(stream, keep.tolist(), strict=True) if k)
