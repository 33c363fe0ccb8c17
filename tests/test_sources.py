"""Feeds, list pages, page metadata, collection and dates."""

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from newsloom.functions.dates import enrich_published_at, parse_date_text, parse_feed_date, parse_iso, selector_date
from newsloom.functions.text import html_unescape, resolve_url, strip_html
from newsloom.profiles import Profile, Source, sources_table
from newsloom.sources import sql_functions
from newsloom.sources.collect import collect, union_sources, write_side_by_side
from newsloom.sources.feeds import read_feed_items
from newsloom.sources.pages import extract_links, extract_page_metadata, fill_from_metadata

RSS = """<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>f</title>
<item><title> First story of all </title><link>https://x.example.com/a/1</link><pubDate>Tue, 05 Mar 2024 10:30:00 +0900</pubDate><description>&lt;p&gt;Short &lt;b&gt;text&lt;/b&gt;&lt;/p&gt;</description><content:encoded>&lt;p&gt;The full   text&lt;/p&gt;</content:encoded></item>
<item><title>Undated story</title><link>https://x.example.com/a/2</link><description>plain</description></item>
<item><title>Excluded</title><link>https://x.example.com/video/a/3</link></item>
<item><title>A pdf</title><link>https://x.example.com/a/4.pdf</link></item>
<item><title> </title><link>https://x.example.com/a/5</link></item>
</channel></rss>"""
ATOM = """<?xml version="1.0"?><feed><entry><title>Atom story</title><link href="https://y.example.com/a/9" rel="alternate"/><updated>2024-03-06T01:02:03Z</updated><summary>s</summary></entry></feed>"""


@pytest.fixture
def feeds(spark, tmp_path):
    (tmp_path / "x.xml").write_text(RSS)
    (tmp_path / "y.xml").write_text(ATOM)
    p = Profile("t", sources=(Source("x", link_patterns=("/a/",), exclude_patterns=("/video/", ".pdf"), prefer_feed_content=True), Source("y")))
    return str(tmp_path), sources_table(spark, [p])


def test_feed_items(spark, feeds):
    rows, rejected = read_feed_items(spark, *feeds)
    got = {r["url"]: r for r in rows.collect()}
    assert sorted(got) == ["https://x.example.com/a/1", "https://x.example.com/a/2", "https://y.example.com/a/9"]
    first = got["https://x.example.com/a/1"]
    assert (first["title"], first["summary"], first["published_at"]) == ("First story of all", "The full text", datetime(2024, 3, 5, 1, 30))
    assert got["https://x.example.com/a/2"]["published_at"] is None and got["https://x.example.com/a/2"]["summary"] == "plain"
    assert got["https://y.example.com/a/9"]["published_at"] == datetime(2024, 3, 6, 1, 2, 3)
    assert rejected.count() == 0


LIST = """<html><body><nav><a href="#top">Top of this page</a></nav><ul>
<li><a href="/news/2024/one">A first headline here</a> <time datetime="2024-03-01">x</time></li>
<li><a href="/news/2024/one">A first headline here</a></li>
<li><a href="/tag/x">Tagged things list</a></li><li><a href="javascript:go()">Some script link</a></li>
<li><a href="https://other.example.org/news/2">Other host headline</a> March 4, 2024</li>
<li><a href="https://evil.example.net/news/3">Evil host headline</a></li>
<li><a href="/news/short">Short</a></li><li><a href="/news/260709j0101.pdf">Release as a document</a></li>
<li><a href="/news/card"><span class="t">A card title  here</span> <span class="d">April  7,2024</span></a></li></ul></body></html>"""


def test_list_page(spark):
    s = Source("s", kind="html", link_patterns=("/news/",), exclude_patterns=(".pdf",), allowed_domains=("OTHER.example.org",), allow_pdf=True, title_class="t", date_class="d")
    dims = sources_table(spark, [Profile("t", sources=(s,))])
    pages = spark.createDataFrame([("https://s.example.com/list/", "s", LIST), ("https://s.example.com/empty", "s", None)], "page_url string, source string, html string")
    got = {r["url"]: (r["title"], r["published_at"]) for r in extract_links(pages, dims, ("MMMM d,yyyy",)).collect()}
    assert got == {
        "https://s.example.com/news/2024/one": ("A first headline here", datetime(2024, 3, 1)),
        "https://other.example.org/news/2": ("Other host headline", datetime(2024, 3, 4)),
        "https://s.example.com/news/260709j0101.pdf": ("Release as a document", datetime(2026, 7, 9)),
        "https://s.example.com/news/card": ("A card title  here", datetime(2024, 4, 7)),
    }


def test_running_numbers_are_no_dates(spark):
    """Ids of six digits look like 2010-01-03; a source may say that its addresses hold numbers."""
    html = '<ul><li><a href="/item/100103-x">A first headline here</a> <time datetime="2024-03-01"></time></li></ul><p><a href="/item/2024-03-02/100104-x">A second headline here</a></p><p><a href="/item/100105-x">A third headline here</a></p>'
    dims = sources_table(spark, [Profile("t", sources=(Source("n", kind="html", numbered_urls=True), Source("d", kind="html")))])
    pages = spark.createDataFrame([(f"https://{s}.example.com/of/p100106", s, html) for s in "nd"], "page_url string, source string, html string")
    dates = lambda df, s: [r["published_at"] for r in df.where(F.col("source") == s).orderBy("pos").collect()]
    got = extract_links(pages, dims)
    assert dates(got, "n") == [datetime(2024, 3, 1), datetime(2024, 3, 2), None]
    assert dates(got, "d") == dates(extract_links(pages, dims.drop("numbered_urls")), "d") == [datetime(2010, 1, 3), datetime(2024, 3, 2), datetime(2010, 1, 5)]


def test_metadata_fills_only_gaps(spark):
    head = '<head><meta property="article:published_time" content="nonsense"><script type="application/ld+json">{"datePublished": "2024-05-06T07:08:09+02:00"}</script><meta name="description" content=" About it "></head>'
    pages = spark.createDataFrame([("u1", head), ("u2", None), ("u3", '<time datetime="2024-01-02">')], "url string, html string")
    meta = extract_page_metadata(pages)
    assert {r["url"]: (r["meta_published_at"], r["description"]) for r in meta.collect()} == {"u1": (datetime(2024, 5, 6, 5, 8, 9), "About it"), "u2": (None, None), "u3": (datetime(2024, 1, 2), None)}
    arts = spark.createDataFrame([("u1", None, "", ""), ("u1", datetime(2023, 1, 1), "kept", "e"), ("u9", None, None, None)], "url string, published_at timestamp, summary string, raw_excerpt string")
    got = sorted((r["summary"] or "", r["raw_excerpt"] or "", str(r["published_at"])) for r in fill_from_metadata(arts, meta).collect())
    twice = fill_from_metadata(arts, meta.union(spark.createDataFrame([("u1", datetime(2030, 1, 1), "zz")], meta.schema))).collect()
    assert len(twice) == 3 and {r["summary"] for r in twice if r["url"] == "u1"} == {"About it", "kept"}
    assert got == [("", "", "None"), ("About it", "About it", "2024-05-06 05:08:09"), ("kept", "e", "2023-01-01 00:00:00")]


@pytest.mark.parametrize(
    ("text", "day"),
    [("Statement Nov. 7, 2022 x", "2022-11-07"), ("may 3, 2024", "2024-05-03"), ("September 09,  2024", "2024-09-09"), ("2026年3月25日 発表", "2026-03-25"), ("on 2026/03/25", "2026-03-25"), ("2026.3.5", "2026-03-05"),
     ("260709j0101.pdf", "2026-07-09"), ("2026-13-40", None), ("Nov 77, 2022 or 2022-11-07", "2022-11-07"), ("none", None), ("", None), (None, None), ("1234567", None)],
)
def test_dates_in_text(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(F.date_format(parse_date_text(F.col("t")), "yyyy-MM-dd")).first()[0]
    assert got == day


def test_other_date_forms(spark):
    row = spark.range(1).select(
        parse_iso(F.lit("2024-01-02T03:04:05+09:00")), parse_iso(F.lit("x")), parse_feed_date(F.lit("bad"), F.lit("Wed, 6 Mar 2024 10:00:00 GMT")), selector_date(F.lit(" 07  Mar 2024 "), ["yyyy-MM-dd", "dd MMM yyyy"]), selector_date(F.lit("x"), []),
        enrich_published_at(F.lit(None).cast("timestamp"), F.lit("t"), F.lit("2024-02-03"), F.lit("2024-02-04")),
    ).first()
    assert list(row) == [datetime(2024, 1, 1, 18, 4, 5), None, datetime(2024, 3, 6, 10), datetime(2024, 3, 7), None, datetime(2024, 2, 3)]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a &amp; b", "<p>x <b>y</b></p>"), (None, None), ("plain", " z ")], "a string, b string")
    assert [tuple(r) for r in df.select(html_unescape(F.col("a")), strip_html(F.col("b"))).collect()] == [("a & b", "x y"), (None, None), ("plain", "z")]
    base = F.lit("https://h.example.com/a/b?c")
    urls = spark.range(1).select(*(resolve_url(F.lit(h), base) for h in ("http://z/", "//z/q", "/r", "s", "?t"))).first()
    assert list(urls) == ["http://z/", "https://z/q", "https://h.example.com/r", "https://h.example.com/a/s", "https://h.example.com/a/b?t"]


def test_references_without_an_end(spark):
    """A title that was cut inside a reference: HTML decodes the old names all the same, SQL's replacements do not."""
    df = spark.createDataFrame([("a&amp;&amp",), ("&lt;b&gt; &#x27;&#39;&quot;&amp;lt;",), ("&nosuch; &notit; &amp",), (None,), ("plain",)], "a string")
    got = [tuple(r) for r in df.select(html_unescape(F.col("a")), html_unescape(F.col("a"), closed=True)).collect()]
    assert got == [("a&&", "a&&amp"), ("<b> ''\"&lt;", "<b> ''\"&lt;"), ("&nosuch; ¬it; &", "&nosuch; &notit; &amp"), (None, None), ("plain", "plain")]


def test_collect_end_to_end(spark, feeds, tmp_path):
    path, dims = feeds
    rows, _ = union_sources(spark, dims, {"rss": lambda s, d: read_feed_items(s, path, d)})
    known = spark.createDataFrame([(5, rows.where("url like '%/9'").first()["content_hash"])], "article_id long, content_hash string")
    meta = spark.createDataFrame([("https://x.example.com/a/2", datetime(2024, 3, 6), None)], "url string, meta_published_at timestamp, description string")
    got = {r["url"]: r for r in collect(rows, known, dims, 72, "2024-03-07 00:00:00", meta).collect()}
    assert sorted(got) == ["https://x.example.com/a/1", "https://x.example.com/a/2"]
    assert got["https://x.example.com/a/2"]["published_at"] == datetime(2024, 3, 6) and all(r["is_new"] for r in got.values())
    write_side_by_side(rows.select("title", "url"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == rows.count()


def test_one_failing_kind_does_not_stop_the_rest(spark, feeds):
    path, dims = feeds
    dims = dims.unionByName(dims.limit(1).withColumn("source", F.lit("z")).withColumn("kind", F.lit("html")))

    def gone(s, d):
        return s.read.parquet(f"{path}/missing"), None

    rows, bad = union_sources(spark, dims, {"html": gone, "rss": lambda s, d: read_feed_items(s, path, d)})
    assert sorted(r["source"] for r in rows.collect()) == ["x", "x", "y"]
    assert [(r["source"], "PATH_NOT_FOUND" in r["_corrupt"]) for r in bad.collect()] == [("z", True)]
    rows, bad = union_sources(spark, dims, {"html": gone})
    assert rows is None and bad.count() == 1


def test_lateral_functions(spark):
    sql_functions.register(spark)
    html = '<li><a href="/a">x <b class="t u">Title</b><i class="d">5 May 2024</i></a> late</li><a name="n">no</a><a href=" /b ">B</a>'
    pages = spark.createDataFrame([(1, "https://h.example.com/l/", html), (2, "https://h.example.com/", None), (3, None, ""), (4, None, '<a href="//[x">bad</a><a href="q">Q</a>')], "id int, url string, html string")
    got = spark.sql("SELECT p.id, l.* FROM {p} p, LATERAL page_links(p.url, p.html, 't', 'd') l", p=pages).orderBy("id", "pos").collect()
    assert [(r["id"], r["href"], r["resolved"], r["title"], r["date_text"], r["pos"]) for r in got] == [
        (1, "/a", "https://h.example.com/a", "Title", "5 May 2024", 0), (1, "/b", "https://h.example.com/b", "B", None, 1), (4, "q", "q", "Q", None, 1),
    ]
    assert spark.sql("SELECT l.title FROM {p} p, LATERAL page_links(p.url, p.html) l WHERE p.id = 1", p=pages).collect()[0]["title"] == "xTitle5 May 2024"
    meta = spark.sql("SELECT m.* FROM LATERAL page_metadata('<meta name=\"date\" content=\"2024-01-02\"><meta name=\"description\" content=\" d \">') m").collect()
    assert [tuple(r) for r in meta] == [(["2024-01-02"], "d")]
    for wrong in ("page_links('u')", "page_metadata(1)", "page_metadata(TABLE(SELECT 1 AS a))"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {wrong}").collect()
