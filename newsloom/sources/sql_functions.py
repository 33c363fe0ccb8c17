"""Pages as row-generating functions of SQL: ``FROM pages p, LATERAL page_links(p.url, p.html) l``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from newsloom.sources.pages import links_of, metadata_of

_STRINGS = ArrayType(StringType())
_TEXTS = ("href", "url", "resolved", "title", "context", "time_in_link", "date_text")
_LINK = StructType([*(StructField(n, StringType()) for n in _TEXTS), StructField("context_times", _STRINGS), StructField("pos", IntegerType())])
_META = StructType([StructField("date_candidates", _STRINGS), StructField("description", StringType())])


def _texts(name: str, least: int, most: int, args: tuple[AnalyzeArgument, ...]) -> None:
    if not least <= len(args) <= most:
        raise ValueError(f"{name} takes {least} to {most} arguments")
    for arg in args:
        if arg.isTable or not (isinstance(arg.dataType, StringType) or arg.dataType.typeName() == "void"):
            raise ValueError(f"{name} takes strings")


class PageLinks:
    """``page_links(page_url, html [, title_class [, date_class]])``: the anchors of a page in order, with all that their
    title and date may come from.  A null or empty page has none."""

    @staticmethod
    def analyze(*args: AnalyzeArgument) -> AnalyzeResult:
        _texts("page_links", 2, 4, args)
        return AnalyzeResult(_LINK)

    def eval(self, page_url, html, title_class=None, date_class=None) -> Iterator[tuple]:
        for r in links_of(page_url, "", html, title_class or "", date_class or ""):
            yield tuple(r[n] for n in (*_TEXTS, "context_times", "pos"))


class PageMetadata:
    """``page_metadata(html)``: one row with the date candidates of a page in their order, and its description."""

    @staticmethod
    def analyze(*args: AnalyzeArgument) -> AnalyzeResult:
        _texts("page_metadata", 1, 1, args)
        return AnalyzeResult(_META)

    def eval(self, html) -> Iterator[tuple]:
        yield metadata_of(html)


def register(spark: SparkSession) -> None:
    """Make page_links and page_metadata known to a session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("page_links", udtf(PageLinks))
    spark.udtf.register("page_metadata", udtf(PageMetadata))
