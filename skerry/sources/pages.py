"""Raw web pages to articles: title and visible paragraphs."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Elements without visible text, those that a page's head may hold, drawings (whose titles
# aren't the page's), and elements that end a paragraph.
_HIDDEN = frozenset(("script", "style", "noscript", "template"))
_OF_HEAD = frozenset(("base", "link", "meta", "noscript", "script", "style", "template", "title", "html", "head"))
_DRAWINGS = frozenset(("svg", "math"))
_BLOCKS = frozenset(("p", "div", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "td", "ul", "ol", "table", "nav", "footer", "header"))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.paragraphs, self._words = None, [], []
        self._hidden = self._drawn = 0
        self._in_head = self._in_title = False

    def _end(self) -> None:
        if text := " ".join("".join(self._words).split()):
            self.paragraphs.append(text)
        self._words = []

    def handle_starttag(self, tag, attrs):
        # The first element that a head can't hold ends it, with or without an end tag.
        self._in_head = tag == "head" or (self._in_head and tag in _OF_HEAD)
        self._hidden += tag in _HIDDEN
        self._drawn += tag in _DRAWINGS
        if tag == "title" and not self._drawn and self.title is None:
            self.title, self._in_title = "", True
        if tag in _BLOCKS:
            self._end()

    def handle_endtag(self, tag):
        self._in_head &= tag != "head"
        self._hidden = max(0, self._hidden - (tag in _HIDDEN))
        self._drawn = max(0, self._drawn - (tag in _DRAWINGS))
        self._in_title &= tag != "title"
        if tag in _BLOCKS:
            self._end()

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        elif not self._hidden and not (self._in_head and not data.strip()):
            self._in_head = False  # text can't stand in a head either
            self._words.append(data)


def parse_html(html: str | None) -> tuple[str, list[str]]:
    page = _Page()
    page.feed(html or "")
    page.close()
    page._end()
    return (page.title or "").strip(), page.paragraphs


@pandas_udf(StructType([StructField("title", StringType()), StructField("paragraphs", ArrayType(StringType()))]))
def _parsed(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_html(x) for x in pages], columns=["title", "paragraphs"])


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title, paragraphs."""
    return pages.select("page_id", "url", _parsed("html").alias("p")).select("page_id", "url", "p.title", "p.paragraphs")
