"""HTML to text with the standard parser, as an Arrow function."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DROP_TAGS = ("script", "style", "input", "img", "svg", "button")
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class _Text(HTMLParser):
    def __init__(self, drop: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.drop, self.open, self.parts = frozenset(drop), [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.drop and tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            del self.open[self.open.index(tag) :]

    def handle_data(self, data):
        if not self.open:
            self.parts.append(data)


def page_text(html: str | None, drop: tuple[str, ...] = DROP_TAGS) -> str:
    """Text nodes outside ``drop`` elements, joined by blanks, white space collapsed; null gives ""."""
    if not html:
        return ""
    parser = _Text(drop)
    parser.feed(html)
    parser.close()
    return " ".join(" ".join(parser.parts).split())


def html_to_text(html: Column | str, drop: tuple[str, ...] = DROP_TAGS) -> Column:
    @F.pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: page_text(p, drop))

    return convert(html)
