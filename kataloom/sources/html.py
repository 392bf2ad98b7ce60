"""Lexicon pages: addresses from sitemaps, entries from HTML."""

from __future__ import annotations

from collections.abc import Mapping
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Class of an element -> field of an entry, and elements without an end.
FIELDS = {"word-category": "category", "word-title": "term", "definition": "definition", "example": "example"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENTRY = r"/kata/([^/?#]+)/?$"


def sitemap_urls(sitemaps: DataFrame, xml_col: str = "xml", path: str = ENTRY, *, ordered: bool = False) -> DataFrame:
    """(url) of a sitemap's <loc> elements whose path is that of an entry, each once; (place, url) with repeats if ``ordered``."""
    locs = F.xpath(F.col(xml_col), F.lit("//*[local-name()='loc']/text()"))
    rows = sitemaps.select(F.posexplode(locs).alias("place", "url")).select("place", F.trim("url").alias("url"))
    rows = rows.where(F.regexp_replace("url", r"[?#].*$", "").rlike(path))
    return rows if ordered else rows.select("url").distinct()


def entry_key(url: Column, path: str = ENTRY) -> Column:
    """The decoded last part of an entry's address (a plus sign stays one), null for other addresses."""

    @F.arrow_udf("string")
    def unquoted(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unquote(t) for t in texts.to_pylist()], pa.string())

    return unquoted(F.nullif(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), path, 1), F.lit("")))


class _Fields(HTMLParser):
    """The text of the first element of each wanted class."""

    def __init__(self, fields: Mapping[str, str]) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted, self.found = fields, {}
        self.name, self.level, self.text = None, 0, []

    def handle_starttag(self, tag, attrs):
        if self.name is None:
            here = set((dict(attrs).get("class") or "").split())
            name = next((f for c, f in self.wanted.items() if c in here and f not in self.found), None)
            if name and tag not in VOID:
                self.name, self.level, self.text = name, 1, []
        elif tag == "br":
            self.text.append(" ")
        elif tag not in VOID:
            self.level += 1

    def handle_endtag(self, tag):
        if self.name is not None and tag not in VOID:
            self.level -= 1
            if self.level == 0:
                text = " ".join("".join(self.text).split())
                if text:
                    self.found[self.name] = text
                self.name = None

    def handle_data(self, data):
        if self.name is not None:
            self.text.append(data)


def extract_entries(pages: DataFrame, source: str, url_col: str = "url", html_col: str = "html", fields: Mapping[str, str] = FIELDS) -> DataFrame:
    """(source, entry_key, url, term, category, definition, example, excluded) of the pages that have a term."""
    names = ("term", "category", "definition", "example")
    wanted = dict(fields)

    @F.arrow_udf("struct<term:string,category:string,definition:string,example:string>")
    def parse(htmls: pa.Array) -> pa.Array:
        out = []
        for html in htmls.to_pylist():
            parser = _Fields(wanted)
            parser.feed(html or "")
            parser.close()
            out.append({n: parser.found.get(n) for n in names})
        return pa.array(out, pa.struct([(n, pa.string()) for n in names]))

    rows = pages.select(F.col(url_col).alias("url"), parse(F.col(html_col)).alias("e")).where("e.term is not null")
    return rows.select(F.lit(source).alias("source"), entry_key(F.col("url")).alias("entry_key"), "url", "e.term", "e.category", "e.definition", "e.example", F.lit(False).alias("excluded"))
