"""Scans of HTML and JSON columns: links, titles, tables, infoboxes, embedded data, sitemaps, robots rules.

What patterns can say stays in SQL functions. Tables with row and column spans and label/value
boxes need a parser; it runs per row of the frame, where the rows lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.text import clean


def first_match(html: Column, patterns: list[str], group: int = 1) -> Column:
    """The group of the first pattern that gives text."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(html, p, group)), F.lit("")) for p in patterns])


def meta(html: Column, key: str) -> Column:
    return first_match(html, [rf'(?is)<meta[^>]+(?:name|property)="{key}"[^>]*content="([^"]*)"', rf'(?is)<meta[^>]+content="([^"]*)"[^>]*(?:name|property)="{key}"'])


def title(html: Column) -> Column:
    return clean(first_match(html, [r'(?is)<meta[^>]+property="og:title"[^>]*content="([^"]+)"', r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<title[^>]*>(.*?)</title>"]))


def links(html: Column) -> Column:
    """Distinct link targets in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1)))


def canonical_links(html: Column) -> Column:
    found = [
        F.regexp_extract_all(html, F.lit(p), F.lit(1))
        for p in (r'<link[^>]+rel="canonical"[^>]*href="([^"]+)"', r'<meta[^>]+property="og:url"[^>]*content="([^"]+)"', r'"url"\s*:\s*"(https?://[^"]+)"')
    ]
    return F.array_distinct(F.concat(*found))


def embedded_json(html: Column) -> Column:
    """JSON texts in ld+json scripts and state assignments."""
    scripts = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    states = F.regexp_extract_all(html, F.lit(r"(?s)__[A-Z_]*STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>"), F.lit(1))
    return F.filter(F.transform(F.concat(scripts, states), lambda j: F.trim(j)), lambda j: F.get_json_object(j, "$").isNotNull())


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def block_around(html: Column, number: Column, before: int = 4000, after: int = 8000) -> Column:
    """The part of a page around the first mention of a number; null without one."""
    at = F.regexp_instr(html, F.concat(F.lit("(?<![0-9])0*"), number.cast("string"), F.lit("(?![0-9])")))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(html, start, at - start + after))


def diagnosis(html: Column, number: Column) -> Column:
    """Why a page gave nothing: no text without scripts, number not listed, or its structure changed."""
    listed = F.rlike(html, F.concat(F.lit("(?<![0-9])0*"), number.cast("string"), F.lit("(?![0-9])")))
    return F.when((F.length(visible_text(html)) < 200) & F.contains(html, F.lit("<script")), "needs_javascript").when(~listed, "not_listed").otherwise("structure_changed")


def sitemap_links(xml: Column, number: Column | None = None) -> Column:
    """<loc> links of a sitemap; with ``number``, those whose path names it."""
    found = F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<loc>(.*?)</loc>"), F.lit(1)), lambda u: F.trim(u))
    if number is None:
        return found
    return F.filter(found, lambda u: F.rlike(F.parse_url(u, F.lit("PATH")), F.concat(F.lit("(?<![0-9])0*"), number.cast("string"), F.lit("(?![0-9])"))))


def robots_allows(rules: Column, path: Column) -> Column:
    """Whether robots.txt lets '*' read a path: the longest rule that is a prefix decides, Allow at a tie."""
    group = F.regexp_extract(F.concat(rules, F.lit("\nUser-agent: end")), r"(?is)user-agent:\s*\*\s*\n(.*?)\n\s*user-agent:", 1)
    lines = F.filter(F.split(group, r"\s*\n\s*"), lambda x: x.rlike(r"(?i)^(?:dis)?allow:\s*\S"))
    parsed = F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_extract(x, r":\s*(\S+)", 1)).alias("n"), x.rlike("(?i)^allow").alias("ok"), F.regexp_extract(x, r":\s*(\S+)", 1).alias("p")
        ),
    )
    best = F.array_max(F.filter(parsed, lambda r: F.startswith(path, r["p"])))
    return F.coalesce(best["ok"], F.lit(True))


class _Tables(HTMLParser):
    """Cells of all tables as (table, row, column, text), spans filled in, and label/value boxes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells, self.pairs = [], []
        self.table = self.row = -1
        self.column, self.open_, self.carried, self.text = 0, None, {}, []
        self.box, self.label = None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.table, self.row, self.carried = self.table + 1, -1, {}
        elif tag == "tr":
            self._close()
            self.row, self.column = self.row + 1, 0
        elif tag in ("td", "th") and self.row >= 0:
            self._close()
            span = lambda k: min(int(a[k]), 500) if (a.get(k) or "").isdigit() and a[k] != "0" else 1
            self.open_, self.text = (span("rowspan"), span("colspan")), []
        elif "pi-data-label" in (a.get("class") or ""):
            self.box, self.text = "label", []
        elif "pi-data-value" in (a.get("class") or ""):
            self.box, self.text = "value", []

    def _fill(self):
        while self.carried.get(self.column, (0, ""))[0]:
            left, text = self.carried[self.column]
            self.cells.append((self.table, self.row, self.column, text))
            self.carried[self.column] = (left - 1, text)
            self.column += 1

    def _close(self):
        if self.open_:
            self._fill()
            (rows, columns), text = self.open_, " ".join("".join(self.text).split())
            for _ in range(columns):
                self.cells.append((self.table, self.row, self.column, text))
                self.carried[self.column] = (rows - 1, text)
                self.column += 1
            self.open_ = None

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._close()
        elif tag == "tr" and self.row >= 0:
            self._close()
            self._fill()
        elif tag == "table":
            self._close()
            self.row = -1
        elif self.box and tag in ("h3", "div"):
            text = " ".join("".join(self.text).split())
            if self.box == "label":
                self.label = text
            elif self.label:
                self.pairs.append((self.label, text))
                self.label = None
            self.box = None

    def handle_data(self, data):
        if self.open_ or self.box:
            self.text.append(data)


def _parsed(html: str | None) -> _Tables:
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return parser


def table_cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, column, text) for every cell of every table, with spans filled in."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, *c) for k, h in zip(part[key], part[html], strict=True) for c in _parsed(h).cells]
            yield pd.DataFrame(rows, columns=[key, "table", "row", "column", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInPandas(run, f"{key} {kind}, table int, row int, column int, text string")


def box_pairs(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, label, value) for every labelled value of a portable infobox."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, *p) for k, h in zip(part[key], part[html], strict=True) for p in _parsed(h).pairs]
            yield pd.DataFrame(rows, columns=[key, "label", "value"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInPandas(run, f"{key} {kind}, label string, value string")


def rows_by_header(cells: DataFrame, key: str, wanted: dict[str, str]) -> DataFrame:
    """Table rows as records: columns found by the first row's labels (name -> pattern), the first match per name."""
    header = cells.where("row = 0")
    named = [header.where(F.col("text").rlike(p)).groupBy(key, "table").agg(F.min("column").alias("column")).withColumn("name", F.lit(n)) for n, p in wanted.items()]
    every = named[0]
    for more in named[1:]:
        every = every.unionByName(more)
    body = cells.where("row > 0").join(every, [key, "table", "column"])
    return body.groupBy(key, "table", "row").pivot("name", list(wanted)).agg(F.first("text"))
