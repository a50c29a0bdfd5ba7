"""The two text functions Spark lacks: entity decoding, in expressions, and article body text."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = re.compile(r"\s+")
#: Where an article's body is looked for, in this order.
PLACES = (("tag", "article"), ("tag", "main"), ("id", "dic_area"), ("class", "article_body"), ("class", "article_view"), ("class", "news_end"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose strings aren't text.
SILENT = frozenset("script style template rt rp".split())
#: Lengths of names that may stand without a semicolon.
BARE = sorted({len(n) for n in html5 if not n.endswith(";")}, reverse=True)
REPLACED = "\N{REPLACEMENT CHARACTER}"


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once a row."""
    return F.transform(F.array(value), use)[0]


def _names() -> Column:
    """Named references by first letter and name; a literal once the plan is optimised."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        by_letter.setdefault(name[0], {})[name] = text
    return F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")


def _character(number: Column) -> Column:
    """What a numeric reference stands for: Windows-1252 for the C1 range, nothing for other controls and non-characters."""
    c1 = F.array(*[F.lit(bytes([n]).decode("cp1252", "ignore") or chr(n)) for n in range(0x80, 0xA0)])
    nothing = (
        number.between(0x1, 0x8) | (number == 0xB) | number.between(0xE, 0x1F) | (number == 0x7F) | number.between(0xFDD0, 0xFDEF) | (number % 0x10000 >= 0xFFFE)
    )
    return (
        F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), REPLACED)
        .when(number.between(0x80, 0x9F), F.try_element_at(c1, (number - 0x7F).cast("int")))
        .when(nothing, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    )


def _reference(piece: Column) -> Column:
    """A piece of text that an ampersand stands before, with the reference it begins with decoded."""

    def numeric(found: Column) -> Column:
        digits = F.regexp_replace(found, "^#[xX]?0*+|;$", "")
        value = F.when(F.length(digits) > 7, 0x110000).when(found.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.try_cast("long"))
        return F.concat(_character(F.coalesce(value, F.lit(0))), F.substring(piece, F.length(found) + 1, F.length(piece)))

    def named(x: Column) -> Column:
        get = lambda name: F.try_element_at(x["names"], name)
        found = F.when(get(x["name"]).isNotNull(), F.length(x["name"]))
        for n in BARE:
            found = found.when((F.length(x["name"]) > n) & get(F.substring(x["name"], 1, n)).isNotNull(), n)
        decoded = lambda n: F.concat(get(F.substring(x["name"], 1, n)), F.substring(piece, n + 1, F.length(piece)))
        return bound(found, lambda n: F.when(n.isNull(), F.concat(F.lit("&"), piece)).otherwise(decoded(n)))

    number = F.regexp_extract(piece, "^#(?:[0-9]++|[xX][0-9a-fA-F]++);?", 0)
    name = F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};?", 0)
    letter = F.struct(F.try_element_at(_names(), F.substring(piece, 1, 1)).alias("names"), name.alias("name"))
    return F.when(piece.startswith("#"), bound(number, lambda n: F.when(n == "", F.concat(F.lit("&"), piece)).otherwise(numeric(n)))).otherwise(
        bound(letter, named)
    )


def unescape(c: Column) -> Column:
    """Character references decoded as HTML5 has it: numbers, names, and the longest name that a reference begins with.

    The text is cut before whatever may be a reference; nothing that was decoded is read again.
    """
    pieces = F.split(c, "&(?=[#A-Za-z])", -1)
    decoded = lambda p: F.concat(p[0], F.array_join(F.transform(F.filter(p, lambda _, k: k > 0), _reference), ""))
    return F.when(c.contains("&"), bound(pieces, decoded)).otherwise(c)


class _Body(HTMLParser):
    """Collects the text inside the first element of each place, and the meta description."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.silent = 0
        self.inside: dict[int, int] = {}
        self.texts: dict[int, list[str]] = {}
        self.description: str | None = None

    def handle_starttag(self, tag, attrs):
        got = dict(attrs)
        if tag == "meta" and got.get("name") == "description" and self.description is None:
            self.description = got.get("content") or ""
        if tag in VOID:
            return
        self.open.append(tag)
        self.silent += tag in SILENT
        for k, (kind, value) in enumerate(PLACES):
            hit = tag == value if kind == "tag" else value in (got.get(kind) or "").split() if kind == "class" else got.get("id") == value
            if hit and k not in self.texts:
                self.texts[k], self.inside[k] = [], len(self.open)

    def handle_endtag(self, tag):
        if tag in self.open:
            gone = None
            while gone != tag:
                gone = self.open.pop()
                self.silent -= gone in SILENT
            self.inside = {k: depth for k, depth in self.inside.items() if depth <= len(self.open)}

    def handle_data(self, data):
        if self.silent:
            return
        if text := data.strip():
            for k in self.inside:
                self.texts[k].append(text)


def body_text_of(page: str | None) -> str | None:
    """Text of the first place found, else the meta description; null if empty."""
    if not page:
        return None
    parser = _Body()
    parser.feed(page)
    parser.close()
    text = " ".join(parser.texts[min(parser.texts)]) if parser.texts else parser.description or ""
    return SPACE.sub(" ", html.unescape(text)).strip() or None


@F.pandas_udf(StringType())
def body_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """:func:`body_text_of` of each page; nulls and empty pages aren't parsed."""
    for batch in pages:
        yield pd.Series([body_text_of(p) if p else None for p in batch], dtype=object)
