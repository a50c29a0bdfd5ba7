"""Text, link, digest and JSON expressions: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from briefloom.functions.html import bound, unescape

#: Python's white space, as one character class of a Java pattern.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Runs of it other than one plain space.
SPACES = rf"(?:\x20{SPACE}|{SPACE[:-1]}&&[^\x20]]){SPACE}*+"
#: Fixed value: what counts as a word of a title.
TOKEN = "[0-9A-Za-z가-힣]{2,}"
URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*+):)?(?://([^/?#]*+))?([^?#]*+)(?:\?([^#]*+))?(?:#.*)?$"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode-aware.  A run is only looked at from its beginning."""
    return F.regexp_replace(c, rf"^{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def normalize_whitespace(c: Column) -> Column:
    """Runs of white space to one space, none at the ends; null to ''."""
    return F.trim(F.regexp_replace(_text(c), SPACES, " "))


def without_tags(c: Column) -> Column:
    """Without ``<...>``.  Behind the last ``>`` nothing is looked for, so every ``<`` that is tried has an end."""

    def cut(x: Column) -> Column:
        return F.concat(F.regexp_replace(F.left(x["t"], F.length(x["t"]) - F.length(x["rest"])), "<[^>]+>", ""), x["rest"])

    parts = F.struct(c.alias("t"), F.substring_index(c, ">", -1).alias("rest"))
    return F.when(c.contains("<"), bound(parts, cut)).otherwise(c)


def strip_html(c: Column) -> Column:
    """Tags out first, then entities decoded, then stripped; null to ''."""
    return strip(_plain(c))


def _plain(c: Column) -> Column:
    return bound(without_tags(_text(c)), unescape)


def normalize_title(c: Column) -> Column:
    """:func:`strip_html`, then white space normalised, which strips as well."""
    return normalize_whitespace(_plain(c))


def canonicalize_link(c: Column) -> Column:
    """Scheme and host in lower case, no slash at the path's end, no fragment, query kept; null to ''."""
    link = F.translate(strip(_text(c)), "\t\r\n", "")
    part = lambda k: F.regexp_extract(link, URL, k)
    scheme, host, path, query = F.lower(part(1)), F.lower(part(2)), F.rtrim(part(3), F.lit("/")), part(4)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def link_domain(c: Column) -> Column:
    """Host part as written; null if there is none."""
    return F.nullif(F.regexp_extract(F.translate(strip(_text(c)), "\t\r\n", ""), URL, 2), F.lit(""))


def first_link(*links: Column) -> Column:
    """First link that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in links])


def dedupe_hash(title: Column, link: Column) -> Column:
    """SHA-256 of the normalised title and link."""
    return F.sha2(F.concat_ws("|", normalize_title(title), canonicalize_link(link)), 256)


def provider_key(origin: Column, link: Column, title: Column, published_iso: Column) -> Column:
    return F.sha2(F.concat_ws("|", strip(_text(origin)), strip(_text(link)), strip(_text(title)), _text(published_iso)), 256)


def _cut(c: Column, limit: int) -> Column:
    short = lambda t: F.regexp_replace(F.substring(t, 1, limit - 1), rf"{SPACE}++\z", "")
    return bound(c, lambda t: F.when(F.length(t) > limit, F.concat(short(t), F.lit("…"))).otherwise(t))


def excerpt(c: Column, limit: int = 240) -> Column:
    """Normalised text of at most ``limit`` code points, the last one an ellipsis if it was longer."""
    return _cut(normalize_title(c), limit)


def body_excerpt(c: Column, limit: int = 280) -> Column:
    """As :func:`excerpt` without touching markup; null and '' to null."""
    return F.when(F.nullif(c, F.lit("")).isNotNull(), _cut(normalize_whitespace(c), limit))


def tokens(c: Column) -> Column:
    """Distinct words of two or more letters, digits or Hangul, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(normalize_title(c)), F.lit(TOKEN), F.lit(0)))


def tags(titles: Column, most: int = 5) -> Column:
    """First distinct words of a list of titles, two characters or more, case kept."""
    words = F.flatten(F.transform(titles, lambda t: F.split(F.trim(F.regexp_replace(F.translate(_text(t), "/|", "  "), SPACES, " ")), " ")))
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2)), 1, most)


def json_field(payload: Column, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}")


def json_texts(c: Column) -> Column:
    """A JSON array of strings; null to an empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_row(*columns: Column) -> Column:
    """A JSON object that keeps null fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def market_fields(metadata: Column) -> Column:
    """Background, key themes and outlook out of a market summary's metadata; missing lists are empty."""
    m, empty = F.from_json(metadata, "background array<string>, keyThemes array<string>, outlook string"), F.array().cast("array<string>")
    return F.struct(F.coalesce(m["background"], empty).alias("background"), F.coalesce(m["keyThemes"], empty).alias("keyThemes"), m["outlook"].alias("outlook"))


def model_answer(c: Column, schema: str) -> Column:
    """A model's JSON answer, code fences taken off; null unless the whole text is one JSON object.

    ``from_json`` alone takes a text that breaks off, or that goes on after the object.
    """
    text = strip(_text(c))
    inner = strip(F.btrim(text, F.lit("`")))
    inner = F.when(inner.startswith("json"), strip(F.substring(inner, 5, 2**31 - 1))).otherwise(inner)
    bare = F.when(text.startswith("```"), inner).otherwise(text)
    whole = F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]")))
    one = bare.startswith("{") & whole.isNotNull() & F.try_variant_get(whole, "$[1]", "variant").isNull()
    return F.when(one, F.from_json(bare, schema))


def keyword_key(c: Column) -> Column:
    return F.lower(F.trim(c))
