"""Dates, prices and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from briefloom.functions.html import bound

#: Business days are UTC+9; labels of the two markets.
BUSINESS_OFFSET = "+09:00"
PAGE_LABELS = ("미국 증시 일간 요약", "한국 증시 일간 요약")
CLUSTER_LABELS = ("미국", "한국")
PAGE_TITLE = "글로벌 시장 일간 요약 - "


#: Zone names of RFC 2822 dates and their hours from UTC, month names.
ZONES = {"ut": 0, "utc": 0, "gmt": 0, "z": 0, "ast": -4, "adt": -3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
PUB_DATE = r"(?i)^\s*+(?:[a-z]++\.?\s*+,?\s*+)?(\d{1,2})[\s-]++([a-z]{3})[a-z]*+\.?,?[\s-]++(\d{2}|\d{4})\s++(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?\s*+([+-]\d{4}|[a-z]++)?\s*+(?:\(.*\))?\s*$"


def _parts(c: Column) -> Column:
    """What the pattern finds in a date, each part once."""
    names = ("day", "month", "year", "hour", "minute", "second", "zone")
    return F.struct(*[F.regexp_extract(c, PUB_DATE, k).alias(n) for k, n in enumerate(names, 1)])


def _offset(zone: Column) -> Column:
    def seconds(z: Column) -> Column:
        number = lambda at: F.substring(z, at, 2).try_cast("int")
        stated = F.when(z.startswith("-"), -1).otherwise(1) * (number(2) * 3600 + number(4) * 60)
        hours = F.create_map(*[F.lit(x) for item in ZONES.items() for x in item])
        return F.when(z.rlike(r"^[+-]\d{4}$"), F.when(z != "-0000", stated)).otherwise(F.try_element_at(hours, z) * 3600)

    return bound(F.lower(zone), seconds)


def _instant(p: Column) -> Column:
    """The instant of the parts of a date."""
    part = lambda n: F.nullif(p[n], F.lit("")).try_cast("int")
    place = F.instr(F.lit(MONTHS), F.lower(F.nullif(p["month"], F.lit(""))))
    month = F.when((place > 0) & (place % 3 == 1), F.floor((place + 2) / 3).cast("int"))
    year = F.when(part("year") >= 100, part("year")).when(part("year") > 68, part("year") + 1900).otherwise(part("year") + 2000)
    second = F.coalesce(part("second"), F.lit(0))
    local = F.try_make_timestamp(year, month, part("day"), part("hour"), part("minute"), F.when(second < 60, second), F.lit("UTC"))
    return F.timestamp_micros(F.unix_micros(local) - _offset(p["zone"]).cast("long") * 1_000_000)


def pub_offset(c: Column) -> Column:
    """Seconds from UTC of an RFC 2822 date; null without an offset, with an unknown zone and with ``-0000``, which states none."""
    return _offset(F.regexp_extract(c, PUB_DATE, 7))


def parse_pub_date(c: Column) -> Column:
    """Instant of an RFC 2822 date; null if it can't be read or has no offset.

    Day names and seconds may be missing; two digits of a year are 1969 to 2068.
    """
    return bound(_parts(c), _instant)


def pub_iso(c: Column) -> Column:
    """An RFC 2822 date as ISO text with the offset it came with."""
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")

    def text(x: Column) -> Column:
        local = F.timestamp_micros(F.unix_micros(x["instant"]) + x["offset"].cast("long") * 1_000_000)
        sign, size = F.when(x["offset"] < 0, "-").otherwise("+"), F.abs(x["offset"])
        return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, two(F.floor(size / 3600)), F.lit(":"), two(F.floor(size % 3600 / 60)))

    whole = lambda p: F.struct(_instant(p).alias("instant"), _offset(p["zone"]).alias("offset"))
    return bound(bound(_parts(c), whole), text)


def business_date(instant: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, BUSINESS_OFFSET))


def iso_utc(instant: Column) -> Column:
    return F.date_format(F.date_trunc("second", instant), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso(instant: Column) -> Column:
    """ISO text with offset, micros only where there are any."""
    instant = instant.cast("timestamp")
    return F.concat(
        F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.expr("0") == F.pmod(F.unix_micros(instant), F.lit(1_000_000)), "").otherwise(F.date_format(instant, ".SSSSSS")),
        F.lit("+00:00"),
    )


def whole_seconds(later: Column, earlier: Column) -> Column:
    """Rounded seconds between two instants, not below 0."""
    return F.greatest(F.round((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000).cast("int"), F.lit(0))


def quantized(c: Column) -> Column:
    """Four decimals, half to even."""
    return F.bround(c.cast("decimal(38,18)"), 4).cast("decimal(20,4)")


def change(close: Column, previous: Column) -> tuple[Column, Column]:
    """(difference, percent of the previous close), each rounded once, half to even; 0 percent where that is 0.

    A decimal division would round before: the percent is a whole quotient of ten-thousandths and
    its remainder.  Prices have 14 digits before and after the point.  The percent has room for any
    change on a price of at least 0.0000000001, beyond the ten digits that the index table keeps.
    """
    before = previous.cast("decimal(28,14)")
    diff = close.cast("decimal(28,14)") - before
    divisor = F.nullif(before, F.lit(0).cast("decimal(28,14)"))
    scaled = diff * F.lit(1_000_000).cast("decimal(7,0)")
    over = scaled % divisor
    # not div, which is a long: what divides evenly isn't rounded
    whole, rest = ((scaled - over) / divisor).cast("decimal(32,0)"), F.abs(over) * 2
    up = (rest > F.abs(divisor)) | ((rest == F.abs(divisor)) & (whole % 2 != 0))
    away = F.when((scaled < 0) != (divisor < 0), -1).otherwise(1)
    percent = (whole + F.when(up, away).otherwise(0)).cast("decimal(32,0)") * F.lit("0.0001").cast("decimal(4,4)")
    return quantized(diff), F.when(before == 0, F.lit(0)).otherwise(percent).cast("decimal(32,4)")


def page_label(market: Column) -> Column:
    return F.when(market == "US", PAGE_LABELS[0]).otherwise(PAGE_LABELS[1])


def cluster_label(market: Column) -> Column:
    return F.when(market == "US", CLUSTER_LABELS[0]).otherwise(CLUSTER_LABELS[1])


def page_title(day: Column) -> Column:
    return F.concat(F.lit(PAGE_TITLE), F.date_format(day, "yyyy-MM-dd"))
