"""Months and round labels from written dates. A text that is not clearly a date gives null, never a guess."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafwork.functions.binding import let

NUMERIC = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$"
UNDATED = "undated"
_FULL = [m.lower() for m in calendar.month_name[1:]]
_SHORT = [m.lower() for m in calendar.month_abbr[1:]]


def _text(x: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), r"(?U)^\s+|\s+$", "")


def _number(text: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, NUMERIC, group), F.lit("")).try_cast("int")


def _named_month(low: Column, names: list[str]) -> Column:
    """The first month by calendar of the names that occur as words; one pattern finds them all."""
    found = F.regexp_extract_all(low, F.lit(rf"(?U)\b({'|'.join(names)})\b"), 1)
    calendar_place = F.array(*map(F.lit, names))
    return F.array_min(F.transform(found, lambda name: F.array_position(calendar_place, name))).cast("int")


def _written_month(text: Column) -> Column:
    """The first month by calendar whose full name occurs as a word, else the first whose short name does."""
    low = F.lower(text)
    return F.coalesce(_named_month(low, _FULL), _named_month(low, _SHORT))


def _numeric_month(text: Column) -> Column:
    month, day = _number(text, 1), _number(text, 2)
    return F.when(month.between(1, 12) & day.between(1, 31), month)


def _month_of(text: Column) -> Column:
    return F.when(text.rlike(NUMERIC), _numeric_month(text)).otherwise(_written_month(text))


def parse_month(x: Column | str) -> Column:
    """The month of ``M/D/Y`` or ``M-D-Y``, or of a date in words. A numeric date out of range does not fall back to words."""
    return let(_text(x), _month_of)


def _year_of(text: Column) -> Column:
    short = _number(text, 3)
    written = F.nullif(F.regexp_extract(text, r"(?U)\b((?:19|20)\d{2})\b", 1), F.lit("")).try_cast("int")
    return F.when(text.rlike(NUMERIC), F.when(short < 100, short + 2000).otherwise(short)).otherwise(written)


def parse_year_month(x: Column | str) -> Column:
    """struct(year, month) or null. Years below 100 count from 2000; a date in words needs a year from 1900 to 2099 as a word."""
    both = lambda text: F.struct(_year_of(text).alias("year"), _month_of(text).alias("month"))
    whole = lambda found: F.when(found["year"].isNotNull() & found["month"].isNotNull(), found)
    return let(let(_text(x), both), whole)


def round_label(x: Column | str) -> Column:
    """``YYYY-MM`` or ``undated``."""
    label = lambda found: F.when(found.isNotNull(), F.format_string("%04d-%02d", found["year"], found["month"]))
    return F.coalesce(let(parse_year_month(x), label), F.lit(UNDATED))


def month_name(month: Column | str) -> Column:
    m = F.col(month) if isinstance(month, str) else month
    return F.get(F.array(*[F.lit(name) for name in calendar.month_name[1:]]), m - 1)
