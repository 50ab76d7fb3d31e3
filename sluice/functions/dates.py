"""Lenient and strict dates; both keep the calendar day as written, whatever its offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANK

_TIME = r"[T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?"


def _day(text: Column, pattern: str, form: str) -> Column:
    return F.when(text.rlike(pattern), F.try_to_date(text, form) if form else None)


def _iso(text: Column) -> Column:
    """The first ten characters as a date where the whole is an ISO date-time with possible times."""
    clock = F.regexp_extract(text, r"^.{10}[T ](\d{2}):?(\d{2})?:?(\d{2})?", 1)
    minute, second = (F.regexp_extract(text, r"^.{10}[T ](\d{2}):?(\d{2})?:?(\d{2})?", i) for i in (2, 3))
    possible = (F.coalesce(clock.try_cast("int"), F.lit(0)) < 24) & (F.coalesce(minute.try_cast("int"), F.lit(0)) < 60) & (F.coalesce(second.try_cast("int"), F.lit(0)) < 60)
    return F.when(text.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}{_TIME}$") & possible, F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def _first_seconds(text: Column) -> Column:
    """The day of a date-time in the first 19 characters, whatever follows them."""
    head = F.substring(text, 1, 19)
    parts = r"^(\d{4}-\d{1,2}-\d{1,2})T(\d{1,2}):(\d{1,2}):(\d{1,2})$"
    hour, minute, second = (F.regexp_extract(head, parts, i).try_cast("int") for i in (2, 3, 4))
    return F.when(head.rlike(parts) & (hour < 24) & (minute < 60) & (second < 62), F.try_to_date(F.regexp_extract(head, parts, 1), "y-M-d"))


def lenient_date(value: Column) -> Column:
    """YYYY-MM-DD, ISO date-times, date-times to the second before anything, Y/m/d, then d/m/Y before m/d/Y; null if none fits."""
    text = F.regexp_replace(value, rf"(?U)^{BLANK}+|{BLANK}+$", "")
    plain = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
    slashes = text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    other = F.coalesce(
        _iso(text), compact, _first_seconds(text), _day(text, r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
        F.when(slashes, F.try_to_date(text, "d/M/y")), F.when(slashes, F.try_to_date(text, "M/d/y")),
    )
    return F.date_format(F.when(plain, F.try_to_date(text, "yyyy-MM-dd")).otherwise(other), "yyyy-MM-dd")


def strict_date(value: Column) -> Column:
    """A real YYYY-MM-DD, alone or before a valid T time; any blank or control character makes it null."""
    day = F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd")
    ok = value.rlike(r"^\d{4}-\d{2}-\d{2}$") | (value.rlike(r"^.{10}T") & _iso(value).isNotNull())
    return F.when(~value.rlike(r"(?U)[\s\x00-\x1F\x7F]") & ok, F.date_format(day, "yyyy-MM-dd"))
