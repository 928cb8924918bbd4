"""Dates in the shapes that registries use: ISO, and day-month-year with a two-digit year. Bad dates become NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-digit years above this belong to the last century.
PIVOT = 30

ISO = r"^\d{4}-\d{2}-\d{2}$"
COMPACT = r"^\d{8}$"
ISO_WEEK = r"^\d{4}-W\d{2}-\d$"
MONTH_NAME = r"^\d{1,2}-[A-Z]{3}-(\d{2}|\d{4})$"


def _month_name_date(c: Column) -> Column:
    parts = F.split(c, "-")
    day, month, year = (F.get(parts, F.lit(i)) for i in range(3))
    short = F.try_to_number(year, F.lit("9999")).cast("int")
    full = F.when(F.length(year) == 2, F.when(short > PIVOT, short + 1900).otherwise(short + 2000)).otherwise(short)
    proper = F.concat(F.upper(F.substring(month, 1, 1)), F.lower(F.substring(month, 2, 2)))
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", F.lpad(day, 2, "0"), proper, F.lpad(full.cast("string"), 4, "0")), F.lit("dd-MMM-yyyy")))


def _tried(c: Column, fmt: str) -> Column:
    return F.to_date(F.try_to_timestamp(c, F.lit(fmt)))


def _iso_week_date(c: Column) -> Column:
    """The fourth of January is always in week 1; weeks begin on Mondays."""
    year, week, day = F.substring(c, 1, 4), F.substring(c, 7, 2).cast("int"), F.substring(c, 10, 1).cast("int")
    monday = lambda y: F.date_trunc("week", _tried(F.concat(y, F.lit("-01-04")), "yyyy-MM-dd")).cast("date")
    found = F.date_add(monday(year), (week - 1) * 7 + day - 1)
    after = monday(F.lpad((year.cast("int") + 1).cast("string"), 4, "0"))
    return F.when((week >= 1) & day.between(1, 7) & (F.date_add(monday(year), (week - 1) * 7) < after), found)


def parse_flexible_date(c: Column) -> Column:
    """DATE from ISO, compact, ISO-week or day-month-year text, after trimming and upper-casing; NULL where it is none."""
    t = F.upper(F.trim(c.cast("string")))
    return (
        F.when(t.rlike(ISO), _tried(t, "yyyy-MM-dd"))
        .when(t.rlike(COMPACT), _tried(t, "yyyyMMdd"))
        .when(t.rlike(ISO_WEEK), _iso_week_date(F.when(t.rlike(ISO_WEEK), t)))
        .when(t.rlike(MONTH_NAME), _month_name_date(F.when(t.rlike(MONTH_NAME), t)))
    )


def legacy_date_iso(c: Column) -> Column:
    """The ISO text of a legacy date; NULL for blanks, impossible dates and junk (never the loss of the row)."""
    t = F.upper(F.trim(c))
    found = F.when(t.rlike(ISO), _tried(t, "yyyy-MM-dd")).when(t.rlike(MONTH_NAME), _month_name_date(F.when(t.rlike(MONTH_NAME), t)))
    return F.date_format(found, "yyyy-MM-dd")


def latest_date(c: Column, is_array: bool) -> Column:
    """The latest readable date of a value or of an array of them."""
    return F.array_max(F.transform(c, parse_flexible_date)) if is_array else parse_flexible_date(c)


def to_yyyymmdd(c: Column) -> Column:
    """The first ten characters without dashes as an integer; NULL where that is no number."""
    digits = F.regexp_replace(F.substring(c.cast("string"), 1, 10), "-", "")
    return F.when(digits.rlike(r"^\d+$"), digits.try_cast("int"))


def from_yyyymmdd(c: Column) -> Column:
    return _tried(c.cast("string"), "yyyyMMdd")


def months_between(start: Column, end: Column) -> Column:
    """Days / 30.4375, of YYYYMMDD integers."""
    return F.date_diff(from_yyyymmdd(end), from_yyyymmdd(start)) / F.lit(30.4375)
