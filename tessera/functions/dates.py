"""Dates and local time on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Vancouver"


# The date forms, in the order in which they are tried on the whole text.
WEEKDAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
LONG_DATE = r"[A-Z][a-z]+\s+[0-9]{1,2},\s+[0-9]{4}"


def parse_date(c: Column) -> Column:
    """ISO date of the first form that parses: month name, day, year after a weekday; the same without one;
    yyyy-Mon-dd; yyyy-mm-dd. Only the first match of each form is tried."""
    def attempt(pattern, form):
        found = F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
        return F.to_date(F.try_to_timestamp(F.regexp_replace(found, r"\s+", " "), F.lit(form)))

    forms = [(rf"(?:{WEEKDAYS}),\s+({LONG_DATE})", "MMMM d, yyyy"), (f"({LONG_DATE})", "MMMM d, yyyy"), ("([0-9]{4}-[A-Z][a-z]{2}-[0-9]{2})", "yyyy-MMM-dd"), ("([0-9]{4}-[0-9]{2}-[0-9]{2})", "yyyy-MM-dd")]
    long_form = F.coalesce(*[attempt(*form) for form in forms])
    return F.date_format(long_form, "yyyy-MM-dd")


def valid_date(c: Column) -> Column:
    return F.coalesce(F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))).isNotNull(), F.lit(False))


def normalize_datetime(c: Column, zone: str = ZONE) -> Column:
    """UTC time of an ISO string; without an offset it is local, a malformed tail means local noon."""
    text = F.trim(c)
    has_offset = text.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$") & text.contains(":")
    # local times are read as if they were UTC and then moved, so the session's zone plays no part
    day = F.nullif(F.regexp_extract(text, "^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.lit(""))
    whole = F.when(F.length(text) <= 10, F.try_to_timestamp(F.concat(day, F.lit("T00:00:00Z")))).otherwise(F.try_to_timestamp(F.concat(text, F.lit("Z"))))
    noon = F.try_to_timestamp(F.concat(day, F.lit("T12:00:00Z")))
    return F.when(has_offset, F.try_to_timestamp(text)).otherwise(F.to_utc_timestamp(F.coalesce(whole, noon), zone))


def activation(*candidates: Column) -> Column:
    """The first of the times that is one: activated, created, made, updated; now where none is."""
    return F.coalesce(*[normalize_datetime(c.cast("string")) for c in candidates], F.current_timestamp())


def change_date_label(at: Column, precision: Column, zone: str = ZONE) -> Column:
    """A change's date for display: a dash where there is none, the UTC year at year precision, else the local date."""
    year = F.date_format(F.to_timestamp_ntz(F.to_utc_timestamp(at, F.current_timezone())), "yyyy")
    return F.when(at.isNull(), "\u2014").when(precision == "year", year).otherwise(F.date_format(F.to_timestamp_ntz(F.to_utc_timestamp(local(at, zone), F.current_timezone())), "MMM d, yyyy"))


def local(c: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(c, zone)


def frequency_due(frequencies: Column, at: Column, hour: int = 8, weekday: int = 0) -> Column:
    """immediate always; daily from an hour on; weekly on a weekday (0 is Monday) from that hour on."""
    late = F.hour(at) >= hour
    return F.array_contains(frequencies, "immediate") | (F.array_contains(frequencies, "daily") & late) | (F.array_contains(frequencies, "weekly") & (F.weekday(at) == weekday) & late)


def date_value(date: Column, year: Column) -> Column:
    return F.coalesce(F.nullif(date, F.lit("")), F.concat(year.cast("string"), F.lit("-01-01")), F.lit("0000-01-01"))
