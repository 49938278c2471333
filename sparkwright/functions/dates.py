"""Dates in many spellings to ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwright.functions.strings import let, squeezed, titled

# The spellings, in the order in which they are tried (month first
# with slashes, day first with hyphens), then the tail that is accepted besides.
# Each is a shape, which keeps the parser from texts that cannot fit, and a format.
SPELLINGS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Z][a-z]+ \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Z][a-z]+ \d{4}$", "d MMMM yyyy"),
    (r"^\d{4}-[A-Z][a-z]{2}-\d{1,2}$", "yyyy-MMM-d"),
    (r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{2}/\d{1,2}/\d{1,2}$", "yy/M/d"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"),
)
_NO_DATE = ("null", "na", "n/a", "none", "nan", "")


def _tried(s: Column) -> Column:
    out = []
    for shape, form in SPELLINGS:
        d = F.try_to_timestamp(s, F.lit(form)).cast("date")
        if "yyyy" not in form:
            d = let(d, lambda x: F.when(F.year(x) >= 2069, F.add_months(x, -1200)).otherwise(x))
        out.append(F.when(s.rlike(shape), d))
    return F.coalesce(*out)


def parsed_date(c: Column) -> Column:
    """The first spelling that gives a real date.  Two-digit years from 69 on are
    of the twentieth century.  Ordinals (21st) and time of day are left out."""
    s = squeezed(F.regexp_replace(c, r"(?i)(\d+)(st|nd|rd|th)\b", "$1"))
    s = F.regexp_replace(s, r"^(\d{4}-\d{1,2}-\d{1,2})[Tt ]\d{1,2}:\d{2}.*$", "$1")
    s = let(s, lambda x: F.when(x.rlike("[A-Za-z]"), titled(x)).otherwise(x))
    return F.when(~F.lower(F.trim(c)).isin(*_NO_DATE), let(s, _tried))


def iso_date(c: Column) -> Column:
    return F.date_format(parsed_date(c), "yyyy-MM-dd")


def is_date(c: Column) -> Column:
    """Whether ``parsed_date`` gives one.  What the date rule has left is ISO text, which
    only the first spelling fits, so it goes there at once."""
    iso = F.try_to_timestamp(c, F.lit(SPELLINGS[0][1])).isNotNull()
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}\z"), iso).otherwise(parsed_date(c).isNotNull())
