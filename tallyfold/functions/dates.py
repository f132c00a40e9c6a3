"""Wall-clock time. Nothing here depends on the session's time zone."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns tried after the ISO forms, month first. A day-first pattern only ever
# sees text that the month-first one refused, such as 13/1/2010.
_TIME = "[ H:mm[:ss[.SSSSSS]]]"
DATE_FORMATS = (
    "M/d/yyyy" + _TIME,
    "M/d/yyyy h:mm[:ss] a",
    "d/M/yyyy" + _TIME,
    "d/M/yyyy h:mm[:ss] a",
    "M/d/yy" + _TIME,
    "M/d/yy h:mm[:ss] a",
    "d/M/yy" + _TIME,
    "d/M/yy h:mm[:ss] a",
    "yyyy/M/d" + _TIME,
    "M-d-yyyy" + _TIME,
    "M.d.yyyy" + _TIME,
    "d.M.yyyy" + _TIME,
    "d-MMM-yyyy" + _TIME,
    "d-MMM-yy" + _TIME,
    "d MMM yyyy" + _TIME,
    "d MMMM yyyy" + _TIME,
    "MMM d[,] yyyy" + _TIME,
    "MMMM d[,] yyyy" + _TIME,
    "yyyyMMdd",
)


#: Column of a stored table with the first day of each row's month, which its folders are named after.
SALE_MONTH = "sale_month"


def parse_date(text: Column, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """Text to ``timestamp_ntz``, null where no pattern fits.

    The patterns are read as UTC and turned into wall-clock time by counting
    microseconds; going through the session's zone would shift hours that a
    daylight-saving change skips.
    """
    tries = [F.upper(text).try_cast("timestamp_ntz")]
    for pattern in formats:
        instant = F.try_to_timestamp(F.concat(text, F.lit(" Z")), F.lit(f"{pattern} X"))
        tries.append(
            F.timestamp_add("MICROSECOND", F.unix_micros(instant), wall_clock("1970-01-01"))
        )
    return F.coalesce(*tries)


def wall_clock(day: str) -> Column:
    """The start of an ISO day as a literal that Catalyst can push into a scan."""
    return F.lit(datetime.date.fromisoformat(day).isoformat()).cast("timestamp_ntz")


def month_of(moment: Column) -> Column:
    """First day of the month."""
    return F.trunc(moment.cast("date"), "month")


def month_label(month: Column) -> Column:
    """``2011-1``: the month is not padded."""
    return F.date_format(month, "yyyy-M")


def whole_days(later: Column, earlier: Column) -> Column:
    """Full 24-hour days between two wall-clock moments; 23:00 to 01:00 is none."""
    return F.extract(F.lit("DAY"), later - earlier).cast("bigint")


def timestamp_text(moment: Column) -> Column:
    """Date and time with a fraction, of six digits, only where there is one."""
    text = moment.cast("timestamp_ntz").cast("string")
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)
