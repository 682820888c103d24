"""ISO times: fixed-width UTC strings with milliseconds, compared as strings."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrollmill.functions.ids import col

EPOCH = "1970-01-01T00:00:00.000Z"
FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso(ts) -> Column:
    """A timestamp as text, in a session of zone UTC."""
    return F.date_format(col(ts), FORMAT)


def from_millis(ms) -> Column:
    return F.when(F.abs(col(ms).cast("double")) <= 8.64e15, iso(F.timestamp_millis(col(ms).cast("long"))))


def iso_date(number, text, fallback=EPOCH) -> Column:
    """From a JSON number (epoch ms) or string (a number of 10+ characters, or a date); the two are null where the value is of the other kind.

    Dates are ISO forms; free forms such as "May 3 2026" give the fallback.
    """
    text = col(text)
    # A failed cast costs an exception, and dates are nearly all of what comes.
    numeric = F.when((F.length(text) >= 10) & ~text.rlike(r"^\d{4}-\d\d-\d\d"), text.try_cast("double"))
    parsed = F.try_to_timestamp(F.trim(text))
    return F.coalesce(from_millis(col(number).cast("double")), from_millis(numeric), iso(parsed), F.lit(fallback))


def seconds_or_millis(number, text, fallback=EPOCH) -> Column:
    """Numbers under 1e11 are seconds, others milliseconds; strings that are no number are dates."""
    n = F.coalesce(col(number).cast("double"), col(text).try_cast("double"))
    return F.coalesce(from_millis(F.when(F.abs(n) < 1e11, n * 1000).otherwise(n)), iso_date(F.lit(None), text, fallback))


def check_day(day: str) -> dt.date:
    """A valid YYYY-MM-DD day, else ValueError."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day or ""):
        raise ValueError("a date must be a valid YYYY-MM-DD local date")
    return dt.date.fromisoformat(day)


def local_day_range(day: str, tz: str = "UTC") -> tuple[str, str]:
    """The half-open UTC range of a local calendar day, as ISO strings."""
    first = check_day(day)
    zone = ZoneInfo(tz)

    def utc(d: dt.date) -> str:
        return dt.datetime(d.year, d.month, d.day, tzinfo=zone).astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")

    return utc(first), utc(first + dt.timedelta(days=1))


def local_date(ts, tz: str) -> Column:
    """The local calendar day of an ISO string or timestamp."""
    return F.to_date(F.from_utc_timestamp(col(ts).cast("timestamp"), tz))
