"""Partial dates (yyyy, yyyy-MM, yyyy-MM-dd) as inclusive intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(c: Column) -> Column:
    """Null for an empty string: both count as missing."""
    return F.nullif(c, F.lit(""))


def _date(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd")


def interval_start(value: Column) -> Column:
    """First day of a partial date; null for anything else (also year 0)."""
    day = F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), _date(value))
    month = F.when(value.rlike("^[0-9]{4}-[0-9]{2}$"), _date(F.concat(value, F.lit("-01"))))
    year = F.when(value.rlike("^[0-9]{4}$"), _date(F.concat(value, F.lit("-01-01"))))
    return F.when(~value.startswith("0000"), F.coalesce(day, month, year))


def interval_end(value: Column) -> Column:
    """Last day of a partial date."""
    start = interval_start(value)
    return (
        F.when(F.length(value) == 10, start)
        .when(F.length(value) == 7, F.last_day(start))
        .when(F.length(value) == 4, F.make_date(F.year(start), F.lit(12), F.lit(31)))
    )


def precision(value: Column) -> Column:
    valid = interval_start(value).isNotNull()
    return F.when(
        valid, F.when(F.length(value) == 10, "day").when(F.length(value) == 7, "month").otherwise("year")
    )


def overlaps(value: Column, lower: str | None = None, upper: str | None = None) -> Column:
    """Inclusive overlap with bounds that are themselves partial dates.

    Without bounds every row passes; with one, an unknown date does not.
    """
    if not lower and not upper:
        return F.lit(True)
    out = interval_start(value).isNotNull()
    if lower:
        out = out & (interval_end(value) >= interval_start(F.lit(lower)))
    if upper:
        out = out & (interval_start(value) <= interval_end(F.lit(upper)))
    return F.coalesce(out, F.lit(False))


def effective_date(online: Column, issue: Column, publication: Column) -> Column:
    return F.coalesce(online, issue, publication)


def date_from_parts(parts: Column) -> Column:
    """'yyyy[-MM[-dd]]' from 1 to 3 integers, or null where they are no date."""
    year, month, day = (F.get(parts, i) for i in range(3))
    n = F.size(parts)
    real = F.try_to_date(
        F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(F.coalesce(month, F.lit(1)).cast("string"), 2, "0"), F.lpad(F.coalesce(day, F.lit(1)).cast("string"), 2, "0")),
        "yyyy-MM-dd",
    )
    text = F.concat_ws(
        "-", F.lpad(year.cast("string"), 4, "0"),
        F.when(n >= 2, F.lpad(month.cast("string"), 2, "0")), F.when(n >= 3, F.lpad(day.cast("string"), 2, "0")),
    )
    in_range = year.between(1000, 9999) & (n.between(1, 3)) & F.when(n >= 2, month.between(1, 12)).otherwise(True)
    in_range = in_range & F.when(n >= 3, day.between(1, 31)).otherwise(True)
    return F.when(in_range & real.isNotNull(), text)


def parse_date(text: Column) -> Column:
    """ISO prefix, else an RFC 822 time as its UTC day."""
    iso = F.regexp_extract(text, "^([0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?)(?:$|[T\\s])", 1)
    known = F.when(interval_start(missing(iso)).isNotNull() & (iso >= "1000"), iso)
    bare = F.regexp_replace(F.trim(text), "^[A-Za-z]{3},\\s*", "")
    zone = F.regexp_replace(bare, "\\s(GMT|UTC?|Z)$", " +0000")
    feed = F.date_format(F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")), "yyyy-MM-dd")
    return F.when(missing(iso).isNotNull(), known).otherwise(feed)


def overlap_start(day: Column, days: int = 7) -> Column:
    """The day from which an incremental read starts again."""
    return F.date_sub(day, days)


def age_ms(now: Column, then: Column) -> Column:
    return F.unix_millis(now) - F.unix_millis(then)


def issue_ready(volume: Column, issue_value: Column, today: Column) -> Column:
    """The volume is known and the whole issue interval has passed."""
    return F.coalesce(missing(volume).isNotNull() & (interval_end(issue_value) <= today), F.lit(False))


def eligible(value: Column, coverage_start: str, until: str, announced: Column) -> Column:
    """Archive eligibility: unknown passes; a future date only if announced."""
    start, end = interval_start(value), interval_end(value)
    known = (end >= F.lit(coverage_start).cast("date")) & ((start <= F.lit(until).cast("date")) | F.coalesce(announced, F.lit(False)))
    return F.when(start.isNull(), True).otherwise(known)


def overlaps_coverage(value: Column, since: str, until: str) -> Column:
    start = interval_start(value)
    return F.when(start.isNull(), True).otherwise((interval_end(value) >= F.lit(since).cast("date")) & (start <= F.lit(until).cast("date")))


def display(value: Column) -> Column:
    """Reader's form of a partial date, by its precision; an unreadable one as it is."""
    start = interval_start(value)
    shown = (
        F.when(F.length(value) == 10, F.date_format(start, "d MMM yyyy"))
        .when(F.length(value) == 7, F.date_format(start, "MMM yyyy"))
        .when(F.length(value) == 4, value)
    )
    return F.when(missing(value).isNull(), "Date unavailable").otherwise(F.coalesce(shown, value))


def display_timestamp(value: Column, with_year: bool = False, zone: str = "Asia/Shanghai") -> Column:
    """Reader's form of a time in the readers' zone."""
    local = F.from_utc_timestamp(F.try_to_timestamp(value), zone)
    shown = F.date_format(local, "d MMM yyyy, HH:mm" if with_year else "d MMM, HH:mm")
    return F.when(missing(value).isNull(), "Awaiting first collection").otherwise(F.coalesce(shown, F.lit("Date unavailable")))


def local_day(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def last_days(ts: Column, days: int = 30, zone: str = "Asia/Shanghai") -> Column:
    """First day of the last ``days`` local days, today included."""
    return F.date_sub(local_day(ts, zone), days - 1)
