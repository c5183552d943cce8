"""Dates, intervals and lap times."""

from pyspark.sql import Column, functions as F

from .ordering import _col


def seconds_between(start, end) -> Column:
    """EXTRACT(EPOCH FROM end - start), fractions kept.

    The difference of two timestamps of one kind is an exact interval whatever
    the session's time zone; its fields add up to seconds.
    """
    span = _col(end) - _col(start)
    whole = sum(F.extract(F.lit(unit), span) * size for unit, size in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60)))
    return (whole + F.extract(F.lit("SECOND"), span)).cast("double")


def mean_interval(start, end) -> Column:
    """Average of ``end - start`` as a day-time interval."""
    return F.make_dt_interval(secs=F.avg(seconds_between(start, end)).cast("decimal(18,6)"))


def lap_seconds(text) -> Column:
    """Seconds of an 'm:ss.fff' text; null for anything else.

    The cast target is a bounded interval, so minutes and seconds come out by
    extraction; try_cast keeps dirty rows as null.
    """
    span = _col(text).try_cast("interval minute to second")
    return F.extract(F.lit("MINUTE"), span) * 60 + F.extract(F.lit("SECOND"), span).cast("double")


def year_text(ts) -> Column:
    return F.date_format(_col(ts).cast("timestamp"), "yyyy")


def year_gap(later, earlier) -> Column:
    """Age as a plain difference of calendar years."""
    return F.year(_col(later)) - F.year(_col(earlier))


def iso_timestamp(text) -> Column:
    """ISO-8601 text with offset, as a timestamp; null when unreadable."""
    return _col(text).try_cast("timestamp")
