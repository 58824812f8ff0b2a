"""Calendar parts of an impression's hour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The log writes its hour as yyMMddHH; two-digit years from 69 on belong to
# the 1900s (POSIX rule), the rest to the 2000s.
HOUR_DIGITS = 8
CENTURY_TURN = "69"

# Full English day names, Monday first.
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def parse_hour(text: Column) -> Column:
    """``yyMMddHH`` text to a timestamp without zone; null when it is not such a text.

    It is put together from its parts, so the session's zone has no say in it.
    """
    text = F.trim(text)
    part = lambda at: F.substring(text, at, 2).try_cast("int")
    year = part(1) + F.when(F.substring(text, 1, 2) >= CENTURY_TURN, 1900).otherwise(2000)
    zero = F.lit(0)
    stamp = F.try_make_timestamp_ntz(year, part(3), part(5), part(7), zero, zero)
    return F.when(text.rlike(f"^[0-9]{{{HOUR_DIGITS}}}$"), stamp)


def hour_start(ts: str) -> Column:
    """A timestamp without zone cut to its hour, whatever the session's zone."""
    stamp = F.col(ts).cast("timestamp_ntz")
    return stamp - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(stamp), F.extract(F.lit("SECOND"), stamp))


def hour_of_day(ts: Column) -> Column:
    """0 to 23."""
    return F.hour(ts)


def weekday(ts: Column) -> Column:
    """Monday is 0, Sunday is 6."""
    return F.weekday(ts)


def day_name(ts: Column) -> Column:
    """Full English day name, looked up by weekday (no text formatting per row)."""
    return F.get(F.array(*[F.lit(name) for name in DAY_NAMES]), weekday(ts))


def with_calendar(df, ts: str = "hour"):
    """Add ``hour_in_day``, ``weekday`` and ``day_name`` in one projection."""
    stamp = F.col(ts)
    return df.withColumns(
        {
            "hour_in_day": hour_of_day(stamp),
            "weekday": weekday(stamp),
            "day_name": day_name(stamp),
        }
    )
