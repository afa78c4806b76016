"""The real-time clock of a record: seven binary bytes, year to hundredths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import byte_at

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS"


def full_year(year_byte: Column) -> Column:
    """2000 and the byte; a hundred years less from 2051 on."""
    return F.when(year_byte > 50, 1900 + year_byte).otherwise(2000 + year_byte)


def rtc_stamp(clock: Column) -> Column:
    """timestamp_ntz of seven clock bytes, null unless they are a real date and time. A second of 60 isn't one."""
    year, month, day, hour, minute, second, hundredths = (byte_at(clock, i) for i in range(7))
    seconds = (second + hundredths / F.lit(100).cast("decimal(3,0)")).cast("decimal(8,6)")
    stamp = F.try_make_timestamp_ntz(full_year(year), month, day, hour, minute, seconds)
    return F.when((second <= 59) & (hundredths <= 99), stamp)


def rtc_text(clock: Column, stamp: Column) -> Column:
    """ISO text to milliseconds, or the raw bytes where they are no date."""
    raw = F.format_string("raw:%02d-%02d-%02dT%02d:%02d:%02d.%02d", *[F.coalesce(byte_at(clock, i), F.lit(0)) for i in range(7)])
    return F.coalesce(F.date_format(stamp, ISO), raw)


def to_millis(stamp: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp_ntz."""
    own = F.col(stamp) if isinstance(stamp, str) else stamp
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), own)
