"""Event time from the texts and numbers found in log payloads, as UTC instants."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date-time texts. The hour may have one digit, the fraction any length.
RFC3339 = (
    r"^(\d{4}-\d{2}-\d{2})T(\d{1,2}:\d{2}:\d{2})(?:[.,](\d+))?(Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"
)
PLAIN = r"^(\d{4}-\d{2}-\d{2}) +(\d{1,2}:\d{2}:\d{2})(?:[.,](\d+))?$"

# Integers above this are epoch milliseconds, others epoch seconds.
MILLIS_ABOVE = 100_000_000_000
# Largest epoch second whose microseconds still fit a BIGINT.
MAX_SECONDS = 9_000_000_000_000

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONGEST_MONTH = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
SYSLOG_TIME = r"^([A-Za-z]{3}) +(\d{1,2}) +(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?$"


def _local_time(text: Column, pattern: str) -> Column:
    """Date and time parts of ``text`` read as UTC, to the microsecond."""
    date, clock, fraction = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    micros = F.rpad(F.substring(fraction, 1, 6), 6, "0")
    return F.try_to_timestamp(F.concat(date, F.lit("T"), clock, F.lit("."), micros, F.lit("Z")))


def _offset_seconds(text: Column) -> Column:
    zone = F.regexp_extract(text, RFC3339, 4)
    seconds = (
        F.substring(zone, 2, 2).try_cast("int") * 3600
        + F.substring(zone, 5, 2).try_cast("int") * 60
    )
    signed = F.when(F.startswith(zone, F.lit("-")), -seconds).otherwise(seconds)
    return F.when(zone == "Z", F.lit(0)).otherwise(signed)


def text_time(text: Column) -> Column:
    """RFC 3339 text, or date and time without zone taken as UTC; null for anything else."""
    zoned = F.timestamp_micros(
        F.unix_micros(_local_time(text, RFC3339)) - _offset_seconds(text).cast("bigint") * 1_000_000
    )
    return F.when(F.rlike(text, F.lit(RFC3339)), zoned).when(
        F.rlike(text, F.lit(PLAIN)), _local_time(text, PLAIN)
    )


def number_time(text: Column) -> Column:
    """Number literal as epoch time; null when it is out of range."""
    whole = F.when(F.rlike(text, F.lit("^-?[0-9]+$")), text.try_cast("bigint"))
    millis = F.when(whole < F.lit(MAX_SECONDS * 1000), F.timestamp_millis(whole))
    seconds = F.when(whole > -MAX_SECONDS, F.timestamp_seconds(whole))
    real = text.try_cast("double")
    base = F.when(F.abs(real) < MAX_SECONDS, real.cast("bigint"))
    nanos = ((real - base) * F.lit(1e9)).cast("bigint")
    fractional = F.timestamp_micros(base * 1_000_000 + F.floor(nanos / 1000).cast("bigint"))
    return F.when(whole > MILLIS_ABOVE, millis).when(whole.isNotNull(), seconds).otherwise(
        fractional
    )


def syslog_time(stamp: Column, received_at: Column) -> Column:
    """``Mon _d hh:mm:ss`` in the year of ``received_at``; null when it is no such stamp.

    The day is checked against a leap year, so Feb 29 rolls to Mar 1 in other years.
    """
    month_name, day, hour, minute, second, fraction = (
        F.regexp_extract(stamp, SYSLOG_TIME, i) for i in range(1, 7)
    )
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month_name)).cast("int")
    day, hour, minute, second = (part.try_cast("int") for part in (day, hour, minute, second))
    micros = F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("bigint")
    valid = (
        F.rlike(stamp, F.lit(SYSLOG_TIME))
        & (month > 0)
        & day.between(1, F.get(F.array(*map(F.lit, LONGEST_MONTH)), month - 1))
        & (hour < 24)
        & (minute < 60)
        & (second < 60)
    )
    date = F.date_add(F.make_date(F.year(received_at), month, F.lit(1)), day - 1)
    seconds = F.unix_date(date).cast("bigint") * 86_400 + hour * 3600 + minute * 60 + second
    return F.when(valid, F.timestamp_micros(seconds * 1_000_000 + micros))
