"""Row validation as an array of (field, error) findings; an empty array means valid."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import schemas as S

# The zero instant of the event clock; a row carrying it has no usable time.
ZERO_TIME = "0001-01-01T00:00:00Z"


def source_valid(source: Column) -> Column:
    return F.coalesce(source.isin(*S.SOURCES), F.lit(False))


def _no_time(instant: Column) -> Column:
    return instant.isNull() | (instant == F.lit(ZERO_TIME).cast("timestamp"))


def _blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def _findings(*checks: tuple[str, Column, str]) -> Column:
    found = [
        F.when(failed, F.struct(F.lit(field).alias("field"), F.lit(error).alias("error")))
        for field, failed, error in checks
    ]
    any_failed = reduce(or_, [failed for _, failed, _ in checks])
    # Valid rows, nearly all, skip building the list.
    none = F.array().cast(S.FIELD_ERRORS)
    return F.when(any_failed, F.array_compact(F.array(*found)).cast(S.FIELD_ERRORS)).otherwise(none)


def raw_errors(source: Column, payload: Column, received_at: Column) -> Column:
    """All violations of a raw event, in a fixed order."""
    return _findings(
        ("payload", _blank(payload), S.EMPTY_PAYLOAD),
        ("source", ~source_valid(source), S.UNKNOWN_SOURCE),
        ("received_at", _no_time(received_at), S.INVALID_TIMESTAMP),
    )


def event_errors(source: Column, service: Column, message: Column, timestamp: Column) -> Column:
    """All violations of a normalized event, in a fixed order."""
    return _findings(
        ("source", ~source_valid(source), S.UNKNOWN_SOURCE),
        ("service", _blank(service), S.MISSING_SERVICE),
        ("message", _blank(message), S.MISSING_MESSAGE),
        ("timestamp", _no_time(timestamp), S.INVALID_TIMESTAMP),
    )


def error_text(errors: Column) -> Column:
    """Findings as one line; '' for a valid row."""
    parts = F.transform(errors, lambda e: F.concat(e.field, F.lit(": "), e.error))
    return F.when(has_errors(errors), F.concat(
        F.lit(S.VALIDATION_FAILED + ": "), F.array_join(parts, "; ")
    )).otherwise("")


def has_error(errors: Column, error: str) -> Column:
    """Does the row carry this error, whatever the field?"""
    return F.exists(errors, lambda e: e.error == error)


def has_errors(errors: Column) -> Column:
    return F.size(errors) > 0
