"""Severity scale: words, names and ordered comparison."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.schemas import ERROR_LEVEL, LEVEL_WORDS, SEVERITIES


def parse_severity(word: Column) -> Column:
    """Level word (already lower case) to the ordered severity; unknown words give 0."""
    level = F.lit(0)
    for name, accepted in LEVEL_WORDS.items():
        level = F.when(word.isin(*accepted), F.lit(SEVERITIES.index(name))).otherwise(level)
    return level.cast("int")


def severity_name(severity: Column) -> Column:
    names = F.array(*[F.lit(name) for name in SEVERITIES])
    known = severity.between(0, len(SEVERITIES) - 1)
    return F.when(known, F.get(names, severity)).otherwise(F.lit(SEVERITIES[0]))


def at_least(severity: Column, minimum) -> Column:
    return severity >= minimum


def is_error_level(severity: Column) -> Column:
    """Only these rows take part in error correlation."""
    return at_least(severity, F.lit(ERROR_LEVEL))
