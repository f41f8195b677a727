"""String helpers with the Unicode white-space rules the log formats use."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"\p{IsWhite_Space}+"


def strip(text: Column) -> Column:
    """Drop white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def words(text: Column) -> Column:
    """White-space separated tokens; empty array for blank text."""
    bare = strip(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, SPACE_RUN)
    )


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chomp(line: Column) -> Column:
    """Drop every trailing carriage return and newline."""
    return F.rtrim(line, F.lit("\r\n"))


def or_empty(text: Column) -> Column:
    """Absent strings are '' everywhere, never null."""
    return F.coalesce(text, F.lit(""))


def text_map(pairs: Column) -> Column:
    """A map as one line of text, ordered by key; for reports and comparisons."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e.key, F.lit("="), e.value)
        ),
        ";",
    )
