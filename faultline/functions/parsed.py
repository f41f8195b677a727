"""Parts every parser shares."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import or_empty
from faultline.schemas import PARSED


def fallback_service(stream_id: Column) -> Column:
    """Service of a payload that names none."""
    return F.coalesce(F.nullif(or_empty(stream_id), F.lit("")), F.lit("app"))


def parse_failure(error: Column) -> Column:
    """The ``PARSED`` struct of a payload that could not be read."""
    return F.struct(
        F.lit(0).alias("severity"),
        F.lit(None).alias("timestamp"),
        F.lit("").alias("service"),
        F.lit("").alias("host"),
        F.lit("").alias("message"),
        F.array().alias("stack_frames"),
        F.lit(None).alias("fields"),
        error.alias("error"),
    ).cast(PARSED)
