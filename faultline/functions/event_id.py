"""Event identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import or_empty


def event_id(stream_id: Column, seq_no: Column) -> Column:
    """``<stream>-<seq>``; a row without stream gets the ``evt`` prefix."""
    prefix = F.when(or_empty(stream_id) == "", F.lit("evt")).otherwise(stream_id)
    return F.concat_ws("-", prefix, seq_no.cast("string"))
