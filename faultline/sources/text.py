"""Log files as line rows or as whole texts, in batch and as streams."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.slices import SLICE

# Lines end at a newline only; a lone carriage return stays in the line.
LINE_END = "\n"


def _received(received_at: Column | None) -> Column:
    return F.current_timestamp() if received_at is None else received_at


def read_lines(
    spark: SparkSession, path, source: str, received_at: Column | None = None
) -> DataFrame:
    """Files as line rows; one file is one stream.

    A file is read in splits of bounded size, in parallel. ``line_no`` only orders the lines
    inside a split, the split start orders the splits.
    """
    return (
        spark.read.option("lineSep", LINE_END)
        .text(path)
        .select(
            F.lit(source).alias("source"),
            F.col("_metadata.file_path").alias("stream_id"),
            F.col("_metadata.file_block_start").alias(SLICE),
            F.monotonically_increasing_id().alias("line_no"),
            F.col("value").alias("line"),
            _received(received_at).alias("received_at"),
        )
    )


def stream_files(
    spark: SparkSession,
    path: str,
    source: str,
    received_at: Column | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream with one whole text per file, for ``frame_text``.

    Meant for the many small files a log shipper drops; large files go through ``read_lines``.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path, wholetext=True).select(
        F.lit(source).alias("source"),
        F.col("_metadata.file_path").alias("stream_id"),
        F.col("value").alias("text"),
        _received(received_at).alias("received_at"),
    )
